"""HTTP freshness hints: directives, validators, a compact token, and their expiry algebra. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hosts import let

DAY, HOUR, WEEK = 86_400, 3_600, 604_800


def parse_directives(cc: Column) -> Column:
    """Fold Cache-Control left to right: s-maxage overwrites, max-age only fills, what cannot be read is passed over."""
    item = F.transform(F.split(F.lower(F.coalesce(cc, F.lit(""))), ","), lambda x: F.trim(x))
    start = F.struct(
        F.lit(None).cast("long").alias("age"), F.lit(None).cast("long").alias("swr"), F.lit(False).alias("immutable"),
        F.lit(False).alias("no_store"), F.lit(False).alias("private"),
    )

    def step(acc, x):
        n = F.regexp_extract(x, "=\\s*\"?([0-9]{1,15})\"?$", 1).try_cast("long")
        name = F.trim(F.split_part(x, F.lit("="), F.lit(1)))
        return F.struct(
            F.when((name == "s-maxage") & n.isNotNull(), n).when((name == "max-age") & acc["age"].isNull(), n).otherwise(acc["age"]).alias("age"),
            F.when((name == "stale-while-revalidate") & n.isNotNull(), n).otherwise(acc["swr"]).alias("swr"),
            (acc["immutable"] | (x == "immutable")).alias("immutable"), (acc["no_store"] | (x == "no-store")).alias("no_store"),
            (acc["private"] | (x == "private")).alias("private"),
        )

    return F.aggregate(item, start, step)


def expires_at(now: int, max_age: Column, age: Column) -> Column:
    return F.lit(now) + F.greatest(F.lit(0), max_age - F.coalesce(age, F.lit(0)))


def from_headers(headers: Column, now: int) -> Column:
    """Hints of a response's lower-case header map, or null if it has none. An empty etag still hides last-modified."""
    def made(d: Column) -> Column:
        etag = F.trim(headers["etag"])
        modified = F.when(headers["etag"].isNull(), headers["last-modified"])
        out = F.struct(
            F.when(d["age"].isNotNull(), expires_at(now, d["age"], headers["age"].try_cast("long"))).alias("expires_at"), d["swr"].alias("stale_while_revalidate"),
            d["immutable"].alias("immutable"), F.nullif(etag, F.lit("")).alias("etag"), modified.alias("last_modified"), d["no_store"].alias("no_store"), d["private"].alias("private"),
        )
        known = d["age"].isNotNull() | d["swr"].isNotNull() | d["immutable"] | d["no_store"] | d["private"] | (F.coalesce(etag, F.lit("")) != "") | modified.isNotNull()
        return F.when(known, out)

    return let(parse_directives(headers["cache-control"]), made)


def conditional(hints: Column) -> Column:
    """The revalidation header: if-none-match, else if-modified-since."""
    return F.when(hints["etag"].isNotNull(), F.struct(F.lit("if-none-match").alias("name"), hints["etag"].alias("value"))).when(
        hints["last_modified"].isNotNull(), F.struct(F.lit("if-modified-since").alias("name"), hints["last_modified"].alias("value"))
    )


def is_fresh(expiry: Column, now: int) -> Column:
    return F.coalesce(F.lit(now) < expiry, F.lit(False))


def cacheable_until(expiry: Column, now: int) -> Column:
    """An hour by default, a week at most."""
    return F.least(F.coalesce(expiry, F.lit(now + HOUR)), F.lit(now + WEEK))


def retry_after(header: Column) -> Column:
    return F.coalesce(F.when(F.trim(header).rlike("^[0-9]{1,15}$"), F.trim(header).cast("long")), F.lit(60))


def _field(text: Column) -> Column:
    """One length byte (at most 255) and the text's bytes, as hex."""
    raw = F.substring(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), 1, 510)
    return F.concat(F.lpad(F.hex((F.length(raw) / 2).cast("int")), 2, "0"), raw)


def encode(hints: Column, default_ttl: int, now: int) -> Column:
    """The token hex_epoch:base64url(blob); empty for what must not be stored."""
    return let(hints, lambda h: _encode(h, default_ttl, now))


def _encode(hints: Column, default_ttl: int, now: int) -> Column:
    validator = hints["etag"].isNotNull() | hints["last_modified"].isNotNull()
    epoch = F.coalesce(hints["expires_at"], F.when(validator, F.lit(1)).otherwise(F.lit(now + default_ttl)))
    swr = F.when(hints["stale_while_revalidate"].isNotNull(), F.concat(F.lit("04"), F.lpad(F.hex(hints["stale_while_revalidate"]), 8, "0"))).otherwise(F.lit("00"))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit("01")).otherwise(F.lit("00"))
    blob = F.concat(swr, flag(hints["immutable"]), _field(hints["etag"]), _field(hints["last_modified"]), flag(hints["no_store"]), flag(hints["private"]))
    cut = F.regexp_replace(blob, "0+$", "")
    even = F.when(F.length(cut) % 2 == 1, F.concat(cut, F.lit("0"))).otherwise(cut)
    kept = F.when(F.length(even) == 0, F.lit("00")).otherwise(even)
    body = F.regexp_replace(F.translate(F.base64(F.unhex(kept)), "+/\r\n", "-_"), "=+$", "")
    refused = F.coalesce(hints["no_store"], F.lit(False)) | F.coalesce(hints["private"], F.lit(False))
    return F.when(refused, F.lit("")).otherwise(F.concat(F.lower(F.hex(epoch)), F.lit(":"), body))


def decode(token: Column) -> Column:
    """Hints of a token, or null if it has no blob or bad shape. Fields cut off at the end take their defaults."""
    return let(token, _decode)


def _decode(token: Column) -> Column:
    ok = token.rlike("^[0-9a-f]{1,15}:[A-Za-z0-9_-]+$")
    blob = F.translate(F.split_part(token, F.lit(":"), F.lit(2)), "-_", "+/")
    pad = F.concat(blob, F.repeat(F.lit("="), F.pmod(-F.length(blob), F.lit(4)).cast("int")))
    raw = F.hex(F.try_to_binary(pad, F.lit("base64")))
    at = lambda h, p, n: F.conv(F.nullif(F.substring(h, p, n), F.lit("")), 16, 10).try_cast("long")

    def body(h):
        a = F.when(at(h, F.lit(1), F.lit(2)) == 4, 11).otherwise(3)

        def etag(p):
            n = F.coalesce(at(h, p + 2, F.lit(2)), F.lit(0)).cast("int")
            m_at = p + 4 + 2 * n
            m = F.coalesce(at(h, m_at, F.lit(2)), F.lit(0)).cast("int")
            text = lambda q, k: F.nullif(F.decode(F.unhex(F.substring(h, q, 2 * k)), "UTF-8"), F.lit(""))
            tail = m_at + 2 + 2 * m
            epoch = F.conv(F.split_part(token, F.lit(":"), F.lit(1)), 16, 10).cast("long")
            return F.struct(
                F.when(epoch > 0, epoch).alias("expires_at"), F.when(at(h, F.lit(1), F.lit(2)) == 4, at(h, F.lit(3), F.lit(8))).alias("stale_while_revalidate"),
                (F.coalesce(at(h, p, F.lit(2)), F.lit(0)) == 1).alias("immutable"), text(p + 4, n).alias("etag"), text(m_at + 2, m).alias("last_modified"),
                (F.coalesce(at(h, tail, F.lit(2)), F.when(epoch == 0, 1).otherwise(0)) == 1).alias("no_store"), (F.coalesce(at(h, tail + 2, F.lit(2)), F.lit(0)) == 1).alias("private"),
            )

        return F.transform(F.array(a), etag)[0]

    return F.when(ok, let(raw, lambda h: F.when(F.length(h) > 0, body(h))))


def content_hash(h: Column) -> Column:
    """The strongest content hash of a header map and what it is."""
    pick = lambda v, name: F.when(v.isNotNull() & (v != ""), F.struct(v.alias("value"), F.lit(name).alias("label")))
    strong = F.when(~h["etag"].startswith("W/"), F.regexp_replace(h["etag"], "^\"|\"$", ""))
    goog = lambda k: F.nullif(F.regexp_extract(h["x-goog-hash"], f"(?:^|,)\\s*{k}=([^,]*)", 1), F.lit(""))
    return F.coalesce(
        pick(h["x-amz-checksum-sha256"], "sha256"), pick(h["content-md5"], "md5"), pick(strong, "etag"), pick(goog("md5"), "md5"), pick(goog("crc32c"), "crc32c")
    )
