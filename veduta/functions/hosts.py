"""Hosts and addresses of URLs, guards against inside addresses, connect strings: Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers to a refused URL.
FILE_REFUSED = "file:// URLs are not permitted"
PRIVATE_REFUSED = "localhost and private-network URLs are not permitted"
RELATIVE_REFUSED = "bare relative paths are not permitted; use an absolute path or a file:// URL"
SCHEME_REFUSED = "url must be an http:// or https:// URL"
#: IPv4 blocks that must not be reached (first address, prefix length).
UNSAFE_V4 = [
    ("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("0.0.0.0", 32), ("224.0.0.0", 4),
    ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("100.64.0.0", 10), ("192.0.0.0", 16), ("198.18.0.0", 15), ("240.0.0.0", 4),
]
PRIVATE_V4 = UNSAFE_V4[:4]
#: How many characters of a secret are shown, from which length on.
SHOWN = [(12, 4), (6, 2)]


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def authority(u: Column) -> Column:
    """What stands between ``://`` and the path, without user information."""
    rest = F.substring(u, F.instr(u, "://") + 3, F.length(u))
    return F.element_at(F.split(F.regexp_extract(rest, r"^([^/?#]*)", 1), "@"), -1)


def host(u: Column) -> Column:
    """The host in lower case, an IPv6 address in its brackets; empty if there is none, null without ``://``."""
    found = let(authority(u), lambda a: F.when(F.startswith(a, F.lit("[")), F.regexp_extract(a, r"^(\[[^\]]*\])", 1)).otherwise(F.split_part(a, F.lit(":"), F.lit(1))))
    return F.when(F.instr(u, "://") > 0, F.lower(found))


def ipv4(h: Column) -> Column:
    """The number of an IPv4 host, or null: up to four parts in decimal, octal (leading 0) or hex (0x), the last one filling the rest."""
    number = lambda p: F.when(p.rlike("^0[xX][0-9a-fA-F]{0,8}$"), F.coalesce(F.conv(F.nullif(F.substring(p, 3, 8), F.lit("")), 16, 10), F.lit("0"))).when(
        p.rlike("^0[0-7]{1,11}$"), F.conv(p, 8, 10)
    ).when(p.rlike("^(0|[1-9][0-9]{0,9})$"), p)
    parts = F.transform(F.split(F.regexp_replace(h, r"\.$", ""), r"\."), lambda p: number(p).cast("long"))

    def value(x):
        n = F.size(x)
        last = F.element_at(x, -1)
        head = F.slice(x, 1, F.greatest(n - 1, F.lit(0)))
        high = F.aggregate(head, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
        room = F.element_at(F.array(*[F.lit(256 ** (4 - k)) for k in range(4)]), F.least(n, F.lit(4)))
        ok = (n <= 4) & F.forall(x, lambda p: p.isNotNull()) & F.forall(head, lambda p: p <= 255) & (last < room)
        return F.when(ok, high * room + last)

    return let(parts, value)


def _number(address: str) -> int:
    out = 0
    for part in address.split("."):
        out = out * 256 + int(part)
    return out


def within(number: Column, blocks: list[tuple[str, int]]) -> Column:
    """Whether an IPv4 number lies in one of the blocks; false for null."""
    arms = [number.between(_number(a), _number(a) + 2 ** (32 - bits) - 1) for a, bits in blocks]
    out = arms[0]
    for arm in arms[1:]:
        out = out | arm
    return F.coalesce(out, F.lit(False))


def private(h: Column) -> Column:
    """Loopback and private networks only; link-local and IPv6 unique-local hosts pass."""
    return F.coalesce(h.isin("localhost", "::1", "[::1]") | within(ipv4(h), PRIVATE_V4), F.lit(False))


def guard(u: Column, allow_local: Column) -> Column:
    """A requested URL as (url, error): one of them is null. Absolute paths become file URLs where local files are allowed."""
    remote, file = F.instr(u, "://") > 0, F.startswith(u, F.lit("file://"))
    error = (
        F.when(allow_local, F.when(~remote & ~F.startswith(u, F.lit("/")), F.lit(RELATIVE_REFUSED)))
        .when(~remote, F.lit(SCHEME_REFUSED))
        .when(file, F.lit(FILE_REFUSED))
        .when(private(host(u)), F.lit(PRIVATE_REFUSED))
    )
    return F.struct(F.when(error.isNull(), F.when(remote, u).otherwise(F.concat(F.lit("file://"), u))).alias("url"), error.alias("error"))


def safe(u: Column, most: int = 2048) -> Column:
    """The stricter check: length in bytes, http or https, a dotted name or an address that is not inside, reserved or for documentation."""
    h = host(u)

    def judge(x):
        inner = F.regexp_replace(x, r"^\[|\]$", "")
        first = F.coalesce(F.conv(F.nullif(F.split_part(inner, F.lit(":"), F.lit(1)), F.lit("")), 16, 10).cast("long"), F.lit(0))
        inside6 = inner.rlike("^[0:]+$") | inner.rlike("^[0:]*:0*1$") | first.between(0xFF00, 0xFFFF) | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF)
        return (
            F.when(x == "", F.lit(False))
            .when(F.startswith(x, F.lit("[")), inner.contains(":") & ~inside6)
            .when(ipv4(x).isNotNull(), ~within(ipv4(x), UNSAFE_V4))
            .otherwise((x != "localhost") & x.contains("."))
        )

    return F.coalesce((F.octet_length(u) <= most) & F.lower(u).rlike("^https?://") & let(h, judge), F.lit(False))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address as it stands, even if empty; the peer without the header."""
    return F.coalesce(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), peer)


def wants_ndjson(accept: Column) -> Column:
    kind = lambda part: F.lower(F.trim(F.split_part(part, F.lit(";"), F.lit(1))))
    return F.coalesce(F.exists(F.split(accept, ","), lambda p: kind(p).isin("application/x-ndjson", "application/ndjson")), F.lit(False))


def masked(x: Column) -> Column:
    """Stars for a secret: three for an empty one; under 6 characters all, under 12 all but two, else all but four."""
    n = F.length(x)
    shown = F.lit(0)
    for least, k in reversed(SHOWN):
        shown = F.when(n >= least, k).otherwise(shown)
    return F.when(n == 0, F.lit("***")).otherwise(F.concat(F.left(x, shown), F.repeat(F.lit("*"), n - shown)))


def is_token(x: Column, prefix: str) -> Column:
    """Whether a value looks like an access token: the issuer's prefix, a letter for its kind, and what follows."""
    return x.rlike(f"^{prefix}_[a-z]_")


def masked_connect(value: Column, prefix: str) -> Column:
    """A connect string for display: the URL stays, values and bare secrets are masked, tokens keep their prefix."""
    head = len(prefix) + 3
    token = lambda s: F.concat(F.left(s, F.lit(head)), masked(F.substring(s, head + 1, 1 << 20)))
    pair = lambda s: F.concat(F.split_part(s, F.lit("="), F.lit(1)), F.lit("="), masked(F.substring(s, F.instr(s, "=") + 1, F.length(s))))
    bare = lambda s: F.when(is_token(s, prefix), token(s)).otherwise(masked(s))
    each = lambda s, i: F.when(i == 0, s).when(F.instr(s, "=") > 0, pair(s)).otherwise(bare(s))
    parts = F.split(value, ",")
    return F.when((F.size(parts) == 1) & (F.instr(value, "://") == 0), bare(value)).otherwise(F.array_join(F.transform(parts, each), ","))


def connect_target(value: Column, prefix: str, handshake: str) -> Column:
    """A connect string as (url, headers): ``url,name=value,token,...``. A bare token has no URL; another bare value is nothing at all.

    Tokens become a bearer header, other bare parts and a URL's fragment the ``handshake`` header; of equal names the last counts.
    """
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    bearer = lambda s: entry(F.lit("Authorization"), F.concat(F.lit("Bearer "), s))
    comma = F.instr(value, ",")
    first = F.when(comma > 0, F.left(value, comma - 1)).otherwise(value)
    rest = F.when(comma > 0, F.substring(value, comma + 1, F.length(value))).otherwise(F.lit(""))
    mark = F.instr(first, "#")
    fragment = F.when(mark > 0, F.trim(F.substring(first, mark + 1, F.length(first)))).otherwise(F.lit(""))
    base = F.trim(F.when(mark > 0, F.left(first, mark - 1)).otherwise(first))
    segments = F.filter(F.transform(F.split(rest, ","), lambda s: F.trim(s)), lambda s: s != "")
    named = F.transform(
        segments,
        lambda s: F.when(F.instr(s, "=") > 0, entry(F.trim(F.split_part(s, F.lit("="), F.lit(1))), F.trim(F.substring(s, F.instr(s, "=") + 1, F.length(s)))))
        .when(is_token(s, prefix), bearer(s))
        .otherwise(entry(F.lit(handshake), s)),
    )
    old = F.filter(F.array(entry(F.lit(handshake), fragment)), lambda e: e["v"] != "")
    entries = F.when(F.instr(value, "://") > 0, F.concat(old, named)).when(is_token(value, prefix), F.array(bearer(value)))
    none = F.create_map().cast("map<string,string>")
    headers = F.aggregate(entries, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    url = F.when(F.instr(value, "://") > 0, F.nullif(F.regexp_replace(base, "/+$", ""), F.lit("")))
    return F.struct(url.alias("url"), F.coalesce(headers, none).alias("headers"))


def flat_headers(names: Column, values: Column) -> Column:
    """A header map with lower-case names; of equal names the last one's value counts."""
    none = F.create_map().cast("map<string,string>")
    pairs = F.arrays_zip(F.transform(names, F.lower).alias("k"), values.alias("v"))
    return F.aggregate(pairs, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def query_value(u: Column, name: str) -> Column:
    """The decoded value of a query parameter, or null; "+" and %XX are decoded, what cannot be decoded is null."""
    raw = F.nullif(F.regexp_extract(F.split_part(u, F.lit("#"), F.lit(1)), rf"[?&]{name}=([^&]*)", 1), F.lit(""))
    return F.try_url_decode(raw)
