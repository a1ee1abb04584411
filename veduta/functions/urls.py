"""URL and string scalars as expression texts over a column name or expression ``u``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import to
from .hosts import let
from .tables import KINDS, SHORTCUTS, alias_rows


def scheme(u: str) -> str:
    return f"CASE WHEN instr({u}, '://') > 0 THEN lower(split_part({u}, '://', 1)) END"


def _rest(u: str) -> str:
    return f"substring({u}, instr({u}, '://') + 3)"


def _bare(u: str) -> str:
    return f"split_part(split_part({_rest(u)}, '#', 1), '?', 1)"


def canonical(u: str) -> str:
    """Lower scheme and host, no fragment, no query; the path keeps its case. Other schemes stay; no scheme is null."""
    host = f"split_part({_bare(u)}, '/', 1)"
    return (
        f"CASE WHEN instr({u}, '://') = 0 THEN NULL WHEN NOT REGEX(lower({u}), '^https?://') THEN {u} "
        f"ELSE concat(lower(split_part({u}, '://', 1)), '://', lower({host}), substring({_bare(u)}, length({host}) + 1)) END"
    )


def origin(u: str) -> str:
    """scheme://host[:port]; a URL without a path is its own origin."""
    return f"CASE WHEN REGEX({u}, '^[^/]*://[^/]*/') THEN regexp_extract({u}, '^([^/]*://[^/]*)/', 1) ELSE {u} END"


def extension(u: str) -> str:
    """Text after the last dot of the last path segment, lower-cased; null without a dot. A bare host gives its last label."""
    seg = f"regexp_extract(split_part(split_part({u}, '?', 1), '#', 1), '([^/]*)$', 1)"
    return f"CASE WHEN instr({seg}, '.') > 0 THEN lower(regexp_extract({seg}, '[.]([^.]*)$', 1)) END"


def alias(e: str) -> str:
    """The canonical spelling of an extension."""
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in alias_rows())
    return f"CASE {e} {arms} ELSE {e} END"


def host(u: str) -> str:
    return f"lower(split_part(split_part(split_part({_bare(u)}, '/', 1), '@', 1), ':', 1))"


def private_host(h: str) -> str:
    """Loopback and RFC 1918 hosts only; link-local and IPv6 unique-local addresses pass."""
    return (
        f"({h} IN ('localhost', '::1', '[::1]') OR REGEX({h}, '^(127|10)[.][0-9]+[.][0-9]+[.][0-9]+$') OR REGEX({h}, '^192[.]168[.][0-9]+[.][0-9]+$') "
        f"OR REGEX({h}, '^172[.](1[6-9]|2[0-9]|3[01])[.][0-9]+[.][0-9]+$'))"
    )


def promoted(u: str) -> str:
    """A bare absolute path as a file URL."""
    return f"CASE WHEN {u} LIKE '/%' THEN concat('file://', {u}) ELSE {u} END"


def host_allowed(h: str, allowed: list[str]) -> str:
    """Whether a host is named, or below a ``*.suffix``; an empty list allows all."""
    if not allowed:
        return "TRUE"
    arms = [f"{h} LIKE '%{a[1:]}' AND length({h}) > {len(a) - 1}" if a.startswith("*.") else f"{h} = '{a}'" for a in allowed]
    return "(" + " OR ".join(f"({a})" for a in arms) + ")"


def query_value(u: str, key: str) -> str:
    return f"nullif(regexp_extract({u}, '[?&]{key}=([^&#]*)', 1), '')"


def mem_size(x: str) -> str:
    """Bytes of '2gb', '100mb', '64kb', or a plain entry count of 10 to 100,000,000; null if out of bounds or unreadable."""
    low = f"lower(trim({x}))"
    num = f"try_cast(trim(substring({low}, 1, greatest(length({low}) - 2, 0))) AS DOUBLE)"
    unit = f"right({low}, 2)"
    arm = lambda u, f, most: f"WHEN {unit} = '{u}' THEN CASE WHEN {num} > 0 AND {num} <= {most} THEN cast(floor({num} * {f}) AS BIGINT) END"
    return (
        f"CASE {arm('gb', 1073741824, 1024)} {arm('mb', 1048576, 1048576)} {arm('kb', 1024, 9007199254740991)} "
        f"WHEN REGEX({low}, '^[0-9]{{1,18}}$') THEN CASE WHEN cast({low} AS BIGINT) BETWEEN 10 AND 100000000 THEN cast({low} AS BIGINT) END END"
    )


def cache_key(account: str, url: str, version: str = "v5") -> str:
    """account/ and the unpadded base64url SHA-256 of version:account:url."""
    digest = f"B64(SHA256(concat('{version}:', {account}, ':', {url})))"
    return f"concat({account}, '/', regexp_replace(translate({digest}, '+/', '-_'), '=+$', ''))"


def col(text: str) -> Column:
    """An expression text as a Spark column."""
    return F.expr(to("spark", text))


def dsn(d: Column) -> list[Column]:
    """Scheme, rest, size after "#" (file caches) and error of a cache's address."""
    scheme = F.split_part(d, F.lit(":"), F.lit(1))
    rest = F.when(F.instr(d, ":") > 0, F.substring(d, F.instr(d, ":") + 1, F.length(d))).otherwise(F.lit(""))
    file = scheme == "sqlite"
    path = F.when(file, F.split_part(rest, F.lit("#"), F.lit(1))).otherwise(rest)
    size = F.when(file & (F.instr(rest, "#") > 0), F.substring(rest, F.instr(rest, "#") + 1, F.length(rest)))
    error = (
        F.when((scheme == "none") & (rest != ""), F.lit("none: takes no parameters - use just 'none:' to disable caching"))
        .when(file & (path == ""), F.lit("sqlite: requires a file path"))
        .when(~scheme.isin("mem", "sqlite", "cloud", "none"), F.concat(F.lit("unknown cache scheme '"), scheme, F.lit("' - supported: mem:, sqlite:, cloud:, none:")))
    )
    return [scheme, path, size, error]


def mem_size_answer(text: Column) -> list[Column]:
    """Size, its unit (bytes or entries) and error of a size like 2gb, 100mb, 64kb or a count of entries; all null for an empty one."""
    spec = F.trim(text)
    low = F.lower(spec)
    unit = F.right(low, F.lit(2))
    known = unit.isin("gb", "mb", "kb")
    n = F.when(known, F.trim(F.left(low, F.length(low) - 2)).try_cast("double"))
    factor = F.when(unit == "gb", float(1 << 30)).when(unit == "mb", float(1 << 20)).otherwise(1024.0)
    most = F.when(unit == "gb", 1024.0).when(unit == "mb", float(1 << 20))
    shown = lambda x: F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    count = F.when(~known & spec.rlike("^[0-9]{1,18}$"), spec.cast("long"))
    limit = F.when(unit == "gb", F.lit("1024")).otherwise(F.lit("1,048,576"))
    error = (
        F.when(spec == "", F.lit(None).cast("string"))
        .when(known & n.isNull(), F.concat(F.lit("invalid size spec: '"), spec, F.lit("' - expected a number before '"), unit, F.lit("'")))
        .when((unit == "kb") & (n <= 0), F.concat(F.lit("KB size must be positive, got "), shown(n)))
        .when(known & ((n <= 0) | (n > most)), F.concat(F.upper(unit), F.lit(" size must be between 0 and "), limit, F.lit(", got "), shown(n)))
        .when(~known & count.isNull(), F.concat(F.lit("invalid size spec: '"), spec, F.lit("' - expected a number, or number+unit (mb/gb/kb)")))
        .when(count < 10, F.concat(F.lit("entry count must be at least 10, got "), count.cast("string")))
        .when(count > 100_000_000, F.concat(F.lit("entry count must be at most 100,000,000, got "), count.cast("string")))
    )
    good = error.isNull() & (spec != "")
    size = F.when(good, F.when(known, F.floor(n * factor)).otherwise(count))
    return [size, F.when(good, F.when(known, F.lit("bytes")).otherwise(F.lit("entries"))), error]


def etag_codec(etag: Column, modified: Column) -> list[Column]:
    """The older freshness token, E or M and the value, and the request header made of it again."""
    token = F.coalesce(F.concat(F.lit("E"), etag), F.concat(F.lit("M"), modified))

    def header(t):
        name = F.when(F.startswith(t, F.lit("E")), F.lit("if-none-match")).when(F.startswith(t, F.lit("M")), F.lit("if-modified-since"))
        return F.struct(t.alias("t"), name.alias("n"), F.when(name.isNotNull(), F.substring(t, 2, 1 << 20)).alias("v"))

    x = let(token, header)
    return [x["t"], x["n"], x["v"]]


def http_answer(code: Column) -> list[Column]:
    """Status, message and whether the URL is remembered as failed, for an upstream status."""
    failed = (
        F.when(code.isin(401, 403), F.lit("permission denied"))
        .when(code == 404, F.lit("source not found"))
        .when(code == 410, F.lit("source gone"))
        .when((code >= 500) & (code != 503), F.concat(F.lit("server error (HTTP "), code.cast("string"), F.lit(")")))
        .when(~code.between(200, 299) & ~code.isin(304, 429, 503), F.concat(F.lit("unexpected HTTP status "), code.cast("string")))
    )
    status = F.when(code == 304, F.lit("fresh")).when(code.isin(429, 503), F.lit("overloaded")).when(failed.isNotNull(), F.lit("failed")).otherwise(F.lit("processing"))
    return [status, failed, failed.isNotNull()]


def log_answer(code: Column, status: Column) -> list[Column]:
    """The logged code of a result (the upstream's if known), and the state of work that a remote result stands for."""
    own = F.when(status == "success", 200).when(status == "failed", 500).when(status == "overloaded", 503).when(status == "intermediate", 102).otherwise(422)
    state = F.when(status == "success", F.lit("complete")).when(status.isin("failed", "batch_limit"), F.lit("failed")).otherwise(status)
    return [F.coalesce(code, own), state]


def shortcut_order(kind: Column, ext: Column) -> Column:
    """The cheap ways that are tried for a file, in order."""
    tries = [F.when((kind == k) & ext.isin(*names.split()), F.lit(name)) for name, k, names in SHORTCUTS]
    return F.array_join(F.array(*tries), ",")


def placeholder(path: Column) -> list[Column]:
    """Status and icon of a placeholder request: the .jpeg ending is asked for, unheard kinds are unknown."""
    name = F.regexp_extract(path, r"^(.*)\.jpeg$", 1)
    known = [*KINDS, "binary", "unknown", "failed"]
    found = F.endswith(path, F.lit(".jpeg"))
    return [F.when(found, 200).otherwise(404), F.when(found, F.when(name.isin(*known), name).otherwise(F.lit("unknown")))]


def abbreviated(thumbnail: Column) -> Column:
    """A base64 thumbnail as it is shown: over 200 characters only its length."""
    n = F.length(thumbnail)
    return F.when(n > 200, F.concat(F.lit("<base64 jpeg data: "), n.cast("string"), F.lit(" bytes>"))).otherwise(thumbnail)


def min_expiry(expiry: Column, now: Column, floor: Column) -> Column:
    """An expiry that is at least ``floor`` seconds from now."""
    return F.greatest(F.coalesce(expiry, now + floor), now + floor)


def rotation(a: Column, c: Column, hint: Column) -> Column:
    """Degrees from a display matrix's first and fourth entry, rounded to quarter turns; the container's hint where the matrix says none."""
    quarter = F.floor(F.degrees(F.atan2(-c.cast("double"), a.cast("double"))) / 90 + 0.5).cast("int")
    turned = F.pmod(F.coalesce(quarter, F.lit(0)) * 90, F.lit(360))
    return F.when(turned != 0, turned).otherwise(F.pmod(F.coalesce(hint, F.lit(0)), F.lit(360)))


def wave(u: Column) -> Column:
    """How far between the two edge colours a place along a page edge lies: straight lines through seven even knots."""
    knots = [0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 0.75]
    x = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * (len(knots) - 1)
    at = F.least(F.floor(x), F.lit(len(knots) - 2)).cast("int")
    y = F.array(*[F.lit(k) for k in knots])
    return F.element_at(y, at + 1) + (F.element_at(y, at + 2) - F.element_at(y, at + 1)) * (x - at)


def fit(w: Column, h: Column, tw: int = 250, th: int = 200, least: float = 0.6, budget: float = 0.1) -> list[Column]:
    """Size after resizing, and the crop's place and size, of an image put on a ``tw`` by ``th`` canvas; in 32-bit floats.

    It is fitted inside. Ratios of 1 to 1.5 fill the canvas, wider and taller ones grow by the budget; what would be thinner than ``least`` of the canvas is
    grown to that and cropped, from the middle across, from a quarter down.
    """
    f = lambda x: (F.lit(x) if isinstance(x, int | float) else x).cast("float")
    over = lambda a, b: (f(a) / f(b)).cast("float")
    near = lambda x: F.floor(x.cast("float").cast("double") + 0.5).cast("int")
    one = F.lit(1)
    min_w, min_h = round(tw * least), round(th * least)
    inside, filling = F.least(over(tw, w), over(th, h)), F.greatest(over(tw, w), over(th, h))
    fit_w, fit_h = (F.greatest(one, F.least(F.lit(t), near(f(x) * inside))) for x, t in ((w, tw), (h, th)))
    ratio = over(w, h)
    most = (inside / F.lit(1 - budget).cast("float")).cast("float")
    scale = F.when(ratio.between(F.lit(1.0).cast("float"), F.lit(1.5).cast("float")), filling).otherwise(F.least(filling, most))
    wide, tall = fit_h < min_h, fit_w < min_w
    rw = F.when(wide, F.greatest(F.lit(tw), near(f(w) * over(min_h, h)))).when(tall, F.lit(min_w)).otherwise(F.greatest(one, near(f(w) * scale)))
    rh = F.when(wide, F.lit(min_h)).when(tall, F.greatest(F.lit(th), near(f(h) * over(min_w, w)))).otherwise(F.greatest(one, near(f(h) * scale)))
    cw, ch = F.least(rw, F.lit(tw)), F.least(rh, F.lit(th))
    return [rw, rh, F.floor((rw - cw) / 2), F.floor((rh - ch) * 0.25), cw, ch]
