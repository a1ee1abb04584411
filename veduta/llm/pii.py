"""Format-preserving Feistel pseudonyms for personal numbers, addresses and dates, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Key of the permutation. Production sets its own; equal keys give equal pseudonyms everywhere.
KEY = "veduta-pii-key"
ROUNDS = 8
#: IBAN lengths by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Codes of their country's length, so that what follows stays outside; of other countries, as many groups as follow."""
    def code(n, names):
        groups, rest = divmod(n - 4, 4)
        return f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")

    known = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    codes = "|".join(code(n, names) for n, names in IBAN_LENGTHS.items())
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{codes}|{other})(?![A-Za-z0-9])"


#: Calling codes of one and of two digits; all others have three.
ONE_DIGIT_CODES = "1 7"
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
_MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: What counts as a personal value. Each alternative is one kind, tried in this order.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": _iban_pattern(),
    "date": (
        r"(?<![0-9.])(?:19|20)[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9])"
        r"|(?<![0-9./-])[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2}(?![0-9])"
        rf"|(?<![0-9.])[0-9]{{1,2}} (?:{_MONTH}) (?:19|20)[0-9]{{2}}(?![0-9])"
    ),
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (
        r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,5}(?:[ .-]?[0-9]{2,5}){1,4}"
        r"|\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4})(?![0-9A-Za-z])"
    ),
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
KINDS = list(PATTERNS)
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 x 4,297, the two halves of the date permutation.
FIRST_DAY, DAY_HALVES = "1900-01-01", (17, 4297)
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once; an expression named twice would else be evaluated twice."""
    return F.transform(F.array(value), body)[0]


def _prf(key: str, label: str, value: Column, modulus: Column) -> Column:
    """Keyed round value in [0, modulus): 60 bits of SHA-256, far above any modulus used here."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{label}|"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def _feistel(left: Column, right: Column, m_left: Column, m_right: Column, label: str, key: str, tweak: Column, back: bool = False) -> Column:
    """A Feistel network on Z_a x Z_b: a bijection for any round function, halves updated in turn. ``back`` runs it backwards.

    Its state runs through ``aggregate`` over the rounds, so the expression stays one round long.
    """
    move = (lambda x, r, m: F.pmod(x - r, m)) if back else (lambda x, r, m: (x + r) % m)

    def step(acc, i):
        seed = F.concat(i.cast("string"), F.lit("|"), tweak, F.lit("|"))
        even = i % 2 == 0
        r = F.concat(seed, F.when(even, acc["r"]).otherwise(acc["l"]).cast("string"))
        return F.when(even, F.struct(move(acc["l"], _prf(key, label, r, m_left), m_left).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), move(acc["r"], _prf(key, label, r, m_right), m_right).alias("r"))
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, step)


def permute_digits(digits: Column, label: str, key: str = KEY, back: bool = False) -> Column:
    """Keyed permutation of digit strings of one length (1 to 34 digits) onto themselves; length is the tweak."""
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    text = lambda x, k: F.lpad(x.cast("string"), k, "0")

    def body(d):
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        left = F.coalesce(F.substring(d, F.lit(1), u).try_cast("long"), F.lit(0))
        right = F.substring(d, u + 1, n - u).cast("long")
        moved = _feistel(left, right, size(u), size(n - u), label, key, n.cast("string"), back)
        return let(moved, lambda x: F.concat(F.when(u > 0, text(x["l"], u)).otherwise(F.lit("")), text(x["r"], n - u)))

    return let(digits, body)


def _refill(template: Column, digits: Column) -> Column:
    """Put ``digits`` in place of the template's digits, keeping every other character."""
    def body(d):
        return F.aggregate(
            F.split(template, ""),
            F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
            lambda acc, c: F.when(
                c.between("0", "9") & (c != ""), F.struct(F.concat(acc["s"], F.substring(d, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))
            ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        )["s"]

    return let(digits, body)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string, its last digit not doubled."""
    at = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: let(c.try_cast("int"), lambda v: F.when(i % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)),
    )
    return F.aggregate(at, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _card(value: Column, key: str, back: bool) -> Column:
    """Permute all but the last digit, which then moves so that the Luhn sum stays what it was."""
    def body(d):
        moved = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, back)
        return let(moved, lambda m: F.concat(m, ((luhn_sum(d) - luhn_sum(F.concat(m, F.lit("0"))) + 20) % 10).cast("string")))

    return _refill(value, let(F.regexp_replace(value, "[^0-9]", ""), body))


def _ip(value: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("long"))
    left, right = octets[0] * 256 + octets[1], octets[2] * 256 + octets[3]
    moved = _feistel(left, right, F.lit(65536), F.lit(65536), "ip", key, F.lit("v4"), back)
    return let(moved, lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))


def _ssn_parts(value: Column) -> list[Column]:
    return [F.split_part(value, F.lit("-"), F.lit(i)).try_cast("long") for i in (1, 2, 3)]


def _ssn(value: Column, key: str, back: bool) -> Column:
    """Issued numbers onto issued numbers: 898 areas (001 to 899 but for 666), 99 groups, 9,999 serials."""
    area, group, serial = _ssn_parts(value)
    left, right = area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1
    moved = _feistel(left, right, F.lit(898), F.lit(99 * 9999), "ssn", key, F.lit("ssn"), back)

    def text(x):
        digits = lambda n, k: F.lpad(n.cast("string"), k, "0")
        return F.concat_ws(
            "-", digits(x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), 3), digits(F.floor(x["r"] / 9999) + 1, 2), digits(x["r"] % 9999 + 1, 4)
        )

    return let(moved, text)


def _phone(value: Column, key: str, back: bool) -> Column:
    """All digits but those of the country's calling code, or else the first, are permuted."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    one, two = ONE_DIGIT_CODES.split(), TWO_DIGIT_CODES.split()
    size = F.when(F.left(digits, F.lit(1)).isin(one), 1).when(F.left(digits, F.lit(2)).isin(two), 2).otherwise(3)
    kept = F.when(F.startswith(value, F.lit("+")), size).otherwise(1)

    def body(d):
        return let(
            F.struct(d.alias("d"), kept.alias("n")),
            lambda x: F.concat(
                F.left(x["d"], x["n"]), permute_digits(F.substring(x["d"], x["n"] + 1, F.length(x["d"]) - x["n"]), "phone", key, back)
            ),
        )

    return _refill(value, let(digits, body))


#: What each notation of a date is called, and how it is written with "-" for its separator.
_STYLES = {"ymd": "yyyy-MM-dd", "dmy": "dd-MM-yyyy", "mdy": "MM-dd-yyyy", "short_dmy": "d-M-yyyy", "short_mdy": "M-d-yyyy", "named": "d MMM yyyy", "long": "d MMMM yyyy"}


def _date_parts(value: Column) -> Column:
    """The value's separator, notation and day; the day is null if it is none from 1900 to 2099. What can be read both ways is read dd/MM."""
    year_first, named = value.rlike("^[0-9]{4}"), value.contains(" ")
    sep = F.when(named, F.lit("")).when(year_first, F.substring(value, 5, 1)).otherwise(F.regexp_extract(value, "[-/.]", 0))
    v = F.translate(value, "/.", "--")
    short = ~year_first & (F.length(value) < 10)
    parse = lambda style: F.try_to_date(v, _STYLES[style])
    month = F.split_part(value, F.lit(" "), F.lit(2))
    spelled = F.concat_ws(" ", F.split_part(value, F.lit(" "), F.lit(1)), F.left(month, F.lit(3)), F.split_part(value, F.lit(" "), F.lit(3)))
    words = F.try_to_date(spelled, _STYLES["named"])
    dmy, mdy = parse("short_dmy"), parse("short_mdy")
    style = (
        F.when(named, F.when(F.length(month) > 3, F.lit("long")).otherwise(F.lit("named")))
        .when(year_first, F.lit("ymd"))
        .when(dmy.isNotNull(), F.when(short, F.lit("short_dmy")).otherwise(F.lit("dmy")))
        .otherwise(F.when(short, F.lit("short_mdy")).otherwise(F.lit("mdy")))
    )
    day = F.when(named, words).when(year_first, parse("ymd")).otherwise(F.coalesce(dmy, mdy))
    return F.struct(sep.alias("sep"), style.alias("style"), day.alias("day"))


#: Steps of a cycle walk. Four of ten days or fewer lie outside a notation, so that one walk in 10^24 would need more.
WALK = 64


def _own_day(day: Column, style: Column) -> Column:
    """Whether a day written in the notation is read in that notation again."""
    d, m = F.dayofmonth(day), F.month(day)
    return (
        F.when(style == "short_dmy", (d < 10) | (m < 10))
        .when(style == "mdy", d > 12)
        .when(style == "short_mdy", (d > 12) & (m < 10))
        .when(style == "long", m != 5)
        .otherwise(True)
    )


def _date(value: Column, key: str, back: bool = False) -> Column:
    """Another day from 1900 to 2099 in the same notation. The permutation is walked on until the day's writing is in that notation alone."""
    first, (a, b) = F.lit(FIRST_DAY).cast("date"), DAY_HALVES
    move = lambda x: _feistel(x["l"], x["r"], F.lit(a), F.lit(b), "date", key, F.lit("day"), back)
    day_of = lambda x: F.date_add(first, (x["l"] * b + x["r"]).cast("int"))

    def body(p):
        n = F.datediff(p["day"], first)
        start = move(F.struct(F.floor(n / b).alias("l"), (n % b).cast("long").alias("r")))
        steps = F.array(*[F.lit(0)] * (WALK - 1))
        walked = F.aggregate(steps, start, lambda acc, _: F.when(_own_day(day_of(acc), p["style"]), acc).otherwise(move(acc)))
        moved = F.when(p["style"].isin("ymd", "dmy", "named"), start).otherwise(walked)
        day = let(moved, day_of)
        text = F.lit(None).cast("string")
        for style, written in _STYLES.items():
            text = F.when(p["style"] == style, F.date_format(day, written)).otherwise(text)
        return F.coalesce(F.when(p["sep"] == "", text).otherwise(F.replace(text, F.lit("-"), p["sep"])), value)

    return let(_date_parts(value), body)


def _email(value: Column, key: str) -> Column:
    """The local part becomes letters and digits of the same length, keyed; so does the domain but for its ending.

    A local part is no number, so its characters are drawn from a keyed digest of the whole lower-cased address
    (equal addresses stay equal; different ones differ but for a digest clash), class by class.
    """
    parts = F.split(value, "@")
    local, domain = parts[0], parts[1]
    ending = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    def redraw(text, start, digest):
        return F.array_join(
            F.transform(
                F.split(text, ""),
                lambda c, i: F.when(
                    c.rlike("^[0-9]$"),
                    (F.conv(F.substring(digest, (i + start) % 126 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string"),
                ).when(
                    c.rlike(r"^\p{L}$"),
                    F.substring(F.lit(LETTERS), F.conv(F.substring(digest, (i + start) % 126 + 1, F.lit(2)), 16, 10).cast("int") % 26 + 1, F.lit(1)),
                ).otherwise(c),
            ),
            "",
        )

    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending))
    digest = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(value)), 512)
    return let(digest, lambda d: F.concat(redraw(local, F.lit(0), d), F.lit("@"), redraw(host, F.lit(64), d), ending))


def _iban_ok(value: Column) -> Column:
    """ISO 7064 mod 97 over the rearranged code."""
    v = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    code = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55))
    rest = F.aggregate(code, F.lit(0), lambda a, x: F.when(x.isNull(), a).when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))
    return rest == 1


def _iban(value: Column, key: str, back: bool) -> Column:
    """Permute the account's digits, keep its letters and country, and set the two check digits anew."""
    v = F.regexp_replace(value, " ", "")
    account = F.substring(v, F.lit(5), F.length(v))
    digits = F.regexp_replace(account, "[^0-9]", "")
    moved = F.when(F.length(digits) > 0, _refill(account, permute_digits(digits, "iban", key, back))).otherwise(account)
    turned = F.concat(moved, F.substring(v, 1, 2), F.lit("00"))
    code = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55))
    rest = F.aggregate(code, F.lit(0), lambda a, x: F.when(x.isNull(), a).when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))
    compact = F.concat(F.substring(v, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), moved)
    spaced = F.trim(F.regexp_replace(compact, "(.{4})", "$1 "))
    return F.when(F.instr(value, " ") > 0, spaced).otherwise(compact)


def kind_of(value: Column) -> Column:
    """The validated kind of one matched piece, or null if it only looks like one."""
    whole = lambda k: value.rlike("^(?:" + PATTERNS[k] + ")$")
    octets = F.forall(F.split(value, r"\."), lambda x: x.try_cast("int") <= 255)
    digits = F.regexp_replace(value, "[^0-9]", "")
    area, group, serial = _ssn_parts(value)
    issued = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    day = F.year(_date_parts(value)["day"]).between(1900, 2099)
    return (
        F.when(whole("email"), F.lit("email"))
        .when(whole("iban") & _iban_ok(value), F.lit("iban"))
        .when(whole("date") & day, F.lit("date"))
        .when(whole("ip") & octets, F.lit("ip"))
        .when(whole("ssn") & issued, F.lit("ssn"))
        .when(whole("phone") & F.length(digits).between(7, 15), F.lit("phone"))
        .when(whole("card") & (luhn_sum(digits) == 0), F.lit("card"))
    )


def pseudonym(value: Column, kind: Column, key: str = KEY, back: bool = False) -> Column:
    """The pseudonym of a validated value of its kind: same format, equal for equal values. ``back`` gives the value of a pseudonym (but for e-mail)."""
    return (
        F.when(kind == "email", value if back else _email(value, key))
        .when(kind == "iban", _iban(value, key, back))
        .when(kind == "date", _date(value, key, back))
        .when(kind == "ip", _ip(value, key, back))
        .when(kind == "ssn", _ssn(value, key, back))
        .when(kind == "phone", _phone(value, key, back))
        .when(kind == "card", _card(value, key, back))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str = KEY, back: bool = False) -> DataFrame:
    """Replace personal values in ``text`` of (doc_id, text, ...), all other columns kept, ``n_pii`` (int) added.

    Candidates are cut out of the whole text by one pattern (its matches, and the gaps between them); each is
    checked (Luhn for card numbers, mod 97 for IBANs, calendar for dates, 0-255 for addresses, issued areas for SSNs,
    7 to 15 digits for phones) and permuted within its format, onto a value that passes the same check. With ``back`` the
    permutations run backwards: numbers and dates get their values again, e-mail addresses stay as they are. Row by row: no shuffle, any length of text.

    Null text: null, n_pii 0. Empty text: empty, 0. What fails its check stays as it is. Repeated rows give
    repeated results; a column of the input named ``n_pii`` is replaced. An empty table gives no rows.
    """
    text = F.col("text")
    # Every other kind starts with one of these characters, which the engine tests before the alternatives.
    without = "(?=[0-9+(A-Z])(?:" + "|".join(p for k, p in PATTERNS.items() if k != "email") + ")"
    with_email = PATTERNS["email"] + "|" + without
    by = lambda f: F.when(F.instr(text, "@") > 0, f(with_email)).otherwise(f(without))
    found = by(lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    gaps = by(lambda p: F.split(text, p, -1))

    def replaced(x):
        return let(kind_of(x), lambda k: F.struct(F.coalesce(pseudonym(x, k, key, back), x).alias("t"), k.isNotNull().cast("int").alias("k")))

    # Texts without a digit or "@" hold no candidate; the others are cut into gaps and candidates in turn.
    done = docs.withColumn("_veduta_found", F.when(text.rlike("[0-9@]"), F.transform(found, replaced)))
    joined = F.concat_ws("", F.flatten(F.zip_with(gaps, F.col("_veduta_found.t"), lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))))
    n = F.coalesce(F.aggregate(F.col("_veduta_found.k"), F.lit(0), lambda a, b: a + b), F.lit(0))
    changed = F.coalesce(F.size("_veduta_found"), F.lit(0)) > 0
    return done.withColumn("n_pii", n).withColumn("text", F.when(changed, joined).otherwise(text)).drop("_veduta_found")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced: doc_id, text, n_pii."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
