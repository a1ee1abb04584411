"""Secret scan: candidates scored by a random forest whose features and trees are SQL expressions."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words that name a secret, with what may stand between them and the value.
_NAMES = r"(?:token|secret|passw(?:or)?d|passwd|passphrase|pwd|api[_ -]?key|access[_ -]?key|auth|credential|private[_ -]?key|connection[_ -]?string)"
_ASSIGNED = rf"(?i:{_NAMES}[A-Za-z0-9_]{{0,12}}[\"']?[ \t]{{0,3}}(?::=|=>|[=:])[ \t]{{0,3}}(?:bearer |basic )?)"
#: What is a candidate, tried in this order: private key blocks, signed tokens, passwords in URLs, values (quoted or not) after a word that
#: names a secret, other quoted values after = or :, long runs of token characters with a digit. Some begin with what leads to the value.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+)?"
    r"|://[^\s:/@\"']{1,64}:[^\s:/@\"']{4,}+@"
    rf"|{_ASSIGNED}(?:\"[^\"\n]{{6,}}+\"|'[^'\n]{{6,}}+'|[^\s\"'<>(){{}}\[\]]{{6,}}+)"
    r"|[=:] ?(?:\"[^\s\"]{8,}+\"|'[^\s']{8,}+')"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
#: What leads to a candidate's value.
_LEAD = rf"^(?:{_ASSIGNED}[\"']?|[=:] ?[\"']|://[^\s:/@\"']{{1,64}}:)"
#: What every text with a candidate holds.
_QUICK = rf"[0-9]|[=:] ?[\"']|://|(?i:{_NAMES})|PRIVATE KEY"
#: Neighbouring words and dictionary words.
SECRET_WORDS = rf"(?i){_NAMES}\w{{0,12}}[^A-Za-z0-9]{{0,8}}$|(?i)bearer\s{{0,3}}$|://[^\s:/@]{{1,64}}:$"
BENIGN_WORDS = r"(?i)(?:sha-?(?:1|256|512)?|commit|hash|digest|checksum|md5|uuid|guid|etag|revision|integrity|build|version|isbn|order|page|ref)[^A-Za-z0-9]{0,6}$"
PLACEHOLDER = (
    r"(?i)example|changeme|change[_-]me|your[_-]|xxxx|dummy|sample|placeholder|redacted|1234567|abcdef|todo|insert|\*\*\*|^\$|^<|^%|"
    r"env[.\[(]|getenv|none$|null$|true$|false$|required|optional|string$|undefined"
)
#: Beginnings that issuers give to their secrets.
KNOWN_PREFIX = r"^(?:AKIA[0-9A-Z]|ASIA[0-9A-Z]|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-[A-Za-z0-9]|AIza[0-9A-Za-z_-]|npm_|pypi-|SG\.|eyJ[A-Za-z0-9_-]+\.|-----BEGIN)"
PATH_BEFORE = r"(?:[/\\.]|://[^\s]*|\.[a-z]{1,4}[?#=])$"
TEST_PATH = r"(?i)(?:test|spec|fixture|mock|docs?|readme|sample)"
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
WORDS = (
    "the|and|for|with|from|that|this|have|name|file|path|data|user|test|config|version|example|value|string|number|index|image|button|"
    "class|table|column|query|page|item|list|group|service|server|client|request|response|manager|handler|factory|default|public|private|"
    "static|update|delete|create|insert|select|media|assets|style|script|module|package|library|component|container|template|password|"
    "secret|token|access|your|here|change|sample|number|account|order|build|release|branch|feature|master|main|long|short|key|about|after|"
    "again|also|always|back|because|before|between|both|code|come|could|day|down|each|even|every|field|find|first|form|format|found|good|"
    "great|header|help|home|host|into|just|know|last|left|level|like|line|link|local|look|make|many|message|more|most|much|must|never|next|"
    "node|object|only|open|option|other|over|people|place|point|port|read|result|right|same|screen|search|set|show|small|some|source|start|"
    "state|status|still|text|their|them|then|there|these|they|thing|think|through|time|title|type|under|used|view|want|water|well|were|what|"
    "when|where|which|while|will|word|work|world|would|write|year|login|session|cookie|cache|filter|input|output|primary|toggle|panel"
)
FEATURES = [
    "length", "digits", "changes", "bigrams", "dictionary", "distinct", "entropy", "hex", "slashes", "signs", "path", "test_path", "secret_word", "benign_word",
    "placeholder", "known_prefix", "quoted", "assigned",
]
TREES, DEPTH, LEAF, LEAST = 15, 7, 4, 0.5
#: Characters of the neighbourhood that a candidate's features see.
BEFORE, AFTER = 60, 20


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, nth (order in the text), value, before (up to ``BEFORE`` characters), after (up to ``AFTER``)."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(text, CANDIDATE, -1)
    cut = docs.where(text.rlike(_QUICK)).select("doc_id", found.alias("found"), gaps.alias("gaps")).where(F.size("found") > 0)
    lead = F.regexp_extract("raw", _LEAD, 0)
    lead = F.when(F.length("raw") - F.length(lead) >= 4, lead).otherwise(F.lit(""))
    # The quote or "@" that ends a value is no part of it.
    close = F.when(F.col("lead").rlike("[\"']$|^://"), F.regexp_extract("raw", "[\"'@]$", 0)).otherwise(F.lit(""))
    rows = cut.select("doc_id", "gaps", F.posexplode("found").alias("nth", "raw")).withColumn("lead", lead).withColumn("close", close)
    at = F.length("lead")
    return rows.select(
        "doc_id", "nth", F.substring("raw", at + 1, F.length("raw") - at - F.length("close")).alias("value"),
        F.right(F.concat(F.col("gaps")[F.col("nth")], "lead"), F.lit(BEFORE)).alias("before"),
        F.left(F.concat("close", F.col("gaps")[F.col("nth") + 1]), F.lit(AFTER)).alias("after"),
    )


def features(rows: DataFrame) -> DataFrame:
    """Add one double column per feature to rows of value, before, after."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    n = F.length(v).cast("double")
    letters = F.array_distinct(F.split(v, ""))
    share = lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.transform(F.filter(letters, lambda c: c != ""), share), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    )
    low = F.lower(v)
    made = {
        "length": F.least(n, F.lit(256.0)),
        "digits": F.regexp_count(v, F.lit("[0-9]")) / n,
        "changes": F.regexp_count(v, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])")) / n,
        "bigrams": F.regexp_count(low, F.lit(f"(?=(?:{BIGRAMS}))")) / n,
        "dictionary": (n - F.length(F.regexp_replace(low, WORDS, ""))) / n,
        "distinct": F.size(letters) / F.least(n, F.lit(62.0)),
        "entropy": entropy,
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "slashes": F.regexp_count(v, F.lit("[/._-]")) / n,
        "signs": F.regexp_count(v, F.lit("[^A-Za-z0-9/._-]")) / n,
        "path": before.rlike(PATH_BEFORE),
        "test_path": before.rlike(TEST_PATH),
        "secret_word": before.rlike(SECRET_WORDS),
        "benign_word": before.rlike(BENIGN_WORDS),
        "placeholder": v.rlike(PLACEHOLDER),
        "known_prefix": v.rlike(KNOWN_PREFIX),
        "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "assigned": before.rlike("[=:]\\s*[\"']?$"),
    }
    return rows.withColumns({k: made[k].cast("double") for k in FEATURES})


_HEX, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_KEYS = [
    "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "pwd", "DB_PASSWORD", "passwd", "apiKey", "SECRET_KEY",
]


class _Maker:
    """Draws the parts of made-up findings."""

    def __init__(self, seed: int):
        self.r, self.words = random.Random(seed), WORDS.split("|")

    def draw(self, letters: str, k: int) -> str:
        return "".join(self.r.choice(letters) for _ in range(k))

    def case(self, text: str) -> str:
        return self.r.choice([str, str, str.upper])(text)

    def prose(self) -> str:
        parts = ["the", "of", "ention", "ver", "que", "reated", "in", "mente", "and."]
        return " ".join(self.r.choice(parts) for _ in range(self.r.randint(0, 6)))

    def name(self) -> str:
        return self.case(self.r.choice(_KEYS))

    def random_token(self) -> str:
        r, kind = self.r, self.r.randrange(4)
        if kind < 2:
            return self.case(self.draw(_HEX, r.choice([32, 40, 40, 48, 64])))
        if kind == 2:
            return self.draw(_B64 + "+/", r.choice([22, 32, 40, 43, 64, 86])) + r.choice(["", "", "=", "=="])
        return self.draw(_B64, r.randint(18, 60))

    def issued(self) -> str:
        r = self.r
        return r.choice(["AKIA", "ASIA"]) + self.draw(_B64[:26] + "0123456789", 16) if r.random() < 0.35 else r.choice(
            ["ghp_", "gho_", "sk_live_", "xoxb-", "xoxp-", "AIza", "glpat-", "npm_", "pypi-", "github_pat_", "rk_live_"]
        ) + self.draw(_B64, r.randint(16, 60))

    def chosen(self) -> str:
        """A password as people choose them."""
        r, kind = self.r, self.r.randrange(5)
        word = lambda: r.choice(["hunter", "dragon", "tiger", "Winter", "summer", "monkey", "shadow", "qwerty", "Falcon", "purple", "horse", "staple", "correct", "battery"])
        if kind == 0:
            return word() + self.draw("0123456789", r.randint(1, 4)) + self.draw("!#$%&*@", r.randint(0, 2))
        if kind == 1:
            return self.draw(_B64, r.randint(6, 14)) + self.draw("!#$%&*@", r.randint(1, 3)) + self.draw(_B64, r.randint(1, 6))
        if kind == 2:
            return "".join(word().title() for _ in range(r.randint(2, 4)))
        if kind == 3:
            leet = str.maketrans("aeio", "@310")
            return (word() + word()).translate(leet) + self.draw("0123456789", r.randint(0, 3))
        return "-".join(word() for _ in range(r.randint(3, 4))) + self.draw("0123456789", r.randint(0, 2))

    def key_block(self) -> str:
        kind = self.r.choice(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "])
        lines = "\n".join(self.draw(_B64 + "+/", 64) for _ in range(self.r.randint(2, 12)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----"

    def secret(self) -> tuple[str, str, str]:
        r, kind = self.r, self.r.randrange(10)
        sep = r.choice([' = "', '="', ': "', " = '", ":'"])
        tail = r.choice(["", " ", "\n", " the", "!!", ",", ";"])
        if kind < 3:
            return r.choice([self.random_token, self.issued, self.chosen])(), f"{self.prose()} {self.name()}{sep}", sep[-1] + tail
        if kind < 5:
            return r.choice([self.random_token, self.issued])(), f"{self.prose()} {self.name()}{r.choice(['=', ': ', ' ', ' = '])}", tail
        if kind == 5:
            return self.chosen(), f"{self.prose()}{r.choice([' ', chr(10)])}{self.name()}{r.choice(['=', ': ', ' = ', ':'])}", r.choice(["", "\n", " "])
        if kind == 6:
            return self.issued(), self.prose() + r.choice([" ", ": ", "\n", "Bearer "]), tail
        if kind == 7:
            parts = ["eyJ" + self.draw(_B64, r.randint(16, 40)), "eyJ" + self.draw(_B64, r.randint(20, 90)), self.draw(_B64 + "_-", 43)]
            return ".".join(parts), self.prose() + r.choice([" ", " Authorization: Bearer ", ' token="', "="]), r.choice(["", '"', "\n"])
        if kind == 8:
            return self.chosen() if r.random() < 0.6 else self.random_token()[:24], f"{self.prose()} {r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb'])}://{r.choice(['admin', 'root', 'app', 'svc_user'])}:", f"@{r.choice(['db', 'host', 'mq'])}.internal"
        return self.key_block(), self.prose() + r.choice(["\n", " ", '"']), r.choice(["\n", "", " end"])

    def harmless(self) -> tuple[str, str, str]:
        r, kind = self.r, self.r.randrange(12)
        sep = r.choice([' = "', '="', ': "', " = '", ":'"])
        benign = ["commit", "sha256", "sha1:", "checksum", "md5", "uuid", "etag", "digest", "revision", "integrity", "build", "ref"]
        join = lambda s, a, b: s.join(r.choice(self.words) for _ in range(r.randint(a, b)))
        if kind == 0:
            return self.case(self.draw(_HEX, r.choice([32, 40, 64]))), f"{self.prose()} {self.case(r.choice(benign))}{r.choice([' ', ': ', '=', ':'])}", " "
        if kind == 1:
            h = self.draw(_HEX, 32)
            return "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]]), f"{self.prose()} {r.choice(['id', 'uuid', 'guid', 'item', ''])}{r.choice([' ', '=', ': '])}", " "
        if kind == 2:
            return self.draw("0123456789", r.randint(16, 19)), self.prose() + " ", r.choice([" ", ".", "!!", "$$$"])
        if kind == 3:
            return join(r.choice("/_-"), 3, 6) + str(r.randint(0, 99)), self.prose() + r.choice([" ", "/", "./", "https://example.org/"]), " "
        if kind == 4:
            return "".join(w.title() for w in r.choices(self.words, k=r.randint(3, 5))) + str(r.randint(0, 9)), self.prose() + r.choice([" ", "class ", "new "]), "("
        if kind == 5:
            made = ["your_api_key_here", "changeme123", "example-token-0000", "xxxxxxxxxxxxxxxx1", "insert_token_here", "placeholder12345", "0000000000000000", "abcdef1234567890", "your-password"]
            return r.choice(made), f"{self.prose()} {self.name()}{sep}", sep[-1]
        if kind == 6:
            return f"{r.choice(self.words)}-{self.draw(_HEX, r.choice([8, 16, 20]))}", f"{self.prose()} https://cdn.example.net/{r.choice(['static', 'assets', 'media'])}/", r.choice([".js", ".css", ".png"])
        if kind == 7:
            return join("", 2, 4), f"{self.prose()} {r.choice(['name', 'title', 'class', 'style', 'label'])}{sep}", sep[-1]
        if kind == 8:
            made = ["${SECRET}", "$DB_PASSWORD", "<password>", "os.environ", "process.env.TOKEN", "getenv", "%PASSWORD%", "required", "string", "undefined", "self.token", "config.password", "****"]
            return r.choice(made), f"{self.prose()} {self.name()}{r.choice(['=', ': ', ' = '])}", r.choice(["", "\n", ",", "(", ")"])
        if kind == 9:
            return r.choice(self.words) + r.choice(["", ",", ".", ";"]), f"{self.prose()} {r.choice(['password', 'secret', 'token', 'auth'])}: ", " " + self.prose()
        if kind == 10:
            return join(r.choice(["-", "_", "."]), 2, 4), f"{self.prose()} {r.choice(['token', 'auth', 'secret'])}_{r.choice(['type', 'name', 'url', 'path', 'field'])}{r.choice(['=', ': ', ' = '])}", r.choice(["", "\n", ","])
        return self.draw("0123456789", r.randint(4, 6)), f"{self.prose()} {r.choice(['https', 'http', 'redis'])}://{r.choice(['localhost', 'host', 'db'])}:", "/x@y"


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """``n`` labelled findings (value, before, after, 1 = secret), made up from a seed: the training set's bound."""
    make, out = _Maker(seed), []
    for i in range(n):
        value, before, after = make.secret() if i % 2 else make.harmless()
        out.append((value, before[-BEFORE:], after[:AFTER], i % 2))
    return out


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A Gini tree as (feature, cut, left, right) or a leaf's share of secrets."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or p in (0.0, 1.0):
        return p
    best = (p * (1 - p) - 1e-9, None, None)
    for f in rng.choice(x.shape[1], size=max(4, int(x.shape[1] ** 0.5)), replace=False):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2
        for cut in cuts if len(cuts) <= 24 else np.quantile(cuts, np.linspace(0.02, 0.98, 24)):
            left = x[:, f] <= cut
            k = int(left.sum())
            if min(k, len(y) - k) < LEAF:
                continue
            a, b = y[left].mean(), y[~left].mean()
            loss = (k * a * (1 - a) + (len(y) - k) * b * (1 - b)) / len(y)
            if loss < best[0]:
                best = (loss, int(f), float(cut))
    if best[1] is None:
        return p
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], y[left], rng, depth - 1), _tree(x[~left], y[~left], rng, depth - 1)


def train(spark: SparkSession, findings: list | None = None, seed: int = 11) -> list:
    """A forest from labelled findings; their features come from the same expressions that score documents."""
    rows = findings or labelled_findings()
    frame = spark.createDataFrame(rows, "value string, before string, after string, y int")
    table_ = np.array(features(frame).select(*FEATURES, F.col("y").cast("double")).collect(), dtype=float)
    x, y = table_[:, :-1], table_[:, -1]
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(TREES):
        pick = rng.integers(0, len(y), len(y))
        forest.append(_tree(x[pick], y[pick], rng, DEPTH))
    return forest


def _as_column(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    f, cut, left, right = node
    return F.when(F.col(FEATURES[f]) <= F.lit(cut), _as_column(left)).otherwise(_as_column(right))


def score(rows: DataFrame, forest: list) -> DataFrame:
    """Add ``score``: the mean of the trees, each a CASE expression."""
    total = _as_column(forest[0])
    for node in forest[1:]:
        total = total + _as_column(node)
    return rows.withColumn("score", F.round(total / len(forest), 6))


def scan(docs: DataFrame, forest: list | None = None, least: float = LEAST) -> DataFrame:
    """Secrets in ``docs`` (doc_id, text): doc_id, nth, value, score, secret (score >= ``least``), one row per candidate.

    Candidates are all matches in the whole text: key blocks, signed tokens, passwords in URLs, quoted values, values after a word that names a secret,
    long runs of token characters. The forest then removes false positives by length, character transitions, dictionary coverage, path and neighbouring
    words; of the neighbourhood it sees ``BEFORE`` characters before and ``AFTER`` after (between this candidate and the next). Row by row, no shuffle.

    Null, empty and plain texts give no rows. Repeated rows repeat results. Other columns are ignored. A text and a value may be of any
    length (lengths above 256 count as 256 in the feature). An empty table gives no rows.
    """
    forest = forest or train(docs.sparkSession)
    scored = score(features(candidates(docs)), forest)
    return scored.select("doc_id", "nth", "value", "score", (F.col("score") >= least).alias("secret"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Every candidate in every document with its score: doc_id, nth, value, score, secret."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
