"""Benchmark decontamination by a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, bounded, table

#: What lies between words, after A-Z are lower-cased.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The columns that name a text: results depend on it alone, so equal texts are searched as one.
KEY = ["k1", "k2"]


def _pieces(text: Column) -> Column:
    """Words with an empty last piece, and an empty first one if the text starts between words. Null is empty."""
    return F.split(F.concat(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), SPLIT, -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with k1 and k2, a 128-bit hash of the text (null as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit("veduta"), text))


class Index:
    """Postings (k1, k2, term, pos) of the test terms in the training texts, stored list by list as a search asks for them.

    A benchmark's terms are a language's words, so the lists of all of them would hold the corpus again. A window stands in a text only with its
    rarest terms: their lists are stored for all texts, those of the other terms for the texts in which rare terms align. ``counts`` (term, cf) is
    each term's number of occurrences in all rows. Positions count pieces of the text, the same for all terms of a text.
    """

    def __init__(self, scratch: Scratch, texts: DataFrame, vocabulary: DataFrame):
        self.scratch, self._texts, self._vocabulary = scratch, texts, bounded(vocabulary)
        self.counts = scratch.keep(self._occurrences(texts, self._vocabulary).groupBy("term").agg(F.count("*").alias("cf")), "counts")

    def _occurrences(self, texts: DataFrame, words: DataFrame) -> DataFrame:
        rows = texts.select(*KEY, F.posexplode(_pieces(F.col("text"))).alias("pos", "word"))
        return rows.join(words, "word").select(*KEY, "term", "pos")

    def lists(self, terms: DataFrame, tag: str) -> DataFrame:
        """The lists of ``terms`` (term) in all texts, sorted by term, text and position in each part."""
        words = bounded(self.scratch.keep(self._vocabulary.join(terms, "term", "left_semi"), f"{tag}-words"))
        return self.scratch.keep(self._occurrences(self._texts, words).sortWithinPartitions("term", *KEY, "pos"), tag)

    def lists_in(self, keys: DataFrame, tag: str) -> DataFrame:
        """The lists of all terms in the texts of ``keys`` (k1, k2), each text once."""
        texts = self._texts.join(bounded(keys), KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
        return self.scratch.keep(self._occurrences(texts, self._vocabulary), tag)


def test_terms(scratch: Scratch, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: item, off, word, n, w; vocabulary: word, term; names: item, item_id). Rows grow with the benchmark only.

    ``item`` is a number for each text of the benchmark, so equal texts are searched once; ``names`` brings their item_ids back.
    """
    words = F.filter(_pieces(F.col("text")), lambda x: x != "")
    rows = items.select("item_id", words.alias("words")).where(F.size("words") > 0)
    uniq = rows.select("words").distinct().withColumn("item", F.monotonically_increasing_id())
    uniq = scratch.keep(uniq, "items")
    n = F.size("words")
    out = uniq.select("item", n.alias("n"), F.least(n, F.lit(window)).alias("w"), F.posexplode("words").alias("off", "word"))
    vocabulary = scratch.keep(out.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    names = scratch.keep(rows.join(uniq, "words").select("item", "item_id").distinct(), "names")
    return out, vocabulary, names


def build_index(scratch: Scratch, docs: DataFrame, vocabulary: DataFrame) -> Index:
    """The index of the whole texts of ``docs`` (doc_id, text)."""
    return Index(scratch, _keyed(docs.select("text")), vocabulary)


def _near(index: Index, terms: DataFrame, ranked: DataFrame, k: int, slack: int) -> DataFrame:
    """k1, k2, item, first, last of item windows of which ``k`` words or more stand within ``slack`` places of one another's alignment.

    Such a window lacks at most w - k words, so two of its w - k + 2 rarest stand in the text. Alignments (position less
    offset) are taken in bands of slack + 1 from ``base`` on; bands with two rare words are intersected with all lists.
    """
    scratch = index.scratch
    rare = ranked.where((F.col("w") > k) & (F.col("rank") <= F.col("w") - k + 2) & (F.col("cf") > 0)).select("item", "off", "term").distinct()
    rare = scratch.keep(rare, "rare")
    diag = F.col("pos") - F.col("off")
    found = index.lists(rare.select("term").distinct(), "near-lists").join(bounded(rare), "term")
    found = found.select(*KEY, "item", "off", F.explode(F.sequence(diag - slack, diag)).alias("base"))
    bands = found.groupBy(*KEY, "item", "base").agg(F.min("off").alias("a"), F.max("off").alias("b")).where("a < b")
    bands = scratch.keep(bands.select(*KEY, "item", "base"), "bands")
    lists = index.lists_in(scratch.keep(bands.select(*KEY).distinct(), "near-texts"), "near-all")
    at = F.col("base") + F.col("off")
    wanted = bands.join(bounded(terms), "item").withColumn("pos", F.explode(F.sequence(at, at + slack)))
    hit = wanted.join(lists, [*KEY, "term", "pos"], "left_semi").groupBy(*KEY, "item", "base", "off", "n", "w").agg(F.min("pos").alias("pos"))
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - F.col("w") + 1), F.least(F.col("off"), F.col("n") - F.col("w"))))
    windows = hit.withColumn("start", start).groupBy(*KEY, "item", "base", "start")
    windows = windows.agg(F.count("*").alias("k"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return windows.where(F.col("k") >= k).select(*KEY, "item", "first", "last").distinct()


def search(index: Index, words: DataFrame, vocabulary: DataFrame, near: int | None = None, slack: int = 1) -> DataFrame:
    """Occurrences of item windows: k1, k2, item, first, last (positions), kind ("exact" or "near").

    Terms of a window are taken from the rarest in the corpus on. The rarest term's list, moved back by its offset,
    gives alignments of item and text; the second rarest term's list is intersected with them at its own offset;
    what is left is intersected with the lists of all other terms of the item. Runs of ``w`` or more
    matched offsets are exact phrases. With ``near`` = k (2 or more), windows of more than k words of which k words or more
    stand at their offsets, give or take ``slack`` inserted or deleted words, are returned as well, but for those inside an exact phrase.
    """
    if near is not None and near < 2:
        raise ValueError("near matches need two words or more")
    scratch = index.scratch
    terms = words.join(vocabulary, "word").join(index.counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    terms = scratch.keep(terms.select("item", "off", "term", "n", "w", "cf"), "test")
    starts = terms.where("off <= n - w").select("item", F.col("off").alias("start"), "w")
    inside = starts.join(terms.drop("w"), "item").where("off >= start AND off < start + w")
    rank = Window.partitionBy("item", "start").orderBy("cf", "off")
    ranked = inside.withColumn("rank", F.row_number().over(rank))
    pair = ranked.where("rank <= 2").groupBy("item", "start").agg(
        F.min_by("term", "rank").alias("t1"), F.min_by("off", "rank").alias("o1"), F.min("cf").alias("cf"),
        F.max_by("term", "rank").alias("t2"), F.max_by("off", "rank").alias("o2"),
    )
    pair = scratch.keep(pair.where("cf > 0").select("item", "t1", "o1", "t2", "o2").distinct(), "rarest")
    rare = index.lists(pair.select(F.explode(F.array("t1", "t2")).alias("term")).distinct(), "lists")
    first = rare.join(bounded(pair), F.col("term") == F.col("t1"))
    diag = F.col("pos") - F.col("o1")
    first = first.select(*KEY, "item", diag.alias("diag"), F.col("t2").alias("term"), (diag + F.col("o2")).alias("pos")).distinct()
    second = rare.join(bounded(scratch.keep(pair.select(F.col("t2").alias("term")).distinct(), "second")), "term", "left_semi")
    second = second.select(*KEY, "term", "pos").distinct()
    aligned = scratch.keep(first.join(second, [*KEY, "term", "pos"], "left_semi").select(*KEY, "item", "diag").distinct(), "aligned")
    lists = index.lists_in(scratch.keep(aligned.select(*KEY).distinct(), "texts"), "all-lists")
    wanted = aligned.join(bounded(terms.select("item", "off", "term", "w")), "item").withColumn("pos", F.col("diag") + F.col("off"))
    hit = wanted.join(lists, [*KEY, "term", "pos"], "left_semi").select(*KEY, "item", "diag", "off", "w")
    by = Window.partitionBy(*KEY, "item", "diag")
    hit = hit.withColumn("island", F.col("off") - F.row_number().over(by.orderBy("off")))
    runs = hit.groupBy(*KEY, "item", "diag", "island", "w").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    place = lambda x: F.col("diag") + F.col(x)
    exact = runs.where("b - a + 1 >= w").select(*KEY, "item", place("a").alias("first"), place("b").alias("last"), F.lit("exact").alias("kind"))
    if near is None:
        return exact
    exact = scratch.keep(exact, "exact")
    e = exact.select(*[F.col(c).alias(f"e_{c}") for c in (*KEY, "item", "first", "last")])
    same = (F.col("k1") == F.col("e_k1")) & (F.col("k2") == F.col("e_k2")) & (F.col("item") == F.col("e_item"))
    covered = same & (F.col("first") >= F.col("e_first")) & (F.col("last") <= F.col("e_last"))
    close = _near(index, terms, ranked, near, slack).join(e, covered, "left_anti")
    return exact.unionByName(close.withColumn("kind", F.lit("near")))


def _found(docs: DataFrame, items: DataFrame, window: int, near: int | None) -> tuple[Scratch, DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "decontaminate")
    words, vocabulary, names = test_terms(scratch, items.select("item_id", "text"), window)
    index = build_index(scratch, docs, vocabulary)
    return scratch, scratch.keep(search(index, words, vocabulary, near), "found"), names


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated; with ``near`` = k also n_near.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a document word inside any
    occurrence of a window is hit. ``items`` (item_id, text). ``n_near`` counts the items of which a window stands in the row with
    k of its words or more (``search``), outside exact phrases; it changes no other column.

    Null and empty texts have no words and are not contaminated; items without words have no window. Repeated
    rows of documents stay separate rows, rows of one id are judged each by its text, repeated or equal items are each counted once by item_id; a null
    item_id is not counted. The digest of no items is that of the empty string. Texts may be of any length. Empty tables give zero counts or no rows.
    Other columns are ignored.
    """
    scratch, every, names = _found(docs, items, window, near)
    found = every.where("kind = 'exact'")
    before = Window.partitionBy(*KEY).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("last") - F.greatest(F.col("first"), F.coalesce(F.max("last").over(before) + 1, F.col("first"))) + 1
    covered = found.select(*KEY, "first", "last").distinct().withColumn("new", F.greatest(new, F.lit(0)))
    n_hit = covered.groupBy(*KEY).agg(F.sum("new").cast("long").alias("n_hit"))
    names = bounded(names)
    named = found.select(*KEY, "item").distinct().join(names, "item").select(*KEY, F.col("item_id").cast("string").alias("id")).distinct()
    ids = named.groupBy(*KEY).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    per = n_hit.join(ids, KEY, "left").select(
        *KEY, "n_hit", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("sha")
    )
    per = scratch.keep(per, "hits")
    n_words = F.size(F.filter(_pieces(F.col("text")), lambda x: x != "")).cast("long")
    out = _keyed(docs.select("doc_id", "text")).select("doc_id", *KEY, n_words.alias("n_words")).join(bounded(per), KEY, "left")
    more = []
    if near is not None:
        close = every.where("kind = 'near'").select(*KEY, "item").distinct().join(names, "item")
        close = scratch.keep(close.groupBy(*KEY).agg(F.count_distinct("item_id").alias("n_near")), "near")
        out = out.join(bounded(close), KEY, "left")
        more = [F.coalesce("n_near", F.lit(0)).alias("n_near")]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *more,
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of ``items`` stands, all columns kept. Judged by each row's text, whatever its id."""
    scratch, found, _ = _found(docs.select("doc_id", "text"), items, window, None)
    bad = bounded(scratch.keep(found.select(*[F.col(k).alias(f"_veduta_{k}") for k in KEY]).distinct(), "bad"))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = (F.xxhash64(text) == F.col("_veduta_k1")) & (F.xxhash64(F.lit("veduta"), text) == F.col("_veduta_k2"))
    return docs.join(bad, same, "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Exact ten-word windows of all benchmark items in all documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_decontamination(spark, sf_dir: str) -> DataFrame:
    """As ``op5_decontamination``, with n_near: items of which 8 words of a window of ten stand in the document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=8)


_W = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
g AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
t AS (SELECT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s FROM g),
l AS (SELECT DISTINCT k FROM g),
p AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, l WHERE len(w) >= k),
h AS (SELECT p.rid, p.i, p.k, t.item_id FROM (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM p) p JOIN (SELECT DISTINCT item_id, k, s FROM t) t USING (k, s)),
n AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS x FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS v FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
