"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, tidied, tidy
from .mixing import uniform
from .shingles import _words, mix

BUCKETS = 10_000
#: Pseudo-counts that draw a bucket's ratio to 1, so that buckets hardly seen in the target decide nothing.
PRIOR = 20.0
#: The bound on labelled rows used, taken by id hash.
LABELLED = 20_000
SEED = "veduta-quality-1"
#: Bins into which a range of keys is cut to find the k-th largest, and keys of one bin that the driver may sort.
BINS, SORTED = 4096, 100_000
_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")
_SAME = np.uint64(0x5AD5AD5AD5AD5AD5)


def buckets(text: bytes | None, size: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's n-grams: words and runs of signs, and pairs of neighbours (a pair of equals is one and the same n-gram)."""
    tokens = _TOKEN.findall(text.lower()) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    pair = np.where(h[1:] == h[:-1], _SAME, mix(h[:-1]) + h[1:])
    return (np.r_[mix(h), mix(pair)] % np.uint64(size)).astype(np.int64)


def count_ngrams(docs: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all of ``docs`` (text, target boolean): row 0 all texts, row 1 those of the target.

    Every task sums its own texts, so what is shuffled is a bucket table per task, and the driver gets one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found: tuple[list, list] = ([], [])
                for t, is_target in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("target").to_pylist(), strict=True):
                    found[bool(is_target)].append(buckets(t, size))
                for row, some in enumerate(found):
                    if some:
                        total[row] += np.bincount(np.concatenate(some), minlength=size)
        total[0] += total[1]
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "n", "m"])

    counted = docs.select("text", "target").mapInArrow(tidied(run), "bucket long, n long, m long")
    out = np.zeros((2, size))
    for bucket, n, m in counted.groupBy("bucket").agg(F.sum("n"), F.sum("m")).collect():
        out[:, bucket] = n, m
    return out


def log_ratios(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log of target over raw probability by bucket."""
    expected = counts[1].sum() * counts[0] / max(counts[0].sum(), 1)
    return np.log((counts[1] + prior) / (expected + prior))


def weigher(ratios: np.ndarray, length: int | None = None):
    """An Arrow UDF from text to its log importance weight: the sum of its n-grams' log ratios (null without any).

    With ``length`` the sum of a longer text is scaled to that many n-grams.
    """
    size = len(ratios)

    @F.arrow_udf("double")
    def weight(text: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(text), 256):
            for t in text.slice(at, 256).cast(pa.binary()).to_pylist():
                b = buckets(t, size)
                total = float(ratios[b].sum()) if len(b) else None
                out.append(total * length / len(b) if length and len(b) > length else total)
        tidy()
        return pa.array(out, pa.float64())

    return weight


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the range of keys that best divides the classes (true less false positive rate)."""
    if not len(good) or not len(bad):
        return -np.inf
    keys = np.unique(np.r_[good, bad])
    gain = np.searchsorted(np.sort(bad), keys, "left") / len(bad) - np.searchsorted(np.sort(good), keys, "left") / len(good)
    best = int(np.argmax(gain))
    below = keys[best - 1] if best else keys[best] - 1.0
    return float((below + keys[best]) / 2)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of ``keys`` (key double, no nulls); minus infinity if there are fewer, plus infinity for k = 0.

    A histogram of the range that holds it is taken again and again, until the bin has few keys or one value. The driver gets
    ``BINS`` counts at a time and at last ``SORTED`` keys.
    """
    if k <= 0:
        return np.inf
    n, low, high = keys.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if n < k:
        return -np.inf
    while n > SORTED and low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        inside = keys.where(F.col("key").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for _, n, low, high in sorted(inside.collect(), reverse=True):  # noqa: B007
            if k <= n:
                break
            k -= n
    if low == high:
        return low
    return sorted((r[0] for r in keys.where(F.col("key").between(low, high)).select("key").collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, labelled: int = LABELLED, seed: str = SEED, length: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with log_weight, key and kept added, all rows and columns kept.

    Target text is that of labelled documents (doc_id, quality) with quality 1, at most ``labelled`` of all labels by id hash; raw text is
    all of ``docs``. log_weight is the sum of the n-grams' log ratios over the whole text; key adds Gumbel noise drawn from the id. The ``k`` documents
    with the largest keys are kept, a sample without replacement by weight; documents tied with the last of them are kept too. Without ``k``, as many are
    kept as reach the key that best divides the labelled ones. Either way one threshold is found and the test is made row by row.

    Texts without words, empty or null: weight and key null, not kept. Null labels are ignored, of several labels of one id the lowest counts, as the
    lowest key of its texts does; without labels of both classes every text with words is kept (unless ``k`` says otherwise). Repeated rows decide alike; a
    null doc_id draws the noise of an empty one. Input columns named like the added ones are replaced. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.drop("log_weight", "key", "kept")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_label"))
    known = F.broadcast(scratch.keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labels"))  # at most ``labelled`` rows
    counts = count_ngrams(docs.select("doc_id", "text").join(known, "doc_id", "left").withColumn("target", F.col("_label") == 1))
    weight = weigher(log_ratios(counts) if counts[1].sum() else np.zeros(BUCKETS), length)
    gumbel = -F.log(-F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)))
    if k is None:
        # The join comes first and the nulls go last: only labelled texts are scored.
        marked = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "_label", (weight("text") + gumbel).alias("key"))
        fit = scratch.keep(marked, "labelled").groupBy("doc_id", "_label").agg(F.min("key").alias("key")).where("key IS NOT NULL").collect()
        good, bad = (np.array([x for _, y, x in fit if (y == 1) is side]) for side in (True, False))
        cut = best_cut(good, bad)
    else:
        keys = scratch.keep(docs.select((weight("text") + gumbel).alias("key")), "keys")
        cut = kth_largest(keys.where("key IS NOT NULL"), k)
    scored = docs.withColumn("log_weight", weight("text")).withColumn("key", F.col("log_weight") + gumbel)
    return scored.withColumn("kept", F.coalesce(F.col("key") >= F.lit(cut), F.lit(False)))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """All documents weighed against those labelled good: doc_id, log_weight, key, kept."""
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", "key", "kept")
