"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
#: Fine steps of the rank at which a source's words are added up before its boundary step is sorted.
STEPS = 4096
SEED = "veduta-mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(scratch: Scratch, sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``: 0-based place of the source by code point, null last, by a distributed sort and the sizes of its partitions."""
    place = F.monotonically_increasing_id()
    placed = scratch.keep(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("place", place), "sources")
    part = F.shiftrightunsigned("place", 33).alias("part")
    counts = placed.groupBy(part).agg(F.max("place").alias("last")).orderBy("part").collect()  # a row for each partition
    before, rows = 0, []
    for r in counts:
        rows.append((r["part"], before - (r["part"] << 33)))
        before += r["last"] - (r["part"] << 33) + 1
    shift = scratch.spark.createDataFrame(rows, "part long, shift long")
    return placed.withColumn("part", part).join(F.broadcast(shift), "part").withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def source_targets(scratch: Scratch, sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the total size; a target stops at
    ``max_copies`` times its source, the excess going to the rest by weight. The level of the rest, words for each unit of weight, rises as sources
    below it are held at their limits, until none is: a few sums over the sources, of which there may be any number.
    """
    x = _numbered(scratch, sizes).withColumn("w", F.col("rank") % 3 + 1).withColumn("cap", F.col("source_size") * max_copies)
    x = scratch.keep(x.drop("rank"), "weights")
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    total, weight = x.agg(F.sum(wide("source_size")), F.sum(wide("w"))).first()
    rest, rest_w = int(total or 0), int(weight or 0)
    while rest_w:
        held = wide("cap") * F.lit(rest_w).cast("decimal(10,0)") <= F.lit(rest).cast("decimal(28,0)") * wide("w")
        some = x.where(held).agg(F.sum(wide("cap")), F.sum(wide("w"))).first()
        now = int(total) - int(some[0] or 0), int(weight) - int(some[1] or 0)
        if now == (rest, rest_w):
            break
        rest, rest_w = now
    if not rest_w:
        return x.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    target = F.when(held, F.col("cap").cast("double")).otherwise(F.lit(float(rest)) * F.col("w") / F.lit(rest_w))
    return x.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of MD5: the same on every run and in other engines."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: str = SEED, max_copies: int = MAX_COPIES, steps: int = STEPS) -> DataFrame:
    """How many words the mix takes from each row of ``docs`` (doc_id, text, source).

    A source with target T and size S expects T/S copies of each row: floor(T/S) whole copies are certain, the rest is
    the inclusion probability p. Rows are ranked by random odds over inclusion odds, (u/(1-u)) / (p/(1-p)), and
    taken in that order while half of the row still fits, so a source ends within half a document of its target.
    The words below each of ``steps`` rank steps are summed first; only a source's boundary step is sorted, so
    a source with most of all rows is no single task.

    Null text: size 0. Null source: a source of its own, last. Repeated rows are rows like any other; equal ids have
    equal ranks, ties go by size. Size 0 takes 0. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = bounded(scratch.keep(source_targets(scratch, per_source, max_copies).withColumnRenamed("source", "t_source"), "targets"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor("copies"), F.lit(max_copies)).cast("long")
    ranked = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("copies", copies)
        .withColumn("whole", whole)
        .withColumn("p", F.col("copies") - F.col("whole"))
        .withColumn("u", uniform(F.col("doc_id"), seed))
        .withColumn("u", F.coalesce("u", F.lit(0.5)))
        .withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))))
        .withColumn("step", F.floor(F.col("q") / (1 + F.col("q")) * steps))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .drop("copies", "p", "u", "t_source")
    )
    by_step = Window.partitionBy("source").orderBy("step")
    below = (
        ranked.where("q IS NOT NULL AND size > 0")
        .groupBy("source", "step")
        .agg(F.sum("size").alias("step_size"), F.max("budget").alias("b"))
        .withColumn("before", F.sum("step_size").over(by_step) - F.col("step_size"))
    )
    edge = (
        below.where(F.col("before") < F.col("b"))
        .groupBy("source")
        .agg(F.max("step").alias("edge"), F.max("before").alias("before"))
        .withColumnRenamed("source", "e_source")
    )
    edge = bounded(scratch.keep(edge, "edges"))
    placed = ranked.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    inside = F.col("q").isNotNull() & (F.col("size") > 0)
    at_edge = inside & (F.col("step") == F.col("edge"))
    run = Window.partitionBy("source").orderBy("q", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sorted_edge = placed.where(at_edge).withColumn("cum", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    extra = F.when(F.col("cum") + F.col("size") / 2.0 <= F.col("budget"), F.col("size")).otherwise(F.lit(0))
    first = F.when(inside & (F.col("step") < F.col("edge")), F.col("size")).otherwise(F.lit(0))
    keep = ["doc_id", "source", "size", "source_size", "target"]
    certain = F.col("whole") * F.col("size")
    return placed.where(~F.coalesce(at_edge, F.lit(False))).select(*keep, (certain + first).cast("long").alias("taken")).unionByName(
        sorted_edge.select(*keep, (certain + extra).cast("long").alias("taken"))
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, source_size * {MAX_COPIES} AS cap FROM s),
x AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM r),
f AS (SELECT max(rest) AS free, max(rest_w) AS free_w FROM x WHERE NOT cap * rest_w <= rest * w),
t AS (SELECT source, source_size, CASE WHEN cap * rest_w <= rest * w THEN cap::DOUBLE ELSE free::DOUBLE * w / free_w END AS target FROM x, f),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  least(floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END), {MAX_COPIES})::BIGINT AS whole,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS copies,
  (('0x' || substr(md5(d.doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN copies - whole > 0 THEN (u / (1 - u)) * ((1 - (copies - whole)) / (copies - whole)) END AS q, target - whole * source_size AS budget FROM c),
m AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM q WHERE q IS NOT NULL AND size > 0)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN cum + size / 2.0 <= budget THEN size ELSE 0 END)::BIGINT AS taken FROM m
UNION ALL SELECT doc_id, size, source_size, target, (whole * size)::BIGINT FROM q WHERE q IS NULL OR size = 0
"""
