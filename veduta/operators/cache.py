"""Eviction from a cache of any size: running totals by steps of time, so that no window runs over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps into which the span of access times is cut.
STEPS = 4096


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as of its log: a key per user, size and cost from its requests."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return events.groupBy(F.col("user_id").alias("cache_key")).agg(
        F.max(at).alias("last_accessed_at"), F.sum(F.floor(F.abs("value") * 100)).cast("long").alias("size_bytes"), F.max(F.col("event_id") % 7).cast("int").alias("render_cost")
    )


def with_running_total(rows: DataFrame, order: list[str], ties: bool) -> DataFrame:
    """``rows`` with rt, the running sum of size_bytes by last_accessed_at and then ``order``; rows that tie share it if ``ties``.

    Sizes are summed by steps of time, the steps' totals (at most ``STEPS``) are added up, and each step is sorted by itself.
    """
    low, high = rows.agg(F.min("last_accessed_at"), F.max("last_accessed_at")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // STEPS))
    placed = rows.withColumn("_step", F.floor((F.col("last_accessed_at") - F.lit(low or 0)) / width))
    sums = placed.groupBy("_step").agg(F.sum("size_bytes").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_step")) - F.col("_sum")  # a row for each step
    inside = Window.partitionBy("_step").orderBy("last_accessed_at", *order)
    inside = inside.rangeBetween(Window.unboundedPreceding, 0) if ties else inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(F.broadcast(sums.select("_step", before.alias("_before"))), "_step")
    return placed.withColumn("rt", F.col("_before") + F.sum("size_bytes").over(inside)).drop("_step", "_before")


def _excess(rows: DataFrame) -> Column:
    return F.lit((rows.agg(F.sum("size_bytes")).first()[0] or 0) // 4)


def cache_evict_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose running total stays within the excess, oldest and cheapest first; ties share a total, so too few may go."""
    rows = entries(spark, sf_dir)
    return with_running_total(rows, ["render_cost"], ties=True).where(F.col("rt") <= _excess(rows)).select("cache_key", "rt")


def cache_evict_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many of the oldest, cheapest entries as free the excess."""
    rows = entries(spark, sf_dir)
    kept = with_running_total(rows, ["render_cost", "cache_key"], ties=False).where(F.col("rt") - F.col("size_bytes") < _excess(rows))
    return kept.select("cache_key", "size_bytes", "rt")


def cache_drop_to_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maintenance recipe as it stands, for two limits: all entries go if the total is within the limit, none if it is not."""
    rows = entries(spark, sf_dir)
    total = rows.agg(F.sum("size_bytes")).first()[0] or 0
    limits = F.explode(F.array(F.lit(1_000_000), F.lit(10**15)).cast("array<long>")).alias("most")
    return rows.select("cache_key", limits).where(F.lit(total) <= F.col("most"))


QUERIES = {"cache_evict_reference": cache_evict_reference, "cache_evict_fit": cache_evict_fit, "cache_drop_to_limit": cache_drop_to_limit}
