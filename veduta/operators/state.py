"""Keyed time-to-live state over request logs as folds, and hint queries that need folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hints

NOW = 1_704_067_200


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", at.alias("at"))


def suppressed(log: DataFrame, key: str, ttl: Column, records: Column | None = None) -> DataFrame:
    """Rows of (key, at, event_id) with ``fetched``: false while an earlier fetched, recorded row's ttl lasts.

    What is suppressed does not extend the ttl, so this is no window function but a fold in time order over each key. Rows are dealt by key
    and sorted by key and time, and one pass holds one number: a key of any number of rows takes constant memory (and one task).
    """
    rows = log.select(key, "at", "event_id", ttl.cast("long").alias("_ttl"), (F.lit(True) if records is None else records).alias("_rec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = object(), 0
        for b in batches:
            fetched = []
            for k, at, lasts, recorded in zip(*(b.column(c).to_pylist() for c in (key, "at", "_ttl", "_rec")), strict=True):
                if k != last:
                    last, until = k, -(1 << 62)
                live = at >= until
                if live and recorded:
                    until = at + lasts
                fetched.append(live)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("event_id"), pa.array(fetched, pa.bool_())], names=[key, "event_id", "fetched"])

    kind = dict(rows.dtypes)[key]
    dealt = rows.repartition(key).sortWithinPartitions(key, "at", "event_id")
    return dealt.mapInArrow(run, f"{key} {kind}, event_id long, fetched boolean")


def url_failure_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a failure of its user's URL; six hours of suppression."""
    return suppressed(_log(spark, sf_dir), "user_id", F.lit(21600))


def origin_backoff_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases back their user off for Retry-After seconds, at most the ceiling."""
    log = _log(spark, sf_dir)
    return suppressed(log, "user_id", F.least(F.col("event_id") % 40 * 1800, F.lit(36000)), F.col("event_type").isin("error", "purchase"))


def sticky_cache_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a short-lived cache per user and type, an hour from each store."""
    out = suppressed(_log(spark, sf_dir).withColumn("k", F.concat_ws("/", "user_id", "event_type")), "k", F.lit(3600))
    return out.groupBy("k").agg(F.count_if("fetched").alias("stores"), F.count_if(~F.col("fetched")).alias("hits"))


_HEADERS = (
    "CASE event_id % 7 WHEN 0 THEN 'max-age=100, s-maxage=50' WHEN 1 THEN 'no-store' WHEN 2 THEN 'public, max-age=600, stale-while-revalidate=30' WHEN 3 THEN 'private, max-age=5' "
    "WHEN 4 THEN 'immutable, max-age=31536000' WHEN 5 THEN 'max-age=oops' ELSE NULL END"
)


def _hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    headers = F.create_map(
        F.lit("cache-control"), F.expr(_HEADERS), F.lit("age"), F.when(F.col("event_id") % 2 == 0, F.lit("20")),
        F.lit("etag"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\"e"), F.col("user_id").cast("string"), F.lit("\""))),
        F.lit("last-modified"), F.when(F.col("event_id") % 5 == 0, F.lit("Thu, 01 Jan 2026 00:00:00 GMT")),
    )
    return events.select("event_id", hints.from_headers(headers, NOW).alias("h"))


def hints_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hints(spark, sf_dir).select("event_id", "h.expires_at", "h.stale_while_revalidate", "h.immutable", "h.etag", "h.last_modified", "h.no_store", "h.private")


def hints_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hints.conditional(F.col("h"))
    return _hints(spark, sf_dir).select("event_id", hints.is_fresh(F.col("h.expires_at"), NOW + 60).alias("fresh"), c["name"].alias("header"), c["value"].alias("value"))


def hints_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hints(spark, sf_dir).select("event_id", hints.encode(F.col("h"), 60, NOW).alias("token"))


def hints_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens decoded again: the fields that a token carries."""
    d = _hints(spark, sf_dir).where("h IS NOT NULL").select("event_id", hints.decode(hints.encode(F.col("h"), 60, NOW)).alias("d"))
    return d.select("event_id", "d.expires_at", "d.stale_while_revalidate", "d.immutable", "d.etag", "d.last_modified")


_FOLD = """
WITH RECURSIVE e AS (SELECT {key} AS k, event_id, {at} AS t, {ttl} AS ttl, {rec} AS rec FROM {source}),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS r FROM e),
f AS (SELECT k, event_id, r, TRUE AS fetched, CASE WHEN rec THEN t + ttl ELSE -4611686018427387904 END AS until FROM o WHERE r = 1
  UNION ALL SELECT o.k, o.event_id, o.r, o.t >= f.until, CASE WHEN o.t >= f.until AND o.rec THEN o.t + o.ttl ELSE f.until END FROM f JOIN o ON o.k = f.k AND o.r = f.r + 1)
"""


def _fold(key: str, ttl: str, rec: str = "TRUE") -> str:
    return _FOLD.replace("{key}", key).replace("{at}", "{sec}").replace("{ttl}", ttl).replace("{rec}", rec).replace("{source}", "{events}")


_H = f"""
WITH c AS (SELECT event_id, user_id, {_HEADERS} AS cc, CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END AS age FROM {{events}}),
d AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(cc, 's-maxage=([0-9]+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(cc, 'max-age=([0-9]+)', 1), '') AS BIGINT)) AS ma,
  try_cast(nullif(regexp_extract(cc, 'stale-while-revalidate=([0-9]+)', 1), '') AS BIGINT) AS swr, coalesce(cc LIKE '%immutable%', FALSE) AS imm, coalesce(cc LIKE '%no-store%', FALSE) AS ns, coalesce(cc LIKE '%private%', FALSE) AS pr,
  CASE WHEN event_id % 3 = 0 THEN concat('"e', user_id, '"') END AS etag FROM c),
h AS (SELECT *, CASE WHEN ma IS NOT NULL THEN {NOW} + greatest(0, ma - age) END AS exp, CASE WHEN etag IS NULL AND event_id % 5 = 0 THEN 'Thu, 01 Jan 2026 00:00:00 GMT' END AS lm FROM d),
k AS (SELECT *, ma IS NOT NULL OR swr IS NOT NULL OR imm OR ns OR pr OR etag IS NOT NULL OR lm IS NOT NULL AS known FROM h)
"""
QUERIES = {
    "url_failure_debounce": url_failure_debounce, "origin_backoff_fold": origin_backoff_fold, "sticky_cache_fold": sticky_cache_fold,
    "hints_parse": hints_parse, "hints_fresh": hints_fresh, "hints_encode": hints_encode, "hints_roundtrip": hints_roundtrip,
}
SQL = {
    "url_failure_debounce": _fold("user_id", "21600") + "SELECT k AS user_id, event_id, fetched FROM f",
    "origin_backoff_fold": _fold("user_id", "least(event_id % 40 * 1800, 36000)", "event_type IN ('error', 'purchase')") + "SELECT k AS user_id, event_id, fetched FROM f",
    "sticky_cache_fold": _fold("concat(user_id, '/', event_type)", "3600") + "SELECT k, count(*) FILTER (WHERE fetched) AS stores, count(*) FILTER (WHERE NOT fetched) AS hits FROM f GROUP BY k",
    "hints_parse": _H + "SELECT event_id, CASE WHEN known THEN exp END AS expires_at, swr AS stale_while_revalidate, CASE WHEN known THEN imm END AS immutable, etag, lm AS last_modified, CASE WHEN known THEN ns END AS no_store, CASE WHEN known THEN pr END AS private FROM k",
    "hints_fresh": _H + f"SELECT event_id, coalesce({NOW + 60} < exp, FALSE) AS fresh, CASE WHEN etag IS NOT NULL THEN 'if-none-match' WHEN lm IS NOT NULL THEN 'if-modified-since' END AS header, coalesce(etag, lm) AS value FROM k",
    "hints_roundtrip": _H + f"SELECT event_id, CASE WHEN NOT ns AND NOT pr THEN coalesce(exp, CASE WHEN etag IS NOT NULL OR lm IS NOT NULL THEN 1 ELSE {NOW + 60} END) END AS expires_at, CASE WHEN NOT ns AND NOT pr THEN swr END AS stale_while_revalidate, CASE WHEN NOT ns AND NOT pr THEN imm END AS immutable, CASE WHEN NOT ns AND NOT pr THEN etag END AS etag, CASE WHEN NOT ns AND NOT pr THEN lm END AS last_modified FROM k WHERE known",
}
