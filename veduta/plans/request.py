"""A thumbnail request from URL to result, end to end: guard, limit, cache, connection, sniffing, routing, quota, result and trace.

Requests are the events: each asks for the page numbered by its id modulo the number of pages, by its real URL (one in 17 for an inside address).
The event's type stands for the upstream status. A page's html is the file, or for one in five pages a PNG signature; its Content-Type is text/html for
one page in three. Tokens, cache entries and quota follow from ids as ``_REQUESTS`` says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hosts, sniff, tables, urls

NOW, LIMIT, SMALL = 1_704_067_200, 12, 80 << 10
HTML_REFUSED = "source returned HTML (likely an error page, not media)"
NO_RENDERER, OVER_QUOTA, OVER_LIMIT = "no higher-tier renderer is configured", "render quota reached", f"batch limited to {LIMIT} items per request"

_STATUS = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 304 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 200 ELSE 503 END"
_REQUESTS = f"""
SELECT e.event_id, e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS idx, p.page_id,
  CASE WHEN e.event_id % 17 = 0 THEN 'http://10.0.0.1/x.png' ELSE p.url END AS url, {_STATUS} AS http,
  CASE WHEN e.event_id % 11 = 0 THEN {NOW + 60} WHEN e.event_id % 11 = 1 THEN {NOW - 60} END AS client_expiry,
  CASE WHEN p.page_id % 4 = 0 THEN CASE WHEN p.page_id % 8 = 0 THEN {NOW + 100} ELSE {NOW - 100} END END AS entry_expiry,
  CASE WHEN e.event_id % 3 = 0 THEN {NOW} + e.event_id % 9000 END AS response_expiry,
  CASE WHEN p.page_id % 3 = 0 THEN 'text/html; charset=utf-8' WHEN p.page_id % 3 = 1 THEN 'application/octet-stream' END AS content_type,
  CASE WHEN p.page_id % 5 = 0 THEN '89504E470D0A1A0A0000000D' ELSE HEAD END AS head, BYTES AS size, e.user_id % 10 = 0 AS over_quota
FROM (SELECT *, (SELECT count(*) FROM PAGES) AS n_pages FROM EVENTS) e JOIN PAGES p ON e.event_id % e.n_pages = p.page_id
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, idx (place in the user's batch), page_id, url, http, expiries, content_type, head (hex), size, over_quota."""
    text = _REQUESTS.replace("EVENTS", f"parquet.`{sf_dir}/events.parquet`").replace("PAGES", f"parquet.`{sf_dir}/pages.parquet`")
    return spark.sql(text.replace("HEAD", "hex(encode(left(p.html, 512), 'UTF-8'))").replace("BYTES", "octet_length(p.html)"))


def run(rows: DataFrame, account: str = "acct") -> DataFrame:
    """A result and trace row for each request: one row in, one out. Row by row but for the batch limit, which ``requests`` numbers.

    What decides first: the batch limit, the guard, the client's own freshness, a fresh cache entry, the connection's answer, the entry that the answer
    confirms, the file's kind, the cheap way for small images, the quota, and last the want of a renderer.
    """
    guarded = hosts.guard(F.col("url"), F.lit(False))
    fresh = lambda c: F.coalesce(F.col(c) > NOW, F.lit(False))
    cached = F.col("entry_expiry").isNotNull()
    status, message, _ = urls.http_answer(F.col("http"))
    html = (status == "processing") & F.coalesce(F.startswith("content_type", F.lit("text/html")), F.lit(False))
    x = rows.withColumn("error", guarded["error"]).withColumn("f", sniff.sniff(F.col("head"), F.col("url"), F.col("content_type")))
    small = (F.col("f.kind") == "image") & F.col("f.ext").isin(*next(n for k, _, n in tables.SHORTCUTS if k == "small").split()) & (F.col("size") <= SMALL)
    stage = (
        F.when(F.col("idx") > LIMIT, F.lit("limit"))
        .when(F.col("error").isNotNull(), F.lit("refused"))
        .when(fresh("client_expiry"), F.lit("client_fresh"))
        .when(cached & fresh("entry_expiry"), F.lit("entry_fresh"))
        .when((status == "fresh") & cached, F.lit("revalidated"))
        .when(status == "fresh", F.lit("not_modified"))
        .when(status == "overloaded", F.lit("overloaded"))
        .when((status == "failed") | html, F.lit("failed"))
        .when(cached & fresh("response_expiry"), F.lit("confirmed"))
        .when(small, F.lit("small"))
        .when(F.col("over_quota"), F.lit("quota"))
        .otherwise(F.lit("unrendered"))
    )
    x = x.withColumn("stage", stage).withColumn("canonical", urls.col(urls.canonical("url")))
    at = lambda *names: F.col("stage").isin(*names)
    seen = at("entry_fresh", "revalidated", "confirmed", "small", "quota", "unrendered")
    connected = ~at("limit", "refused", "client_fresh", "entry_fresh")
    trace = (
        F.when(at("client_fresh", "not_modified", "revalidated"), F.lit("not_modified"))
        .when(at("unrendered"), F.lit("placeholder"))
        .when(at("overloaded", "failed", "quota"), F.lit("fallback"))
        .when(at("small"), F.lit("shortcut"))
        .when(at("entry_fresh", "confirmed"), F.lit("render"))
    )
    hint = F.col("response_expiry")
    manifest = [(f"{k}/{e}", min(t for k2, t, _, _, e2 in tables.format_rows() if (k2, e2) == (k, e))) for k, _, _, _, e in tables.format_rows()]
    tiers = F.create_map(*[F.lit(v) for row in dict(manifest).items() for v in row])
    kinds = F.create_map(*[F.lit(v) for row in tables.DEFAULT_TIER.items() for v in row])
    tier = F.coalesce(F.try_element_at(tiers, F.concat_ws("/", "f.kind", "f.ext")), F.try_element_at(kinds, F.col("f.kind")))
    return x.select(
        "event_id", "idx", "stage", F.when(~at("refused", "limit"), F.col("canonical")).alias("canonical_url"),
        F.when(at("limit"), F.lit("batch_limit")).when(at("refused", "failed"), F.lit("failed")).when(at("overloaded"), F.lit("overloaded")).otherwise(F.lit("success")).alias("status"),
        F.when(connected, F.col("http")).alias("http_status"),
        F.when(at("entry_fresh", "revalidated", "confirmed"), F.lit("cache")).otherwise(trace).alias("source"), trace.alias("trace_source"),
        F.when(at("limit"), F.lit(OVER_LIMIT)).when(at("refused"), F.col("error")).when(at("failed"), F.coalesce(message, F.lit(HTML_REFUSED)))
        .when(at("quota"), F.lit(OVER_QUOTA)).when(at("unrendered"), F.lit(NO_RENDERER)).alias("message"),
        F.when(seen, F.col("f.kind")).alias("kind"), F.when(seen, F.col("f.ext")).alias("extension"), F.when(at("small", "quota", "unrendered"), tier).alias("tier"),
        F.when(at("quota", "unrendered"), F.col("f.kind")).when(at("failed"), F.lit("failed")).when(at("overloaded"), F.lit("unknown")).alias("placeholder"),
        F.when(at("quota"), F.greatest(F.coalesce(hint, F.lit(0)), F.lit(NOW + 3600))).when(at("unrendered"), F.lit(NOW + 86400))
        .when(at("small"), F.least(F.coalesce(hint, F.lit(NOW + 3600)), F.lit(NOW + 604800))).cast("long").alias("expires_at"),
        F.when(~at("refused", "limit"), urls.col(urls.cache_key(f"'{account}'", "canonical"))).alias("cache_key"),
    )


def request_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(requests(spark, sf_dir))


def request_trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces counted by kind and source, with totals."""
    return request_results(spark, sf_dir).rollup("kind", "trace_source").agg(F.count("*").alias("items"))


_DUCK = _REQUESTS.replace("EVENTS", "events").replace("PAGES", "pages").replace("HEAD", "hex(encode(left(p.html, 512)))").replace("BYTES", "octet_length(encode(p.html))")
_RESULTS = f"""
WITH q AS ({_DUCK}),
-- every page's html begins as HTML does; the others are PNG files
g AS (SELECT *, page_id % 5 = 0 AS png, coalesce(entry_expiry > {NOW}, FALSE) AS hit, entry_expiry IS NOT NULL AS cached,
  CASE WHEN http = 200 AND coalesce(starts_with(content_type, 'text/html'), FALSE) THEN 'html' WHEN http = 200 THEN 'ok' WHEN http = 304 THEN 'same' WHEN http = 404 THEN 'gone' ELSE 'busy' END AS answer FROM q),
s AS (SELECT *, CASE WHEN idx > {LIMIT} THEN 'limit' WHEN event_id % 17 = 0 THEN 'refused' WHEN event_id % 11 = 0 THEN 'client_fresh' WHEN hit THEN 'entry_fresh'
  WHEN answer = 'same' AND cached THEN 'revalidated' WHEN answer = 'same' THEN 'not_modified' WHEN answer = 'busy' THEN 'overloaded' WHEN answer IN ('gone', 'html') THEN 'failed'
  WHEN cached AND response_expiry > {NOW} THEN 'confirmed' WHEN png AND size <= 81920 THEN 'small' WHEN over_quota THEN 'quota' ELSE 'unrendered' END AS stage,
  regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '') AS bare FROM g),
r AS (SELECT *, lower(regexp_extract(bare, '^[^:]*://[^/]*')) || regexp_extract(bare, '^[^:]*://[^/]*(.*)$', 1) AS canonical_url FROM s)
SELECT event_id, idx, stage, CASE WHEN stage NOT IN ('refused', 'limit') THEN canonical_url END AS canonical_url,
  CASE stage WHEN 'limit' THEN 'batch_limit' WHEN 'refused' THEN 'failed' WHEN 'failed' THEN 'failed' WHEN 'overloaded' THEN 'overloaded' ELSE 'success' END AS status,
  CASE WHEN stage NOT IN ('limit', 'refused', 'client_fresh', 'entry_fresh') THEN http END AS http_status,
  CASE stage WHEN 'client_fresh' THEN 'not_modified' WHEN 'not_modified' THEN 'not_modified' WHEN 'entry_fresh' THEN 'cache' WHEN 'revalidated' THEN 'cache' WHEN 'confirmed' THEN 'cache'
    WHEN 'overloaded' THEN 'fallback' WHEN 'failed' THEN 'fallback' WHEN 'quota' THEN 'fallback' WHEN 'small' THEN 'shortcut' WHEN 'unrendered' THEN 'placeholder' END AS source,
  CASE stage WHEN 'client_fresh' THEN 'not_modified' WHEN 'not_modified' THEN 'not_modified' WHEN 'entry_fresh' THEN 'render' WHEN 'revalidated' THEN 'not_modified' WHEN 'confirmed' THEN 'render'
    WHEN 'overloaded' THEN 'fallback' WHEN 'failed' THEN 'fallback' WHEN 'quota' THEN 'fallback' WHEN 'small' THEN 'shortcut' WHEN 'unrendered' THEN 'placeholder' END AS trace_source,
  CASE stage WHEN 'limit' THEN '{OVER_LIMIT}' WHEN 'refused' THEN '{hosts.PRIVATE_REFUSED}' WHEN 'failed' THEN CASE WHEN http = 404 THEN 'source not found' ELSE '{HTML_REFUSED}' END
    WHEN 'quota' THEN '{OVER_QUOTA}' WHEN 'unrendered' THEN '{NO_RENDERER}' END AS message,
  CASE WHEN stage IN ('entry_fresh', 'revalidated', 'confirmed', 'small', 'quota', 'unrendered') THEN CASE WHEN png THEN 'image' ELSE 'document' END END AS kind,
  CASE WHEN stage IN ('entry_fresh', 'revalidated', 'confirmed', 'small', 'quota', 'unrendered') THEN CASE WHEN png THEN 'png' ELSE 'html' END END AS extension,
  CASE WHEN stage IN ('small', 'quota', 'unrendered') THEN CASE WHEN png THEN 1 ELSE 2 END END AS tier,
  CASE WHEN stage IN ('quota', 'unrendered') THEN CASE WHEN png THEN 'image' ELSE 'document' END WHEN stage = 'failed' THEN 'failed' WHEN stage = 'overloaded' THEN 'unknown' END AS placeholder,
  CASE stage WHEN 'quota' THEN greatest(coalesce(response_expiry, 0), {NOW + 3600}) WHEN 'unrendered' THEN {NOW + 86400} WHEN 'small' THEN coalesce(response_expiry, {NOW + 3600}) END::BIGINT AS expires_at,
  CASE WHEN stage NOT IN ('refused', 'limit') THEN 'acct/' || rtrim(translate(to_base64(unhex(sha256('v5:acct:' || canonical_url))), '+/', '-_'), '=') END AS cache_key
FROM r
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"request_results": request_results, "request_trace_rollup": request_trace_rollup}
SQL = {"request_results": _RESULTS, "request_trace_rollup": f"SELECT kind, trace_source, count(*) AS items FROM ({_RESULTS}) GROUP BY ROLLUP (kind, trace_source)"}
