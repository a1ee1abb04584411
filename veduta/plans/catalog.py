"""Registered queries: one text per query that Spark and DuckDB both run, over the driver's tables.

The engine's own inputs (requests, fetches, cache entries) are derived from those tables by fixed rules, stated per query:
pages.url stands for requested URLs, events for a log of requests by user (the cache key), lineitem per order for container streams.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import tables, urls
from ..functions.dialect import to

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
#: The fixed clock of all queries, Unix seconds.
NOW = 1_704_067_200
SEC = {
    "spark": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
    "duckdb": "cast(floor(epoch(ts)) AS BIGINT)",
}
WHOLE = {"spark": "div", "duckdb": "//"}


def _values(rows, names: str) -> str:
    lit = lambda v: ("TRUE" if v else "FALSE") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names}))"


FORMATS = _values(tables.format_rows(), "kind, tier, renderer, shortcut, ext")
KINDS = _values(tables.kind_rows(), "ext, kind")
MIMES = _values(tables.mime_rows(), "ext, mime")
EXTENSIONS = _values(tables.extension_rows(), "mime, ext")
DEFAULTS = _values(list(tables.DEFAULT_TIER.items()), "kind, tier")
BACKENDS = _values([("libav", True), ("ffmpeg_cli", False), ("pdftoppm", True), ("f3d", False), ("image_crate", True), ("builtin", True), ("raw_preview", True)], "renderer, available")


def text_for(engine: str, text: str, sf_dir: str = "") -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`" if engine == "spark" else t)
    text = text.replace("{sec}", SEC[engine]).replace("{div}", WHOLE[engine])
    text = re.sub(r"ARRAY_LEN\(", "size(" if engine == "spark" else "len(", text)
    text = re.sub(r"BYTES\(([^()]*)\)", r"octet_length(\1)" if engine == "spark" else r"octet_length(encode(\1))", text)
    text = re.sub(r"FOLD\(([^|]*)\|([^|]*)\|([^|]*)\)", r"aggregate(\1, \2, \3)" if engine == "spark" else r"list_reduce(\1, lambda \3, \2)", text)
    return to(engine, text)


U, X = "url", urls.extension("url")
_EXT_OF_ID = "CASE page_id % 12 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'pdf' WHEN 3 THEN 'mp4' WHEN 4 THEN 'stp' WHEN 5 THEN 'zip' WHEN 6 THEN 'svg' WHEN 7 THEN 'mp3' WHEN 8 THEN 'docx' WHEN 9 THEN 'exr' WHEN 10 THEN 'qoi' ELSE 'unheard' END"
_ITEM = f"SELECT page_id, {urls.alias('raw_ext')} AS ext FROM (SELECT page_id, {_EXT_OF_ID} AS raw_ext FROM {{pages}}) r"
_KINDED = f"SELECT i.page_id, i.ext, coalesce(k.kind, 'unknown') AS kind FROM ({_ITEM}) i LEFT JOIN {KINDS} k ON i.ext = k.ext"
_ROUTED = (
    f"SELECT i.page_id, i.ext, i.kind, coalesce(m.tier, d.tier) AS tier, m.tier IS NOT NULL AS listed FROM ({_KINDED}) i "
    f"LEFT JOIN (SELECT kind, ext, min(tier) AS tier FROM {FORMATS} GROUP BY kind, ext) m ON i.kind = m.kind AND i.ext = m.ext LEFT JOIN {DEFAULTS} d ON i.kind = d.kind"
)
_STATUS = "SELECT event_id, user_id, {sec} AS at, event_type, value, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 304 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE 503 END AS http FROM {events}"
_MIME = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' WHEN 2 THEN 'text/html' WHEN 3 THEN 'text/x-log' WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'application/zip' WHEN 6 THEN 'model/stl' WHEN 7 THEN 'video/mp4' ELSE 'application/x-unheard' END AS mime FROM {pages}"
#: A cache as of its log: a key per user, size and cost from its requests.
_ENTRIES = (
    "SELECT user_id AS cache_key, max({sec}) AS last_accessed_at, count(*) AS access_count, cast(sum(floor(abs(value) * 100)) AS BIGINT) AS size_bytes, "
    "cast(max(event_id % 7) AS INT) AS render_cost, min({sec}) + 86400 AS expires_at FROM {events} GROUP BY user_id"
)
_EXCESS = f"SELECT cast(floor(sum(size_bytes) / 4) AS BIGINT) AS excess FROM ({_ENTRIES}) x"
_FIT = "SELECT l_orderkey, l_linenumber, l_partkey % 1900 + 1 AS w, l_suppkey * 7 % 1700 + 1 AS h FROM {lineitem}"
_F = lambda a, b: f"cast(cast({a} AS FLOAT) / cast({b} AS FLOAT) AS FLOAT)"
_R = lambda e: f"cast(floor(cast({e} AS FLOAT) + cast(0.5 AS FLOAT)) AS INT)"
_FIT_SQL = f"""
WITH s AS ({_FIT}),
a AS (SELECT *, least({_F('250', 'w')}, {_F('200', 'h')}) AS fit, greatest({_F('250', 'w')}, {_F('200', 'h')}) AS fill, {_F('w', 'h')} AS ar FROM s),
b AS (SELECT *, greatest(1, least(250, {_R('cast(w AS FLOAT) * fit')})) AS fw, greatest(1, least(200, {_R('cast(h AS FLOAT) * fit')})) AS fh, cast(fit / cast(0.9 AS FLOAT) AS FLOAT) AS most FROM a),
c AS (SELECT *, CASE WHEN ar >= 1.0 AND ar <= 1.5 THEN fill ELSE least(fill, most) END AS blend, {_F('120', 'h')} AS sh, {_F('150', 'w')} AS sw FROM b),
d AS (SELECT l_orderkey, l_linenumber, w, h,
  CASE WHEN fh < 120 THEN greatest(250, {_R('cast(w AS FLOAT) * sh')}) WHEN fw < 150 THEN 150 ELSE greatest(1, {_R('cast(w AS FLOAT) * blend')}) END AS resize_w,
  CASE WHEN fh < 120 THEN 120 WHEN fw < 150 THEN greatest(200, {_R('cast(h AS FLOAT) * sw')}) ELSE greatest(1, {_R('cast(h AS FLOAT) * blend')}) END AS resize_h FROM c)
SELECT l_orderkey, l_linenumber, w, h, resize_w, resize_h, least(resize_w, 250) AS crop_w, least(resize_h, 200) AS crop_h FROM d
"""
_PIX = "SELECT p_partkey, CASE p_size % 11 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' WHEN 2 THEN 'yuv422p' WHEN 3 THEN 'yuv422p12le' WHEN 4 THEN 'yuv444p10le' WHEN 5 THEN 'rgb24' WHEN 6 THEN 'gray' WHEN 7 THEN 'gray10le' WHEN 8 THEN 'rgb48' WHEN 9 THEN 'yuv444p' ELSE 'nv12' END AS f FROM {part}"
_EIGHT = "f NOT LIKE '%p10%' AND f NOT LIKE '%p12%' AND f NOT LIKE '%p16%'"
_KIND_ORDER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate([*tables.KINDS, "binary", "unknown"])) + " END"

SAME: dict[str, str] = {
    # URL and string scalars
    "url_canonicalize": f"SELECT page_id, {urls.canonical(U)} AS canonical_url FROM {{pages}}",
    "url_canonicalize_twice": f"SELECT page_id, {urls.canonical('c')} AS again, c AS once FROM (SELECT page_id, {urls.canonical(U)} AS c FROM {{pages}}) x",
    "url_origin": f"SELECT page_id, {urls.origin(U)} AS origin FROM {{pages}}",
    "url_extension": f"SELECT page_id, {X} AS raw_ext, {urls.alias(X)} AS ext FROM {{pages}}",
    "url_private_host": f"SELECT s_suppkey, h, {urls.private_host('h')} AS private FROM (SELECT s_suppkey, concat(CASE s_suppkey % 4 WHEN 0 THEN '10.' WHEN 1 THEN '172.' WHEN 2 THEN '192.' ELSE '127.' END, s_suppkey % 40, '.', s_suppkey % 200, '.1') AS h FROM {{supplier}}) x",
    "url_host_allowlist": f"SELECT page_id, {urls.host_allowed(urls.host(U), ['example.com', '*.example.net'])} AS allowed FROM {{pages}}",
    "url_query_value": f"SELECT page_id, {urls.query_value(U, 'page')} AS page, {urls.query_value(U, 'ref')} AS ref FROM {{pages}}",
    "parse_mem_size": f"SELECT p_partkey, s, {urls.mem_size('s')} AS size FROM (SELECT p_partkey, concat(p_size, CASE p_partkey % 6 WHEN 0 THEN 'mb' WHEN 1 THEN 'GB' WHEN 2 THEN ' kb' WHEN 3 THEN '' WHEN 4 THEN 'xb' ELSE '00' END) AS s FROM {{part}}) x",
    "cache_key_sha256": f"SELECT page_id, {urls.cache_key(chr(39) + 'acct' + chr(39), 'c')} AS cache_key FROM (SELECT page_id, {urls.canonical(U)} AS c FROM {{pages}}) x",
    "meta_page_count": "SELECT page_id, try_cast(regexp_extract(m, 'page-count=\"([0-9]{1,9})\"', 1) AS BIGINT) AS pages FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<meta/>' ELSE concat('<meta page-count=\"', page_id % 400, '\" image-count=\"1\"/>') END AS m FROM {pages}) x",
    # classification and routing
    "ext_alias_kind_mime": f"SELECT i.page_id, i.ext, coalesce(k.kind, 'unknown') AS kind, coalesce(m.mime, 'application/octet-stream') AS mime FROM ({_ITEM}) i LEFT JOIN {KINDS} k ON i.ext = k.ext LEFT JOIN {MIMES} m ON i.ext = m.ext",
    "mime_to_extension": f"SELECT p.page_id, p.mime, coalesce(e.ext, 'bin') AS ext FROM ({_MIME}) p LEFT JOIN {EXTENSIONS} e ON p.mime = e.mime",
    "mime_to_kind": f"SELECT p.page_id, p.mime, CASE WHEN p.mime LIKE 'image/%' THEN CASE WHEN e.ext = 'svg' THEN 'vector' ELSE 'image' END WHEN p.mime LIKE 'video/%' THEN 'video' WHEN p.mime LIKE 'audio/%' THEN 'audio' "
    "WHEN p.mime IN ('text/html', 'application/xhtml+xml') THEN 'document' WHEN p.mime LIKE 'text/%' THEN 'text' WHEN p.mime IN ('application/zip', 'application/x-tar', 'application/gzip', 'application/x-bzip2', 'application/x-xz', 'application/vnd.rar', 'application/x-7z-compressed') THEN 'archive' "
    f"ELSE coalesce(k.kind, 'unknown') END AS kind FROM ({_MIME}) p LEFT JOIN {EXTENSIONS} e ON p.mime = e.mime LEFT JOIN {KINDS} k ON e.ext = k.ext",
    "lossless_flags": f"SELECT page_id, ext, ext IN ('png', 'bmp', 'tiff', 'gif', 'ico', 'tga', 'exr') AS lossless_image, ext IN ('flac', 'wav', 'aiff', 'aif', 'alac', 'ape', 'wv') AS lossless_audio FROM ({_ITEM}) x",
    "route_min_tier": f"SELECT page_id, ext, kind, tier, listed FROM ({_ROUTED}) x",
    "handoff_tier_sequence": f"SELECT page_id, kind, tier, CASE WHEN tier = 1 AND kind = 'image' THEN 2 ELSE greatest(tier, 2) END AS first_try, 4 - CASE WHEN tier = 1 AND kind = 'image' THEN 2 ELSE greatest(tier, 2) END AS tries FROM ({_ROUTED}) x",
    "formats_by_kind": f"SELECT kind, count(*) AS formats, count(DISTINCT ext) AS extensions, min(tier) AS lowest, sum(CASE WHEN shortcut THEN 1 ELSE 0 END) AS shortcuts, min({_KIND_ORDER}) AS kind_order FROM {FORMATS} f GROUP BY kind",
    "formats_rollup": f"SELECT kind, tier, count(*) AS formats FROM {FORMATS} f GROUP BY ROLLUP (kind, tier)",
    "formats_lowest_entry": f"SELECT kind, ext, tier, renderer FROM (SELECT *, row_number() OVER (PARTITION BY kind, ext ORDER BY tier) AS r FROM {FORMATS} f) x WHERE r = 1",
    "formats_unavailable": f"SELECT f.kind, f.ext, f.renderer FROM {FORMATS} f LEFT ANTI JOIN (SELECT renderer FROM {BACKENDS} b WHERE available) b ON f.renderer = b.renderer",
    "handlers_available": f"SELECT f.kind, f.ext, f.tier, f.renderer FROM {FORMATS} f LEFT SEMI JOIN (SELECT renderer FROM {BACKENDS} b WHERE available) b ON f.renderer = b.renderer",
    "backend_summary": f"SELECT available, count(*) AS backends, min(renderer) AS first_name, max(renderer) AS last_name FROM {BACKENDS} b GROUP BY available",
    "sniff_html_svg_prefix": "SELECT page_id, REGEX(lower(left(html, 4096)), '^[ \t\r\n]*(<!doctype html|<html)') AS is_html, REGEX(lower(left(html, 4096)), '<svg[ \t\r\n>/]') AS is_svg FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN concat('<?xml version=\"1.0\"?><SVG width=\"1\">', left(html, 50)) ELSE html END AS html FROM {pages}) x",
    "magic_prefix_join": "SELECT p.page_id, m.ext FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '89504E470D0A1A0A00' WHEN 1 THEN 'FFD8FFE000104A46' WHEN 2 THEN '474946383961' ELSE '00000000' END AS head FROM {pages}) p LEFT JOIN " + _values([("png", 0, "89504E470D0A1A0A"), ("jpeg", 0, "FFD8FF"), ("gif", 0, "474946")], "ext, off, magic") + " m ON substring(p.head, cast(m.off * 2 + 1 AS INT), cast(length(m.magic) AS INT)) = m.magic",
    "html_error_filter": "SELECT page_id, mime, mime LIKE 'text/html%' AS refused FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'text/html; charset=utf-8' ELSE 'image/png' END AS mime FROM {pages}) x",
    "result_source": f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'cache' WHEN http = 304 THEN 'not_modified' WHEN event_id % 7 = 0 THEN 'placeholder' WHEN http >= 400 THEN 'fallback' WHEN event_id % 2 = 0 THEN 'shortcut' ELSE 'render' END AS result_source, CASE WHEN http = 304 THEN 'not_modified' WHEN event_id % 7 = 0 THEN 'placeholder' WHEN http >= 400 THEN 'fallback' WHEN event_id % 2 = 0 THEN 'shortcut' ELSE 'render' END AS trace_source FROM ({_STATUS}) x",
    # batches
    "batch_limit": "SELECT user_id, event_id, r <= 12 AS processed FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {events}) x",
    "batch_union_overflow": "SELECT conv_id, turn, 'batch_limit' AS status FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}) x WHERE r > 3 UNION ALL SELECT conv_id, turn, 'processing' FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}) x WHERE r <= 3",
    "single_flight_leaders": "SELECT user_id, min(event_id) AS leader, count(*) AS requests FROM {events} GROUP BY user_id, event_type",
    "single_flight_fanout": "SELECT e.event_id, l.leader, e.event_id = l.leader AS leads FROM {events} e JOIN (SELECT user_id, event_type, min(event_id) AS leader FROM {events} GROUP BY user_id, event_type) l ON e.user_id = l.user_id AND e.event_type = l.event_type",
    # cache
    "cache_lookup_left": f"SELECT p.page_id, e.size_bytes, e.expires_at IS NOT NULL AND e.expires_at > {NOW} AS fresh FROM (SELECT page_id, page_id % 400 AS k FROM {{pages}}) p LEFT JOIN ({_ENTRIES}) e ON p.k = e.cache_key",
    "cache_sticky_then_durable": f"SELECT p.page_id, coalesce(s.size_bytes, d.size_bytes) AS size_bytes, CASE WHEN s.cache_key IS NOT NULL THEN 'sticky' WHEN d.cache_key IS NOT NULL THEN 'durable' ELSE 'miss' END AS hit FROM (SELECT page_id, page_id % 400 AS k FROM {{pages}}) p LEFT JOIN (SELECT * FROM ({_ENTRIES}) q WHERE cache_key % 3 = 0) s ON p.k = s.cache_key LEFT JOIN ({_ENTRIES}) d ON p.k = d.cache_key",
    "cache_resolution": f"SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not_modified' WHEN cached AND http <> 304 AND event_id % 3 = 0 THEN 'cache' WHEN http = 304 AND cached THEN 'cache' WHEN http = 304 THEN 'not_modified' WHEN http = 200 AND cached AND event_id % 2 = 0 THEN 'cache' ELSE 'fetch' END AS resolution FROM (SELECT event_id, http, user_id % 2 = 0 AS cached FROM ({_STATUS}) s) x",
    "cache_upsert": f"SELECT coalesce(n.user_id, o.cache_key) AS cache_key, coalesce(n.at, o.last_accessed_at) AS last_accessed_at, coalesce(o.access_count, 0) + CASE WHEN n.user_id IS NULL THEN 0 ELSE 1 END AS access_count FROM (SELECT * FROM ({_ENTRIES}) q WHERE cache_key % 2 = 0) o FULL OUTER JOIN (SELECT user_id, max({{sec}}) + 60 AS at FROM {{events}} WHERE event_type = 'view' GROUP BY user_id) n ON o.cache_key = n.user_id",
    "cache_touch": f"SELECT cache_key, CASE WHEN cache_key % 3 = 0 THEN {NOW} ELSE last_accessed_at END AS last_accessed_at, access_count + CASE WHEN cache_key % 3 = 0 THEN 1 ELSE 0 END AS access_count FROM ({_ENTRIES}) e",
    "cache_purge_expired": f"SELECT cache_key, expires_at FROM ({_ENTRIES}) e WHERE expires_at > (SELECT cast(floor(avg(expires_at)) AS BIGINT) FROM ({_ENTRIES}) a)",
    "cache_stats": f"SELECT count(*) AS entries, round(sum(size_bytes) / 1048576.0, 2) AS mb, min(last_accessed_at) AS oldest, max(last_accessed_at) AS newest FROM ({_ENTRIES}) e",
    "cache_drop_by_days": f"SELECT cache_key, last_accessed_at FROM ({_ENTRIES}) e WHERE last_accessed_at >= (SELECT max(last_accessed_at) - 2 * 86400 FROM ({_ENTRIES}) m)",
    "render_cost": "SELECT event_id, cast(floor(least(floor(abs(value) * 100), 1000) / 10) AS INT) AS render_cost FROM {events}",
    "cache_expires_at": f"SELECT event_id, least(coalesce(CASE WHEN event_id % 4 > 0 THEN {NOW} + user_id * 2000 END, {NOW} + 3600), {NOW} + 604800) AS expires_at FROM {{events}}",
    "placeholder_ttl": f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN greatest(3600, user_id % 9000) WHEN 1 THEN 86400 WHEN 2 THEN 900 ELSE user_id % 9000 END AS ttl FROM {{events}}",
    "retry_after": "SELECT event_id, coalesce(CASE WHEN REGEX(trim(h), '^[0-9]{1,15}$') THEN cast(trim(h) AS BIGINT) END, 60) AS seconds FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat(' ', user_id, ' ') WHEN 1 THEN 'Thu, 01 Jan 2026 00:00:00 GMT' END AS h FROM {events}) x",
    # layout and media arithmetic
    "fit_to_target": _FIT_SQL,
    "page_edge_thickness": "SELECT doc_id, greatest(2, least(10, cast(length(bin(n_chars {div} 500 + 1)) AS INT))) AS thickness FROM {documents}",
    "estimated_pages": "SELECT doc_id, greatest(1, n_chars {div} 11750) AS pages FROM {documents}",
    "progressive_budget": "SELECT p_partkey, CASE WHEN p_size = 7 THEN 262144 ELSE greatest(10240, (p_size * 100) * (p_partkey % 900 + 1) {div} 42) END AS bytes FROM {part}",
    "cover_scale": f"SELECT l_orderkey, l_linenumber, greatest({_F('250', 'w')}, {_F('200', 'h')}) AS scale FROM ({_FIT}) x",
    "probe_channels": "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS channels, min(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS video FROM {lineitem} GROUP BY l_orderkey",
    "pix_fmt_bpp": f"SELECT p_partkey, f, CASE WHEN f LIKE 'yuv420%' AND {_EIGHT} THEN 12 WHEN f LIKE 'yuv422%' AND {_EIGHT} THEN 16 WHEN f LIKE 'yuv444%' AND {_EIGHT} THEN 24 WHEN f LIKE 'yuv420p10%' THEN 15 WHEN f LIKE 'yuv422p10%' THEN 20 WHEN f LIKE 'yuv444p10%' THEN 30 WHEN f LIKE 'yuv420p12%' THEN 18 WHEN f LIKE 'yuv422p12%' THEN 24 WHEN f LIKE 'yuv444p12%' THEN 36 WHEN f IN ('rgb24', 'bgr24', 'gbrp', 'gbrp9') THEN 24 WHEN f IN ('rgb48', 'bgr48') THEN 48 WHEN f LIKE 'gray%10%' THEN 10 WHEN f LIKE 'gray%12%' THEN 12 WHEN f LIKE 'gray%16%' THEN 16 WHEN f LIKE 'gray%' THEN 8 ELSE 0 END AS bpp FROM ({_PIX}) x",
    "synchsafe_decode": "SELECT o_orderkey, (o_orderkey % 128) * 2097152 + (o_custkey % 128) * 16384 + (o_orderkey * 7 % 128) * 128 + o_custkey * 3 % 128 AS size FROM {orders}",
    "mp3_header_fields": "SELECT o_orderkey, CASE WHEN h {div} 2097152 <> 2047 OR (h {div} 131072) % 4 <> 1 THEN NULL ELSE (h {div} 524288) % 4 END AS version, (h {div} 4096) % 16 AS bitrate_index, (h {div} 1024) % 4 AS rate_index, CASE WHEN (h {div} 64) % 4 = 3 THEN 1 ELSE 2 END AS channels FROM (SELECT o_orderkey, 4292870144 + o_orderkey * 131 + (o_custkey % 2) * 131072 AS h FROM {orders}) x",
    "page_index_explode": "SELECT page_id, n, (n + 4095) {div} 4096 AS pages, n % 4096 AS tail FROM (SELECT page_id, BYTES(html) AS n FROM {pages}) x",
    "range_header": "SELECT page_id, least(try_cast(regexp_extract(r, 'bytes=([0-9]{1,15})-', 1) AS BIGINT), n) AS from_byte, least(coalesce(try_cast(regexp_extract(r, '-([0-9]{1,15})$', 1) AS BIGINT) + 1, n), n) AS to_byte FROM (SELECT page_id, BYTES(html) AS n, concat('bytes=', page_id % 900, '-', CASE WHEN page_id % 3 = 0 THEN '' ELSE cast(page_id % 900 + 2000 AS VARCHAR(9)) END) AS r FROM {pages}) x",
    "tail_fetch_decision": "SELECT page_id, off >= n - 61440 AND off - got > CASE WHEN page_id % 2 = 0 THEN 512000 ELSE 65536 END AND page_id % 5 <> 0 AS fetch_tail FROM (SELECT page_id, BYTES(html) * 200 AS n, BYTES(html) * 190 AS off, page_id * 100 AS got FROM {pages}) x",
    "alpha_composite": "SELECT p_partkey, ((p_size * 5 % 256) * a + (p_partkey % 256) * (255 - a) + 127) {div} 255 AS composed FROM (SELECT p_partkey, p_size, p_partkey * 13 % 256 AS a FROM {part}) x",
    "box_half_pixels": "SELECT p_partkey, (p_size + p_partkey % 256 + p_size * 3 % 256 + p_partkey * 5 % 256 + 2) {div} 4 AS pixel FROM {part}",
    "gamma_lut": "SELECT DISTINCT p_size, cast(floor(power(p_size / 255.0, 1 / 2.2) * 255 + 0.5) AS INT) AS srgb FROM {part}",
    "seek_timestamp": "SELECT o_orderkey, cast(floor((o_orderkey % 600) * 90000 / 1001.0 + 0.5) AS BIGINT) AS ts_units FROM {orders}",
    # extension: rollup of request traces
    "trace_rollup_kind_source": f"SELECT http, event_type, count(*) AS items, sum(floor(abs(value) * 100)) AS units FROM ({_STATUS}) x GROUP BY ROLLUP (http, event_type)",
}
#: SQL of the eviction queries, whose Spark form is ``operators.cache``.
EVICTION = {
    "cache_evict_reference": f"SELECT cache_key, rt FROM (SELECT cache_key, sum(size_bytes) OVER (ORDER BY last_accessed_at, render_cost) AS rt FROM ({_ENTRIES}) e) x WHERE rt <= ({_EXCESS})",
    "cache_evict_fit": f"SELECT cache_key, size_bytes, rt FROM (SELECT cache_key, size_bytes, sum(size_bytes) OVER (ORDER BY last_accessed_at, render_cost, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rt FROM ({_ENTRIES}) e) x WHERE rt - size_bytes < ({_EXCESS})",
    "cache_drop_to_limit": f"SELECT cache_key, most FROM ({_ENTRIES}) e, (VALUES (1000000::BIGINT), (1000000000000000)) l(most) WHERE (SELECT sum(size_bytes) FROM ({_ENTRIES}) s) <= most",
}
#: DuckDB spells semi and anti joins shorter.
_DUCK = {"LEFT ANTI JOIN": "ANTI JOIN", "LEFT SEMI JOIN": "SEMI JOIN"}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(text_for("spark", text, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ..operators import cache, state
    from . import files, request, rules

    return {k: _query(v) for k, v in SAME.items()} | cache.QUERIES | state.QUERIES | rules.QUERIES | request.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    from ..operators import state
    from . import files, request, rules

    out = {}
    for k, v in (SAME | EVICTION).items():
        text = text_for("duckdb", v)
        for a, b in _DUCK.items():
            text = text.replace(a, b)
        out[k] = text
    return out | {k: text_for("duckdb", v) for k, v in state.SQL.items()} | rules.SQL | request.SQL | files.SQL
