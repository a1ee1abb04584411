import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from veduta.functions import hints, tables
from veduta.operators.state import suppressed
from veduta.plans import catalog
from veduta.sources import media

SF = "/root/testdata/sf0.001"


def rows(x):
    return sorted(repr([float(v) if type(v).__name__ in ("Decimal", "float", "int") else v for v in r]) for r in x)


def test_queries_equal_their_sql(spark):
    """Every registered query but those of the training data, on the smallest tables."""
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries, sql, wrong = catalog.queries(), catalog.oracle_sql(), []
    for name, text in sql.items():
        got, want = queries[name](spark, SF), con.sql(text)
        at = [want.columns.index(c) for c in got.columns]
        if rows(got.collect()) != rows([[r[i] for i in at] for r in want.fetchall()]):
            wrong.append(name)
    assert not wrong and len(sql) > 100


def test_native_queries_run_no_python(spark):
    for name in ["route_min_tier", "fit_to_target", "hints_roundtrip", "cache_evict_fit"]:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_tables():
    assert [len(x()) for x in (tables.format_rows, tables.kind_rows, tables.mime_rows, tables.extension_rows)] == [114, 123, 103, 66]
    assert len({e for *_, e in tables.format_rows()}) == 104


HINT = "expires_at long, stale_while_revalidate long, immutable boolean, etag string, last_modified string, no_store boolean, private boolean"


@pytest.mark.parametrize(
    "h, ttl, want",
    [
        ((1780007113, 3600, True, '"abc123"', "Thu, 01 Jan 2026 00:00:00 GMT", False, False), 0, (1780007113, 3600, True, '"abc123"', "Thu, 01 Jan 2026 00:00:00 GMT")),
        ((None, None, False, '"xyz789"', None, False, False), 0, (1, None, False, '"xyz789"', None)),
        ((None, None, False, None, None, False, False), 60, (1060, None, False, None, None)),
    ],
)
def test_token_round_trip(spark, h, ttl, want):
    df = spark.createDataFrame([(h,)], f"h struct<{HINT.replace(' ', ':').replace(',:', ',')}>")
    d = df.select(hints.decode(hints.encode(F.col("h"), ttl, 1000)).alias("d")).first().d
    assert tuple(d)[:5] == want and not d.no_store


def test_token_refused_and_empty(spark):
    df = spark.createDataFrame([((None, None, False, None, None, True, False),), ((None, None, False, None, None, False, True),)], f"h struct<{HINT.replace(' ', ':').replace(',:', ',')}>")
    assert [r[0] for r in df.select(hints.encode(F.col("h"), 0, 1)).collect()] == ["", ""]
    assert spark.range(1).select(hints.decode(F.lit("0:"))).first()[0] is None


def test_directives_keep_order(spark):
    values = {"max-age=600": 600, "public, max-age=3600, immutable": 3600, "max-age=1, s-maxage=2": 2, "s-maxage=2, max-age=1": 2, "max-age=1, max-age=9": 1, "s-maxage=1, s-maxage=3": 3, "max-age=x, max-age=4": 4, "": None}
    df = spark.createDataFrame([(k,) for k in values], "c string")
    d = hints.parse_directives(F.col("c"))
    assert {r.c: r.a for r in df.select("c", d["age"].alias("a")).collect()} == values
    assert [r.c for r in df.where(d["immutable"]).collect()] == ["public, max-age=3600, immutable"]


def test_sizes(spark):
    from veduta.functions import urls

    cases = {"": None, "100mb": 104857600, "2gb": 2147483648, "500": 500, "abc": None, "0gb": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.v for r in df.select("s", urls.col(urls.mem_size("s")).alias("v")).collect()} == cases


def _png(w=3, h=2, colour=6):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 100)) + chunk(b"IEND", b"")


def _files():
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("content.xml", "x" * 50)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00\xff\xda"
    irot = struct.pack(">I4sB", 9, b"irot", 1)
    box = lambda k, d: struct.pack(">I4s", 8 + len(d), k) + d
    heic = box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", irot)))
    mp3 = b"ID3\x03\x00\x00\x00\x00\x00\x05hello" + struct.pack(">I", 0xFFFB9064) + b"\0" * 15996
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Pages /Count 5 /Kids [2 0 R]>> endobj" + b"".join(b"\n%d 0 obj <</Type /Page /Parent 1 0 R>> endobj" % i for i in range(2, 7))
    return {"png": _png(), "odt": z.getvalue(), "jpeg": jpeg, "heic": heic, "mp3": mp3, "pdf": pdf, "gif": b"GIF89a\x05\x00\x04\x00\0\0\0", "bmp": b"BM" + b"\0" * 16 + struct.pack("<iiHH", 7, -9, 1, 24)}


def test_media_facts(spark):
    got = {k: media.probe(v) for k, v in _files().items()}
    assert {k: v["format"] for k, v in got.items()} == {k: k for k in got}
    assert (got["png"]["width"], got["png"]["alpha"], got["jpeg"]["width"], got["jpeg"]["height"]) == (3, 1, 32, 16)
    assert got["heic"]["rotation"] == 270 and got["pdf"]["pages"] == 5 and got["bmp"]["height"] == 9
    assert got["mp3"]["duration_seconds"] == pytest.approx(1.0, rel=0.01)
    df = spark.createDataFrame([(k, v) for k, v in _files().items()], "name string, content binary")
    assert {r.name: r.format for r in media.parse(df).collect()} == {k: k for k in got}


def test_media_cut_at_any_length():
    for data in _files().values():
        for n in range(min(len(data), 300)):
            media.probe(data[:n])


def test_batch_items(spark):
    df = spark.createDataFrame([(1, '{"items": ["http://a/x", {"url": "http://b/y", "cache": "1:AA"}]}'), (2, "bad")], "call int, body string")
    assert media.batch_items(df, most=5).where("url IS NOT NULL").count() == 0
    got = {(r.call, r.idx, r.url, r.cache) for r in media.batch_items(df).collect()}
    assert got == {(1, 0, "http://a/x", None), (1, 1, "http://b/y", "1:AA"), (2, None, None, None)}


def test_stream_equals_batch(spark, tmp_path):
    from veduta.streaming import state as streams

    log = spark.createDataFrame([(i % 3, i * 7 % 50, i) for i in range(60)], "user_id long, at long, event_id long")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    streams.ndjson(streams.suppressed(stream, "user_id", 10), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == 60
    streams.written(out.drop("batch"), 0, str(tmp_path / "twice"), [str(tmp_path / "log")])
    streams.written(out.drop("batch"), 0, str(tmp_path / "twice"), [str(tmp_path / "log")])
    assert spark.read.json(str(tmp_path / "twice")).count() == spark.read.json(str(tmp_path / "log")).count() == 60
    got = {(r.user_id, r.event_id, r.fetched) for r in out.collect()}
    assert got == {(r.user_id, r.event_id, r.fetched) for r in suppressed(log, "user_id", F.lit(10)).collect()}


def against_sql(spark, folder, name, table, made):
    """A query's rows and its SQL's, over one table of our own."""
    made.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want, got = con.sql(catalog.oracle_sql()[name]), catalog.queries()[name](spark, str(folder))
    at = [want.columns.index(c) for c in got.columns]
    return rows(got.collect()), rows([[r[i] for i in at] for r in want.fetchall()])


def test_tile_grid_pick_ties_and_odd_lines(spark, tmp_path):
    """Grids of one area and line number (the first row is picked), quantities that are not whole, nothing or below zero, nulls."""
    lines = [(1, 1, 5.0, 6), (1, 1, 10.0, 3), (2, 2, 10.0, 3), (2, 2, 5.0, 6), (3, 1, 2.5, 1), (4, 1, 3.5, 1), (5, 1, 0.4, 2), (6, 1, None, 2), (7, 1, -3.0, 2), (8, 3, -3.0, 2), (9, None, 4.0, 2), (10, 1, 4.0, None)]
    lines += [(11, 150, 2.0, 1), (11, 1, 1.0, 2), (None, 1, 5.0, 6)]
    made = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long")
    got, want = against_sql(spark, tmp_path, "tile_grid_pick", "lineitem", made)
    assert got == want and len(got) == 8


def test_failure_lookup_fractions_and_repeated_requests(spark, tmp_path):
    """Seconds round to even; one event_id's rows are one request; rows without a user or failures without an id match nothing."""
    times = [(1, "00:00:00.4", 1, "error"), (2, "00:00:00.6", 1, "view"), (3, "00:00:00.5", 2, "error"), (4, "00:00:00.9", 2, "view"), (5, "00:00:01.5", 3, "error"), (6, "00:00:02.4", 3, "view")]
    times += [(7, "00:00:00", None, "error"), (8, "01:00:00", None, "view"), (None, "00:00:00", 4, "error"), (9, "01:00:00", 4, "view"), (10, "00:00:00", 5, "error"), (11, "05:59:59.6", 5, "view")]
    times += [(12, "05:59:59.4", 5, "view"), (13, "01:00:00", 5, "view"), (13, "01:00:00", 6, "view"), (10, "03:00:00", 5, "error"), (14, None, 5, "view"), (15, "07:00:00", 5, None)]
    made = spark.createDataFrame(times, "event_id long, at string, user_id long, event_type string").selectExpr("event_id", "to_timestamp_ntz('2024-01-01 ' || at) AS ts", "user_id", "event_type")
    got, want = against_sql(spark, tmp_path, "failure_lookup", "events", made)
    assert got == want and len(got) == 16
