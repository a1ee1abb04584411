"""WARC archives: written per page, read back, and indexed by an external merge of sorted capture runs."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, table, tidied

#: Least payload that may be a revisit; compressed bytes after which a new archive is begun; runs merged at once; rows read at a time.
LEAST_BYTES, ARCHIVE_BYTES, FAN_IN, ROWS = 1000, 64 << 20, 64, 2048
#: Captures a merge task returns, about, and split keys sampled at most.
RANGE_ROWS, SAMPLE = 20_000, 10_000
#: Capture time of page 0 where a table has none; page n follows n seconds later.
FIRST_CAPTURE = "2024-01-01 00:00:00"
RUN = pa.schema([
    ("key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
RUN_DDL = "key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels from the right, then path and query, lower-cased. ``http://a.example.com/x`` is ``com,example,a)/x``."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1], rest[cut:].split("#", 1)[0]
    name, _, port = host.partition(":")
    return (",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (path or "/")).lower()


def _header_value(x: str) -> str:
    """A value on one line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in x)


def record(page_id: int | None, url: str | None, ts: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response with the payload, or a revisit with its headers only."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{ts}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {ts}"]
    lines += [f"WARC-Target-URI: {_header_value(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's named headers, payload (None for a revisit) and payload length; its digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":", 1)[1]).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"fields": fields, "payload": None if revisit else payload, "length": length, "digest": digest}


def _open_fs(root: str):
    """The shared folder's file system and path, for executors' Python workers."""
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _writer(root: str, limit: int):
    """Task body: pages to gzip-by-record archives in the shared folder. Names are new on every attempt; only those returned count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(root)
        fs.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

        for b in batches:
            for page_id, url, ts, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "ts", "html", "refers_to")), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(page_id, url, ts, (html or "").encode(), refers)
                member = z.compress(raw) + z.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= limit:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def read_archive(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of a gzip-by-record archive, read forward in pieces of 1 MB."""
    offset, left = 0, b""
    while True:
        z, raw, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            piece = left or stream.read(1 << 20)
            left = b""
            if not piece:
                if used:
                    raise ValueError("archive ends inside a record")
                return
            raw.append(z.decompress(piece))
            used += len(piece) - len(z.unused_data)
        left = z.unused_data
        yield offset, used, b"".join(raw)
        offset += used


def _save_run(fs, path: str, rows: Iterator[tuple]) -> tuple[int, list[str]]:
    """Write sorted rows as an Arrow file of small batches; return the row count and each batch's first key."""
    n, firsts, held = 0, [], []
    with fs.open_output_stream(path, compression=None) as sink, pa.ipc.new_file(sink, RUN) as out:

        def flush():
            firsts.append(f"{held[0][0]}\t{held[0][1]}")
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), RUN.types, strict=True)], schema=RUN))
            held.clear()

        for row in rows:
            held.append(row)
            n += 1
            if len(held) == ROWS:
                flush()
        if held:
            flush()
    return n, firsts


def _rank(row: tuple) -> tuple:
    """Order of captures: URL key, time, page, then the place in the archives. Nulls first."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _indexer(archives: str, runs: str):
    """Task body: archives read back from the shared folder, their captures sorted and saved as one run each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(archives)
        _, to = _open_fs(runs)
        fs.create_dir(to, recursive=True)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, length, raw in read_archive(stream):
                        r = parse(raw)
                        f = r["fields"]
                        number = lambda k, f=f: int(f[k]) if k in f else None
                        url = f.get("WARC-Target-URI")
                        rows.append((url_key(url), f["WARC-Date"], number("X-Page-Id"), url, r["length"], r["digest"], f["WARC-Type"], number("X-Refers-To-Page"), name, offset, length))
                rows.sort(key=_rank)
                path = f"{uuid.uuid4().hex}.run"
                n, firsts = _save_run(fs, f"{to}/{path}", iter(rows))
                yield pa.RecordBatch.from_pydict({"run": [path] * len(firsts), "rows": [n] + [0] * (len(firsts) - 1), "first": firsts})

    return run


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so the next winner takes one path of log2 k comparisons."""

    def __init__(self, sources: list[Iterator[tuple]], rank: Callable[[tuple], tuple] = _rank):
        self._sources, self._rank, self._k = sources, rank, len(sources)
        self._row: list = [None] * self._k
        self._key: list = [None] * self._k
        for i in range(self._k):
            self._pull(i)
        self._lost = [-1] * max(self._k, 1)
        self._winner = self._build(1) if self._k else -1

    def _pull(self, i: int) -> None:
        self._row[i] = row = next(self._sources[i], None)
        self._key[i] = None if row is None else self._rank(row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key[a], self._key[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        """Play the matches below ``node``; leaves are k .. 2k - 1."""
        if node >= self._k:
            return node - self._k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self._lost[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self._k and self._row[self._winner] is not None:
            yield self._row[self._winner]
            self._pull(self._winner)
            node, win = (self._winner + self._k) // 2, self._winner
            while node:
                if self._beats(self._lost[node], win):
                    self._lost[node], win = win, self._lost[node]
                node //= 2
            self._winner = win


def _slice(fs, path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a run with low <= (key, time) < high, batch by batch, the first batch found by bisection."""
    with fs.open_input_file(path) as source:
        reader = pa.ipc.open_file(source)
        a, b = 0, reader.num_record_batches
        while low is not None and b - a > 1:
            mid = (a + b) // 2
            batch = reader.get_batch(mid)
            if (batch.column("key")[0].as_py(), batch.column("ts")[0].as_py()) < low:
                a = mid
            else:
                b = mid
        for i in range(a, reader.num_record_batches):
            columns = [c.to_pylist() for c in reader.get_batch(i).columns]
            for row in zip(*columns, strict=True):
                if high is not None and row[:2] >= high:
                    return
                if low is None or row[:2] >= low:
                    yield row


#: A task's share of a merge: consecutive keys from low to below high, and the runs that hold them.
_SHARE = "id long, low_key string, low_ts string, high_key string, high_ts string, run array<string>"


def _shares(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Shares in order, one a partition."""
    frame = spark.createDataFrame([(i, *(low or (None, None)), *(high or (None, None)), list(run)) for i, (low, high, run) in enumerate(rows)], _SHARE)
    return frame.repartitionByRange(max(1, len(rows)), "id").sortWithinPartitions("id")


def _merged(fs, base: str, b: pa.RecordBatch) -> Iterator[Iterator[tuple]]:
    """Of each share of a batch its captures in order."""
    for low_key, low_ts, high_key, high_ts, run in zip(*(b.column(c).to_pylist() for c in ("low_key", "low_ts", "high_key", "high_ts", "run")), strict=True):
        low, high = (None if key is None else (key, ts) for key, ts in ((low_key, low_ts), (high_key, high_ts)))
        yield iter(LoserTree([_slice(fs, f"{base}/{p}", low, high) for p in run]))


def _merge_pass(spark: SparkSession, runs: str, ranges: list[tuple], fan_in: int) -> list[tuple]:
    """Of each range (low, high, runs) groups of at most ``fan_in`` runs become one run each: a task a group and range."""
    shares = [(low, high, paths[i : i + fan_in]) for low, high, paths in ranges for i in range(0, len(paths), fan_in)]
    owner = [n for n, (_, _, paths) in enumerate(ranges) for _ in range(0, len(paths), fan_in)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(runs)
        for b in batches:
            for i, rows in zip(b.column("id").to_pylist(), _merged(fs, base, b), strict=True):
                path = f"{uuid.uuid4().hex}.run"
                if _save_run(fs, f"{base}/{path}", rows)[0]:
                    yield pa.RecordBatch.from_pydict({"id": [i], "run": [path]})

    made: dict[int, list[str]] = {}
    for i, path in sorted(tuple(r) for r in _shares(spark, shares).mapInArrow(tidied(run), "id long, run string").collect()):
        made.setdefault(owner[i], []).append(path)
    return [(low, high, made.get(n, [])) for n, (low, high, _) in enumerate(ranges)]


def merge(spark: SparkSession, runs: str, manifest: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """All captures of the runs in one global order: partitions are consecutive key ranges, each merged by a loser tree.

    Beyond ``fan_in`` runs the keys are cut into as many ranges as there are groups of runs, and passes merge groups of each range into longer runs, so
    every pass has a task for each group and range. What the driver holds is the names of runs and at most ``SAMPLE`` split keys. Ranges
    are cut by URL key and time, so a page captured very often is no single task.
    """
    total = manifest.agg(F.sum("rows")).first()[0] or 0
    paths = sorted(r[0] for r in manifest.select("run").distinct().collect())
    sample = sorted(r[0] for r in manifest.select("first").orderBy(F.xxhash64("run", "first")).limit(SAMPLE).collect())

    def cut(n: int) -> list[tuple]:
        n = max(1, min(n, len(sample)))
        return sorted({tuple(sample[i * len(sample) // n].rsplit("\t", 1)) for i in range(1, n)})

    wide = cut(math.ceil(len(paths) / fan_in))
    ranges = [(low, high, paths) for low, high in zip([None, *wide], [*wide, None], strict=True)]
    while any(len(p) > fan_in for _, _, p in ranges):
        ranges = _merge_pass(spark, runs, ranges, fan_in)
    narrow, shares = cut(math.ceil(total / RANGE_ROWS)), []
    for low, high, held in ranges:
        inner = [c for c in narrow if (low is None or c > low) and (high is None or c < high)]
        shares += [(a, b, held) for a, b in zip([low, *inner], [*inner, high], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(runs)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN.types, strict=True)], schema=RUN)
        for b in batches:
            for rows in _merged(fs, base, b):
                while held := list(itertools.islice(rows, ROWS)):
                    yield made(held)

    return _shares(spark, shares).mapInArrow(tidied(run), RUN_DDL)


def archive(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Write ``pages`` (page_id, url, html, optionally captured timestamp) as WARC archives, read them back, and return their capture index.

    One record per row. Of rows with equal payloads of at least ``LEAST_BYTES`` bytes that with the largest page_id is a
    response, the others revisit it. Rows of the result come from the archives (responses' digests are checked against their payloads), in order
    of URL key, time and page: key, ts, page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, offset, length.

    Null html: an empty payload. Null url: no target, key "". Null page_id: ranks below all; a revisit needs an id to refer to. Repeated rows are records each; those of
    the largest page_id are all responses. An empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    when = F.col("captured") if "captured" in pages.columns else F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE)) + F.coalesce(F.col("page_id"), F.lit(0)))
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")
    )
    long = page.where(F.octet_length("html") >= LEAST_BYTES).select("page_id", F.sha2("html", 256).alias("sha"))
    long = scratch.keep(long.where("page_id IS NOT NULL"), "digests")
    last = long.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    last = scratch.keep(last, "last")
    revisit = long.join(bounded(last), "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    revisit = scratch.keep(revisit, "revisits")
    planned = page.withColumn("sha", F.when(F.octet_length("html") >= LEAST_BYTES, F.sha2("html", 256))).join(
        bounded(revisit), ["page_id", "sha"], "left"
    )
    archives, runs = scratch.path("archives"), scratch.path("runs")
    files = planned.select("page_id", "url", "ts", "html", "refers_to").mapInArrow(tidied(_writer(archives, archive_bytes)), "file string, records long, bytes long")
    files = scratch.keep(files, "manifest")
    n = max(1, files.count())
    # One archive a task.
    named = files.select("file").repartition(n)
    manifest = scratch.keep(named.mapInArrow(tidied(_indexer(archives, runs)), "run string, rows long, first string"), "runs-manifest")
    return merge(spark, runs, manifest, fan_in)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to FROM m
"""
