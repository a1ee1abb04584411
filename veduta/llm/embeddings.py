"""Embedding near-duplicates: spherical k-means cells, products of packed blocks, one representative per group."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, components, table, tidied

#: Components of the vectors that a block holds, about (2,048 vectors of 64).
BLOCK_VALUES = 2048 * 64
#: Vectors a cell holds, about, and a group of neighbouring cells that makes a block; most vectors of a cell that share a bound.
PER_CELL, PER_GROUP, PER_BOUND = 128, 2048, 512
#: Bounds of the cell model: cells in all, sampled vectors a cell, sampled components in all, rows whose products with all centres are held at once.
MAX_CELLS, SAMPLE, TRAIN_VALUES, AT_ONCE = 4096, 32, 4_000_000, 2048
_GROUPS, _SLICES = 1 << 20, 1 << 16
#: While blocks meet: pairs of blocks that go to Python at once, blocks held unless there is memory for more, bytes of blocks that a task takes from either side.
_MEETING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.cartesianProductExec.buffer.in.memory.threshold": "16", "spark.sql.files.maxPartitionBytes": str(32 << 20),
}
#: Blocks of the other side that a worker keeps ready.
_READY = 64
_PACKED = "g long, tb long, id binary, copies binary, cell binary, dot binary, v binary"


def _home(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Each row's cell, by largest cosine; the products are held for ``AT_ONCE`` rows at a time."""
    return np.concatenate([np.argmax(x[i : i + AT_ONCE] @ centre.T, axis=1) for i in range(0, len(x), AT_ONCE)] or [np.empty(0, int)])


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on unit rows: cells by largest cosine, centres by normalised sums. An empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), size=k, replace=False)].copy()
    for _ in range(rounds):
        home = _home(sample, centre)
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        total = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        some = norm[:, 0] > 0
        centre[cells[some]] = total[some] / norm[some]
    return centre


class Cells:
    """Centres of one vector length (None: a single cell), the group of each, and the blocks that a group's vectors are dealt to."""

    def __init__(self, centre: np.ndarray | None, group: np.ndarray, blocks: np.ndarray):
        self.centre, self.group, self.blocks = centre, group, blocks

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), int) if self.centre is None else _home(x.astype(np.float32), self.centre)


def train(sample: np.ndarray, n: int, cells: int, block: int) -> Cells:
    """A model for ``n`` vectors from a sample of them: about ``PER_CELL`` vectors a cell, at most ``cells`` cells; neighbouring cells, by k-means too, in groups."""
    sample = sample.astype(np.float32)
    k = max(1, min(cells, n // PER_CELL, len(sample)))
    centre = centroids(sample, k)
    groups = max(1, min(k, n // PER_GROUP))
    order = np.argsort(_home(centre, centroids(centre, groups)), kind="stable")
    group = np.empty(k, int)
    group[order] = np.arange(k) * groups // k
    share = np.bincount(group[_home(sample, centre)], minlength=groups) / len(sample)
    return Cells(centre, group, np.maximum(1, np.ceil(share * n / block)).astype(int))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = np.array(raw, dtype=np.float64)
    # Scaled first: squares of very large or small components would leave the range of doubles.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of lists, and their values as a matrix."""
    size = np.asarray(column.value_lengths())
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (embedding), all of one length, to their unit vectors as bytes of 32-bit floats: a sample for the cells."""
    for b in batches:
        for _, raw in _by_length(b.column("embedding")):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _unit(raw).astype(np.float32)], pa.binary())], names=["v"])


def _deal(model: dict[int, Cells], kind: type):
    """Rows (id, copies, embedding) to (g, tb, id, copies, cell, v): the length and group of cells, a block of the group, the vector as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies = (b.column(c).to_numpy() for c in ("id", "copies"))
            for rows, raw in _by_length(b.column("embedding")):
                cells = model.get(raw.shape[1])
                cell = cells.home(_unit(raw)) if cells else np.zeros(len(rows), int)
                group = cells.group[cell] if cells else cell
                mixed = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block = (mixed % (cells.blocks[group] if cells else np.ones(len(rows), int)).astype(np.uint64)).astype(np.int64)
                columns = raw.shape[1] * _GROUPS + group, block, ids[rows], copies[rows], cell
                vectors = pa.array([x.tobytes() for x in raw.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), vectors], names=["g", "tb", "id", "copies", "cell", "v"])

    return run


def _pack(model: dict[int, Cells], kind: type):
    """Task body: the vectors of one (g, tb) as one row, sorted by cell and falling cosine to its centre; as more where they are many more than a block's."""

    def body(rows: pa.Table) -> pa.Table:
        g = int(rows.column("g")[0].as_py())
        dim, cells = g // _GROUPS, model.get(g // _GROUPS)
        ids, copies, cell = (rows.column(c).to_numpy() for c in ("id", "copies", "cell"))
        raw = np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(len(ids), dim)
        dot = np.zeros(len(ids)) if cells is None or cells.centre is None else np.einsum("ij,ij->i", _unit(raw), cells.centre[cell])
        order = np.lexsort((ids, -dot, cell))
        out: dict[str, list] = {c: [] for c in ("g", "tb", "id", "copies", "cell", "dot", "v")}
        step = 2 * max(1, BLOCK_VALUES // dim)
        for n, at in enumerate(range(0, len(order), step)):
            some = order[at : at + step]
            facts = g, rows.column("tb")[0].as_py() * _SLICES + n, *(x[some].tobytes() for x in (ids, copies, cell, dot, raw))
            for name, value in zip(out, facts, strict=True):
                out[name].append(value)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), kinds, strict=True)})

    return body


class _Block:
    """One side of a block pair: ids, copies, vectors as they came, unit vectors in single precision, and runs of one cell, each with its centre and bound.

    For unit vectors x and y with angle(x, y) <= t, and any centre c: angle(y, c) <= angle(x, c) + t. So a vector that links to one of a run has at
    least the run's bound, the cosine of its farthest vector's angle plus t, as its cosine to the centre. And if x is in cell a, y in cell b:
    x.a >= x.b, so y.b - y.a <= sin(t) * |a - b|.
    """

    def __init__(self, cells: Cells | None, dim: int, least: float, kind: type, ids: bytes, copies: bytes, cell: bytes, dot: bytes, v: bytes):
        self.id, self.copies, self.cell = (np.frombuffer(x, np.int64) for x in (ids, copies, cell))
        self.dot, self.raw = np.frombuffer(dot, np.float64), np.frombuffer(v, kind).reshape(len(self.id), dim)
        self.f = (self.raw / np.abs(self.raw).max(axis=1, keepdims=True)).astype(np.float32)
        self.f /= np.sqrt(np.einsum("ij,ij->i", self.f, self.f))[:, None]
        #: What single precision may be off by.
        self.slack = 1e-6 + 1.2e-7 * dim
        edges = [0, *(np.flatnonzero(np.diff(self.cell)) + 1), len(self.id)]
        self.runs = [(i, min(i + PER_BOUND, end)) for start, end in zip(edges, edges[1:], strict=False) for i in range(start, end, PER_BOUND)]
        self.first = np.array([i for i, _ in self.runs])
        self.run = np.repeat(np.arange(len(self.runs)), [e - i for i, e in self.runs])
        self.centre, self.sin = None, math.sqrt(1 - least * least) if 0 < least <= 1 else 1.0
        if cells and cells.centre is not None:
            self.centre = cells.centre[self.cell[self.first]]
            angle = np.arccos(np.clip(np.minimum.reduceat(self.dot, self.first) - self.slack, -1, 1)) + math.acos(min(max(least, -1), 1))
            self.bound = np.cos(np.minimum(angle, math.pi)) - self.slack

    def near(self, other: _Block) -> np.ndarray:
        """Whether each of the rows may have a link in each of the other's runs."""
        if other.centre is None:
            return np.ones((len(self.id), len(other.runs)), bool)
        far = self.sin * np.sqrt(np.maximum(0, 2 - 2 * self.centre @ other.centre.T) + 2 * self.slack) + 3 * self.slack
        far = (self.dot[:, None] - far[self.run]).astype(np.float32)
        return self.f @ other.centre.T >= np.maximum(far, other.bound.astype(np.float32))


def _roots(linked: np.ndarray, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each side's rows reach by links of this product."""
    far = np.iinfo(np.int64).max
    while True:
        q2 = np.minimum(q, np.where(linked, t[None, :], far).min(axis=1))
        t2 = np.minimum(t, np.where(linked, q2[:, None], far).min(axis=0))
        if (q2 == q).all() and (t2 == t).all():
            return q, t
        q, t = q2, t2


def _links(q: _Block, t: _Block, same: bool, least: float, tell) -> int:
    """Tells the links of two blocks, or inside one: counts of both sides and a spanning forest. The number of pairs compared.

    Products in single precision find what may link; those are told by products in double precision.
    """
    low, compared, near, back = least - q.slack, 0, t.near(q), q.near(t)
    # A row of a run that nothing in the other run may link to is not near it.
    near &= np.logical_or.reduceat(back, q.first, axis=0).T[t.run]
    # Small runs are taken from one side only: their products are cheaper whole.
    parts = [(s, e, k) for k, (s, e) in enumerate(t.runs)] if len(t.id) >= PER_BOUND // 2 * len(t.runs) else [(0, len(t.id), None)]
    for k, (s, e) in enumerate(q.runs):
        some = near[:, k].copy()
        if same:
            some[:s] = False  # met from the earlier run
        for start, end, run in parts:
            i = np.arange(s, e) if run is None else s + np.flatnonzero(back[s:e, run])
            j = start + np.flatnonzero(some[start:end])
            if not len(i) or not len(j):
                continue
            compared += len(i) * len(j)
            product = q.f[i] @ (t.f if len(j) == len(t.f) else t.f[j]).T
            if product.max() < low:
                continue
            x, y = ((product >= low).any(axis=a) for a in (1, 0))
            i, j = i[x], j[y]
            linked = _unit(q.raw[i]) @ _unit(t.raw[j]).T >= least
            if same:
                linked &= i[:, None] != j[None, :]
            if not linked.any():
                continue
            x, y = linked.any(axis=1), linked.any(axis=0)
            i, j, linked = i[x], j[y], linked[x][:, y]
            tell(q.id[i].tolist(), (linked @ t.copies[j]).tolist(), [None] * len(i))
            # Inside a run every pair is met in both orders.
            there = j >= e if same else np.ones(len(j), bool)
            tell(t.id[j[there]].tolist(), (q.copies[i] @ linked[:, there]).tolist(), [None] * int(there.sum()))
            for ids, roots in zip((q.id[i], t.id[j]), _roots(linked, q.id[i], t.id[j]), strict=True):
                moved = ids != roots
                tell(ids[moved].tolist(), [0] * int(moved.sum()), roots[moved].tolist())
    return compared


def _products(model: dict[int, Cells], least: float, kind: type):
    """Pairs of packed blocks to link counts of both sides, a spanning forest of the links, and the number of pairs compared (id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict[tuple, _Block]] = [{}, {}]

        def block(side: int, row: list) -> _Block:
            # A block meets all those that a task has of the other side in turn.
            held, key = ready[side], (row[0].as_py(), row[1].as_py())
            if key not in held:
                if len(held) >= (_READY if side else 1):
                    held.pop(next(iter(held)))
                dim = key[0] // _GROUPS
                held[key] = _Block(model.get(dim), dim, least, kind, *(x.as_py() for x in row[2:]))
            return held[key]

        for b in batches:
            out: dict[str, list] = {"id": [], "n": [], "other": []}

            def tell(ids, n, other, out=out):
                out["id"] += ids
                out["n"] += n
                out["other"] += other

            for n in range(b.num_rows):
                row = [c[n] for c in b.columns]
                half = len(row) // 2
                q, t = block(0, row[:half]), block(1, row[half:])
                same = row[:2] == row[half : half + 2]
                tell([None], [_links(q, t, same, least, tell)], [None])
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def models(distinct: DataFrame, least: float) -> dict[int, Cells]:
    """A cell model for each length of vectors (id, embedding) with two cells' worth or more, the commonest first; a single cell once ``MAX_CELLS`` are used up.

    Fitted on a sample by id hash: about ``SAMPLE`` vectors a cell, about ``TRAIN_VALUES`` components.
    """
    out: dict[int, Cells] = {}
    left = MAX_CELLS
    lengths = distinct.groupBy(F.size("embedding").alias("dim")).count().where(F.col("count") >= 2 * PER_CELL)
    for dim, n in lengths.orderBy(F.desc("count"), "dim").limit(MAX_CELLS).collect():
        k, block = min(left, n // PER_CELL), max(1, BLOCK_VALUES // dim)
        if k < 2:
            out[dim] = Cells(None, np.zeros(1, int), np.array([math.ceil(n / block)]))
            continue
        size = max(2, min(k * SAMPLE, TRAIN_VALUES // dim))
        # Every vector where the share is 1.
        some = distinct.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, size / n))))
        sample = [r[0] for r in some.select("embedding").mapInArrow(tidied(_units), "v binary").collect()]
        if len(sample) < 2:
            out[dim] = Cells(None, np.zeros(1, int), np.array([math.ceil(n / block)]))
            continue
        out[dim] = train(np.frombuffer(b"".join(sample), np.float32).reshape(len(sample), dim), n, k, block)
        left -= k
    return out


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def compare(scratch: Scratch, distinct: DataFrame, least: float) -> DataFrame:
    """Links of ``distinct`` (id, copies, embedding): rows (id, n links, other null), (id, 0, other: an id linked to it), (null, pairs compared, null)."""
    model = models(distinct, least)
    kind = np.float32 if isinstance(distinct.schema["embedding"].dataType.elementType, FloatType) else np.float64
    dealt = distinct.select("id", "copies", "embedding").mapInArrow(tidied(_deal(model, kind)), "g long, tb long, id long, copies long, cell long, v binary")
    # Files of some MB, so that blocks are read by many tasks.
    size = distinct.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    parts = max(8, min(math.ceil(size / (16 * BLOCK_VALUES)), 4096))
    packed = scratch.keep(dealt.repartition(parts, "g", "tb").groupBy("g", "tb").applyInArrow(_pack(model, kind), _PACKED), "packed")
    other = packed.toDF(*(f"{c}2" for c in packed.columns))
    length = lambda c: F.floor(F.col(c) / _GROUPS)
    # Every pair of blocks of one length of vectors, read from the stored table: nothing is shuffled, and no block is stored twice.
    later = (F.col("g") < F.col("g2")) | ((F.col("g") == F.col("g2")) & (F.col("tb") <= F.col("tb2")))
    met = packed.join(other, (F.abs(length("g") - length("g2")) < 1) & later)
    with _settings(scratch.spark, _MEETING):
        return scratch.keep(met.mapInArrow(tidied(_products(model, least, kind)), "id long, n long, other long"), "found")


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """Per row of ``vectors`` (vec_id long, embedding array<float or double>): n_links, component_id, kept.

    Vectors link if their cosine, in double precision, is at least ``least``. All rows are compared: equal vectors are one
    with a number of copies. A bounded sample trains the cells (``models``); vectors are compared unless geometry rules a link out
    (``_Block``), so none is missed. Groups of neighbouring cells are packed in blocks, one row each; all pairs of blocks meet, read from
    the stored table without a shuffle: no cell, however large, is one task. Tasks return counts and spanning edges, never pairs. kept marks the
    smallest vec_id of each group.

    Null, empty and zero vectors and such with null or non-finite components link with nothing. Vectors of different
    lengths do not link. Every row is a vector of its own: rows of one vec_id are linked by their vectors only. component_id is the smallest vec_id among
    the rows that links reach, itself included; a null vec_id takes part and is never the smallest (component_id and kept are null if all are null, kept is
    null for a null vec_id). An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    # Single precision is kept as it came (half the bytes); cosines are taken in double precision of either.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit("veduta"), "embedding"))
    same = ["k1", "k2"]
    distinct = rows.where("usable").groupBy(*same).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # ``id`` numbers the distinct vectors. It is made once and read back.
    distinct = scratch.keep(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    found = compare(scratch, distinct, least).where("id IS NOT NULL")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(scratch, found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = distinct.select("id", *same, "copies", "least").join(counts, "id", "left").join(group, "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("usable").select("vec_id", *same).join(scratch.keep(named, "named"), same).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_embeddings(spark, sf_dir: str) -> DataFrame:
    """Cosine of 0.95 or more over all vectors: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT rid, vec_id, e::DOUBLE[64] AS e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b, b.vec_id AS vb FROM u a JOIN u b ON a.rid <> b.rid AND array_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
n AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY a),
reach(a, b, vb) AS (SELECT a, b, vb FROM l UNION SELECT reach.a, l.b, l.vb FROM reach JOIN l ON reach.b = l.a),
m AS (SELECT a AS rid, min(vb) AS root FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.root, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.root, v.vec_id)) AS kept
FROM v LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
