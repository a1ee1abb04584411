"""N-gram Jaccard join: groups of similar documents, their token unions, and groups opened only if a bound allows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, components, meet, parts_for, table, tidied
from .shingles import digest, shingle_set

#: Sets compared in one task of the opening step, on either side; a set counts as one for every ``BLOCK_TOKENS`` tokens.
BLOCK, BLOCK_TOKENS = 256, 1000
#: Documents' tokens combined before they are dealt out.
COMBINE = 250
#: Input bytes whose tokens a task counts, range by range, and the sets it adds up before it gives them out.
TASK_BYTES, HELD = 128 << 20, 250_000
_LOW48 = np.uint64((1 << 48) - 1)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = COMBINE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, which bounds what a worker holds at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _load(n: str) -> Column:
    """What a set of ``n`` tokens counts for in a block."""
    return F.greatest(F.lit(1.0), F.col(n) / BLOCK_TOKENS)


def profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles and a 128-bit digest (k1, k2) of the shingle set, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 512):
            sets = [shingle_set(t, k) for t in _texts(b)]
            keys = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("t"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()),
                ],
                names=["doc_id", "t", "n_shingles", "k1", "k2"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(tidied(run), "doc_id long, t long, n_shingles long, k1 long, k2 long")


def shared_tokens(docs: DataFrame, k: int) -> DataFrame:
    """(k1, shared): how many tokens of the head of each distinct set occur in the head of another too, sets with none left out.

    A set's head is the smaller half of its tokens (``head``). Two sets with at least o tokens in common have at least o - n / 2 of them in both
    heads, n being the larger size: the common tokens that a head lacks lie in the other half, and what both heads hold is a beginning of the
    common tokens in order. Half of all tokens so serve to tell which sets can have a link.

    Tokens are cut to 48 bits, and copies of a set may be counted apart (both only raise ``shared``). They are dealt by value to tasks and, in a
    task, to ranges, packed as bytes: a batch's copies of a token are combined first, so a token of a third of all documents is one entry per
    batch. A task counts its ranges one after another, holding one at a time, and adds up what they say of a set, so a set gives at most
    one row a task (more where a task meets over ``HELD`` sets). Ranges follow the input's size, and tokens are near-uniform over them.
    """
    # Every core has a task; past that, tasks follow the input by whole ``TASK_BYTES``, so sets are told of in few of them.
    tasks = parts_for(docs, small=TASK_BYTES, large=TASK_BYTES, least=docs.sparkSession.sparkContext.defaultParallelism)
    # Leaves of unknown size count nothing: the session's shuffle partitions are the least number of ranges.
    ranges = -(-parts_for(docs, least=int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets, keys, seen = [], [], set()
            for t in _texts(b):
                s = shingle_set(t, k)
                if len(s) and (key := digest(s)[0]) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(np.unique(head(s) & _LOW48))
            if not sets:
                continue
            tok = np.concatenate(sets)
            own = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            key_of = np.array(keys, np.int64)
            order = np.argsort(tok, kind="stable")
            tok, own = tok[order], own[order]
            # Two owners show that a token is shared; a batch's further owners are counted here and now.
            first = np.r_[True, tok[1:] != tok[:-1]]
            nth = np.arange(len(tok)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            told = np.bincount(own[nth >= 2], minlength=len(sets))
            tok, own = tok[nth < 2], own[nth < 2]
            rows = {"part": [int(tok[0]) % tasks], "rng": [0], "tok": [b""], "own": [told[told > 0].tobytes()], "keys": [key_of[told > 0].tobytes()]}
            place = (tok % np.uint64(tasks * ranges)).astype(np.int64)
            order = np.lexsort((own, place))
            tok, own, place = tok[order], own[order], place[order]
            cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            ends = np.r_[cut[1:], len(place)]
            for a, b in zip(cut, ends, strict=True):
                owners, local = np.unique(own[a:b], return_inverse=True)
                six = tok[a:b].view(np.uint8).reshape(-1, 8)[:, :6]
                rows["part"].append(int(place[a]) % tasks)
                rows["rng"].append(int(place[a]) // tasks)
                rows["tok"].append(np.ascontiguousarray(six).tobytes())
                rows["own"].append(local.astype(np.uint16).tobytes())
                rows["keys"].append(key_of[owners].tobytes())
            yield pa.RecordBatch.from_pydict(
                rows, schema=pa.schema([("part", pa.int64()), ("rng", pa.int64()), ("tok", pa.binary()), ("own", pa.binary()), ("keys", pa.binary())])
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, owners, keys, n = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def range_ends() -> None:
            """Count the tokens of the range held, as seen in one set or in more, into keys and n."""
            if not toks:
                return
            tok, own = np.concatenate(toks), np.concatenate(owners)
            toks.clear()
            owners.clear()
            order = np.lexsort((own, tok))
            tok, own = tok[order], own[order]
            fresh = np.r_[True, (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])]
            tok, own = tok[fresh], own[fresh]
            same = tok[1:] == tok[:-1]
            own = own[np.r_[same, False] | np.r_[False, same]]
            keys.append(own)
            n.append(np.ones(len(own), np.int64))

        def known(most: int) -> Iterator[pa.RecordBatch]:
            """Add up keys and n, and give them out if they are more than ``most`` sets."""
            ids, sums = _summed(np.concatenate(keys), np.concatenate(n))
            if full := len(ids) > most:
                for at in range(0, len(ids), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 65536]), pa.array(sums[at : at + 65536])], names=["k1", "shared"])
            keys[:], n[:] = ([ids[:0]], [sums[:0]]) if full else ([ids], [sums])

        at = None
        for b in batches:
            for rng, tok, own, key in zip(*(b.column(c).to_pylist() for c in ("rng", "tok", "own", "keys")), strict=True):
                if rng != at:
                    range_ends()
                    at = rng
                if not tok:
                    keys.append(np.frombuffer(key, np.int64))
                    n.append(np.frombuffer(own, np.int64))
                else:
                    eight = np.zeros((len(tok) // 6, 8), np.uint8)
                    eight[:, :6] = np.frombuffer(tok, np.uint8).reshape(-1, 6)
                    toks.append(eight.view(np.uint64).ravel())
                    owners.append(np.frombuffer(key, np.int64)[np.frombuffer(own, np.uint16)])
            if sum(map(len, keys)) > 2 * HELD:
                yield from known(HELD)
        range_ends()
        yield from known(0)

    dealt = docs.select("text").mapInArrow(tidied(deal), "part long, rng long, tok binary, own binary, keys binary")
    # The task number itself is the partition.
    dealt = dealt.repartitionById(tasks, F.col("part").cast("int")).sortWithinPartitions("rng")
    return dealt.mapInArrow(tidied(count), "k1 long, shared long").groupBy("k1").agg(F.sum("shared").alias("shared"))


def head(tokens: np.ndarray) -> np.ndarray:
    """The smaller half of a sorted set, the middle one included."""
    return tokens[: (len(tokens) + 1) // 2]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(keys, return_inverse=True)
    return ids, np.bincount(at, weights=n, minlength=len(ids)).astype(np.int64)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """n, k1, k2 and the set itself (sorted 64-bit tokens as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 128):
            sets = [shingle_set(t, k) for t in _texts(b)]
            keys = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in keys], pa.int64()),
                    pa.array([x[1] for x in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["n", "k1", "k2", "tokens"],
            )

    return docs.select("text").mapInArrow(tidied(run), "n long, k1 long, k2 long, tokens binary")


def postings(sets: DataFrame) -> DataFrame:
    """(id, tok) rows of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, t in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                for at in range(0, n, 65536):
                    tok = np.frombuffer(t, np.int64)[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tok), i, np.int64)), pa.array(tok)], names=["id", "tok"])

    return sets.select("id", "n", "tokens").mapInArrow(tidied(_joined(run)), "id long, tok long")


def _joined(run):
    """Small record batches put together to about 65,536 rows."""

    def out(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 65536:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def _link(percent: int):
    """Task body: the links of a block's queries with members, but for those that join what is joined already."""

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        ids = np.array(right.column("id").to_pylist(), np.int64)
        sizes = np.array(right.column("n").to_pylist(), np.int64)
        out_a, out_b = [], []
        if left.num_rows and len(ids):
            sets = [np.frombuffer(t, np.uint64) for t in right.column("tokens").to_pylist()]
            tok = np.concatenate(sets)
            own = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tok, kind="stable")
            tok, own = tok[order], own[order]
            for i, n, t in zip(left.column("id").to_pylist(), left.column("n").to_pylist(), left.column("tokens").to_pylist(), strict=True):
                q = np.frombuffer(t, np.uint64)
                a, b = np.searchsorted(tok, q, "left"), np.searchsorted(tok, q, "right")
                length = b - a
                total = int(length.sum())
                if not total:
                    continue
                at = np.repeat(a - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(total)
                common = np.bincount(own[at], minlength=len(ids))
                hit = np.flatnonzero((100 * common >= percent * (sizes + n - common)) & (ids != i))
                for j in ids[hit].tolist():
                    if (x := top(i)) != (y := top(j)):
                        up[x] = y
                        out_a.append(i)
                        out_b.append(j)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return link


def _bound(percent: int):
    """Task body: queries whose overlap with a group's token union allows a link with a member."""

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "g": [], "tb": []}
        for g, tb, low, high, u in zip(*(right.column(c).to_pylist() for c in ("g", "tb", "low", "high", "tokens")), strict=True):
            union = np.frombuffer(u, np.uint64)
            for i, n, t in zip(*(left.column(c).to_pylist() for c in ("id", "n", "tokens")), strict=True):
                if percent * n > 100 * high or percent * low > 100 * n:
                    continue
                q = np.frombuffer(t, np.uint64)
                at = np.minimum(np.searchsorted(union, q), len(union) - 1)
                if 100 * int((union[at] == q).sum()) >= percent * n:
                    out["id"].append(i)
                    out["g"].append(g)
                    out["tb"].append(tb)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return bound


def _unions(members: DataFrame) -> DataFrame:
    """The token-group matrix: per group block (g, tb) the sorted union of its members' tokens, and their least and largest size."""

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        tok = np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in rows.column("tokens").to_pylist()]))
        n = rows.column("n").to_pylist()
        return pa.table({
            "g": pa.array([key[0].as_py()], pa.int64()), "tb": pa.array([key[1].as_py()], pa.int64()), "low": pa.array([min(n)], pa.int64()),
            "high": pa.array([max(n)], pa.int64()), "tokens": pa.array([tok.tobytes()], pa.binary()),
        })

    return members.groupBy("g", "tb").applyInArrow(unite, "g long, tb long, low long, high long, tokens binary")


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t, n_shingles and root (a number for each component; null without shingles), for every row of ``docs`` (doc_id long, text)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.keep(profile(docs, k), "profile")
    # ``id`` names a distinct set. It is made once and read back.
    sets_of = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.first("n_shingles").alias("n"))
    sets_of = scratch.keep(sets_of.withColumn("id", F.monotonically_increasing_id()), "classes")
    shared = shared_tokens(docs, k)
    # Links share percent % of the larger set at least, so percent - 50 % of it in both heads (the middle token may be one more).
    left = sets_of.join(shared, "k1").where(f"100 * shared >= {percent - 50} * n").select("id", "k1", "k2")
    left = scratch.keep(left, "candidates")
    # One text of each candidate set: any row's will do.
    texts = rows.where("n_shingles > 0").join(bounded(left.select("k1", "k2")), ["k1", "k2"], "left_semi")
    texts = scratch.keep(texts.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t")).alias("d")).select("d.doc_id", "d.t").distinct(), "one-text")
    named = docs.withColumn("t", F.xxhash64("text"))
    one = bounded(texts.toDF("d2", "t2"))
    sets = shingle_sets(named.join(one, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left_semi"), k)
    sets = sets.join(bounded(left), ["k1", "k2"])
    sets = scratch.keep(sets.dropDuplicates(["id"]).drop("k1", "k2"), "sets")

    all_tok = postings(sets)
    df = all_tok.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    tok = scratch.keep(all_tok.join(df, "tok"), "postings")
    by_id = Window.partitionBy("id")
    need = F.ceil(F.col("n") * percent / 100)
    ranked = (
        tok.join(sets.select("id", "n"), "id")
        .withColumn("known", F.count("*").over(by_id))
        .withColumn("central", F.sum("df").over(by_id) / F.col("n"))
        .withColumn("at", F.row_number().over(by_id.orderBy("df", "tok")))
        .where(F.col("at") <= F.col("known") - need + 1)
    )
    prefix = scratch.keep(ranked.select("id", "n", "tok", "central"), "prefix")
    scratch.drop(tok)
    leader = prefix.groupBy("tok").agg(F.max_by("id", F.struct("central", "id")).alias("leader"))
    met = prefix.join(leader, "tok").where("id <> leader").groupBy("id", "leader").count()
    top = Window.partitionBy("id").orderBy(F.desc("count"), "leader")
    met = scratch.keep(met.withColumn("at", F.row_number().over(top)).where("at <= 2").select("id", F.col("leader").alias("g"), "at"), "leaders")
    zero = F.lit(0).cast("long").alias("tb")
    lead = met.select("g").distinct().join(sets.withColumnRenamed("id", "g"), "g").select("g", zero, F.col("g").alias("id"), "n", "tokens")
    links = meet(scratch, met.join(sets, "id").select("g", zero, "id", "n", "tokens"), lead, _link(percent), "a long, b long", BLOCK, _load("n"))
    links = scratch.keep(links, "links")

    # Groups: a component of two or more, or the unlinked sets of one leader. s = 1 for the latter.
    best = met.where("at = 1").select("id", F.col("g").alias("leader"))
    ids = prefix.select("id", "n").distinct().join(components(scratch, links), "id", "left").join(best, "id", "left")
    ids = ids.select("id", "n", F.col("root").isNull().cast("long").alias("s"), F.coalesce("root", "leader", "id").alias("g"))
    ids = scratch.keep(ids.withColumn("g", F.col("g") * 2 + F.col("s")), "groups")
    query = prefix.select("id", "tok").join(ids, "id")
    useful = query.groupBy("tok").agg(F.count("*").alias("docs"), F.min("g").alias("a"), F.max("g").alias("b"), F.max("s").alias("s"))
    query = query.join(useful.where("docs > 1 AND (a <> b OR s = 1)").select("tok"), "tok", "left_semi")
    union = query.select("tok", F.col("g").alias("g2"), F.col("s").alias("s2")).distinct()
    # Each two groups are compared from one side, unlinked sets asking components; such sets also ask their own group.
    once = "s2 < s OR (s2 = s AND (g2 < g OR (g2 = g AND s = 1)))"
    asked = scratch.keep(query.join(union, "tok").where(once).select("id", F.col("g2").alias("g")).distinct(), "asked")
    size = ids.join(asked.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.ceil(F.sum(_load("n")) / BLOCK).cast("long").alias("nt"))
    size = bounded(scratch.keep(size, "sizes"))
    members = ids.select("id", "g").join(size, "g").select("g", F.pmod(F.xxhash64("id"), F.col("nt")).alias("tb"), "id")
    members = members.join(sets, "id").select("g", "tb", "id", "n", "tokens")
    matrix = scratch.keep(_unions(members), "matrix")
    asking = asked.join(size, "g").select("id", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nt") - 1)).alias("tb"))
    asking = asking.join(sets, "id").select("g", "tb", "id", "n", "tokens")
    bound = meet(scratch, asking, matrix, _bound(percent), "id long, g long, tb long", BLOCK, _load("n"))
    opened = scratch.keep(bound, "opened")
    inside = members.join(opened.select("g", "tb").distinct(), ["g", "tb"], "left_semi")
    more = meet(scratch, opened.join(sets, "id").select("g", "tb", "id", "n", "tokens"), inside, _link(percent), "a long, b long", BLOCK, _load("n"))
    links = scratch.keep(links.unionByName(more), "all-links")
    final = components(scratch, links)
    named = scratch.keep(sets_of.join(final, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("root")), "roots")
    return rows.join(named, ["k1", "k2"], "left").select("doc_id", "t", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * common >= ``percent`` * union over their sets of ``k``-word shingles (``percent`` above 50). component_id is the
    smallest doc_id reachable by links, itself included; every link between different texts counts.

    1. Equal sets become one class (128-bit digest).
    2. A set of whose smaller half too few tokens occur in that of any other set has no link: counted over all sets (``shared_tokens``).
    3. What is left orders its tokens from the rarest on. With need = ceil(percent * n / 100), two linked sets share one of
       their first n - need + 1 tokens. Each token of these prefixes has a leader, the set with the most common
       tokens; sets are compared with the two leaders they meet most often. Links make components.
    4. Token-group matrix: groups are the components and, of sets not yet linked, those of one leader; each block
       of up to about ``BLOCK`` members stores the union of its tokens. A set asks the groups that its prefix meets in the union
       of their prefixes, except its own component. Its overlap with a block's union bounds that with any member: below need the block stays
       closed. Qualifying blocks are opened and compared, and their links join components.

    Null, empty and blank texts: n_shingles 0, linked with nothing. Fewer than k words: the sequence is one shingle.
    Every row is a document: repeated rows get equal results, rows of one doc_id with different texts are linked by their texts only. A null
    doc_id takes part and is never the smallest; component_id is null if all reachable are. Texts may be of any length. An empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _classes(docs, k, percent)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("root IS NOT NULL").join(least, "root").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component kept, all its columns and, of the others, none.

    The document of the smallest doc_id stays (ids that are null come last; of one id's texts the one with the smallest hash). Of rows that
    repeat it word for word one stays. Rows without words are linked with nothing and all stay. Rows of one doc_id whose texts are not linked are
    different documents. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _classes(plain, k, percent).where("root IS NOT NULL")
    rows = scratch.keep(rows.groupBy("root", "doc_id", "t").agg(F.count("*").alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
    first = scratch.keep(rows.groupBy("root").agg(F.min(order).alias("f")).select("root", F.col("f.doc_id").alias("d"), F.col("f.t").alias("ft")), "first")
    told = rows.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("ft")))
    told = told.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_veduta_d"), F.col("t").alias("_veduta_h"), "stays")
    told = scratch.keep(told, "told")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_veduta_d")) & (F.xxhash64("text") == F.col("_veduta_h"))
    alone = docs.join(bounded(told.drop("stays")), same, "left_anti")
    again = bounded(told.where("stays").drop("stays"))
    copies = docs.join(again, same).dropDuplicates(["_veduta_d", "_veduta_h"]).select(*docs.columns)
    return alone.unionByName(copies)


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.85 or more, over all documents: doc_id, n_shingles, component_id."""
    return classes(table(spark, sf_dir, "documents"), 4, 85)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS g FROM d),
n AS MATERIALIZED (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS h FROM s GROUP BY rid),
r AS MATERIALIZED (SELECT h, min(rid) AS rid, min(doc_id) AS id, any_value(n) AS n FROM n GROUP BY h),
t AS MATERIALIZED (SELECT r.id, r.n, s.g, count(*) OVER (PARTITION BY s.g) AS df FROM s JOIN r USING (rid)),
p AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY df, g) AS k FROM t) WHERE df > 1 AND k <= n - ceil(n * 85 / 100.0) + 1),
c AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.g = b.g AND a.id > b.id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, an, bn, count(*) AS k FROM c JOIN t x ON x.id = a JOIN t y ON y.id = b AND y.g = x.g GROUP BY a, b, an, bn) WHERE 100 * k >= 85 * (an + bn - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS id, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, r.id, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN r ON r.h = n.h LEFT JOIN m ON m.id = r.id
"""
