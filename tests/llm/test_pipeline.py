import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from veduta.llm import jaccard, mixing, pii, quality

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, ids = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SF)
        assert out.columns == docs.columns
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        assert name in ("quality", "near_copies", "decontamination") or now == ids
        before, ids = out, now
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in last.collect()} == ids
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "personal_data", "mixing"]


def corpus():
    """A small corpus with planted junk, copies, near copies, benchmark passages and personal data; null and repeated ids."""
    r = random.Random(31)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(14)) for i in range(6)]
    good = [prose(r.randint(30, 90)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)]
    for i in range(12):
        rows.append((100 + i, good[i]))  # copies
        w = good[20 + i].split()
        rows.append((120 + i, " ".join([*w[:-1], word()])))  # near copies
        rows.append((140 + i, f"{prose(20)} {items[i % 6][1]} {prose(20)}"))  # passages
        rows.append((160 + i, f"{prose(25)} mail {word()}@{word()}.example.org and 4111111111111111 {prose(10)}"))
        rows.append((180 + i, " ".join(f"{word()}$$$ %%%" for _ in range(40))))  # junk
    rows += [(None, prose(50)), (None, prose(50)), (5, prose(50)), (300, None), (301, ""), (302, "  ")]
    labels = [(i, 1) for i in range(40)] + [(180 + i, 0) for i in range(9)]
    docs = [(i, t, "en", f"s{n % 4}", len(t or "")) for n, (i, t) in enumerate(rows)]
    return docs, labels, items


def plain_run(docs, labels, items):
    """The five stages one after the other in plain Python, on rows (doc_id, text, source)."""
    label = dict(labels)
    rows = [(i, t, s) for i, t, _, s, _ in docs]
    # quality
    raw = np.zeros((2, quality.BUCKETS))
    for i, t, _ in rows:
        n = np.bincount(quality.buckets((t or "").encode()), minlength=quality.BUCKETS)
        raw += [n, n * (label.get(i) == 1)]
    ratios = np.log((raw[1] + quality.PRIOR) / (raw[1].sum() * raw[0] / raw[0].sum() + quality.PRIOR))

    def key(i, t):
        import hashlib

        u = (int(hashlib.md5(f"{'' if i is None else i}:{quality.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        b = quality.buckets((t or "").encode())
        return ratios[b].sum() - np.log(-np.log(u)) if len(b) else None

    keys = [key(i, t) for i, t, _ in rows]
    fit: dict = {}
    for (i, _, _), k in zip(rows, keys, strict=True):
        if i in label and k is not None:
            fit[i] = min(k, fit.get(i, k))
    cut = quality.best_cut(*(np.array([k for i, k in fit.items() if label[i] == y]) for y in (1, 0)))
    rows = [row for row, k in zip(rows, keys, strict=True) if k is not None and k >= cut]
    # near copies: five words, 0.8, the smallest id of each component stays
    sets = []
    for _, t, _ in rows:
        w = t.lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    stay = {}
    for at, c in enumerate(comp):
        rank = (rows[at][0] is None, rows[at][0] or 0)
        if c not in stay or rank < stay[c][0]:
            stay[c] = (rank, at)
    rows = [rows[at] for _, at in stay.values()]
    # contamination: ten consecutive words of an item
    cut_words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    windows = {tuple(w[j : j + 10]) for _, t in items for w in [cut_words(t)] for j in range(len(w) - 9)}
    rows = [r for r in rows if not any(tuple(w[j : j + 10]) in windows for w in [cut_words(r[1])] for j in range(len(w)))]
    # personal data changes no count of words; the mix takes by source
    return rows


def test_run_equals_a_plain_one(spark, tmp_path):
    """Row by row: which documents reach the mix, with their sizes, sources and targets; personal data are gone by then."""
    docs, labels, items = corpus()
    for name, rows, schema in (("documents", docs, DOC), ("labels", labels, "doc_id long, quality int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = plain_run(docs, labels, items)
    ids = [i for i, _, _ in want]
    assert set(range(60)) - {0} <= set(ids) and not set(ids) & set(range(140, 152)) and len(ids) == len(want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = lambda t: len(t.split())
    assert sorted((str(q.doc_id), q.size, q.source) for q in got) == sorted((str(i), size(t), s) for i, t, s in want)
    totals = Counter()
    for _, t, s in want:
        totals[s] += size(t)
    assert {q.source: q.source_size for q in got} == dict(totals)
    taken = Counter()
    for q in got:
        taken[q.source] += q.taken
        assert q.taken <= 3 * q.size
    longest = max(size(t) for _, t, _ in want)
    assert all(abs(taken[q.source] - q.target) <= longest for q in got)
    kept = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in want], DOC)
    clean = corpus_pipeline.hide_personal_data(spark, kept, str(tmp_path)).collect()
    assert all("4111111111111111" not in q.text and q.n_chars == len(q.text) for q in clean)
    assert {q.text for q in clean if q.doc_id in range(160, 172)} & {t for _, t, _ in want} == set()
    assert pii.pseudonymise(kept).count() == mixing.mix(kept).count() == len(want)


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    """Empty tables pass through; null texts, ids and sources, repeated rows and clashing columns do not stop a stage."""
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, None, None, None, None), (1, "a b c d e f g", "en", None, 13), (1, "a b c d e f g", "en", None, 13), (2, "", "en", "s", 0), (2, "x " * 30000, "en", "s", 60000)]
    for rows, left in (([], 0), (odd, 2)):
        docs = spark.createDataFrame(rows, DOC)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == left


def test_columns_with_clashing_names_go_through(spark, tmp_path):
    """Columns named like those that operators add or use inside keep their values through the stages."""
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["key", "kept", "log_weight", "_label", "n_pii", "_d", "_h", "stays", "t", "root", "k1", "target", "size", "a.b"]
    rows = [(i, t, "en", "s", 0, *[f"{c}{i}" for c in names]) for i, t in enumerate(["one good text a@b.org", "one good text a@b.org", "$$$ %%%", "another good text"])]
    docs = before = spark.createDataFrame(rows, DOC + "".join(f", `{c}` string" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
    got = [q.asDict() for q in docs.collect()]
    assert got and all(q[c] == f"{c}{q['doc_id']}" for q in got for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(got)


def test_operators_keep_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "one two a@b.org"), (1, "one two a@b.org"), (2, "three")], "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("_d", "_h", "_found", "_label", "stays", "t")})
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out, n in ((jaccard.keep_one(df), 2), (pii.pseudonymise(df), 3), (quality.resample(df, labels), 3)):
        rows = out.collect()
        assert set(df.columns) <= set(out.columns) and len(rows) == n and all(q[c] == "x" for q in rows for c in ("_d", "_h", "_found", "_label"))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
