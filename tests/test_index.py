"""Stored indexes: BM25 postings and cells of vectors, against full comparisons."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.operators import cells, postings, search
from siltstone.plans import registry

SF = "/root/testdata/sf0.01"


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    words = {i: t.lower().split() for i, t in docs}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text in queries:
        scores = []
        for i, w in words.items():
            tf = Counter(w)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / average)) for t in set(text.lower().split()) if t in tf)
            if s > 0:
                scores.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: x for q, x in out.items() if x}


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(n)]


def test_postings_find_what_a_full_comparison_finds(spark, tmp_path, monkeypatch):
    docs = corpus()
    queries = [(1, "w0 w1 W250"), (2, "w299 w7"), (3, "nothing known"), (4, ""), (5, docs[17][1]), (6, "w0"), (7, "w120 w130 w140 w150")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(queries + [(None, "w1"), (8, None)], "query long, text string")
    index = postings.build(df.union(spark.createDataFrame([(None, "w1")], df.schema)), str(tmp_path / "p"), block=32)
    for k in (1, 5, 1000):
        got = {}
        for r in search.ranked(postings.search(index, asked, k).drop("rank"), k).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
        want = brute_bm25(docs, queries, k)
        assert got.keys() == want.keys()
        for q in want:
            mine = [x[1:] for x in sorted(got[q])]
            assert [i for i, _ in mine] == [i for i, _ in want[q]] and [s for _, s in mine] == pytest.approx([s for _, s in want[q]], abs=1e-8)
    again = postings.search(postings.load(spark, str(tmp_path / "p")), asked, 5)
    assert again.count() == sum(map(len, brute_bm25(docs, queries, 5).values()))


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    index = postings.build(spark.createDataFrame(corpus(), "doc_id long, text string"), str(tmp_path / "p"), block=32)
    scan = index.rows([3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in scan and "IN (3,4)" in scan
    read = {f.split("bucket=")[1].split("/")[0] for f in index.rows([3, 4]).select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert read <= {"3", "4"}
    assert index.rows().where("size(ids) <> df or array_max(weights) <> top").count() == 0


def test_blocks_beyond_reach_are_not_scored(spark, tmp_path):
    rare = [(i, "common " * 3 + ("needle " * 9 if i in (5, 6) else "hay ")) for i in range(600)]
    index = postings.build(spark.createDataFrame(rare, "doc_id long, text string"), str(tmp_path / "p"), block=8)
    got = postings.search(index, spark.createDataFrame([(1, "needle common")], "query long, text string"), 2)
    assert [r["id"] for r in got.orderBy("rank").collect()] == [5, 6]
    assert index.rows().where("term = 'needle'").count() <= 2 and index.rows().where("term = 'common'").count() > 60


def test_what_a_search_writes_grows_with_its_words(spark, tmp_path, monkeypatch):
    from siltstone import scratch

    docs, made = corpus(), []
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = postings.build(df, str(tmp_path / "p"), block=8)
    new = scratch.new_folder
    for module in (scratch, postings):
        monkeypatch.setattr(module, "new_folder", lambda *a: made.append(new(*a)) or made[-1], raising=False)
    got = postings.search(index, df.selectExpr("doc_id as query", "text"), 3).count()
    words = sum(len(set(t.split())) for _, t in docs)
    assert got > 0 and made and max(spark.read.parquet(f).count() for f in made) <= words < len(docs) * index.rows().select("block").distinct().count()


def test_a_search_in_groups_finds_what_a_full_comparison_finds(spark, tmp_path, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    queries = docs[::9] + [(1000, "w0 nothing"), (1001, ""), (1002, "nothing")]
    asked = spark.createDataFrame(queries, "query long, text string")
    monkeypatch.setattr(postings, "QUERIES", 20)
    monkeypatch.setattr(postings, "TASKS", 1)
    monkeypatch.setattr(postings, "UNIT", 50)
    index, want = postings.build(df, str(tmp_path / "p"), block=16), brute_bm25(docs, queries, 4)
    for found in (postings.scan(df, asked, 4), postings.search(index, asked, 4)):
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_columns_tiles_and_first_looks_change_no_result(spark, tmp_path, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    queries = docs[::5] + [(1000, "w0 nothing"), (1001, ""), (1002, "w299")]
    asked = spark.createDataFrame(queries, "query long, text string")
    for name, value in {"SHARE": 0.02, "COLUMNS": 9, "TILE": 8, "ADDED": 20, "UNIT": 900, "DOCS": 40, "FIRST": 4, "LEAST": 15}.items():
        monkeypatch.setattr(postings, name, value)
    index = postings.build(df, str(tmp_path / "p"), block=64)
    for k in (1, 4, 1000):
        want = brute_bm25(docs, queries, k)
        for found in (postings.scan(df, asked, k), postings.search(index, asked, k)):
            got = {}
            for r in sorted(found.collect(), key=lambda r: r["rank"]):
                got.setdefault(r["query"], []).append((r["id"], r["score"]))
            assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
            assert all([s for _, s in x] == pytest.approx([s for _, s in want[q]], abs=1e-8) for q, x in got.items())


def test_the_first_look_reaches_no_more_than_the_best(spark):
    docs = corpus()
    own = postings.counted(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    average = own.agg({"len": "avg"}).first()[0]
    asked = postings._asked(spark.createDataFrame(docs[:30], "query long, text string"))
    counts = {r["term"]: r["count"] for r in own.selectExpr("explode(terms) as term").groupBy("term").count().collect()}
    idf = spark.createDataFrame([(t, float(np.log1p((len(docs) - n + 0.5) / (n + 0.5)))) for t, n in counts.items()], "term string, idf double")
    packed = postings._packed(asked.join(idf, "term").select("query", "term", "idf"))
    shared = spark.sparkContext.broadcast(packed)
    batches = own.toArrow().combine_chunks().to_batches()
    found = {exact: [b.to_pylist() for b in postings._best(shared, 5, postings._of_documents(1.2, 0.75, average), exact)(batches)][0] for exact in (True, False)}
    least = {exact: {q: min(r["score"] for r in rows if r["query"] == q) for q in {r["query"] for r in rows}} for exact, rows in found.items()}
    assert least[True].keys() == least[False].keys() and len(least[True]) > 20
    assert all(least[True][q] * 0.999 < least[False][q] <= least[True][q] for q in least[True])


def test_words_that_most_texts_share_cost_a_matrix_product(spark):
    import time

    import pyarrow as pa

    rng = np.random.default_rng(8)
    held = rng.random((4000, 400)) < 0.5
    vocabulary = pa.array([f"w{i:03}" for i in range(400)])
    doc, word = np.nonzero(held)
    ends = pa.array(np.r_[0, np.cumsum(held.sum(axis=1))].astype(np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(held.sum(axis=1)), pa.ListArray.from_arrays(ends, vocabulary.take(pa.array(word))), pa.ListArray.from_arrays(ends, pa.array(np.ones(len(doc), np.int32)))], names=["id", "len", "terms", "tfs"])

    class Shared:
        value = (np.arange(1000), np.r_[0, np.cumsum(held[:1000].sum(axis=1))], word[doc < 1000].astype(np.int32), np.full(400, np.log(2.0)), vocabulary, np.full(1000, -np.inf))

    def one_by_one():
        docs = [np.nonzero(c)[0] for c in held.T]
        for q in held[:250]:  # of 1000
            at = np.concatenate([docs[w] for w in np.nonzero(q)[0]])
            np.bincount(at, np.ones(len(held))[at], len(held))

    def scored():
        (got,) = postings._best(Shared, 10, postings._of_documents(1.2, 0.75, 200.0))(iter([batch]))
        assert len(got) == 10_000

    took = []
    for work in (one_by_one, scored):
        began = time.perf_counter()
        work()
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0]


def test_words_end_at_any_white_space():
    import pyarrow as pa
    import pyarrow.compute as pc

    from siltstone.functions.text import SPACE

    texts = pa.array(["a\x1cb\u00a0C\x85d\u2003e \x0bf\x0cg\r\n h", "", " ", None, "\u1680\u3000x\u205fy\u202fz", "\u200bone\u2028two"])
    words = [[w for w in x if w] for x in postings.terms_of(texts).to_pylist()]
    assert words == [[w for w in x if w] for x in pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), SPACE).to_pylist()]


def test_reranking_splits_each_text_once(spark):
    plan = registry.QUERIES["rerank_by_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joined = [line for line in plan.splitlines() if "array_intersect" in line]
    assert joined and not any("split(" in line for line in joined)


def test_words_are_counted_from_bounded_slices_of_text():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([f"w{i} " * 150_000 for i in range(30)])], names=["id", "text"])
    made = list(postings._counted([batch]))
    assert len(made) > 3 and max(map(len, made)) < 10
    assert [(r["id"], r["len"], r["terms"], r["tfs"]) for b in made for r in b.to_pylist()] == [(i, 150_000, [f"w{i}"], [150_000]) for i in range(30)]


def test_an_empty_index(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "p"))
    assert postings.search(index, spark.createDataFrame([(1, "a")], "query long, text string"), 3).count() == 0
    full = postings.build(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "q"))
    assert postings.search(full, spark.createDataFrame([], "query long, text string"), 3).count() == 0


# Cells -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_of_cells(spark, sf):
    exact, near = registry.QUERIES["dense_topk"](spark, sf).collect(), registry.QUERIES["ann_topk"](spark, sf).collect()
    ten = lambda rows: {(r["query"], r["id"]) for r in rows if r["rank"] <= 10}
    assert len(ten(exact) & ten(near)) / len(ten(exact)) >= 0.9
    assert len(ten(exact)) >= 10 * min(10, len({q for q, _ in ten(exact)}))
    scores = {(r["query"], r["id"]): r["score"] for r in exact}
    assert all(abs(scores[q, i] - s) < 1e-8 for q, i, s in ((r["query"], r["id"], r["score"]) for r in near) if (q, i) in scores)


def test_a_search_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 16)) * 5
    x = [(i, (centre[i % 20] + rng.standard_normal(16)).tolist()) for i in range(3000)]
    index = cells.build(spark.createDataFrame(x, "id long, vector array<double>"), str(tmp_path / "c"), cells=20, spill=1)
    asked = spark.createDataFrame([(i, v) for i, v in x[:3]], "query long, vector array<double>")
    got = cells.search(index, asked, 5, probes=2)
    looked = sorted({int(c) for _, v in x[:3] for c in cells._nearest(np.array([v]), index.centres[16], 2)[0]})
    scan = index.points(16, looked)
    assert "PartitionFilters: [" in scan._jdf.queryExecution().executedPlan().toString()
    assert {r["cell"] for r in scan.select("cell").distinct().collect()} <= set(looked) and len(looked) <= 6 < len(index.sizes)
    want = search.dense_topk(spark.createDataFrame(x, "id long, vector array<double>"), asked, 5)
    key = lambda df: {(r["query"], r["rank"], r["id"]) for r in df.collect()}
    assert len(key(got) & key(want)) >= 14
    again = cells.search(cells.load(spark, str(tmp_path / "c")), asked, 5, probes=2)
    assert key(again) == key(got)


def test_hot_and_broken_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 64)
    x = [(i, [1.0, 0.0]) for i in range(500)] + [(600, [0.0, 1.0]), (601, [0.0, 0.0]), (602, None), (603, [1.0, None]), (604, [1.0, 2.0, 3.0]), (605, [float("nan"), 1.0]), (None, [1.0, 0.0]), (606, [1e300, 1e300])]
    index = cells.build(spark.createDataFrame(x, "id long, vector array<double>"), str(tmp_path / "c"), cells=4)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 5.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [1.0]), (6, [1e-200, 1e-200])], "query long, vector array<double>")
    got = {}
    for r in cells.search(index, asked, 3, probes=4, least=0.5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    assert sorted(got[1]) == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)] and [x[1] for x in sorted(got[2])] == [600, 606] and [x[1] for x in got[4]] == [604] and sorted(got) == [1, 2, 4, 6]
    assert sorted(got[6])[0][1:] == (606, 1.0)


def test_dense_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    x = [(i, rng.standard_normal(4).tolist()) for i in range(60)]
    df = spark.createDataFrame(x, "id long, vector array<double>")
    asked = df.selectExpr("id as query", "vector").unionByName(spark.createDataFrame([(99, [1.0, 2.0])], "query long, vector array<double>"))
    got = {(r["query"], r["rank"]): r["id"] for r in search.dense_topk(df, asked, 3).collect()}
    m = np.array([v for _, v in x])
    m /= np.linalg.norm(m, axis=1)[:, None]
    assert got == {(i, r + 1): int(j) for i in range(60) for r, j in enumerate(np.argsort(-(m @ m[i]))[:3])}


def test_placing_is_bounded(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x, centres = rng.standard_normal((500, 4)), rng.standard_normal((50, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])
    whole = list(cells._placed({4: centres}, 30)([batch]))
    monkeypatch.setattr(cells, "PLACE_BYTES", 1 << 14, raising=False)
    parts = list(cells._placed({4: centres}, 30)([batch]))
    assert max(p.nbytes for p in parts) < 1 << 15 and pa.Table.from_batches(parts).equals(pa.Table.from_batches(whole))
