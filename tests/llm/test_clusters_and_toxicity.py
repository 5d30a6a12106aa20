"""op13 against plain integer k-means; op12 against a full comparison, and on labels held out."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import centroids, examples, toxicity
from siltstone.llm.common import read

SF = "/root/testdata/sf0.01"


def plain_kmeans(rows, k=8, dim=64, rounds=10):
    """[(id, vector)] -> {row number: (cluster, distance)}, centroids."""
    x = {n: [int(np.floor(1024 * float(c))) for c in v] for n, (_, v) in enumerate(rows) if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)}
    first = sorted(x, key=lambda n: (hashlib.sha256(f"3:{'' if rows[n][0] is None else rows[n][0]}".encode()).hexdigest(), x[n]))[:k]
    c = [x[n] for n in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    at = {}
    for t in range(rounds + 1):
        at = {n: min((far(v, c[j]), j) for j in range(len(c))) for n, v in x.items()}
        if t < rounds:
            for j in range(len(c)):
                own = [x[n] for n in x if at[n][1] == j]
                c[j] = [sum(col) // len(own) for col in zip(*own)] if own else c[j]
    return {n: (j, d) for n, (d, j) in at.items()}, c


def test_op13_equals_plain_kmeans(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, SF, "embeddings").collect()]
    want, c = plain_kmeans(rows)
    got = centroids.op13(spark, SF).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted((rows[n][0], j, d) for n, (j, d) in want.items())
    total = sum(d for _, d in want.values())
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for j, d in want.values() if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_broken_repeated_and_tied_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice([-1.0, 0.0, 0.5, 1e-4], 4).tolist()) for i in range(60)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, None, 0.0, 0.0]), (74, [float("nan")] * 4), (75, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    got, c = centroids.fit(df, dim=4, rounds=3)
    want, plain = plain_kmeans(rows, dim=4, rounds=3)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got.collect()), key=key) == sorted(((rows[n][0], j, d) for n, (j, d) in want.items()), key=key)
    assert c == plain


def test_few_none_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    got, c = centroids.fit(spark.createDataFrame([], schema))
    assert got.collect() == [] and c == []
    got, c = centroids.fit(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1e300, -1e300])], schema), dim=2)
    assert len(c) == 2 and {r["distance"] for r in got.collect()} == {0} and max(map(max, c)) == centroids.MOST


def test_sort_means_scans_to_twice_the_distance():
    rng = np.random.default_rng(2)
    c, x = rng.integers(-9, 9, (12, 3)), rng.integers(-9, 9, (500, 3))
    full = np.stack([centroids.squared(x, p) for p in c], 1)
    for start in (np.zeros(500, np.int64), rng.integers(0, 12, 500)):
        at, d = centroids.assign(x, start, c)
        assert (at == full.argmin(1)).all() and (d == full.min(1)).all()


def brute(model, vector, without):
    """All cosines of one vector, best first."""
    ix = model
    cos = np.zeros(len(ix.y))
    blocks = ix.most.shape[1]
    for col, w in zip(*vector):
        for b in range(blocks):
            for p in range(ix.starts[col * blocks + b], ix.starts[col * blocks + b + 1]):
                cos[ix.example[p]] += w * ix.weight[p]
    return sorted((-s, i) for i, s in enumerate(cos) if s > 0 and ix.group[i] != without)


def test_block_max_search_finds_what_a_full_comparison_finds():
    rng = np.random.default_rng(3)
    n, v = 500, 60
    cols = [np.sort(rng.choice(v, rng.integers(0, 9), replace=False)) for _ in range(n)]
    idf = rng.uniform(0.1, 3, v)
    part = toxicity.Index(idf, None, None, None, None, None, None, None, None)
    counts = [rng.integers(1, 5, len(c)).astype(float) for c in cols]
    vectors = [part.vector(c, m) for c, m in zip(cols, counts)]
    group = np.arange(n) // 3
    ix = toxicity.index(cols, vectors, idf, np.arange(n), np.zeros(n), np.ones(n), group)
    for q in range(0, n, 7):
        for without in (-1, int(group[q])):
            at, cos = ix.nearest(cols[q], vectors[q], 10, without)
            want = brute(ix, (cols[q], vectors[q]), without)[:10]
            assert at.tolist() == [i for _, i in want] and np.allclose(cos, [-s for s, _ in want])


def test_op12_on_labels_held_out(spark):
    got = {r["doc_id"]: r for r in toxicity.op12(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert len(held) > 700 and np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    some = [r for r in got.values() if r["predicted"]]
    assert len(some) > 300 and all(r["evidence"] and r["evidence"][0]["cosine"] >= r["evidence"][-1]["cosine"] for r in some)


def toxic_corpus(spark):
    docs = [(i, f"alpha{i} beta{i} gamma{i} word{i} " + ("nasty vile" if i % 4 == 0 else "kind warm"), "s") for i in range(200)]
    return docs, spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(200)], "doc_id long, toxic int, text int")


def test_score_edges(spark):
    docs, labels = toxic_corpus(spark)
    long = "kind " * 1_200_000 + " nasty vile"
    docs += [(900, None, "s"), (901, "", "s"), (902, "...", "s"), (903, long, "s"), (904, "Vile, NASTY; things", "s"), (904, "kind, warm", "s"), (904, "kind, warm", "s"), (None, "nasty vile", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = {}
    for r in toxicity.score(df, labels).collect():
        got.setdefault(r["id"], []).append(r["score"])
    assert got[900] == got[901] == got[902] and got[900][0] < 0.5 < got[None][0]
    assert sorted(x > 0.5 for x in got[904]) == [False, False, True] and len(got) == 206
    assert all((got[i][0] > 0.5) == (i % 4 == 0) for i in range(200))
    cols, n, ends = toxicity.hits(pa.array([long, None, "x nasty"]), {"nasty": 0, "kind": 1})
    assert list(zip(cols.tolist(), n.tolist())) == [(0, 1), (1, 1_200_000), (0, 1)] and ends.tolist() == [0, 2, 2, 3]


def test_score_without_labels_or_rows(spark):
    docs, labels = toxic_corpus(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    assert {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), labels).collect() == []


def test_copies_share_a_vote():
    assert toxicity.copy_groups([[1, 2], [3, 4], [1, 9], [8, 9], [4, 3]]).tolist() == [0, 1, 0, 0, 4]


def test_sample_passes_over_what_does_not_fit(spark):
    docs = [(i, "x" * (40_000 if i == 7 else 100)) for i in range(50)]
    known = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, y int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = examples.sampled(df.union(df), known, 1000, 30_000).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in range(50) if i != 7]
    assert len(examples.sampled(df, known, 1000, 1050).collect()) == 10
    with pytest.raises(ValueError):
        examples.sampled(df, known, 1000, 10)
