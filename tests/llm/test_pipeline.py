"""The pipeline against brute-force versions of its stages, on a fixture with planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import bpe, quality
from siltstone.llm.common import read, scratch_root
from test_operators import cut_runs, similar_groups

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    rng = random.Random(11)
    names = ["river", "stone", "lamp", "cloud", "paper", "glass", "field", "horse", "winter", "garden", "letter", "window", "bridge", "music", "silver", "market"]
    prose = lambda n: " ".join(" ".join(rng.choices(names, k=rng.randrange(6, 14))).capitalize() + "." for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["!!!", "BUY", "$$$", "click click", "win!!!", "xx"]) for _ in range(n))
    bench = [(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(4)]
    rows, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        rows.append((i, prose(9) if good else junk(60)))
        labels.append((i, int(good), 0))
    passage = prose(8)
    rows += [(200 + k, prose(3) + " " + passage + " " + prose(3)) for k in range(5)]
    rows += [(210 + k, rows[1][1]) for k in range(3)] + [(1, rows[1][1])]
    base = " ".join(f"{rng.choice(names)} {k}" for k in range(80))
    rows += [(300, base), (301, base.replace("40", "forty")), (302, base + " tail")]
    rows += [(310, prose(2) + " " + bench[0][1] + "."), (311, prose(30) + " " + bench[1][1][:20])]
    rows += [(400, None), (401, ""), (402, "  "), (None, prose(4)), (None, prose(5)), (500, prose(4)), (500, prose(6))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def plain_scores(texts, w, h):
    """The classifier's scores feature by feature, with a dictionary for each text."""
    import pyarrow as pa

    out = []
    for t in texts:
        counts: dict[int, int] = {}
        cols, ok, _ = h.batch(pa.array([t], pa.string()))
        for c, o in zip(cols, ok):
            for x, y in zip(c.tolist(), o.tolist()):
                if y:
                    counts[x] = counts.get(x, 0) + 1
        norm = max(sum(counts.values()) ** 0.5, 1e-12)
        out.append(1 / (1 + np.exp(-(sum(float(w[c]) * n**0.5 / norm for c, n in counts.items()) + float(w[-1])))))
    return out


def contaminated(text, bench):
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())  # noqa: E731 - the fixture is ASCII
    windows = {tuple(w[s : s + 13]) for _, b in bench for w in [words(b)] for s in range(len(w) - 12)}
    w, hit = words(text), set()
    for s in range(len(w) - 12):
        if tuple(w[s : s + 13]) in windows:
            hit |= set(range(s, s + 13))
    return bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("shuffled", [False, True])
def test_pipeline_equals_brute_force(spark, tmp_path, shuffled):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows, bench = fixture(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs, labels = read(spark, str(tmp_path), "documents"), read(spark, str(tmp_path), "labels")
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in labels.where(f"not ({quality.HELD_OUT})").collect())
    w = quality.fit(docs, labels)
    good = [r for r, p in zip(rows, plain_scores([t or "" for _, t in rows], w, quality.Hashing())) if p >= quality.THRESHOLD]
    assert 0 < len(good) < len(rows) and (1, rows[1][1]) in good and (0, rows[0][1]) not in good
    order = {id(r): k for k, r in enumerate(good)}
    keyed = [(r[0] if r[0] is not None else -1, k, r[1]) for k, r in enumerate(good)]
    # ids repeat, so lines are cut by position; of rows with one id the operator's order is a hash's,
    # and the fixture repeats nothing between different texts of one id
    unique, seen = [], {}
    for i, k, t in sorted(keyed, key=lambda x: (x[0], x[1])):
        if (i, t) not in seen:
            seen[i, t] = len(unique)
            unique.append((len(unique), t))
    cut = cut_runs(unique, 25)
    after = [(i, cut[seen[i, t]]) for i, k, t in keyed]
    low, _ = similar_groups(sorted(set(after), key=lambda r: (r[0], r[1] or "")))
    ranked = sorted(set(after), key=lambda r: (r[0], r[1] or ""))
    single = [r for k, r in enumerate(ranked) if low[k] == k]
    left = [r for r in single if not contaminated(r[1], bench)]
    tok = Tokenizer.from_file(bpe.default_vocab())
    want = []
    for i, t in left:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((None if i == -1 else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    sf = str(tmp_path)
    if shuffled:  # other partitions, the same rows
        sf = f"{tmp_path}/again"
        docs.orderBy("text").repartition(5).write.parquet(f"{sf}/documents.parquet")
        for n in ("labels", "benchmark"):
            read(spark, str(tmp_path), n).write.parquet(f"{sf}/{n}.parquet")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ids = {g[0] for g in got}
    assert 310 not in ids and 301 not in ids and 302 not in ids and {300, 311, None} <= ids and order


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0, name


def test_run_deletes_what_it_wrote_on_the_way(spark):
    import corpus_pipeline

    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    listing = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {x.getPath().getName() for x in listing.listStatus(fs)} if listing.exists(fs) else set()
    before = names()
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = names() - before
    assert len(new) == 1 and next(iter(new)).startswith("stage-decontamination")
