"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled texts (``SAMPLE`` rows, ``SAMPLE_BYTES``) gives the examples.  Near copies
among them share one vote.  The vocabulary is the words whose presence depends on the label (G-test,
``LEAST_G``); their document frequencies are counted over all documents.  The index keeps, for each word,
its postings by blocks of examples and each block's largest weight: a search looks into blocks by falling
bound and stops where no block can reach the k-th best, so its neighbours are those of a full comparison.
The K nearest vote with the square of their cosine, next to a prior; the votes are calibrated on the
examples themselves, each left out with its copies.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import materialize, read, slices
from .examples import sampled

#: Bounds of the labelled rows the examples are taken from, and of their texts.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
K, BLOCK = 15, 64
#: A word is kept from this G statistic on (a chance of about 1e-6 a word), the strongest VOCABULARY.
LEAST_G, VOCABULARY = 24.0, 4096
#: Weight of the prior in a vote, and the bytes of a long text that are looked at together.
PRIOR, PIECE = 1.0, 4 << 20
THRESHOLD = 0.5
SHINGLE, MINIMA = 5, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _examples(batches):
    """(doc_id, y, text) -> each text's distinct words and the minima of its shingles' hashes."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        ids, ys, terms, counts, minima = [], [], [], [], []
        for row in batch.to_pylist():
            w = words(row["text"])
            s = [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]
            h = np.fromiter((xxhash.xxh64_intdigest(x) for x in s), np.uint64, len(s))
            seen: dict[str, int] = {}
            for x in w:
                seen[x] = seen.get(x, 0) + 1
            ids.append(row["doc_id"])
            ys.append(row["y"])
            terms.append(list(seen))
            counts.append(list(seen.values()))
            minima.append([int((h * np.uint64(m)).min().view(np.int64)) for m in MINIMA])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), pa.array(minima, pa.list_(pa.int64()))],
            names=["doc_id", "y", "terms", "counts", "minima"],
        )


def copy_groups(minima: list[list[int]]):
    """Group number of each example: those that share one of their minima are copies."""
    import numpy as np

    top = list(range(len(minima)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, m in enumerate(minima):
        for place in enumerate(m):
            j = find(first.setdefault(place, i))
            i_top = find(i)
            top[max(i_top, j)] = min(i_top, j)
    return np.array([find(i) for i in range(len(minima))], np.int64)


def vocabulary(terms: list[list[str]], y, share) -> list[str]:
    """The words whose presence depends on the label, each group of copies counted once."""
    with_it: dict[str, list[float]] = {}
    for ts, label, s in zip(terms, y, share):
        for t in ts:
            with_it.setdefault(t, [0.0, 0.0])[int(label)] += float(s)
    n = [float(share[y == 0].sum()), float(share[y == 1].sum())]
    total = n[0] + n[1]

    def g(a):
        out = 0.0
        for label in (0, 1):
            for seen, there in ((a[label], a[0] + a[1]), (n[label] - a[label], total - a[0] - a[1])):
                if seen > 1e-9:
                    out += 2 * seen * math.log(seen * total / (n[label] * there))
        return out

    strong = [(g(a), t) for t, a in with_it.items() if a[0] + a[1] >= 3]
    return [t for _, t in sorted((-s, t) for s, t in strong if s >= LEAST_G)[:VOCABULARY]]


def hits(texts, places: dict[str, int]):
    """Arrow strings -> (cols, counts, offsets): the vocabulary's words in each whole text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    owner, parts = [], []
    if any(n > PIECE for n in pc.binary_length(texts).fill_null(0).to_pylist()):  # long texts in pieces, cut at white space
        for i, text in enumerate(texts.to_pylist()):
            text, at = text or "", 0
            while at < len(text) or at == 0:
                to = at + PIECE
                while to < len(text) and not text[to].isspace():
                    to += 1
                parts.append(text[at:to])
                owner.append(i)
                at = to
        pieces = pa.array(parts, pa.large_string())
    else:
        pieces, owner = pc.fill_null(texts, ""), range(len(texts))
    lists = pc.utf8_split_whitespace(pieces)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    enc = lists.flatten().dictionary_encode()
    in_token = [[places[w] for w in words(u) if w in places] for u in enc.dictionary.to_pylist()]
    many = np.fromiter(map(len, in_token), np.int64, len(in_token))
    flat = np.fromiter((p for x in in_token for p in x), np.int64, int(many.sum()))
    start = np.r_[0, np.cumsum(many)]
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.nonzero(many[codes])[0] if len(many) else np.zeros(0, np.int64)
    n = many[codes[at]]
    text_of = np.asarray(owner, np.int64)[np.searchsorted(ends - ends[0], at, "right") - 1] if len(at) else at
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    cols = flat[np.repeat(start[codes[at]], n) + inside]
    size = max(1, len(places))
    key, count = np.unique(np.repeat(text_of, n) * size + cols, return_counts=True)
    return key % size, count, np.searchsorted(key, np.arange(len(texts) + 1) * size)


@dataclass
class Index:
    """Postings of unit TF-IDF vectors: word by word, in each by block of examples."""

    idf: Any
    starts: Any  # word * blocks + block -> first posting
    example: Any
    weight: Any
    most: Any  # (words, blocks) largest weight
    ids: Any
    y: Any
    share: Any
    group: Any

    def vector(self, cols, counts):
        """A text's unit vector."""
        import numpy as np

        w = (1 + np.log(counts)) * self.idf[cols]
        return w / max(np.sqrt((w * w).sum()), 1e-300)

    def nearest(self, cols, weights, k: int, without: int = -1):
        """The k examples of largest cosine above zero, ties by smaller number, those of the group
        ``without`` left out -> (examples, cosines)."""
        import numpy as np

        n, blocks = len(self.y), self.most.shape[1]
        bound = weights @ self.most[cols]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, cosines, least, at, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 2
        while at < len(order) and (len(found) < k or bound[order[at]] >= least * (1 - 1e-9)):
            look = order[at : at + step]
            at, step = at + step, step * 2
            cell = (cols[:, None] * blocks + look[None, :]).ravel()
            a, m = self.starts[cell], self.starts[cell + 1] - self.starts[cell]
            posting = np.repeat(a - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            dot = np.bincount(self.example[posting], self.weight[posting] * np.repeat(np.repeat(weights, len(look)), m), n)
            new = np.nonzero(dot > 0)[0]
            new = new[self.group[new] != without]
            found, cosines = np.r_[found, new], np.r_[cosines, dot[new]]
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            least = cosines[-1] if len(found) == k else 0.0
        return found, np.minimum(cosines, 1.0)


def index(cols: list, weights: list, idf, ids, y, share, group) -> Index:
    """Examples' sparse vectors -> their inverted index."""
    import numpy as np

    n, v = len(y), len(idf)
    blocks = max(1, -(-n // BLOCK))
    of = np.repeat(np.arange(n), [len(c) for c in cols])
    word, w = (np.concatenate(x) if len(x) else np.zeros(0) for x in (cols, weights))
    word = word.astype(np.int64)
    cell = word * blocks + of // BLOCK
    order = np.lexsort((of, cell))
    most = np.zeros(v * blocks)
    np.maximum.at(most, cell, w)
    return Index(idf, np.searchsorted(cell[order], np.arange(v * blocks + 1)), of[order], w[order], most.reshape(v, blocks), ids, y, share, group)


@dataclass
class Model:
    """An index and how votes become scores.  ``blank`` is the vote of a text without a known word."""

    index: Index
    prior: float
    blank: float
    slope: float
    level: float

    def vote(self, cols, counts, without: int = -1):
        """-> (vote for label 1, examples, cosines)."""
        import numpy as np

        if not len(cols):
            return self.blank, np.zeros(0, np.int64), np.zeros(0)
        at, cos = self.index.nearest(cols, self.index.vector(cols, counts), K, without)
        w = cos * cos * self.index.share[at]
        return float((w @ self.index.y[at] + PRIOR * self.prior) / (w.sum() + PRIOR)), at, cos

    def score(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.slope * vote + self.level))))


def calibrated(votes, y, share) -> tuple[float, float]:
    """Platt's logistic fit of labels on votes, with his smoothed targets."""
    import numpy as np

    n1, n0 = share[y == 1].sum(), share[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([votes, np.ones(len(votes))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (share * (target - p)))
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return float(b[0]), float(b[1])


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, held_out: str = HELD_OUT) -> DataFrame:
    """-> (id, score, evidence) for every row of ``docs``; evidence lists the nearest examples with
    cosine and label, nearest first.

    Examples come from ``labels (doc_id, label)`` outside ``held_out``; labels other than 0 and 1, of
    unknown documents or without an id are ignored.  A null, blank or unknown text has no neighbours
    and scores what such examples are labelled.  Without a usable label every score is 0.  Each row is
    scored by its own text: repeated rows score alike.  An empty table gives no rows; other columns
    are not looked at.  Ids are integers.
    """
    import numpy as np

    spark = docs.sparkSession
    known = labels.where(f"not ({held_out}) and {label_col} in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    some = sampled(src.withColumnRenamed("id", "doc_id"), known, sample, sample_bytes)
    rows = sorted(map_arrow(some, _examples, "doc_id long, y int, terms array<string>, counts array<int>, minima array<long>").collect(), key=lambda r: (r["doc_id"], r["y"], r["minima"]))
    y, ids = np.array([r["y"] for r in rows], np.int64), np.array([r["doc_id"] for r in rows], np.int64)
    group = copy_groups([r["minima"] for r in rows])
    share = 1 / np.bincount(group, minlength=len(rows))[group] if rows else np.zeros(0)
    places = {t: i for i, t in enumerate(vocabulary([r["terms"] for r in rows], y, share))}
    shared = spark.sparkContext.broadcast(places)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                cols, n, ends = hits(part.column(1), shared.value)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(cols, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))], names=["id", "cols", "counts"])

    table = materialize(map_arrow(src, count, "id long, cols array<int>, counts array<int>"), "toxic-words")
    df = dict(table.select(F.explode("cols").alias("c")).groupBy("c").count().collect())  # at most VOCABULARY rows
    total = table.count()
    idf = np.log((1.0 + total) / (1.0 + np.array([df.get(i, 0) for i in range(len(places))], np.float64)))

    own = []
    for r in rows:
        got = sorted((places[t], n) for t, n in zip(r["terms"], r["counts"]) if t in places)
        own.append((np.array([c for c, _ in got], np.int64), np.array([n for _, n in got], np.float64)))
    empty = Index(idf, None, None, None, None, ids, y, share, group)
    vectors = [empty.vector(*x) for x in own]
    ix = index([c for c, _ in own], vectors, idf, ids, y, share, group)
    bare = np.array([not len(c) for c, _ in own], bool)
    prior = float((share @ y + 0.5) / (share.sum() + 1)) if rows else 0.0
    blank = float((share[bare] @ y[bare] + prior) / (share[bare].sum() + 1)) if rows else 0.0
    model = Model(ix, prior, blank, 0.0, -100.0)
    if rows:
        votes = np.array([model.vote(c, n, int(g))[0] for (c, n), g in zip(own, group)])
        model.slope, model.level = calibrated(votes, y, share)
    sent = spark.sparkContext.broadcast(model)

    def judge(batches):
        import pyarrow as pa

        m, kept = sent.value, {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            out, why = [], []
            for cols, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key = (tuple(cols), tuple(n))
                if key not in kept:
                    if len(kept) >= 4096:
                        kept.clear()
                    vote, at, cos = m.vote(np.array(cols, np.int64), np.array(n, np.float64))
                    p = m.score(vote) if len(m.index.y) else 0.0
                    kept[key] = (p, [{"doc_id": int(m.index.ids[i]), "cosine": float(c), "label": int(m.index.y[i])} for i, c in zip(at, cos)])
                out.append(kept[key][0])
                why.append(kept[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(why, kind)], names=["id", "score", "evidence"])

    return map_arrow(table, judge, "id long, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")


def op12(spark, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
    return out.selectExpr("doc_id", f"{HELD_OUT} as held_out", "score", f"cast(score >= {THRESHOLD} as int) as predicted", "evidence")
