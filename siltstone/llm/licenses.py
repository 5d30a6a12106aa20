"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a line, or a window of WINDOW words (every STRIDE words) of a longer one; and such a
window of a whole text of several lines, so that wrapped notices are whole.  One
logistic regression per licence family on hashed word n-grams (FTRL updates) scores it; Platt
scaling calibrates the scores on templates that the scored model has not seen (FOLDS models, each
without every FOLDS-th template), and a paragraph none of whose probabilities reaches KNOWN is
unknown.  Every family that reaches it counts if the paragraph holds CONFIRM of
the word pairs of one of the family's templates, unless another one's template explains them better
or the notice is denied ("not released under").

Training data are the templates in random surroundings, and as the unknown class sentences that
talk about licences without granting one, and words of a bounded sample of the corpus: one window of
SAMPLE_WORDS words, at a hashed place of the whole text, of at most SAMPLE_DOCS different texts, of each word the
first WORD_CHARS characters.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import read, slices
from .features import Ftrl, Hashing

#: Usual notices by licence family, the first parts of licence texts among them.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "released under the AGPL v3 license", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "released under the Apache 2.0 license", "you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License", "licensed under the BSD license", "Use of this source code is governed by a BSD-style license"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "released under the Boost Software License", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "under the Creative Commons Attribution 4.0 license"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "under the Creative Commons Attribution-NonCommercial 4.0 license"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "under the Creative Commons Attribution-ShareAlike 4.0 license"],
    "CC0": ["released into the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work", "under the Creative Commons CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0", "licensed under the Eclipse Public License v2.0", "released under the Eclipse Public License"],
    "GPL": ["licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation", "released under the GPL v3 license", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC license", "licensed under the ISC license"],
    "LGPL": ["licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "released under the LGPL v3 license", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "distributed under the terms of the MIT license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "released under the Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "released under the Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
#: Identifiers by family; "SPDX-License-Identifier: " and each is a template too.
SPDX = {
    "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "BSL-1.0": ["BSL-1.0"],
    "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC0": ["CC0-1.0"], "EPL-2.0": ["EPL-2.0"],
    "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "ISC": ["ISC"], "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"], "Unlicense": ["Unlicense"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {x}" for x in _ids]
#: How notices name the families in few words.
NAMES = {
    "AGPL-3.0": ["AGPL-3.0", "AGPLv3", "GNU AGPL version 3"], "Apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache 2.0 License"], "BSD": ["BSD-3-Clause", "BSD 2-Clause License", "BSD License"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License"], "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC0": ["CC0 1.0", "CC0-1.0"], "EPL-2.0": ["EPL-2.0", "Eclipse Public License"], "GPL": ["GNU GPL version 2", "GNU GPL version 3", "GPLv2", "GPLv3", "GPL-3.0"], "ISC": ["ISC", "ISC License"],
    "LGPL": ["GNU LGPL version 2.1", "GNU LGPL version 3", "LGPLv3", "LGPL-2.1"], "MIT": ["MIT", "MIT License"], "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public License"], "Unlicense": ["Unlicense"],
}
#: What stands around a name in a short notice.
FRAMES = ["License: {}", "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "available under the {}", "distributed under the {}", "under the terms of the {}", "{} licensed"]
#: And between two of a dual notice.
DUAL = ["dual-licensed under {} and {}", "licensed under {} and {}", "dual licensed {} or {}", "licensed under {} or {}", "under either the {} or the {}", "License: {} OR {}"]


def short_notices() -> dict[str, list[str]]:
    """Each family's short notices; in those of two families the name of the other is any."""
    return {f: [x.format(n) for n in names for x in FRAMES] for f, names in NAMES.items()}


#: Sentences of the unknown class.
OTHER = [
    "a driver must carry a licence at all times", "the public was released from the building under protest", "the license plate was registered in 2004",
    "all rights reserved by the publisher", "the general public may visit the museum", "students at MIT published a paper", "he works under the terms of a contract",
    "the software is available to licensed physicians only", "free copies of this version are sold in the shop", "the Apache helicopter landed", "Creative people share common attributes",
    "version 2 of the report was released", "the fishing licence expired in version 3 of the law", "the file is in compliance with the use of force rules", "this work is not yet finished",
    "the eclipse was watched by the public", "Mozilla published a new browser version", "the permission was granted by the mayor", "redistribution of wealth is permitted by law", "a boost to software exports",
]
#: Words that deny a notice if one of the three before it.
DENIALS = {"not", "never", "no", "nor", "neither", "isn't", "aren't", "wasn't", "cannot"}
#: Ends of sentences, and words that deny the notice before them.
STOPS, AFTER = ".!?;", {"does not apply", "do not apply", "doesn't apply", "did not apply"}
FAMILIES = sorted(TEMPLATES)
HASHING = Hashing(bits=16, words=3, shapes=0)
#: Bounds of the different texts whose words go into training, and of the words of each.
SAMPLE_DOCS, SAMPLE_WORDS, WORD_CHARS = 200, 100, 40
FOLDS = 3
WINDOW, STRIDE = 32, 16
CONFIRM = 0.8
#: A family is predicted from this calibrated probability on; templates decide then.
KNOWN = 0.25
#: Words of a long line that are looked at together: the windows are those of the whole line.
SHARE = 1 << 16
#: Characters of lines that are scored together.
LOOK = 2 << 20
_WORD = re.compile(r"\w+(?:['\u2019]t\b)?")
_SENTENCE = re.compile(r"[.!?;](?=\s|$)")
_SPELL = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def words_of(text: str) -> list[str]:
    return [_SPELL.get(w, w.replace("\u2019", "'")) for w in map(str.lower, _WORD.findall(text))]


def pairs(text: str) -> set[tuple[str, str]]:
    w = words_of(text)
    return set(zip(w, w[1:]))


TEMPLATE_PAIRS = {f: [p for t in [*TEMPLATES[f], *short_notices()[f]] if (p := pairs(t))] for f in FAMILIES}
#: Word pairs that name a family: a second name of a notice ("under A or B") is confirmed by them.
NAME_PAIRS = {f: [p for n in names if (p := pairs(n))] for f, names in NAMES.items()}
NAME_WORDS = {f: {words_of(n)[0] for n in names if len(words_of(n)) == 1} for f, names in NAMES.items()}
_GRANT = re.compile(r"\b(?:licen[sc]ed|released|available|distributed|licen[sc]e:|under)\b", re.I)


def sentences(text: str) -> list[list[str]]:
    return [words_of(x) for x in _SENTENCE.split(text)]


def denied(sentence: list[str], own: set[tuple[str, str]]) -> bool:
    """Whether, in every place where the template's word pairs begin in a sentence, one of the three words
    before denies them, or the words right behind them do."""
    at = [i for i, x in enumerate(zip(sentence, sentence[1:])) if x in own]
    begins = [i for i in at if not any(i - len(own) < j < i for j in at)]
    behind = " ".join(sentence[at[-1] + 2 : at[-1] + 5]) if at else ""
    return bool(begins) and (all(DENIALS & set(sentence[max(0, i - 3) : i]) for i in begins) or behind.startswith(tuple(AFTER)))


def holds(text: str, template: set[tuple[str, str]]) -> bool:
    """Whether a sentence of the text that holds some of the template doesn't deny it."""
    some = [s for s in sentences(text) if set(zip(s, s[1:])) & template]
    return not some or not all(denied(s, template) for s in some)


def second_names(families: list[str], text: str, first: set[str]) -> set[str]:
    """Families named beside a confirmed one in its own sentence, as in "under A or B"."""
    out = set()
    for s in _SENTENCE.split(text):
        w = words_of(s)
        own = set(zip(w, w[1:]))
        if not _GRANT.search(s) or not any(p <= own for f in first for p in NAME_PAIRS[f]) and not any(NAME_WORDS[f] & set(w) for f in first):
            continue
        joined = {b for a, b in own if a in ("and", "or")} | {c for a, b, c in zip(w, w[1:], w[2:]) if a in ("and", "or") and b == "the"}
        for f in families:
            named = [p for p in NAME_PAIRS[f] if p <= own and {a for a, _ in p} & joined] or NAME_WORDS[f] & joined
            if f not in first and named:
                out.add(f)
    return out


def confirmed_families(families: list[str], text: str) -> set[str]:
    """Those of ``families`` that the text confirms.  One whose word pairs there are all part of
    another's template that the text holds to a larger share is left out (GPL within LGPL), unless it stands
    there on its own too."""
    words = words_of(text)
    own = set(zip(words, words[1:]))
    best = {f: max((len(p & own) / len(p), len(p), i) for i, p in enumerate(TEMPLATE_PAIRS[f])) for f in families}
    best = {f: (x[0], x[1], TEMPLATE_PAIRS[f][x[2]]) for f, x in best.items() if x[0] >= CONFIRM}
    first = {f for f, (x, n, p) in best.items() if not any((y, m) > (x, n) and p & own <= q for y, m, q in best.values()) and holds(text, p)}
    return first | second_names(families, text, first) if first else first


def examples(words: list[str], seed: int = 7) -> list[tuple[str, str | tuple[str, str] | None, int]]:
    """(paragraph, family, two families or None, fold) from the templates, other sentences and corpus words.  A
    template's, and an other sentence's, paragraphs share a fold."""
    rng = random.Random(seed)
    around = lambda most: [rng.choice(words) for _ in range(rng.randrange(most + 1))]

    def spot(sentence: str) -> str:
        w = sentence.split()
        if rng.random() < 0.3:
            w = [x.upper() if rng.random() < 0.5 else x.lower() for x in w]
        most = rng.choice((4, 12, 30))
        return " ".join(around(most) + w + around(most)) + rng.choice(["", ".", "!", "###"])

    short = short_notices()
    out: list[tuple[str, str | tuple[str, str] | None, int]] = [(spot(t), f, k % FOLDS) for f, ts in TEMPLATES.items() for k, t in enumerate(ts) for _ in range(16)]
    out += [(spot(t), f, k % FOLDS) for f, ts in short.items() for k, t in enumerate(ts) for _ in range(2)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    made_up = lambda: "".join(rng.choice(letters) for _ in range(rng.choice((1, 1, 2, 4, 7))))
    out += [(" ".join(made_up() for _ in range(rng.randrange(2, 40))), None, k % FOLDS) for k in range(300)]  # words of no language
    for k in range(400):  # a few words over and over
        few = [rng.choice((made_up(), rng.choice(words), rng.choice(letters), rng.choice(letters))) for _ in range(rng.randrange(1, 8))]
        out.append((" ".join(few * rng.randrange(3, 33)), None, k % FOLDS))
    known = {p for ps in TEMPLATE_PAIRS.values() for x in ps for p in x}
    for k in range(1200):  # the corpus as it stands, where it holds no part of a notice
        i = rng.randrange(len(words))
        span = " ".join(words[i : i + rng.randrange(3, WINDOW + 1)] * rng.choice((1, 1, 2)))
        own = pairs(span)
        if 5 * len(own & known) <= len(own):
            out.append((span, None, k % FOLDS))
    for k in range(800):  # notices of two families
        f, g = rng.sample(FAMILIES, 2)
        t = spot(rng.choice(DUAL).format(rng.choice(NAMES[f]), rng.choice(NAMES[g])))
        out.append((t, (f, g), k % FOLDS))
    out += [(spot(t), None, k % FOLDS) for k, t in enumerate(OTHER) for _ in range(16)]
    out += [(" ".join(around(60)), None, k % FOLDS) for k in range(400)]
    every = [x for ts in TEMPLATES.values() for t in ts for x in t.split()]
    out += [(spot(" ".join(rng.sample(every, 5))), None, k % FOLDS) for k in range(160)]  # licence words in no order
    rng.shuffle(out)
    return out


@lru_cache(maxsize=1)
def run_columns():
    """Columns of n-grams that lie inside a run of one repeated word: no evidence either way."""
    import numpy as np
    import pyarrow as pa

    cols, ok, offsets = HASHING.batch(pa.array(["a a a a a", "b b b b b"]))
    return np.intersect1d(*(cols[:, s:e][ok[:, s:e]] for s, e in zip(offsets[:-1], offsets[1:])))


def vectors(texts):
    """Arrow strings -> for each (columns, counts / sqrt(total))."""
    import numpy as np

    cols, ok, offsets = HASHING.batch(texts)
    for a, b in zip(offsets[:-1], offsets[1:]):
        c, n = np.unique(cols[:, a:b][ok[:, a:b]], return_counts=True)
        some = ~np.isin(c, run_columns())
        yield c[some], n[some] / max(1.0, np.sqrt(b - a))


def platt(scores, labels, steps: int = 200):
    """(a, b) of sigmoid(a * score + b), by Newton steps with a weak prior for a = 1, b = 0."""
    import numpy as np

    x, w = np.stack([scores, np.ones_like(scores)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + 0.1 * (w - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows, labels, epochs: int = 6):
    """-> weights (columns + 1, families): each family against all else, by FTRL updates that all
    families make at once."""
    import numpy as np

    model = Ftrl(1 << HASHING.bits, alpha=0.6, l1=0.03, outputs=len(FAMILIES))
    for _ in range(epochs):
        for (cols, values), y in zip(rows, labels):
            model.update(cols, values, y)
    return model.weights().astype(np.float64)


def fit(words: list[str]):
    """-> (weights (columns + 1, families), calibration (families, 2)).  The calibration is learnt on
    scores of templates that the scoring model was not trained on."""
    import numpy as np
    import pyarrow as pa

    data = examples(words)
    rows = list(vectors(pa.array([t for t, _, _ in data])))
    y = np.array([[x in f if isinstance(f, tuple) else x == f for x in FAMILIES] for _, f, _ in data], np.float64)
    fold = np.array([k for _, _, k in data])
    scores = np.zeros(y.shape)
    for k in range(FOLDS):
        w = train([rows[i] for i in np.nonzero(fold != k)[0]], y[fold != k])
        for i in np.nonzero(fold == k)[0]:
            scores[i] = rows[i][1] @ w[rows[i][0]] + w[-1]
    scale = [platt(scores[:, f], y[:, f]) for f in range(len(FAMILIES))]
    return train(rows, y).astype(np.float32), np.array(scale)


def corpus_words(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> list[str]:
    """Words of at most ``sample`` different texts, for the surroundings of training examples only:
    those with the smallest hashes, and of each a window of ``words`` words at a hashed place.  A
    threshold on the hash keeps most texts from being cut into words; where copies leave too few, it
    is raised."""
    src = docs.where(f"length(`{text_col}`) > 0").select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    total, share = docs.count(), 1.0
    if total > 8 * sample:
        share = 8 * sample / total
    while True:
        most = int(share * 2**64) - 2**63 - 1
        some = src.where(F.col("h") <= most).selectExpr("h", r"transform(filter(split(t, r'\s+'), w -> w <> ''), w -> left(w, " + str(WORD_CHARS) + r")) as w")
        window = f"slice(w, cast(pmod(xxhash64(h), greatest(1, size(w) - {words} + 1)) as int) + 1, {words})"
        rows = some.groupBy("h").agg(F.first(F.expr(window)).alias("w")).orderBy("h").limit(sample).collect()
        if len(rows) >= sample or share >= 1:
            return [x for r in rows for x in r["w"]] or ["text"]
        share = min(1.0, 8 * share)


def shares(text: str):
    """A line's words, SHARE at a time with those that the windows beginning there need behind them: the windows
    of all shares are the line's."""
    held: list[str] = []
    for m in re.finditer(r"\S+", text):
        held.append(m.group())
        if len(held) > SHARE + WINDOW - STRIDE:
            yield " ".join(held[:-1])
            held = held[SHARE:]
    yield " ".join(held)


class Finds:
    """What is found in a batch's documents."""

    def __init__(self, n: int, weights, scale):
        import numpy as np

        self.weights, self.scale = weights, scale
        self.families: list[set[str]] = [set() for _ in range(n)]
        self.paragraphs, self.predicted, self.confirmed = (np.zeros(n, np.int32) for _ in range(3))

    def look(self, texts: list[str], doc_of) -> None:
        """Score all windows of some lines, and confirm what is predicted."""
        import numpy as np
        import pyarrow as pa

        weights, scale, n_docs = self.weights, self.scale, len(self.families)
        cols, ok, at = HASHING.batch(pa.array(texts, pa.large_string()))
        sums = np.zeros((cols.shape[1] + 1, len(FAMILIES)))
        for c, o in zip(cols, ok):
            sums[1:] += weights[c] * o[:, None]
        np.cumsum(sums, axis=0, out=sums)
        n = np.diff(at)
        wins = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), wins)
        k = np.arange(len(text)) - np.repeat(np.cumsum(wins) - wins, wins)
        a = at[text] + k * STRIDE
        b = np.minimum(a + WINDOW, at[text] + n[text])
        raw = (sums[b] - sums[a]) / np.sqrt(np.maximum(1, b - a))[:, None] + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(raw * scale[:, 0] + scale[:, 1], -30, 30)))
        self.paragraphs += np.bincount(doc_of[text], minlength=n_docs).astype(np.int32)
        last, words = -1, []
        for i in np.nonzero((p >= KNOWN).any(axis=1))[0]:
            d, lo = doc_of[text[i]], int(a[i] - at[text[i]])
            if text[i] != last:
                last, words = text[i], texts[int(text[i])].split()
            self.predicted[d] += 1
            sure = confirmed_families([FAMILIES[f] for f in np.nonzero(p[i] >= KNOWN)[0]], " ".join(words[max(0, lo - STRIDE) : lo + WINDOW + STRIDE]))
            self.confirmed[d] += bool(sure)
            self.families[d] |= sure


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """-> (id, licenses, n_paragraphs, n_predicted, n_confirmed): ``licenses`` lists the confirmed
    families, sorted, comma-joined ('' for none).

    One row per row of ``docs``.  A null or blank text has no paragraph; whole texts are scanned,
    by lines and across them, long lines share by share with the windows of the whole; repeated rows give equal
    rows; an empty table gives none; other columns are not looked at.  Ids are integers.
    """
    model = fit(corpus_words(docs, text_col, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def lines(texts):
        """(row, line or share of one) of a batch, and the whole text of those of several lines."""
        for d, t in enumerate(texts):
            t = t or ""
            own = t.split("\n")
            for x in [*own, *([t] if len(own) > 1 else [])]:
                if len(x) <= SHARE:  # no more words than characters
                    yield d, x
                else:
                    yield from ((d, y) for y in shares(x))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                finds = Finds(len(part), *shared.value)
                held, of, size = [], [], 0
                for d, x in lines(part.column(1).to_pylist()):
                    held.append(x)
                    of.append(d)
                    size += len(x)
                    if size >= LOOK:
                        finds.look(held, np.array(of))
                        held, of, size = [], [], 0
                if held:
                    finds.look(held, np.array(of))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([",".join(sorted(f)) for f in finds.families]), pa.array(finds.paragraphs), pa.array(finds.predicted), pa.array(finds.confirmed)],
                    names=["id", "licenses", "n_paragraphs", "n_predicted", "n_confirmed"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "id long, licenses string, n_paragraphs int, n_predicted int, n_confirmed int")


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
