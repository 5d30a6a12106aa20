"""Hashed word n-grams and follow-the-regularised-leader logistic regression, on Arrow and NumPy.

A word is a run between white space.  Its features are its lower-cased letters and its shape
(case, the punctuation around it, digits, whether it repeats the word before), so the n-grams
generalise over invented or unseen words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_EDGE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
#: Odd 64-bit multipliers of the n-gram hash.
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shape(word: str) -> str:
    """Case and punctuation of a word, without its letters."""
    lead, core, tail = _EDGE.match(word).groups()
    kind = "0" if not core else "9" if core.isdigit() else "A" if core.isupper() and len(core) > 1 else "Aa" if core[0].isupper() else "a"
    if kind == "a" and any(c.isdigit() for c in core):
        kind = "a9"
    return f"{lead[:3]}|{kind}|{tail[:4]}"


@dataclass(frozen=True)
class Hashing:
    """Features: word n-grams up to ``words`` words and shape n-grams up to ``shapes``, hashed
    into 2**bits columns."""

    bits: int = 18
    words: int = 2
    shapes: int = 3

    def batch(self, texts):
        """Arrow strings -> (cols (k, n), ok (k, n), offsets): for each word position its k
        n-grams' columns, which of them exist, and each text's range of positions."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        blank = pc.equal(flat, "")
        if pc.any(blank).as_py():  # a blank text splits into one empty word
            keep = ~blank.to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            flat = flat.filter(pa.array(keep))
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        enc = flat.dictionary_encode()
        codes = enc.indices.to_numpy(zero_copy_only=False)
        uniq = enc.dictionary.to_pylist()
        own = np.fromiter((xxhash.xxh64_intdigest(_EDGE.sub(r"\2", u).lower(), 1) for u in uniq), np.uint64, len(uniq))
        form = np.fromiter((xxhash.xxh64_intdigest(shape(u), 2) for u in uniq), np.uint64, len(uniq))
        n = len(codes)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        same = np.zeros(n, bool)
        same[1:] = (codes[1:] == codes[:-1]) & (text_of[1:] == text_of[:-1])
        h = own[codes] if n else np.zeros(0, np.uint64)
        s = form[codes] if n else np.zeros(0, np.uint64)
        s = np.where(same, s ^ np.uint64(_MULT[2]), s)
        h = np.where(same, np.uint64(_MULT[1]), h)
        cols, ok = [], []
        for base, most, salt in ((h, self.words, 3), (s, self.shapes, 5)):
            acc = base * np.uint64(_MULT[0])
            inside = np.ones(n, bool)
            for k in range(most):
                if k:
                    acc = acc.copy()
                    acc[:-k] = (acc[:-k] ^ (base[k:] >> np.uint64(7))) * np.uint64(_MULT[k % 3])
                    inside = inside.copy()
                    inside[:-k] &= text_of[:-k] == text_of[k:]
                    inside[-k:] = False
                cols.append((((acc + np.uint64(salt * (k + 1))) * np.uint64(_MULT[1])) >> np.uint64(64 - self.bits)).astype(np.int32))
                ok.append(inside)
        return np.array(cols).reshape(len(cols), n), np.array(ok).reshape(len(ok), n), offsets

    def sparse(self, texts):
        """Arrow strings -> for each text (columns, values), L2-normalised square roots of counts."""
        import numpy as np

        cols, ok, offsets = self.batch(texts)
        for a, b in zip(offsets[:-1], offsets[1:]):
            c, n = np.unique(cols[:, a:b][ok[:, a:b]], return_counts=True)
            v = np.sqrt(n.astype(np.float64))
            yield c, v / max(np.sqrt((v * v).sum()), 1e-12)


@dataclass
class Ftrl:
    """Logistic regression by follow-the-regularised-leader (FTRL-proximal) updates: per column
    the gradient sum z and the squared gradient sum n; the weight is their closed form.  With
    ``outputs`` several regressions over the same columns learn side by side."""

    columns: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    outputs: int = 0

    def __post_init__(self):
        import numpy as np

        shape = (self.columns + 1, self.outputs) if self.outputs else self.columns + 1
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self, at=slice(None)):
        import numpy as np

        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, cols, values, label) -> None:
        """One example; the last column is the bias.  ``label``: 0 or 1, or one for each output."""
        import numpy as np

        at, x = np.append(cols, self.columns), np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = np.multiply.outer(x, p - label)
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g
