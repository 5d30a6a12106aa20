"""Byte-level BPE by prefix-sharing trie traversal.

Let e(p) be the BPE encoding of a word prefix p.  e(p) = e(p without its last token) + that last
token, so the last token of each prefix is all the state there is.  The distinct
new words of a batch form a trie; a depth-first walk gives each node its prefix's last token, found among the
vocabulary's tokens that end there: exactly one of them forms a valid pair with the last token
before it.  A prefix shared by many words is thus encoded once; a word's ids are
read off by stepping back along its path.

The vocabulary (a tokenizers-library JSON of a byte-level BPE model) is a parameter; its content,
a few MB whatever the corpus, is broadcast.  A worker keeps the ids of the words it has seen and
forgets them all at ``MAX_WORDS``, which bounds its memory and changes no result.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import slices

MAX_WORDS, MAX_PAIRS = 400_000, 1_000_000
#: Fixed value: the pre-tokenizer pattern of byte-level BPE (tokenizers' ByteLevel with use_regex).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's letters for bytes: printable Latin-1 stands for itself, the others for
    the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, spec: str):
        import regex

        d = json.loads(spec)
        if d["model"]["type"] != "BPE" or (d.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        vocab = {k: v for k, v in d["model"]["vocab"].items() if k not in self.special}
        self.ids = {raw(k): v for k, v in vocab.items()}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.rank = {}
        for i, m in enumerate(d["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[self.ids[raw(a)], self.ids[raw(b)]] = (i, self.ids[raw(a) + raw(b)])
        self.parents = {t: (r, *pair) for pair, (r, t) in self.rank.items()}
        self.longest = max(map(len, self.ids))
        self.size = max(self.bytes_of) + 1
        self.prefix_space = bool(d["pre_tokenizer"].get("add_prefix_space"))
        self.pieces = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fits: dict[int, bool] = {}
        self.words: dict[str | int, bytes] = {}
        self.alone = {t: self.whole(w) for w, t in self.ids.items()}

    def whole(self, word: bytes) -> bool:
        """Whether a token's own bytes are encoded as that token: no pair that crosses the seam
        of its last merge would have merged before it."""
        up = self.parents.get(self.ids[word])
        return up is None or self.pair_fits(up[1], up[2], up[0])

    def pair_fits(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether the encodings of two tokens' bytes stay apart when joined, up to the merge
        of rank ``until``.

        Seen backwards in time, the tokens at the seam come apart one merge after the other,
        the later merge first.  Two neighbours existed together until the rank of the merge
        undone last; had their own merge a lower rank, it would have come first.
        """
        rank, parents = self.rank, self.parents
        while True:
            joined = rank.get((a, b))
            if joined is not None and joined[0] < until:
                return False
            pa, pb = parents.get(a), parents.get(b)
            if pa is None and pb is None:
                return True
            if pb is None or pa is not None and pa[0] > pb[0]:
                until, a = pa[0], pa[2]
            else:
                until, b = pb[0] + 1, pb[1]  # at equal rank the merge further left comes first

    def learn(self, words: set[str]) -> None:
        """Note the ids of words.

        Sorted, the words are the depth-first walk of their trie: what a word shares with the
        one before it is the path that stays.  ``token[d]`` and ``start[d]`` are the state at
        depth d of the path: the last token of that prefix's encoding and where it starts.
        """
        if len(self.fits) > MAX_PAIRS:
            self.fits.clear()
        words = words - set(self.special.values())
        self.words |= {i: i.to_bytes(4, "little") for i in self.special.values()}
        ids, fits, alone, longest, size = self.ids.get, self.fits, self.alone, self.longest, self.size
        token, start, before = [0], [0], b""
        for word, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del token[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for s in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                    t = ids(word[s:end])
                    if t is None:
                        continue
                    if s == 0:
                        if alone[t]:
                            break
                    else:
                        fit = fits.get(token[s] * size + t)
                        if fit is None:
                            fit = fits[token[s] * size + t] = self.pair_fits(token[s], t)
                        if fit:
                            break
                token.append(t)
                start.append(s)
            before, at, out = word, len(word), []
            while at:
                out.append(token[at])
                at = start[at]
            self.words[text] = b"".join([i.to_bytes(4, "little") for i in reversed(out)])

    def parts(self, text: str) -> list:
        """The text's pre-tokens in order; added tokens, which the library matches first, as ints."""
        if not self.split:
            return self.plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        return self.pieces(" " + text if self.prefix_space and text and text[0] != " " else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.parts(t) for t in texts]
        pieces = set()
        for ps in split:
            pieces.update(ps)
        known = self.words
        if len(known) > MAX_WORDS:
            known.clear()
        if fresh := pieces.difference(known):
            self.learn(fresh)
        return [b"".join([known[p] for p in ps]) for ps in split]

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """This process's codec for a vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, n_tokens, ids array<int>): the whole text's encoding.  A null text counts as
    empty (no ids); repeated rows and ids are each encoded; an empty table gives no rows; other
    columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(_spec(vocab_path))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                out = own.encode([t or "" for t in part.column(1).to_pylist()])
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["id", "n_tokens", "ids"],
                )

    return map_arrow(_two(docs, id_col, text_col), run, "id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(id, ids array<int>) -> (id, text).  Null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_spec(vocab_path))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec(shared.value)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return map_arrow(encoded.select("id", "ids"), run, "id long, text string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass -> (id, n_tokens, ids_sha256, decoded_sha256);
    the same codec and the same defined results as the two operators above."""
    shared = docs.sparkSession.sparkContext.broadcast(_spec(vocab_path))

    def run(batches):
        import pyarrow as pa

        own, sha = codec(shared.value), hashlib.sha256
        for batch in batches:
            for part in slices(batch, "text"):
                out = own.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in out], pa.int64()),
                        pa.array([sha(x).hexdigest() for x in out]),
                        pa.array([sha(own.decode(x).encode()).hexdigest() for x in out]),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_arrow(
        _two(docs, id_col, text_col), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return round_trip(read(spark, sf_dir, "documents"), default_vocab()).withColumnRenamed("id", "doc_id")
