"""Model calls behind one protocol: servers, chains of them, retries, bounded concurrency, what a call used."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RETRYABLE
from ..shipping import map_arrow
from .prompts import AGAIN_INVALID, AGAIN_REPEATED, PROMPTS

MAX_ATTEMPTS = 3
#: Calls in flight at a time over a whole job, and texts of an embedding request.
IN_FLIGHT, EMBED_TEXTS = 16, 64


@dataclass
class Reply:
    """What a model answered, and what the server says it used (0 if it doesn't)."""

    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    model: str = ""


class Provider(Protocol):
    """``chat`` answers a stage's prompt, with ``note`` behind it, over ``text``; a plain string counts as a
    reply without usage."""

    def chat(self, stage: str, text: str, note: str = "") -> Reply | str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def reply_of(said: Reply | str) -> Reply:
    return said if isinstance(said, Reply) else Reply(said)


_built: dict[str, object] = {}
_building = threading.Lock()


class Once:
    """A provider that each worker process builds for itself, once, on its first call: ``Once(Http, url,
    model)``.  Connections and limits then live as long as the worker."""

    def __init__(self, make: Callable, *args, **kwargs):
        self.make, self.args, self.kwargs, self.key = make, args, kwargs, uuid.uuid4().hex

    def get(self) -> Provider:
        with _building:
            if self.key not in _built:
                _built[self.key] = self.make(*self.args, **self.kwargs)
            return _built[self.key]

    def chat(self, stage: str, text: str, note: str = "") -> Reply | str:
        return self.get().chat(stage, text, note)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.get().embed(texts)


class Unavailable(Exception):
    """The provider cannot be reached."""


class Offline:
    """Answers each stage in the form its parser reads, from the text's words alone.  For dry runs: it says
    nothing about a model's quality."""

    model = "offline-synthetic"

    def __init__(self, width: int = 64):
        self.width = width

    def chat(self, stage: str, text: str, note: str = "") -> str:
        words = re.findall(r"\w+", text)[:12] or ["empty"]
        if stage == "holistic":
            return f"core_thesis: {' '.join(words)}\ndomains: {words[0]}, {words[-1]}"
        if stage == "causal":
            return f"- cause: {words[0]}\nmechanism: {words[len(words) // 2]}\neffect: {words[-1]}\nrelation: leads_to"
        if stage == "context":
            return f"This part concerns {words[0]}."
        if stage == "image":
            return f"An image of {len(text)} characters of data."
        return f"type: concept\ntopic: {words[0].lower()}\nsummary: {' '.join(words)}\nkey_points: {', '.join(words[:3])}\nconfidence: 0.8"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = np.zeros((len(texts), self.width))
        for row, t in zip(out, texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest())
                row[h % self.width] += 1 if h >> 63 else -1
            row /= max(float(np.linalg.norm(row)), 1e-12)
        return out.tolist()


class Refused(Exception):
    """The server answers, and another try would not help."""


class Http:
    """A server with OpenAI-style /v1/chat/completions and /v1/embeddings.  Busy answers are tried
    again, ``tries`` times in all; a refused key is final; an answer without content gives its
    reasoning.  ``prompts`` are the stages' own; ``options`` go into every request."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60, tries: int = 4, backoff: float = 2, prompts: dict[str, str] = PROMPTS, options: dict | None = None):
        self.url, self.model, self.key, self.timeout, self.tries, self.backoff = url.rstrip("/"), model, key, timeout, tries, backoff
        self.prompts, self.options = prompts, options or {}

    def _open(self, path: str, body: dict):
        import urllib.error
        import urllib.request

        req = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for n in range(1, self.tries + 1):
            try:
                return urllib.request.urlopen(req, timeout=self.timeout)
            except urllib.error.HTTPError as e:
                if e.code not in (429, 500, 502, 503, 504):
                    raise Refused(f"status {e.code}") from e
                last = Unavailable(f"status {e.code}")
            except (urllib.error.URLError, TimeoutError) as e:
                last = Unavailable(str(e))
            if n < self.tries:
                time.sleep(n * n * self.backoff)
        raise last

    def _post(self, path: str, body: dict) -> dict:
        with self._open(path, body) as r:
            return json.load(r)

    def _asked(self, stage: str, text: str, note: str, **more) -> dict:
        system = self.prompts[stage] + (f"\n\n{note}" if note else "")
        data = text if stage != "image" else [{"type": "image_url", "image_url": {"url": text}}]
        return {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": data}], **self.options, **more}

    def chat(self, stage: str, text: str, note: str = "") -> Reply:
        out = self._post("/v1/chat/completions", self._asked(stage, text, note))
        said, used = out["choices"][0]["message"], out.get("usage") or {}
        return Reply(said.get("content") or said.get("reasoning") or said.get("reasoning_content") or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0), out.get("model") or self.model)

    def stream(self, stage: str, text: str, note: str = "") -> Iterator[Reply]:
        """The reply piece by piece; lines that can't be read are passed over.  What was used comes with
        the last piece, if the server tells."""
        with self._open("/v1/chat/completions", self._asked(stage, text, note, stream=True)) as r:
            for line in r:
                body = line.decode("utf-8", "replace").rstrip("\r\n").removeprefix("data: ")
                if body == "[DONE]":
                    return
                if got := _object(body):
                    used = got.get("usage") or {}
                    said = "".join((c.get("delta") or {}).get("content") or "" for c in got.get("choices") or [])
                    yield Reply(said, used.get("prompt_tokens", 0), used.get("completion_tokens", 0), got.get("model") or self.model)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [d["embedding"] for d in self._post("/v1/embeddings", {"model": self.model, "input": texts})["data"]]


def _object(line: str) -> dict | None:
    try:
        got = json.loads(line)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


class Local(Http):
    """A server with /api/chat and /api/embed."""

    def chat(self, stage: str, text: str, note: str = "") -> Reply:
        out = self._post("/api/chat", self._asked(stage, text, note, stream=False))
        return Reply(out["message"]["content"], out.get("prompt_eval_count", 0), out.get("eval_count", 0), out.get("model") or self.model)

    def stream(self, stage: str, text: str, note: str = "") -> Iterator[Reply]:
        with self._open("/api/chat", self._asked(stage, text, note, stream=True)) as r:
            for line in r:
                if got := _object(line.decode("utf-8", "replace")):
                    yield Reply((got.get("message") or got).get("content") or "", got.get("prompt_eval_count", 0), got.get("eval_count", 0), got.get("model") or self.model)
                    if got.get("done"):
                        return

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._post("/api/embed", {"model": self.model, "input": texts})["embeddings"]


class Streamed:
    """A server's streamed answers as whole replies, so that a slow one is read as it comes."""

    def __init__(self, server: Http):
        self.server = server

    def chat(self, stage: str, text: str, note: str = "") -> Reply:
        out = Reply("")
        parts = []
        for piece in self.server.stream(stage, text, note):
            parts.append(piece.text)
            out = Reply("", piece.prompt_tokens or out.prompt_tokens, piece.completion_tokens or out.completion_tokens, piece.model or out.model)
        out.text = "".join(parts)
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.server.embed(texts)


class Chain:
    """Models in order: the next one is asked when one's error is worth another try.  Embeddings are
    the first one's, since vectors of different models don't compare."""

    def __init__(self, *providers: Provider):
        self.providers = providers

    def chat(self, stage: str, text: str, note: str = "") -> Reply | str:
        for p in self.providers[:-1]:
            try:
                return p.chat(stage, text, note)
            except Exception as e:  # noqa: BLE001 - judged by its message
                if not isinstance(e, Unavailable) and not any(x in str(e) for x in RETRYABLE):
                    raise
        return self.providers[-1].chat(stage, text, note)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.providers[0].embed(texts)


class Fallback:
    """The first provider that can be reached."""

    def __init__(self, *providers: Provider):
        self.providers = providers

    def _try(self, call):
        for p in self.providers[:-1]:
            try:
                return call(p)
            except Unavailable:
                continue
        return call(self.providers[-1])

    def chat(self, stage: str, text: str, note: str = "") -> Reply | str:
        return self._try(lambda p: p.chat(stage, text, note))

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._try(lambda p: p.embed(texts))


def repeats(reply: str) -> bool:
    """Whether a reply of ten words or more says a word over ten times in a row, or three words over
    five times."""
    w = reply.lower().split()
    if len(w) < 10:
        return False
    run = longest = 1
    for a, b in zip(w, w[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return longest > 10 or max(Counter(zip(w, w[1:], w[2:])).values()) > 5


REPLIES = (
    "doc_id string, chunk_idx int, text string, response string, attempts int, error string, prompt_chars long, completion_chars long, "
    "prompt_tokens long, completion_tokens long, model string, latency_ms long"
)


def _ask(provider: Provider, stage: str, text: str, ok, retry: bool, backoff: float) -> tuple:
    """One row's call, with its repetitions -> the columns of REPLIES behind ``text``."""
    reply, error, n, note, sent, took, used = None, None, 0, "", 0, 0.0, Reply("")
    for n in range(1, MAX_ATTEMPTS + 1):
        sent += len(PROMPTS.get(stage, "").encode()) + len(text.encode()) + len(note.encode())
        start = time.monotonic()
        try:
            reply, error = reply_of(provider.chat(stage, text, note)), None
        except Exception as e:  # noqa: BLE001 - any provider error becomes data
            reply, error = None, f"{type(e).__name__}: {e}"
        took += time.monotonic() - start
        if reply is None:
            if retry and n < MAX_ATTEMPTS:
                time.sleep(n * n * backoff)
                continue
            break
        used = Reply("", used.prompt_tokens + reply.prompt_tokens, used.completion_tokens + reply.completion_tokens, reply.model)
        if repeats(reply.text):
            error, note = "repetitive reply", AGAIN_REPEATED
        elif not ok(reply.text):
            error, note = "invalid reply", AGAIN_INVALID + reply.text
        else:
            break
    said = None if reply is None else reply.text
    return said, n, error, sent, len((said or "").encode()), used.prompt_tokens, used.completion_tokens, used.model, int(took * 1000)


def call_model(
    rows: DataFrame, provider: Provider, stage: str, accept: str = "", partitions: int | None = None, retry: bool = False, backoff: float = 2, in_flight: int = IN_FLIGHT
) -> DataFrame:
    """``rows (doc_id, chunk_idx, text)`` -> REPLIES: up to three attempts while the reply repeats itself or
    doesn't match the pattern ``accept``, the later ones saying what was wrong; an error is a value, not a
    failed job, and tried again (after 2 and 8 seconds) with ``retry`` only.

    At most ``in_flight`` calls are open at a time over the whole job: the rows are dealt to as many tasks as
    the session runs side by side (or ``partitions``), and each keeps its share of the limit open.  A
    task's rows keep their order.  The plan calls the model each time it runs: write it (``scratch.written``)
    before using it twice.
    """
    tasks = max(1, min(partitions or rows.sparkSession.sparkContext.defaultParallelism, in_flight))
    own = max(1, in_flight // tasks)

    def run(batches):
        import pyarrow as pa

        ok = re.compile(accept).search if accept else lambda _: True
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        with ThreadPoolExecutor(own) as pool:
            for batch in batches:
                out = list(pool.map(lambda t: _ask(provider, stage, t or "", ok, retry, backoff), batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names=[c.split()[0] for c in REPLIES.split(", ")])

    src = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_idx").cast("int").alias("chunk_idx"), "text")
    return map_arrow(src.repartition(tasks), run, REPLIES)


def call_telemetry(replies: DataFrame, stage: str, model: str = "") -> DataFrame:
    """What ``call_model`` gives as telemetry rows; a call without a chunk has a null chunk_index, and one
    whose server named no model has ``model``.  ``telemetry.priced`` sets the cost from the tokens."""
    return replies.selectExpr(
        "doc_id as source", f"'{stage}' as stage", "chunk_idx as chunk_index", "attempts - 1 as retry_attempt", f"coalesce(nullif(model, ''), '{model}') as model", "prompt_tokens", "completion_tokens",
        "prompt_chars", "completion_chars", "0D as cost", "latency_ms", "error is null as success", "error", "current_timestamp() as timestamp",
    )


def embed_texts(rows: DataFrame, provider: Provider, id_col: str = "id", text_col: str = "text", per_call: int = EMBED_TEXTS) -> DataFrame:
    """-> (id, vector array<float>, error), ``per_call`` texts a request; a request that fails leaves its
    texts without a vector."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, vectors, errors = [t or "" for t in batch.column(1).to_pylist()], [], []
            for at in range(0, len(texts), per_call):
                part = texts[at : at + per_call]
                try:
                    got, error = provider.embed(part), None
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                except Exception as e:  # noqa: BLE001 - any provider error becomes data
                    got, error = [None] * len(part), f"{type(e).__name__}: {e}"
                vectors += got
                errors += [error] * len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["id", "vector", "error"])

    return map_arrow(rows.select(F.col(id_col).cast("string").alias("id"), text_col), run, "id string, vector array<float>, error string")
