"""Model calls: each made once, so many at a time, priced by what the server says; replies read piece by piece."""

import json
import os
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle

from siltstone.functions import parse, text
from siltstone.operators import prompts, providers, split, stages, telemetry
from siltstone.operators.blocks import BlockParser, blocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
CHUNK = "Type: idea\ntopic: t\nsummary: s of it\nkey_points: a, b\nconfidence: 0.5"


class Counting:
    """Answers each stage and notes every call in a folder, where all workers see it."""

    def __init__(self, folder):
        self.folder = str(folder)

    def chat(self, stage, t, note=""):
        import uuid
        from pathlib import Path

        (Path(self.folder) / f"{stage}-{uuid.uuid4().hex}").write_text(t)
        said = {"chunk": CHUNK, "holistic": "core_thesis: x\ndomains: d", "causal": "causal_chains:\n- cause: a\n  effect: b\n  relation: causes", "context": "within it", "clean": f" {t} "}[stage]
        return providers.Reply(said, 10, 4, "m-big")

    def embed(self, texts):
        return [[1.0]] * len(texts)


def made(folder):
    out = {}
    for p in folder.iterdir():
        stage = p.name.split("-")[0]
        out[stage] = out.get(stage, 0) + 1
    return out


def test_each_call_is_made_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * 900 + "\n" + "other " * 400) for i in range(5)], "doc_id long, text string")
    chunks = split.chunk_documents(docs)
    n = chunks.count()
    got = stages.analysed(chunks, Counting(tmp_path))
    assert got.count() == 5 and all("## Holistic Analysis" in r.markdown and "within it" in r.markdown for r in got.collect())
    assert made(tmp_path) == {"chunk": n, "context": n, "holistic": 5, "causal": 5} and n > 5


def test_cleaning_goes_by_size(spark, tmp_path):
    docs = spark.createDataFrame([(1, "short"), (2, "one\n\n" + "x" * 20 + "\n\n" + "y" * 30), (3, " \n "), (4, None)], "doc_id long, text string")
    asked = stages.cleaning_calls(docs, most=30)
    assert sorted((r.doc_id, r.chunk_idx, r.text) for r in asked.collect()) == [("1", 0, "short"), ("2", 0, "one\n\n" + "x" * 20), ("2", 1, "\n\n" + "y" * 28), ("2", 2, "yy")]
    got = {r.doc_id: (r.text, r.error) for r in stages.clean(docs, Counting(tmp_path)).collect()}
    assert got == {"1": ("short", None), "2": ("one\n\n" + "x" * 20 + "\n\n" + "y" * 30, None)} and made(tmp_path) == {"clean": 2}
    replies = spark.createDataFrame([("1", 0, "a", None), ("1", 1, None, "Unavailable: down"), ("2", 1, "b", None), ("2", 0, " a ", None), ("3", 0, " ", None)], "doc_id string, chunk_idx int, response string, error string")
    assert {r.doc_id: (r.text, r.error) for r in stages.cleaned(replies).collect()} == {"1": (None, "Unavailable: down"), "2": ("a\n\nb", None), "3": (None, "empty reply")}


def test_usage_is_kept_and_priced(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y")], "doc_id string, chunk_idx int, text string")
    calls = providers.call_telemetry(stages.chunk_replies(rows, Counting(tmp_path)), "chunk")
    prices = spark.createDataFrame([("M-Big", 2.0, 10.0)], "model string, input_price double, output_price double")
    got = telemetry.priced(calls, prices).collect()
    assert [(r.model, r.prompt_tokens, r.completion_tokens, round(r.cost, 9)) for r in got] == [("m-big", 10, 4, 0.00006)] * 2
    assert all(r.prompt_chars > len(prompts.CHUNK) for r in got)


class Slow:
    """Counts how many calls it has open."""

    def __init__(self, folder):
        self.folder, self.open, self.peak, self.lock = folder, 0, 0, threading.Lock()
        with open(f"{folder}/built-{os.getpid()}", "a") as f:
            f.write("x")

    def chat(self, stage, t, note=""):
        with self.lock:
            self.open += 1
            self.peak = max(self.peak, self.open)
        time.sleep(0.05)
        with self.lock:
            self.open -= 1
            with open(f"{self.folder}/peak-{os.getpid()}", "w") as f:
                f.write(str(self.peak))
        return t

    def embed(self, texts):
        return []


def test_calls_in_flight_are_bounded_and_ordered(spark, tmp_path):
    rows = spark.range(80).selectExpr("'d' as doc_id", "cast(id as int) as chunk_idx", "cast(id as string) as text")
    for tasks, limit in ((2, 8), (8, 3), (1, 4)):
        folder = tmp_path / f"{tasks}-{limit}"
        folder.mkdir()
        got = providers.call_model(rows.coalesce(1), providers.Once(Slow, str(folder)), "chunk", partitions=tasks, in_flight=limit).collect()
        assert all(r.response == r.text for r in got) and len(got) == 80
        peaks = [int(p.read_text()) for p in folder.glob("peak-*")]
        assert len(peaks) <= min(tasks, limit) and max(peaks) <= limit // min(tasks, limit) and sum(peaks) <= limit
        assert len(peaks) > 1 or max(peaks) > 1
        assert all(p.read_text() == "x" for p in folder.glob("built-*"))


def test_order_within_a_task(spark):
    class Hasty:
        def chat(self, stage, t, note=""):
            time.sleep(0.02 * (int(t) % 3))
            return t

    rows = spark.createDataFrame([("d", i, str(i)) for i in range(30)], "doc_id string, chunk_idx int, text string").coalesce(1).sortWithinPartitions("chunk_idx")
    got = providers.call_model(rows, Hasty(), "chunk", partitions=1, in_flight=6).collect()
    assert [r.response for r in got] == [r.text for r in got] and sorted(int(r.text) for r in got) == list(range(30))


def test_prompts_ask_for_what_the_parsers_read(spark):
    assert all(f"\n{k}: " in prompts.CHUNK for k in parse.KEYS) and all(k in prompts.CHUNK for k in prompts.KINDS)
    reply = prompts.HOLISTIC[prompts.HOLISTIC.index("core_thesis:") :]
    got = spark.createDataFrame([(reply,)], "x string").selectExpr(f"{text.holistic('x')} as h").first().h
    assert got.core_thesis.startswith("(what") and got.domains
    form = prompts.CAUSAL[prompts.CAUSAL.index("causal_chains:") :]
    c = spark.createDataFrame([(form,)], "x string").selectExpr(f"{parse.causal('x')} as c").first().c
    assert len(c.chains) == 1 and c.chains[0].relation.startswith("(one of causes") and len(c.preconditions) == len(c.counterfactuals) == 1
    assert prompts.with_context("p", " ") == "p" and prompts.with_context("p", "known").endswith("Context:\nknown") and "5 different" in prompts.variants(5)


# Blocks ----------------------------------------------------------------------------------------
REPLIES = [
    ("> memory\nПользователь пишет\n<", [("memory", None, "Пользователь пишет")]),
    ("> topic: chunk=3, lang=ru\nгоры, море\n<", [("topic", {"chunk": "3", "lang": "ru"}, "горы, море")]),
    ("> topic\none\n<\n> summary\ntwo words\n<", [("topic", None, "one"), ("summary", None, "two words")]),
    ("A reply without marks", [("text", None, "A reply without marks")]),
    ("> memory\nnot closed", [("memory", None, "not closed")]),
    ("> quote\na > b\n<", [("quote", None, "a > b")]),
    ("", []),
    (" \n ", []),
    ("before\n > a: x, =y, k = v \n 1\n\n2 \n<\nbetween\n> b: \n>\n> c\n", [("a", {"k": "v"}, "1\n\n2"), ("b:", None, ">"), ("c", None, "")]),
]


@pytest.mark.parametrize(("reply", "want"), REPLIES)
def test_every_cut_gives_the_same_blocks(reply, want):
    plain = lambda bs: [(b["type"], b["params"], b["content"]) for b in bs]
    assert plain(blocks([reply])) == want
    for i in range(len(reply) + 1):
        assert plain(blocks([reply[:i], reply[i:]])) == want
        p = BlockParser()
        out = p.feed(reply[:i])
        p = BlockParser(**json.loads(json.dumps(p.state())))  # saved and set up again
        assert plain([*out, *p.feed(reply[i:]), *p.close()]) == want
    assert plain(blocks(reply)) == want


def test_blocks_come_as_soon_as_they_end():
    p = BlockParser()
    assert p.feed("> a\n1") == [] and p.feed("\n<") == [] and p.feed("\n")[0]["content"] == "1" and p.close() == []


def test_sql_and_incremental_parsers_agree(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, x string")
    for r in df.selectExpr("i", f"{parse.typed_blocks('x')} as b").collect():
        if r.i != 8:  # a header's odd spaces
            assert [(b.type, b.params, b.content) for b in r.b] == REPLIES[r.i][1]


@pytest.fixture
def server():
    class Lines(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            pieces = ["> to", "pic\non", "e\n<\n", "> b\ntwo"]
            if self.path == "/api/chat":
                out = [json.dumps({"message": {"content": p}}) for p in pieces] + ["{broken", json.dumps({"content": "", "done": True, "prompt_eval_count": 9, "eval_count": 4}), json.dumps({"message": {"content": "late"}})]
            else:
                out = ["data: " + json.dumps({"choices": [{"delta": {"content": p}}], "model": "big"}) for p in pieces] + ["", ": comment", "data: {bad", "data: " + json.dumps({"choices": [], "usage": {"prompt_tokens": 8, "completion_tokens": 3}}), "data: [DONE]", 'data: {"choices": [{"delta": {"content": "late"}}]}']
            assert body["stream"] is True
            self.send_response(200)
            self.end_headers()
            for line in out:
                self.wfile.write(line.encode() + b"\n")
                self.wfile.flush()

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Lines)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_streaming_clients(spark, server):
    for client, used in ((providers.Http(server, "m"), (8, 3)), (providers.Local(server, "m"), (9, 4))):
        got = list(blocks(p.text for p in client.stream("chunk", "t")))
        assert [(b["type"], b["content"]) for b in got] == [("topic", "one"), ("b", "two")]
        whole = providers.Streamed(client).chat("chunk", "t")
        assert whole.text == "> topic\none\n<\n> b\ntwo" and (whole.prompt_tokens, whole.completion_tokens) == used
    rows = spark.createDataFrame([("d", 0, "x")], "doc_id string, chunk_idx int, text string")
    got = providers.call_model(rows, providers.Streamed(providers.Local(server, "m")), "chunk").first()
    assert got.response.startswith("> topic") and got.completion_tokens == 4 and got.error is None
