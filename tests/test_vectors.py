"""Literal cases: parsers, text functions, containers, providers, streams."""

import io
import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.functions import parse, text
from siltstone.operators import assemble, providers, search, split, stages, telemetry
from siltstone.sinks import files as sinks
from siltstone.sources import files, workspace
from siltstone.streaming import telemetry as streams


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").selectExpr(f"{expr} as y").first()[0]


@pytest.mark.parametrize(
    ("reply", "blocks"),
    [
        ("> memory\nsome text\n<", [("memory", None, "some text")]),
        ("> topic: chunk=3, lang=ru\nx\n<", [("topic", {"chunk": "3", "lang": "ru"}, "x")]),
        ("> a\n1\n<\n> b\n2\n<", [("a", None, "1"), ("b", None, "2")]),
        ("just a sentence", [("text", None, "just a sentence")]),
        ("> a\nno end", [("a", None, "no end")]),
        ("> a\nx > y\n<", [("a", None, "x > y")]),
        ("> a\n1\n> b\n2\n<", [("a", None, "1"), ("b", None, "2")]),
        ("  ", []),
    ],
)
def test_typed_blocks(spark, reply, blocks):
    assert [(b.type, b.params, b.content) for b in one(spark, parse.typed_blocks("x"), reply)] == blocks


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (text.word_count("x"), "a  b\tc\nd", 4), (text.word_count("x"), "", 0), (text.word_count("x"), "a\rb", 1),
        (text.html_text("x"), "a &amp;lt; b", "a < b"), (text.html_text("x"), "<p>a</p><b>c", "a\nc"),
        (text.title("x"), "x/.hidden", ".hidden"), (text.title("x"), "x/a.b.md", "a.b"), (text.title("x"), "", "unnamed_document"),
        (text.is_boilerplate_page("x"), "a" * 49, True), (text.is_boilerplate_page("x"), "a" * 50, False), (text.is_boilerplate_page("x"), "1" * 60, True),
        (text.comma_list("x"), "a, b, ,c", ["a", "b", "c"]), (parse.variants("x"), "1. x\n12345. y\n- z", ["x", "12345. y", "- z"]),
        (text.strip_frontmatter("x"), "---\na: b\n---\n\nbody", "body"), (text.price_keys("x"), "m-20250514", ["m-20250514", "m", None]),
        (text.price_keys("x"), "m-2025051", ["m-2025051", None, None]), (text.price_keys("x"), "m:free", ["m:free", None, "m"]),
        (text.needs_ocr("x"), "x", True), (text.needs_ocr("x"), "1" * 200, True), (text.byte_cut("x", 3), "ééé", "é..."), (text.byte_cut("x", 9), "ééé", "ééé"),
        (text.query_format("x"), "what is this", "fragment"), (text.query_format("x"), "what is this?", "question"), (text.query_format("x"), "Как жить дальше", "question"), (text.query_format("x"), "объясни это", "command"),
        (text.query_format("x"), "one two three four", "statement"), (text.sanitize_filename("x"), 'a/b:c "d"  e', "a-b-c 'd' e"), (text.sanitize_filename("x"), "a\\b\x00c*?<>|\u00a0 d", "a-bc----- d"),
        (text.trim("x"), "\u00a0\u2003 a b\u3000\x85", "a b"), (text.fields("x"), "a\u00a0b\u2009c", ["a", "b", "c"]), (text.html_text("x"), "<p>\u00a0a\u00a0</p>", "a"),
        (text.byte_cap("x", 3), "ééé", "é"), (text.byte_cap("x", 6), "ééé", "ééé"), (text.display_cut("x", 10), "a" * 11, "a" * 7 + "..."), (text.display_cut("x", 10), "a" * 10, "a" * 10), (text.is_hash_name("x"), "0123abcd", True), (text.is_hash_name("x"), "0123ABCD", False),
        (text.string_list("x"), "[a, b ,, c]", ["a", "b", "c"]), (text.string_list("x"), "[]", []), (text.holistic_reload("x"), "thesis\n\nDomains: a, b", ("thesis", ["a", "b"])), (text.holistic_reload("x"), "thesis", ("thesis", [])),
        (text.retryable_error("x"), "status 429", True), (text.retryable_error("x"), "bad key", False),
    ],
)
def test_text(spark, expr, value, want):
    assert one(spark, expr, value) == want


@pytest.mark.parametrize(("n", "want"), [(59, "59s"), (3600, "1h 0m 0s"), (90061, "1d 1h 1m 1s"), (61, "1m 1s")])
def test_duration(spark, n, want):
    assert one(spark, text.duration("x"), n, "bigint") == want


@pytest.mark.parametrize(("c", "want"), [(0.85, "high"), (0.55, "medium"), (0.2, "low")])
def test_confidence(spark, c, want):
    assert one(spark, text.confidence("x"), c, "double") == want


def test_chunks(spark):
    assert one(spark, split.chunks("x"), "a" * 1500) == ["a" * 1500]
    assert one(spark, split.chunks("x"), " " + "a" * 1500) == ["a" * 1500]
    sizes = one(spark, f"transform({split.merge_small('x')}, c -> length(c))", ["a" * 100, "b" * 600, "c" * 100], "array<string>")
    assert sizes == [100 + 2 + 600 + 2 + 100]


@given(st.text(alphabet="ab\né ", max_size=200), st.integers(8, 40))
def test_parts_join_to_the_text(t, n):
    ps = split.parts(t, n)
    assert "".join(ps) == t and all(len(p.encode()) <= n for p in ps)


def test_key_values(spark):
    m = one(spark, parse.key_values("x"), "Type: fact\nsummary: a\nb\n\nc\ntopic: x\nTOPIC: y")
    assert m == {"type": "fact", "summary": "a b", "topic": "y"}


def test_causal_keeps_the_bullet_after_a_chain(spark):
    c = one(spark, parse.causal("x"), "- cause: a\nmechanism: m\neffect: b\nrelation: r\npreconditions:\n- p\ncounterfactuals:\n- q")
    assert [tuple(x) for x in c.chains] == [("a", "m", "b", "r")] and c.preconditions == ["p"] and c.counterfactuals == ["q"]


def test_markdown_chunks(spark):
    got = one(spark, parse.markdown_chunks("x"), "pre\n## chunk_01\n\ntopic: t\nkey_points:\n- k\n\ncontent\nmore\n## chunk_02\ntopic: none")
    assert [(c.topic, c.key_points, c.content) for c in got] == [("t", ["k"], "content\nmore")]
    assert one(spark, parse.markdown_chunks("x"), "plain")[0].topic == "general"


def test_rrf_and_upsert(spark):
    kind = "query long, id long, score double, rank int"
    dense = spark.createDataFrame([(5, 1, 0.9, 1), (5, 2, 0.8, 2), (6, 2, 0.7, 1)], kind)
    sparse = spark.createDataFrame([(5, 3, 5.0, 1), (5, 4, 4.0, 2), (5, 1, 3.0, 3)], kind)
    got = {(r["query"], r.id): r.rrf_score for r in search.rrf(dense, sparse, 10).collect()}
    assert got[5, 1] == 1 / 61 + 1 / 63 and got[5, 3] == 1 / 63 + 1 / 61 and got[5, 2] == 1 / 62 + 1 / 64 and got[6, 2] == 1 / 61 + 1 / 61
    assert [r.id for r in search.rrf(dense, sparse, 1).where("query = 5").collect()] == [1]
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id long, seq long, v string")
    new = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (3, 1, "z")], "id long, seq long, v string")
    once = search.upsert(old, new)
    assert sorted((r.id, r.v) for r in once.collect()) == [(1, "y"), (2, "b"), (3, "z")] == sorted((r.id, r.v) for r in search.upsert(once, new).collect())


def test_books(spark):
    epub = io.BytesIO()
    with zipfile.ZipFile(epub, "w") as z:
        for n, t in (("nav.xhtml", "no"), ("c2.html", "<p>two</p>"), ("copyright.html", "no"), ("c1.html", "<p>one</p>"), ("i.png", "p")):
            z.writestr(n, t)
    df = spark.createDataFrame([("a.epub", epub.getvalue()), ("bad.epub", b"x")], "path string, content binary")
    got = {r.path: r for r in files.read_epub(df).collect()}
    assert got["a.epub"].text == "two\n\none" and got["a.epub"].error is None and got["bad.epub"].error
    got = {r.path: r for r in files.read_epub_images(df).collect()}
    assert (got["a.epub"].name, bytes(got["a.epub"].data)) == ("i.png", b"p") and got["bad.epub"].error
    fb2 = '<FictionBook xmlns="x"><body><section><title><p>T</p></title><p>a</p><section><title><p>Contents</p></title><p>b</p></section></section></body></FictionBook>'
    got = files.read_fb2(spark.createDataFrame([("b.fb2", fb2.encode()), ("c.fb2", b"<")], "path string, content binary")).collect()
    assert got[0].text == "## T\n\na\n\nb" and got[1].error


def test_a_corrupt_member_is_an_error_value(spark):
    epub = io.BytesIO()
    with zipfile.ZipFile(epub, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.html", "<p>" + "word " * 400 + "</p>")
        z.writestr("b.png", bytes(range(256)) * 9)
    data = bytearray(epub.getvalue())
    for name in (b"a.html", b"b.png"):
        at = data.index(name) + len(name) + 4
        data[at : at + 8] = b"\xff" * 8
    df = spark.createDataFrame([("bad.epub", bytes(data))], "path string, content binary")
    assert files.read_epub(df).first().error and files.read_epub_images(df).first().error


def test_fb2_images_and_data_urls(spark):
    import base64

    png = b"\x89PNG\r\n\x1a\nx"
    fb2 = f'<FictionBook xmlns="x"><body/><binary id="p1" content-type="image/png">{base64.b64encode(png).decode()}</binary><binary id="p2" content-type="image/jpeg">%%%</binary></FictionBook>'
    rows = files.read_fb2_images(spark.createDataFrame([("b.fb2", fb2.encode())], "path string, content binary"))
    got = rows.selectExpr("name", "alt_text", f"{text.data_url('data')} as url").collect()
    assert [tuple(r) for r in got] == [("p1.png", "Image from FB2: p1", "data:image/png;base64," + base64.b64encode(png).decode())]
    described = stages.describe_images(rows.selectExpr("name as path", "data"), providers.Offline()).first()
    assert described.path == "p1.png" and described.description.startswith("An image of") and described.error is None


def test_chunk_numbers_beyond_99(spark):
    rows = [("d", i, "t", "s", "c", 0.5) for i in (0, 98, 99, 100, 120, 1000)] + [("d", 5, "", "", "c", 0.5)]
    r = spark.createDataFrame(rows, "doc_id string, index int, type string, summary string, content string, confidence double").selectExpr(
        "*", "'' as topic", "array() as key_points", "'' as source_quote", "'' as my_takeaway", "'' as applicability"
    )
    md = assemble.render(r).first().markdown
    assert [x for x in md.split("\n") if x.startswith("## ")] == [f"## chunk_{n}" for n in ("01", "99", "100", "101", "121", "1001")]
    assert sorted(x.name for x in assemble.export_chunks(r).collect()) == sorted(f"chunk_{n}.md" for n in ("001", "099", "100", "101", "121", "1001"))


def test_prices_repeat_nothing(spark):
    prices = spark.createDataFrame([("m", 2.0, 4.0), ("M", 1.0, None), ("n", None, 8.0)], "model string, input_price double, output_price double")
    calls = spark.createDataFrame([("m", 1_000_000, 1_000_000), ("n:free", 1_000_000, 1_000_000), ("x", 5, 5)], "model string, prompt_tokens long, completion_tokens long")
    assert sorted((r.model, r.cost) for r in telemetry.priced(calls, prices).collect()) == [("m", 1.0), ("n:free", 8.0), ("x", 0.0)]


@given(st.lists(st.text(alphabet="ab \u00a0é", max_size=60), max_size=30), st.integers(5, 120))
def test_cut_equals_its_definition(ps, most):
    """The linear pass against the rules one after the other."""
    t = "\n\n".join(ps)
    size = lambda x: len(x.encode())
    groups, cur = [], ""
    for p in (x.strip() for x in t.split("\n\n")):
        if p and cur and size(cur) + size(p) + 2 > most:
            groups.append(cur)
            cur = p
        elif p:
            cur = f"{cur}\n\n{p}" if cur else p
    groups += [cur] if cur else []
    merged, wait = [], ""
    for g in groups:
        joined = f"{wait}\n\n{g}" if wait else g
        wait, merged = ("", [*merged, joined]) if size(g) >= 20 else (joined, merged)
    if wait:
        merged = [*merged[:-1], f"{merged[-1]}\n\n{wait}"] if merged else [wait]
    want = [t] if size(t) <= most else groups if len(groups) <= 1 else merged
    assert split.cut(t, most, 20) == want


def test_chunks_of_a_long_text(spark):
    long = "\n".join(f"paragraph {i} " + "x" * (i % 900) for i in range(20_000))
    got = split.chunk_documents(spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [r.chunk_idx for r in got if r.doc_id == 1] == list(range(sum(r.doc_id == 1 for r in got))) and [r.text for r in got if r.doc_id == 3] == [""]
    assert "\n\n".join(r.text for r in got if r.doc_id == 1) == "\n\n".join(x.strip() for x in long.split("\n")) and not [r for r in got if r.doc_id == 2]


def test_chunks_come_in_parts_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from siltstone import shipping

    held = {}
    monkeypatch.setattr(shipping, "map_arrow", lambda df, run, schema: held.setdefault("run", run) and df)

    class Docs:
        schema = [type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "long")})})]

        def select(self, *_):
            return self

        def withColumn(self, *_):
            return self

    monkeypatch.setattr(split, "F", type("F", (), {n: staticmethod(lambda *_: type("C", (), {"cast": lambda *_: None})()) for n in ("col", "octet_length")}))
    split.chunk_documents(Docs())
    texts = ["a" * 1000 + "\n" + "b" * 1000, None, ""] * 8000
    batch = pa.RecordBatch.from_arrays([pa.array(range(24_000)), pa.array(texts)], names=["doc_id", "text"])
    out = list(held["run"]([batch]))
    assert len(out) > 3 and max(b.nbytes for b in out) < 6 << 20
    got = pa.Table.from_batches(out).to_pydict()
    assert list(zip(got["doc_id"], got["chunk_idx"], got["text"])) == [(i, n, c) for i, t in enumerate(texts) if t is not None for n, c in enumerate(split.cut(t.replace("\n", "\n\n")))]


def test_searches_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vs = [rng.standard_normal(6).tolist() for _ in range(300)]
    vs[7] = [0.0] * 6
    points = spark.createDataFrame([(i, v) for i, v in enumerate(vs)] + [(900, None), (901, [1.0])], "id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, vs[i]) for i in (0, 7, 50)] + [(999, None)], "query long, vector array<double>")
    got = {(r["query"], r["rank"]): (r.id, r.score) for r in search.dense_topk(points, queries, 4).collect()}
    x = np.array(vs)
    n = np.sqrt((x * x).sum(axis=1))
    for q in (0, 7, 50):
        c = np.divide(x @ x[q], n * n[q], out=np.zeros(300), where=n * n[q] > 0).round(9)
        assert [got[q, k + 1] for k in range(4)] == [(int(i), float(c[i])) for i in np.lexsort((np.arange(300), -c))[:4]]
    assert len(got) == 12 and search.dense_topk(points, queries, 4, least=2.0).count() == 0
    old = search.BLOCK_ROWS
    try:
        search.BLOCK_ROWS = 2  # several blocks of queries
        assert {(r["query"], r["rank"]): (r.id, r.score) for r in search.dense_topk(points, queries, 4).collect()} == got
    finally:
        search.BLOCK_ROWS = old
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "d")], "doc_id long, text string")
    hits = search.bm25(docs, spark.createDataFrame([(10, "B a a"), (11, None), (12, "zz")], "query long, text string"), 5).collect()
    idf = lambda df: np.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda df, tf, dl: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.5))
    assert [(r["query"], r.id, r["rank"]) for r in hits] == [(10, 1, 1), (10, 2, 2)]
    assert [r.score for r in hits] == pytest.approx([part(1, 1, 3) + part(2, 2, 3), part(2, 1, 2)], abs=1e-8)


def test_stage_calls(spark):
    class Loop:
        def __init__(self, replies):
            self.replies = replies

        def chat(self, stage, t, note=""):
            self.replies = self.replies[1:] if note else self.replies
            return self.replies[0]

        def embed(self, texts):
            return []

    rows = spark.createDataFrame([("d", 0, "x")], "doc_id string, chunk_idx int, text string")
    good = "type: fact\nsummary: s"
    got = providers.call_model(rows, Loop(["no " * 20, "nothing", good]), "chunk", "^type").first()
    assert got.attempts == 3 and got.error is None and got.response == good
    got = providers.call_model(rows, Loop(["no " * 20, "nothing", "nothing"]), "chunk", "^type").first()
    assert got.attempts == 3 and got.error == "invalid reply" and got.response == "nothing"
    got = providers.call_model(rows, Loop(["no " * 20] * 3), "chunk").first()
    assert (got.attempts, got.error) == (3, "repetitive reply") and got.completion_chars == 60 and got.prompt_chars > 3
    tel = providers.call_telemetry(providers.call_model(rows, providers.Offline(), "chunk"), "chunk", "m").first()
    assert (tel.source, tel.chunk_index, tel.retry_attempt, tel.success) == ("d", 0, 0, True)

    class Down(Loop):
        def chat(self, stage, t, note=""):
            raise providers.Unavailable("down")

    got = providers.call_model(rows, Down([]), "holistic", retry=True, backoff=0).first()
    assert got.attempts == 3 and "down" in got.error
    assert providers.Chain(Down([]), providers.Offline()).chat("context", "a b") == "This part concerns a."
    with pytest.raises(providers.Refused):
        providers.Chain(type("No", (), {"chat": lambda *a: (_ for _ in ()).throw(providers.Refused("status 401"))})(), providers.Offline()).chat("x", "y")


def test_clients(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            code, out = 200, {}
            if self.path == "/v1/chat/completions":
                if len(seen) == 1:
                    code = 503
                elif body["model"] == "bad":
                    code = 401
                out = {"choices": [{"message": {"content": "", "reasoning": "thought"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}, "model": "big"}
            elif self.path == "/v1/embeddings":
                out = {"data": [{"embedding": [1.0]} for _ in body["input"]]}
            elif self.path == "/api/chat":
                out = {"message": {"content": "hi"}, "prompt_eval_count": 5, "eval_count": 2}
            else:
                out = {"embeddings": [[2.0] for _ in body["input"]]}
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    said = providers.Http(url, "m", backoff=0).chat("chunk", "t", "again")
    assert (said.text, said.prompt_tokens, said.completion_tokens, said.model) == ("thought", 7, 3, "big") and len(seen) == 2
    system = seen[0][1]["messages"][0]["content"]
    assert "key_points" in system and system.endswith("again")
    with pytest.raises(providers.Refused):
        providers.Http(url, "bad", backoff=0).chat("chunk", "t")
    assert providers.Http(url, "m").embed(["a", "b"]) == [[1.0], [1.0]] and providers.Local(url, "m").chat("holistic", "t") == providers.Reply("hi", 5, 2, "m") and providers.Local(url, "m").embed(["a"]) == [[2.0]]
    server.shutdown()
    with pytest.raises(providers.Unavailable):
        providers.Http("http://127.0.0.1:9", "m", tries=2, backoff=0).chat("clean", "t")


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 0, "one"), ("d", 1, " "), ("d", 100, "two"), ("e", 0, "é")], "doc_id string, chunk_idx int, text string")
    assert sinks.write_files(sinks.chunk_files(chunks), "file://" + str(tmp_path / "cp")) == 3
    assert (tmp_path / "cp/d/chunks/chunk-101.md").read_text() == "two" and (tmp_path / "cp/e/chunks/chunk-001.md").read_text() == "é"
    back = workspace.read_chunks(workspace.read_texts(spark, str(tmp_path / "cp")))
    assert sorted((r.doc_id, r.chunk_idx, r.text) for r in back.collect()) == [("d", 0, "one"), ("d", 1, "two"), ("e", 0, "é")]
    assert sinks.chunk_files(chunks, "_").where("name = 'chunks/chunk_001.md'").count() == 2
    results = stages.chunk_results(stages.chunk_replies(chunks.where("text <> ' '"), providers.Offline()))
    assert sinks.write_files(sinks.result_files(results), "file://" + str(tmp_path / "r")) == 3
    assert json.loads((tmp_path / "r/d/results/result_000.json").read_text())["type"] == "concept"
    assert [len(json.loads(r.text)) for r in sinks.result_arrays(results).orderBy("doc_id").collect()] == [2, 1]
    meta = spark.createDataFrame([("d", "lib/de\u0301.md", {"author": "A"}), ("e", "x.md", {})], "doc_id string, source string, frontmatter map<string,string>")
    files_ = sinks.export(results, assemble.render(results, meta), assemble.metadata(results, meta), raw=chunks.selectExpr("doc_id", "text").where("text = 'one'"))
    names = sorted((r.doc_id, r.name) for r in files_.collect())
    assert ("d", "d\u00e9.md") in names and ("e", "final.md") in names and ("d", "raw.md") in names and ("d", "chunks/chunk_101.md") in names and ("e", "metadata.json") in names
    states = spark.createDataFrame([("d", "done", 2, None)], "doc_id string, stage string, chunks_total long, failed_with string")
    each = spark.createDataFrame([("d", 0, True), ("d", 1, False)], "doc_id string, index int, done boolean")
    assert json.loads(sinks.status_files(states, each).first().text)["chunks"][0] == {"index": 0, "done": True}
    calls = providers.call_telemetry(providers.call_model(chunks, providers.Offline(), "chunk"), "chunk", "m")
    out = []
    sinks.fan_out(calls, lambda c: sinks.append_telemetry(c, str(tmp_path / "t")), lambda c: sinks.append_telemetry(c, str(tmp_path / "t")), lambda c: out.append(c.count()))
    assert spark.read.json(str(tmp_path / "t")).count() == 8 and out == [4]


def test_index_of_a_workspace(spark, tmp_path):
    for doc, version, body in (("0123abcd", 2, "old"), ("0123abcd", 10, "## chunk_01\ntopic: t\n\nnew"), ("89abcdef", 1, "plain")):
        place = tmp_path / doc / "versions" / f"v{version}"
        place.mkdir(parents=True)
        (place / "final.md").write_text(body)
    texts = workspace.read_texts(spark, str(tmp_path))
    assert workspace.is_workspace(texts.select("path")).first().workspace
    docs = workspace.final_versions(texts)
    assert sorted((r.doc_id, r.version) for r in docs.collect()) == [("0123abcd", 10), ("89abcdef", 1)]
    got = sorted((r.doc_id, r.chunk_idx, r.topic, r.content) for r in workspace.indexed_chunks(docs).collect())
    assert got == [("0123abcd", 0, "t", "new"), ("89abcdef", 0, "general", "plain")]
    assert one(spark, workspace.yaml_frontmatter("x"), "---\na: b\n---\nx") == {"a": "b"} and one(spark, workspace.yaml_frontmatter("x"), "a: b") == {}


def test_files_of_a_folder(spark, tmp_path):
    for n in ("a.md", "b.PDF", "._c.md", "d.txt", "e.zip"):
        (tmp_path / n).write_text("x")
    assert sorted((r.path.rsplit("/", 1)[-1], r.kind) for r in files.list_paths(spark, str(tmp_path)).collect()) == [("a.md", "markdown"), ("b.PDF", "pdf"), ("e.zip", "fb2")]
    assert sorted(bytes(r.content) for r in files.list_directory(spark, str(tmp_path)).collect()) == [b"x"] * 3
    models = spark.createDataFrame([('{"data": [{"id": "a"}, {"id": "b"}]}',), ('{"models": [{"name": "c"}, {"key": "d"}]}',), ("{bad",)], "json string")
    assert sorted(r.model for r in files.model_names(models).collect()) == ["a", "b", "c", "d"]
    assert files.no_images(spark.createDataFrame([("p",)], "path string")).first().images == []


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nx: y\n---\nbody")
    (tmp_path / "._b.md").write_text("no")
    assert [r.text for r in files.read_markdown(spark, str(tmp_path)).collect()] == ["body"]


def test_providers(spark):
    class Shaky:
        def chat(self, stage, t, note=""):
            if t == "boom":
                raise providers.Unavailable("down")
            return "nonsense"

        def embed(self, texts):
            raise providers.Unavailable("down")

    rows = spark.createDataFrame([("d", 0, "boom"), ("d", 1, "x")], "doc_id string, chunk_idx int, text string")
    got = {r.chunk_idx: r for r in providers.call_model(rows, Shaky(), "chunk", "^type").collect()}
    assert "down" in got[0].error and got[0].attempts == 1 and got[1].attempts == 3 and got[1].error == "invalid reply"
    both = providers.Fallback(Shaky(), providers.Offline())
    assert len(both.embed(["a b"])[0]) == 64
    asked = rows.selectExpr("chunk_idx as id", "text")
    assert {(len(r.vector), r.error) for r in providers.embed_texts(asked, both).collect()} == {(64, None)}
    assert {(r.vector, r.error) for r in providers.embed_texts(asked, Shaky()).collect()} == {(None, "Unavailable: down")}


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"stage": "chunk", "prompt_tokens": i, "completion_tokens": 1, "success": i % 2 == 0, "timestamp": f"2024-01-01T0{i}:00:00Z"} for i in range(5)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    batch = streams.windows(spark.read.schema(streams.TELEMETRY).json(str(src)))
    q = streams.windows(streams.tail(spark, str(src))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 5


def test_upsert_stream(spark, tmp_path):
    from siltstone.sinks.collection import Collection

    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id long, seq long, v string").write.parquet(str(src))
    q = streams.upsert_stream(spark.readStream.schema("id long, seq long, v string").parquet(str(src)), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert [r.v for r in Collection(spark, str(tmp_path / "t")).read().collect()] == ["b"]


def test_sse(spark):
    lines = [("c", 2, 'data: {"choices":[{"delta":{"content":"b"}}]}'), ("c", 1, 'data: {"choices":[{"delta":{"content":"a"}}]}'), ("c", 3, "data: {bad"), ("c", 4, "data: [DONE]")]
    got = telemetry.reassemble(spark.createDataFrame(lines, "call_id string, seq int, line string")).first()
    assert (got.content, got.finished) == ("ab", True)
