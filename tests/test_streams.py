"""Stateful streams against their batch forms, over restarts; collections; listeners; the data source; status files."""

import datetime as dt
import json
import sys
import time
import zipfile

import pytest
from pyspark import cloudpickle

from siltstone.operators import prompts, resume
from siltstone.plans import registry
from siltstone.sinks import collection as collections_
from siltstone.sinks import files as sinks
from siltstone.sinks.collection import Collection, Conflict
from siltstone.sources import documents, workspace
from siltstone.streaming import calls, observers, progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def feed(spark, rows, schema, folder, n):
    """One more file in a stream's folder, later than those before."""
    df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)
    df.coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(1.1)


def run(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def call(i, seq, second, event, **more):
    return {"call_id": i, "seq": seq, "at": T0 + dt.timedelta(seconds=second), "event": event, **more}


def test_facts_of_streamed_calls(rocks, tmp_path):
    spark, src = rocks, tmp_path / "in"
    first = [
        call("a", 0, 0, "open", source="s", stage="chunk", chunk_index=3, retry_attempt=0, model="m", prompt_chars=10), call("a", 1, 1, "piece", piece="é1"),
        call("b", 0, 2, "open", source="s", stage="chunk", model="m"), call("c", 0, 3, "open", source="s", stage="x", model="m"), call("c", 1, 4, "error", error="status 500"),
    ]
    second = [call("a", 2, 5, "piece", piece="2", model="big"), call("a", 3, 6, "close", prompt_tokens=7, completion_tokens=2), call("c", 2, 6, "piece", piece="late"), call("b", 1, 7, "piece", piece="xyz")]
    third = [call("d", 0, 3600, "open", source="s", stage="x", model="m"), call("d", 1, 3600.5, "close")]
    stream = lambda: calls.call_facts(spark.readStream.schema(calls.EVENTS).parquet(str(src)), "10 minutes", "1 second")
    for n, part in enumerate((first, second, third, [call("e", 0, 7300, "open")])):  # each a run of its own on one checkpoint
        feed(spark, part, calls.EVENTS, src, n)
        run(stream(), tmp_path, "calls")
    got = {r["call_id"]: r for r in spark.read.parquet(str(tmp_path / "calls-out")).collect()}
    assert spark.read.parquet(str(tmp_path / "calls-out")).count() == 4
    batch = {r["call_id"]: r for r in calls.recorded_facts(spark.createDataFrame([tuple(r.get(c.split()[0]) for c in calls.EVENTS.split(", ")) for r in first + second + third], calls.EVENTS), until="2024-01-01 01:30:00").collect()}
    assert got.keys() == batch.keys() == {"a", "b", "c", "d"}
    for i in batch:
        assert {c: got[i][c] for c in batch[i].asDict()} == batch[i].asDict()
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["completion_chars"], a["prompt_tokens"], a["model"], a["latency_ms"], a["chunk_index"], a["success"]) == (4, 7, "big", 6000, 3, True)
    assert (b["success"], b["error"], b["completion_chars"], b["latency_ms"]) == (False, calls.SILENT, 3, 605_000) and (c["error"], c["completion_chars"]) == ("status 500", 0)


def mark(run_, name, seq, second, event, error=None):
    return {"run": run_, "name": name, "seq": seq, "at": T0 + dt.timedelta(seconds=second), "event": event, "error": error}


def test_outcomes_over_a_restart(rocks, tmp_path):
    spark, src = rocks, tmp_path / "in"
    first = [mark("r", "a", 0, 0, "file_start"), mark("r", "b", 1, 1, "file_start"), mark("r", "x", 2, 2, "file_start"), mark("r", "c", 3, 2, "file_skip"), mark("r", "a", 4, 3, "file_start")]
    second = [mark("r", "a", 5, 10, "file_done"), mark("r", "b", 6, 11, "file_error", "bad"), mark("r", "z", 7, 12, "file_done"), mark("r", "a", 8, 13, "file_start"), mark("r", "a", 9, 15, "file_done")]
    for n, part in enumerate((first, second, [mark("q", "w", 10, 90_000, "file_skip")], [mark("q", "w", 11, 99_000, "file_skip")])):
        feed(spark, part, progress.EVENTS, src, n)
        run(progress.outcomes(spark.readStream.schema(progress.EVENTS).parquet(str(src)), "1 hour", "1 second"), tmp_path, "runs")
    out = spark.read.parquet(str(tmp_path / "runs-out"))
    key = lambda r: (r["run"], r["name"], r["outcome"], r["at"], r["duration_ms"] or -1, r["error"] or "")
    got = sorted(map(key, out.where("outcome <> 'lost'").collect()))
    every = spark.createDataFrame([tuple(r.values()) for r in first + second + [mark("q", "w", 10, 90_000, "file_skip"), mark("q", "w", 11, 99_000, "file_skip")]], progress.EVENTS)
    assert got == sorted(map(key, progress.recorded_outcomes(every).collect()))
    assert [(n, o, d) for _, n, o, _, d, _ in got if n in "ab"] == [("a", "done", 7000), ("a", "done", 2000), ("b", "failed", 10_000)]
    lost = out.where("outcome = 'lost'").collect()
    assert [(r["name"], r["at"]) for r in lost] == [("x", T0 + dt.timedelta(seconds=3602))]
    s = {r["run"]: r for r in progress.summary(out, spark.createDataFrame([("r", 20, 2), ("new", 5, 0)], "run string, total long, active long")).collect()}
    assert (s["r"]["done"], s["r"]["failed"], s["r"]["skipped"], s["r"]["lost"], s["r"]["mean_ms"], s["r"]["remaining"], s["r"]["wait_ms"]) == (3, 1, 1, 1, 6333, 14, 44_331)
    assert s["new"]["wait_ms"] is None and s["new"]["remaining"] == 5


def test_summary_of_a_run_that_ended_more_than_its_total(spark):
    at = dt.datetime(2026, 1, 1)
    ended = spark.createDataFrame([("r", f"f{i}", "done", at, 900, None) for i in range(5)], progress.OUTCOMES)
    r = progress.summary(ended, spark.createDataFrame([("r", 3, 1)], "run string, total long, active long")).first()
    assert (r["remaining"], r["wait_ms"], r["wait"]) == (-2, -1800, "0s")


# Collections -----------------------------------------------------------------------------------
def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    assert not c.exists()
    c.init("id long, v string", buckets=16).init("other int")
    assert c.exists() and c.count() == 0 and c.read().count() == 0
    assert c.upsert(spark.range(400).selectExpr("id", "concat('a', id) as v")) == 16 and c.count() == 400
    before = {b: f for b, f in c.manifest()["folders"].items()}
    old = c.read()
    new = spark.createDataFrame([(5, "x"), (5, "y"), (None, "z"), (1000, "n")], "id long, v string")
    touched = c.upsert(new)
    after = c.manifest()["folders"]
    assert touched <= 2 and sum(before[b] != after[b] for b in before) == touched
    assert c.count() == 401 and {r["id"]: r["v"] for r in c.read().where("id in (5, 6, 1000)").collect()} == {5: "y", 6: "a6", 1000: "n"}
    assert old.where("id = 5").first()["v"] == "a5"  # what was read before stays
    assert c.delete(spark.createDataFrame([(5,), (7777,)], "id long")) <= 2 and c.count() == 400
    assert c.upsert(new.limit(0)) == 0
    c.vacuum()
    assert c.read().count() == 400
    assert c.delete(spark.range(2000)) == 16 and c.count() == 0 and c.read().count() == 0 and c.exists() and c.vacuum() >= 1
    c.drop()
    assert not c.exists()


def test_a_failed_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    c = Collection(spark, str(tmp_path / "c")).init("id long, v string", buckets=2)
    c.upsert(spark.range(10).selectExpr("id", "'a' as v"))
    (tmp_path / "c/_manifests" / f"{2:020d}.json").write_text('{"version": 2, "fol')  # a writer that died
    assert c.manifest()["version"] == 1 and c.count() == 10
    with pytest.raises(Conflict):  # its number is taken
        c.upsert(spark.range(1).selectExpr("id", "'b' as v"))
    assert {r["v"] for r in c.read().collect()} == {"a"}
    (tmp_path / "c/_manifests" / f"{2:020d}.json").unlink()
    monkeypatch.setattr(Collection, "_commit", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        c.upsert(spark.range(1).selectExpr("id", "'b' as v"))
    monkeypatch.undo()
    assert {r["v"] for r in c.read().collect()} == {"a"} and c.vacuum() == 2


def test_batches_are_applied_once(spark, tmp_path):
    src, c = tmp_path / "in", Collection(spark, str(tmp_path / "c")).init("id long, seq long, v string", buckets=4)
    for n in range(2):
        spark.createDataFrame([(1, n, f"v{n}"), (n + 10, n, "w")], "id long, seq long, v string").coalesce(1).write.mode("append").parquet(str(src))
        q = c.upsert_stream(spark.readStream.schema("id long, seq long, v string").parquet(str(src)), str(tmp_path / "cp"), "seq")
        q.awaitTermination(60)
    assert {r["id"]: r["v"] for r in c.read().collect()} == {1: "v1", 10: "w", 11: "w"} and c.manifest()["applied"] == {"points": 1}
    version = c.manifest()["version"]
    (tmp_path / "cp/commits/.1.crc").unlink(missing_ok=True)
    (tmp_path / "cp/commits/1").unlink()  # as if the query had died between the commit and its own mark
    q = c.upsert_stream(spark.readStream.schema("id long, seq long, v string").parquet(str(src)), str(tmp_path / "cp"), "seq")
    q.awaitTermination(60)
    assert c.manifest()["version"] == version and c.count() == 3


# Observers -------------------------------------------------------------------------------------
def test_metrics_and_stream_events(spark, tmp_path):
    df = registry.calls(spark, SF)
    seen, metrics = observers.observed(df)
    seen.write.format("noop").mode("overwrite").save()
    want = df.selectExpr("count(*) as c", "sum(prompt_tokens) as t", "count_if(not success) as f").first()
    assert (metrics.get["calls"], metrics.get["tokens_in"], metrics.get["failures"]) == (want.c, want.t, want.f)
    df.write.parquet(str(tmp_path / "in"))
    kept, log = [], tmp_path / "events.jsonl"

    def broken(event):
        raise OSError("full")

    tee = observers.Tee(kept.append, broken, observers.Lines(str(log)))
    listener = observers.listen(spark, tee)
    try:
        stream, name = observers.observed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "calls")
        q = stream.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(100):
            if any(e["type"] == "completed" for e in kept):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    types = [e["type"] for e in kept]
    assert types[0] == "pipeline_start" and types[-1] == "completed" and tee.failed == len(kept)
    assert sum(e["observed"]["calls"]["calls"] for e in kept if "observed" in e and e["observed"]) == want.c and name == "calls"
    assert [json.loads(x)["type"] for x in log.read_text().splitlines()] == types
    lines = []
    observers.Lines(lines.append)({"b": 1, "a": 2})
    assert lines == ['{"a": 2, "b": 1}']


# Data source -----------------------------------------------------------------------------------
class Upper(documents.Extractor):
    kind, content_type, endings = "txt", "clean", (".txt",)

    def extract(self, open_, path, members):
        for m, text in super().extract(open_, path, members):
            yield m, text.upper()


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nt: 1\n---\nbody")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/n.txt").write_text("loud")
    (tmp_path / "x.bin").write_bytes(b"1")
    (tmp_path / "._a.md").write_text("no")
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    (tmp_path / "b.fb2").write_text("<FictionBook><body><section><title><p>T</p></title><p>one</p></section></body></FictionBook>")
    (tmp_path / "doc/chunks").mkdir(parents=True)
    (tmp_path / "doc/chunks/chunk-002.md").write_text("second")
    with zipfile.ZipFile(tmp_path / "big.epub", "w") as z:
        for i in range(10):
            z.writestr(f"c{i}.xhtml", f"<p>page {i}</p>")
        z.writestr("toc.html", "<p>contents</p>")
        z.writestr("copyright.html", "<p>rights</p>")
    documents.register(spark, Upper())
    read = spark.read.format("siltstone_documents").option("target", "1000").option("members", "4")
    parts = read.load(str(tmp_path))
    assert parts.rdd.getNumPartitions() >= 3
    rows = {(r["path"].rsplit("/", 1)[1], r["part"]): r for r in parts.collect()}
    assert rows["n.txt", 0]["text"] == "LOUD" and rows["chunk-002.md", 0]["kind"] == "chunk" and rows["chunk-002.md", 0]["member"] == "002"
    assert rows["bad.epub", 0]["error"] and rows["bad.epub", 0]["text"] is None and ("x.bin", 0) not in rows and ("._a.md", 0) not in rows
    assert sorted(p for n, p in rows if n == "big.epub") == list(range(11))
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.documents(parts).collect()}
    assert got["a.md"]["text"] == "body" and got["big.epub"]["text"].split("\n\n") == [f"page {i}" for i in range(10)]
    assert got["b.fb2"]["text"] == "## T\n\none" and got["bad.epub"]["error"] and got["b.fb2"]["content_type"] == "book"
    strict = {r["path"].rsplit("/", 1)[1]: r["error"] for r in read.option("strict", "true").load(str(tmp_path)).collect()}
    assert strict["x.bin"] == "no extractor"
    assert documents.find("A/B.MD").kind == "markdown" and documents.find("a.pdf") is None


# Status ----------------------------------------------------------------------------------------
def test_status_over_resizing(spark):
    e = lambda seq, event, index=None, **k: {"doc_id": "d", "seq": seq, "event": event, "index": index, "at": T0 + dt.timedelta(seconds=seq), **k}
    events = [
        e(0, "started", 0, stage="early"), e(1, "chunks", total=3), e(2, "started", 0, stage="process"), e(3, "cost", 0, cost=0.5, tokens_in=7, model="m"), e(4, "done", 0), e(5, "started", 2, stage="process"),
        e(6, "failed", 2, error="bad"), e(7, "done", 9), e(8, "chunks", total=2), e(9, "done", 2), e(10, "chunks", total=4), e(11, "started", 0, stage="again"), e(12, "done", 1),
    ]
    schema = "doc_id string, seq long, event string, index int, at timestamp, total int, stage string, error string, cost double, tokens_in long, tokens_out long, model string, latency_ms long"
    df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in events], schema)
    got = {r["index"]: r for r in resume.chunk_fold(df).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0]["done"], got[0]["duration_ms"], got[0]["cost"], got[0]["tokens_in"], got[0]["model"], got[0]["stage"]) == (True, 2000, 0.5, 7, "m", "again")
    assert (got[1]["done"], got[1]["duration_ms"]) == (True, 0) and not (got[2]["failed"] or got[2]["done"]) and got[2]["started_at"] is None and got[3]["error"] == ""
    files = spark.createDataFrame([("a/d/status.yaml", '{"stage": "done", "chunks_'), ("a/e/status.yaml", '{"stage": "done", "chunks_total": 1, "chunks": [{"index": 0, "done": true}]}'), ("a/f/other.yaml", "{}")], "path string, text string")
    assert [(r["doc_id"], r["chunks"][0]["done"]) for r in workspace.read_status(files).collect()] == [("e", True)]


def test_paths_stay_in_their_folder(spark, tmp_path):
    for doc, name in (("..", "x"), ("a", "../../x"), ("/etc", "x"), ("a", "b/../../c"), ("a", "/x"), (None, "x"), ("a", "")):
        with pytest.raises(ValueError):
            sinks.inside(doc, name)
    rows = spark.createDataFrame([("a", "../../x.md", "t")], "doc_id string, name string, text string")
    with pytest.raises(Exception, match="not a path inside"):
        sinks.write_files(rows, "file://" + str(tmp_path / "out"))
    assert not (tmp_path / "x.md").exists()


def test_query_context_file(spark, tmp_path):
    (tmp_path / "ctx.md").write_text("known\nthings")
    assert workspace.query_prompt(spark, prompts.QUERY, str(tmp_path / "ctx.md")) == prompts.QUERY + "\n\nContext:\nknown\nthings"
    assert workspace.query_prompt(spark, "p") == "p"
    assert collections_.BUCKETS == 64
