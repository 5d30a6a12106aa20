"""What is left to do: the state of documents and chunks as tables of events, and the work that a run
which starts again can skip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A document's stages in order.
STAGES = ["extracted", "cleaned", "split", "processing", "holistic", "causal", "context_enrichment", "done"]


def stage_index(stage: str) -> str:
    """SQL: a stage's place, -1 if unknown (a failed document has none)."""
    return f"(coalesce(array_position(array({', '.join(repr(s) for s in STAGES)}), {stage}), 0) - 1)"


def stage_past(stage: str, target: str) -> str:
    """SQL: whether a document is past a stage; a failed one never is."""
    return f"({stage} <> 'failed' and {stage_index(stage)} > {stage_index(target)})"


def document_state(events: DataFrame) -> DataFrame:
    """``events (doc_id, seq, event, value)`` -> (doc_id, stage, chunks_total, failed_with): events are
    new, stage (value: its name), chunks (value: how many), failed (value: why) and completed."""
    stage = "case event when 'new' then 'extracted' when 'stage' then value when 'failed' then 'failed' when 'completed' then 'done' end"
    return events.withColumn("stage", F.expr(stage)).groupBy("doc_id").agg(
        F.expr("max_by(stage, seq) filter (where stage is not null)").alias("stage"),
        F.expr("cast(max_by(value, seq) filter (where event = 'chunks') as bigint)").alias("chunks_total"),
        F.expr("max_by(value, seq) filter (where event = 'failed')").alias("failed_with"),
    )


def chunk_state(events: DataFrame) -> DataFrame:
    """``events (doc_id, index, seq, event, at, error)`` -> (doc_id, index, done, failed, error,
    duration_ms): the last of done and failed counts; the time is that since the last start before."""
    ends = "event in ('done', 'failed')"
    last = events.groupBy("doc_id", "index").agg(
        F.expr(f"max_by(struct(seq, event, at, error), seq) filter (where {ends})").alias("e"), F.expr("collect_list(struct(seq, at)) filter (where event = 'started')").alias("s")
    )
    begun = "array_max(filter(s, x -> e is null or x.seq < e.seq)).at"
    return last.selectExpr(
        "doc_id", "index", "coalesce(e.event = 'done', false) as done", "coalesce(e.event = 'failed', false) as failed", "if(e.event = 'failed', e.error, '') as error",
        f"coalesce((unix_micros(e.at) - unix_micros({begun})) div 1000, 0L) as duration_ms",
    )


#: A chunk's status.
CHUNK = (
    "index int, done boolean, failed boolean, error string, started_at timestamp, completed_at timestamp, duration_ms long, cost double, "
    "tokens_in long, tokens_out long, model string, latency_ms long, stage string"
)


def chunk_fold(events: DataFrame) -> DataFrame:
    """``events (doc_id, seq, event, index, at, total, stage, error, cost, tokens_in, tokens_out, model, latency_ms)`` -> (doc_id,
    *CHUNK): the status of each of a document's chunks.

    ``chunks`` sets their number: chunks beyond it are forgotten, and those that a later one adds are new.
    ``started`` keeps when and for which stage, ``done`` and ``failed`` the outcome, its time and the time since the start
    before; ``cost`` keeps what calls used, which outcomes don't touch.  Events of a chunk that isn't there count for
    nothing; a document without ``chunks`` has no chunk.
    """
    sizes = events.where("event = 'chunks'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "total"))).alias("sizes"))
    own = events.where("event <> 'chunks'").join(sizes, "doc_id")
    before = "element_at(filter(sizes, x -> x.seq < seq), -1)"
    some = f"size(filter(sizes, x -> x.seq < seq)) > 0 and index >= 0 and {before}.total > index and not exists(sizes, x -> x.seq > seq and x.total <= index)"
    kept = own.where(some)
    last = lambda cols, when: f"max_by(struct({cols}), seq) filter (where {when})"
    got = kept.groupBy("doc_id", "index").agg(
        F.expr(last("seq, at, stage", "event = 'started'")).alias("s"), F.expr(last("seq, at, event, error", "event in ('done', 'failed')")).alias("e"),
        F.expr(last("cost, tokens_in, tokens_out, model, latency_ms", "event = 'cost'")).alias("c"), F.expr("collect_list(if(event = 'started', struct(seq, at), null))").alias("starts"),
    )
    every = sizes.selectExpr("doc_id", "explode(filter(sequence(0, element_at(sizes, -1).total), i -> i < element_at(sizes, -1).total)) as index").select("doc_id", F.col("index").cast("int").alias("index"))
    both = every.join(got.withColumn("index", F.col("index").cast("int")), ["doc_id", "index"], "left")
    begun = "array_max(filter(starts, x -> x.seq < e.seq)).at"
    return both.selectExpr(
        "doc_id", "index", "coalesce(e.event = 'done', false) as done", "coalesce(e.event = 'failed', false) as failed", "if(e.event = 'failed', coalesce(e.error, ''), '') as error", "s.at as started_at", "e.at as completed_at",
        f"coalesce((unix_micros(e.at) - unix_micros({begun})) div 1000, 0L) as duration_ms", "coalesce(c.cost, 0D) as cost", "coalesce(c.tokens_in, 0L) as tokens_in", "coalesce(c.tokens_out, 0L) as tokens_out",
        "coalesce(c.model, '') as model", "coalesce(c.latency_ms, 0L) as latency_ms", "coalesce(s.stage, '') as stage",
    )


def status_events(chunks: DataFrame) -> DataFrame:
    """``chunk_fold``'s table as events that fold to it again, so a run goes on from a stored status."""
    none = {"at": "timestamp", "stage": "string", "error": "string", "cost": "double", "tokens_in": "long", "tokens_out": "long", "model": "string", "latency_ms": "long", "total": "int"}

    def event(df: DataFrame, seq: str, name: str, index: str = "index", **own: str) -> DataFrame:
        return df.selectExpr("doc_id", f"cast({seq} as long) as seq", f"'{name}' as event", f"cast({index} as int) as index", *[f"cast({own.get(c, 'null')} as {k}) as {c}" for c, k in none.items()])

    anew = "coalesce(started_at > completed_at, false)"
    start = f"if({anew}, timestamp_micros(unix_micros(completed_at) - duration_ms * 1000), started_at)"
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    parts = [
        event(sizes, "0", "chunks", "null", total="n"),
        event(chunks.where(f"started_at is not null and (not {anew} or duration_ms > 0)"), "index * 5 + 1", "started", at=start, stage="stage"),
        event(chunks.where(anew), "index * 5 + 4", "started", at="started_at", stage="stage"),
        event(chunks.where("done"), "index * 5 + 2", "done", at="completed_at"), event(chunks.where("failed"), "index * 5 + 2", "failed", at="completed_at", error="error"),
        event(chunks.where("cost > 0 or tokens_in > 0 or tokens_out > 0 or model <> ''"), "index * 5 + 3", "cost", **{c: c for c in ("cost", "tokens_in", "tokens_out", "model", "latency_ms")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def todo(files: DataFrame, states: DataFrame, force: bool = False) -> DataFrame:
    """``files (doc_id, ...)`` that are not done; all of them with ``force``."""
    return files if force else files.join(states.where("stage = 'done'").select("doc_id"), "doc_id", "left_anti")


def restored(chunks: DataFrame, states: DataFrame, results: DataFrame, legacy: DataFrame) -> DataFrame:
    """``chunks (doc_id, index)`` with the stored result that counts: of a chunk whose state is done,
    else of one with a summary, else the legacy table's; (.., origin, summary, type), null if none.
    ``results`` and ``legacy``: (doc_id, index, summary, type)."""
    own = lambda df, p: df.selectExpr("doc_id", "index", f"struct(summary, type) as {p}")
    both = chunks.join(states.select("doc_id", "index", "done"), ["doc_id", "index"], "left").join(own(results, "r"), ["doc_id", "index"], "left").join(own(legacy, "l"), ["doc_id", "index"], "left")
    pick = "case when done and r is not null then 'status' when r.summary <> '' then 'file' when l is not null then 'legacy' end"
    return both.withColumn("origin", F.expr(pick)).selectExpr("doc_id", "index", "origin", "if(origin = 'legacy', l, if(origin is null, null, r)) as x").select("doc_id", "index", "origin", "x.summary", "x.type")


def restored_text(docs: DataFrame, states: DataFrame, output: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """``docs (doc_id)`` -> (doc_id, text): the cleaned text in the output folder if the document is past
    extraction, else the checkpoint's, else null (it is cleaned anew).  Tables: (doc_id, text)."""
    both = docs.select("doc_id").join(states.select("doc_id", "stage"), "doc_id", "left").join(output.withColumnRenamed("text", "o"), "doc_id", "left").join(checkpoint.withColumnRenamed("text", "c"), "doc_id", "left")
    past = stage_past("coalesce(stage, '')", "'extracted'")
    return both.selectExpr("doc_id", f"if({past} and o is not null, o, c) as text")


def stored_or_new(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks (doc_id, key, ...) that are stored under the content's key stay; of other documents, or
    where the text or the chunk size and so the key changed, the new ones count."""
    return stored.join(new.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi").unionByName(new.join(stored.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti"))
