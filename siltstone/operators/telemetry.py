"""Roll-ups over model-call telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import duration, price_keys

SUMS = ["round(sum(cost), 6) as cost", "sum(prompt_tokens) as tokens_in", "sum(completion_tokens) as tokens_out"]


def prices(pricing: DataFrame) -> DataFrame:
    """``pricing (model, input_price, output_price)`` with one row per lower-cased model: of several
    the one of the smallest prices, so the result doesn't depend on their order."""
    both = F.min(F.struct("input_price", "output_price")).alias("p")
    return pricing.groupBy(F.lower("model").alias("model")).agg(both).select("model", "p.input_price", "p.output_price")


def priced(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """``calls`` with ``cost``: tokens per million at the prices of the first key that is known, both
    from one key; 0 for an unknown model.  ``pricing`` is a small dimension (``prices``)."""
    keyed = calls.withColumn("__k", F.expr(price_keys("model")))
    dim = prices(pricing).selectExpr("model as __m", "struct(coalesce(input_price, 0D) as i, coalesce(output_price, 0D) as o) as __p")
    for i in range(3):
        keyed = keyed.join(dim.selectExpr(f"__m as __m{i}", f"__p as __p{i}"), F.col("__k")[i] == F.col(f"__m{i}"), "left")
    keyed = keyed.withColumn("__p", F.expr("coalesce(__p0, __p1, __p2, struct(0D as i, 0D as o))"))
    cost = "cast(prompt_tokens as double) / 1e6D * __p.i + cast(completion_tokens as double) / 1e6D * __p.o"
    return keyed.withColumn("cost", F.expr(cost)).select(*[c for c in calls.columns if c != "cost"], "cost")


def totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("calls"), *map(F.expr, SUMS), F.sum("prompt_chars").alias("chars_in"), F.sum("completion_chars").alias("chars_out"))


def stage_breakdown(calls: DataFrame) -> DataFrame:
    return calls.where("stage <> ''").groupBy("stage").agg(F.count("*").alias("calls"), *map(F.expr, SUMS))


def model_usage(calls: DataFrame) -> DataFrame:
    return calls.where("success and model <> ''").groupBy("model").agg(F.count("*").alias("calls"), *map(F.expr, SUMS))


def chunk_cost(calls: DataFrame, paid_only: bool = True) -> DataFrame:
    """Of each chunk the last successful call, with a cost unless ``paid_only`` is off (free local
    models); calls without a chunk are left out."""
    last = F.max_by(F.struct("model", "cost", "prompt_tokens", "completion_tokens", "latency_ms"), "seq").alias("c")
    kept = calls.where("success and chunk_index is not null" + (" and cost > 0" if paid_only else ""))
    return kept.groupBy("source", "chunk_index").agg(last).select("source", "chunk_index", "c.*")


def status_stats(chunks: DataFrame) -> DataFrame:
    """``chunks (source, done, failed, duration_ms, tokens_in, tokens_out, cost)`` -> per source the
    counts, integer means over done chunks, and the success rate."""
    return chunks.groupBy("source").agg(
        F.count_if("done").alias("chunks_done"), F.count_if(F.expr("failed and not done")).alias("chunks_failed"), F.count("*").alias("chunks_total"),
        F.expr("coalesce(sum(if(done, duration_ms, 0)) div nullif(count_if(done), 0), 0)").alias("avg_latency_ms"),
        F.expr("coalesce(sum(if(done, tokens_in, 0)) div nullif(count_if(done), 0), 0)").alias("avg_tokens_in"),
        F.expr("round(coalesce(sum(if(done, cost, 0D)) / nullif(count_if(done), 0), 0D), 8)").alias("avg_cost"),
        F.expr("cast(count_if(done) as double) / count(*)").alias("success_rate"),
    )


def stage_timing(calls: DataFrame) -> DataFrame:
    """Per source and stage the milliseconds from first to last call, and their short form."""
    t = calls.groupBy("source", "stage").agg(F.expr("(unix_micros(max(timestamp)) - unix_micros(min(timestamp))) div 1000").alias("ms"))
    return t.withColumn("human", F.expr(duration("cast((ms + 500) div 1000 as bigint)")))


def rollup(status: DataFrame) -> DataFrame:
    """A batch's processed, skipped and failed files with sums over the processed ones."""
    return status.agg(
        F.count_if(F.expr("state = 'done'")).alias("processed"), F.count_if(F.expr("state = 'skipped'")).alias("skipped"),
        F.count_if(F.expr("state = 'failed'")).alias("failed"), F.expr("coalesce(sum(if(state = 'done', tokens_in, 0)), 0)").alias("tokens_in"),
        F.expr("round(coalesce(sum(if(state = 'done', cost, 0D)), 0D), 6)").alias("cost"),
    )


def remaining(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a usable stored result (a summary or a type)."""
    done = results.where("summary <> '' or type <> ''").select("doc_id", "chunk_idx")
    return chunks.join(done, ["doc_id", "chunk_idx"], "left_anti")


def reassemble(lines: DataFrame) -> DataFrame:
    """Recorded ``data: {json}`` stream lines (call_id, seq, line) -> (call_id, content,
    finished): malformed lines skipped, deltas joined in order."""
    got = lines.withColumn("body", F.regexp_extract("line", r"^data: (.*)$", 1)).withColumn(
        "delta", F.expr("try_variant_get(try_parse_json(body), '$.choices[0].delta.content', 'string')")
    )
    return got.groupBy("call_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(if(delta is not null, struct(seq, delta), null))), x -> x.delta), '')").alias("content"),
        F.expr("bool_or(body = '[DONE]')").alias("finished"),
    )


def reassemble_objects(lines: DataFrame) -> DataFrame:
    """Recorded lines of JSON objects (call_id, seq, line) -> (call_id, content, finished, prompt_tokens,
    completion_tokens): malformed lines skipped, contents (nested under ``message`` or not) joined in
    order up to the first that says done, the usage that of the last line that has one."""
    get = lambda path, kind: f"try_variant_get(v, '$.{path}', '{kind}')"
    got = lines.selectExpr("call_id", "seq", "try_parse_json(line) as v").where("v is not null").selectExpr(
        "call_id", "seq", f"coalesce({get('message.content', 'string')}, {get('content', 'string')}) as delta", f"coalesce({get('done', 'boolean')}, false) as done",
        f"{get('prompt_eval_count', 'bigint')} as i", f"{get('eval_count', 'bigint')} as o",
    )
    every = "array_sort(collect_list(struct(seq, delta, done, i, o)))"
    by_call = got.groupBy("call_id").agg(F.expr(every).alias("x")).selectExpr("call_id", "x", "array_position(x.done, true) as stop")
    return by_call.selectExpr("call_id", "if(stop > 0, slice(x, 1, cast(stop as int)), x) as x", "stop > 0 as finished").selectExpr(
        "call_id", "array_join(x.delta, '') as content", "finished",
        "aggregate(x, 0L, (a, y) -> coalesce(y.i, a)) as prompt_tokens", "aggregate(x, 0L, (a, y) -> coalesce(y.o, a)) as completion_tokens",
    )


def prompt_chars(messages: str) -> str:
    """SQL: the bytes of all contents of an array of messages."""
    return f"aggregate({messages}, 0L, (a, m) -> a + octet_length(coalesce(m.content, '')))"
