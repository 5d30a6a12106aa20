"""Model stages over documents: cleaning, chunks, whole-document analysis, causes, context, images.

A stage is three plans: what is asked (``*_prompts``, or the chunks themselves), the calls
(``providers.call_model``), and what the replies say.  Replies are a table (``providers.REPLIES``), so recorded
ones serve as well as fresh ones; ``analysed`` and the other functions that take a provider write each
stage's replies once and read them from there, so no call is made twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import byte_cap, comma_list, data_url, holistic as parse_holistic, trim
from ..scratch import written
from . import assemble, split
from .providers import Provider, call_model

#: A chunk's reply is of use if one of its lines names a type.
TYPED = r"(?im)^[ \t]*type:[ \t]*\S"


def chunk_replies(chunks: DataFrame, provider: Provider, **how) -> DataFrame:
    """``chunks (doc_id, chunk_idx, text)`` -> their replies, written.  A reply that repeats itself or is not
    valid is asked for again, with a word on why."""
    return written(call_model(chunks, provider, "chunk", accept=TYPED, **how), "chunk-replies")


def chunk_results(replies: DataFrame) -> DataFrame:
    """Chunk replies -> results as the parsers read them, with attempts, error and the call's figures."""
    m = replies.withColumn("m", F.expr(parse.key_values("coalesce(response, '')")))
    get = lambda k: f"coalesce(m['{k}'], '')"
    return m.selectExpr(
        "doc_id", "chunk_idx as index", *[f"{get(k)} as {k}" for k in ("type", "title", "topic", "summary", "source_quote", "my_takeaway", "applicability")],
        f"{comma_list(get('key_points'))} as key_points", "cast(array() as array<string>) as topics", "cast(array() as array<string>) as domains",
        "coalesce(try_cast(m['confidence'] as double), 0D) as confidence", "text as content", f"{parse.valid_result('m')} as valid", "attempts", "error",
        "prompt_chars", "completion_chars", "prompt_tokens", "completion_tokens", "latency_ms",
    )


def _whole(texts: DataFrame) -> DataFrame:
    """``texts (doc_id, text)`` as calls, one a document; documents without text make none."""
    return texts.where("text <> ''").selectExpr("cast(doc_id as string) as doc_id", "cast(null as int) as chunk_idx", "text")


def holistic_prompts(results: DataFrame) -> DataFrame:
    """-> (doc_id, chunk_idx, text): a document's summaries."""
    return _whole(assemble.holistic_input(results))


def holistic(replies: DataFrame) -> DataFrame:
    """-> (doc_id, core_thesis, domains, error)."""
    return replies.selectExpr("doc_id", f"{parse_holistic('coalesce(response, {0})'.format(repr('')))} as h", "error").selectExpr("doc_id", "h.core_thesis", "h.domains", "error")


def causal_prompts(results: DataFrame) -> DataFrame:
    """-> (doc_id, chunk_idx, text): a document's numbered summaries and key points."""
    return _whole(assemble.causal_input(results))


def causal(replies: DataFrame) -> DataFrame:
    """-> (doc_id, causal_chains, preconditions, counterfactuals, error)."""
    return replies.selectExpr("doc_id", f"{parse.causal('coalesce(response, {0})'.format(repr('')))} as c", "error").selectExpr("doc_id", "c.chains as causal_chains", "c.preconditions", "c.counterfactuals", "error")


def enrichable(results: DataFrame) -> DataFrame:
    """Chunks with content and summary that have no context yet."""
    have = "context" if "context" in results.columns else "''"
    return results.where(f"coalesce(content, '') <> '' and coalesce(summary, '') <> '' and coalesce({have}, '') = ''")


def context_prompts(results: DataFrame) -> DataFrame:
    """-> (doc_id, index, text): the document's summary and a chunk's first 1000 bytes."""
    about = assemble.doc_summary(results).withColumnRenamed("summary", "about")
    text = f"concat('Document summary: ', about, '\\n\\nChunk content:\\n', {byte_cap('content', 1000)})"
    return enrichable(results).join(about, "doc_id").selectExpr("doc_id", "index", f"{text} as text")


def context_calls(results: DataFrame) -> DataFrame:
    return context_prompts(results).selectExpr("cast(doc_id as string) as doc_id", "index as chunk_idx", "text")


def with_context(results: DataFrame, replies: DataFrame) -> DataFrame:
    """``results`` with ``context``: what the model says of a chunk's place in its document."""
    got = replies.selectExpr("doc_id as __d", "chunk_idx as __i", f"{trim('response')} as __c")
    base = results if "context" in results.columns else results.withColumn("context", F.lit(""))
    both = base.join(got, (F.col("doc_id").cast("string") == F.col("__d")) & (F.col("index") == F.col("__i")), "left")
    return both.withColumn("context", F.coalesce(F.expr("nullif(context, '')"), "__c", F.lit(""))).drop("__d", "__i", "__c")


def describe_images(images: DataFrame, provider: Provider) -> DataFrame:
    """``images (path, data)`` -> (path, description, error): the model is given a data URL."""
    asked = images.selectExpr("path as doc_id", "cast(null as int) as chunk_idx", f"{data_url('data')} as text")
    got = written(call_model(asked, provider, "image"), "image-replies")
    return got.selectExpr("doc_id as path", f"coalesce({trim('response')}, '') as description", "error")


def cleaning_calls(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 28_000) -> DataFrame:
    """-> (doc_id, chunk_idx, text): a text of up to ``most`` bytes is cleaned in one call, a longer one in
    parts; blank texts need none."""
    parts = split.hard_parts(docs.where(f"{trim(f'coalesce({text_col}, {repr(str())})')} <> ''"), id_col, text_col, most)
    return parts.selectExpr(f"cast({id_col} as string) as doc_id", "part_idx as chunk_idx", "part as text")


def cleaned(replies: DataFrame) -> DataFrame:
    """Cleaning replies -> (doc_id, text, error): the parts joined in order; a document with a part that
    failed or came back blank has no text and says why."""
    said = f"{trim('response')}"
    one = replies.selectExpr("doc_id", "chunk_idx", f"{said} as part", f"coalesce(error, if(coalesce({said}, '') = '', 'empty reply', null)) as error")
    every = "array_join(transform(array_sort(collect_list(struct(chunk_idx, part))), x -> x.part), '\\n\\n')"
    got = one.groupBy("doc_id").agg(F.expr(every).alias("text"), F.expr("min_by(error, chunk_idx) filter (where error is not null)").alias("error"))
    return got.selectExpr("doc_id", "if(error is null, text, null) as text", "error")


def clean(docs: DataFrame, provider: Provider, **how) -> DataFrame:
    """Texts cleaned by the model -> (doc_id, text, error)."""
    return cleaned(written(call_model(cleaning_calls(docs), provider, "clean", retry=True, **how), "clean-replies"))


def rendered(chunk: DataFrame, context: DataFrame, whole: DataFrame, causes: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Replies of all stages -> (doc_id, markdown)."""
    results = with_context(chunk_results(chunk), context)
    known = holistic(whole).drop("error").join(causal(causes).drop("error"), "doc_id", "full")
    if meta is not None:
        known = meta.withColumn("doc_id", F.col("doc_id").cast("string")).join(known, "doc_id", "full")
    return assemble.render(results, known)


def analysed(chunks: DataFrame, provider: Provider, meta: DataFrame | None = None, **how) -> DataFrame:
    """The whole run over ``chunks`` -> (doc_id, markdown); each call is made once."""
    first = chunk_replies(chunks, provider, **how)
    results = chunk_results(first)
    own = {stage: written(call_model(asked, provider, stage, **how), f"{stage}-replies") for stage, asked in (
        ("context", context_calls(results)), ("holistic", holistic_prompts(results)), ("causal", causal_prompts(results)),
    )}
    return rendered(first, own["context"], own["holistic"], own["causal"], meta)
