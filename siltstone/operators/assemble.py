"""Chunk results -> documents: topics, takeaways, summaries, model input, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import render_causal
from ..functions.text import bullets, confidence, document_title, fields, string_list, trim, yaml_field

#: Columns of a document that ``render`` takes, beside doc_id; all may be absent.
META = {
    "source": "string", "source_type": "string", "frontmatter": "map<string,string>", "core_thesis": "string",
    "causal_chains": "array<struct<cause:string,mechanism:string,effect:string,relation:string>>", "preconditions": "array<string>",
    "counterfactuals": "array<string>", "images": "array<struct<path:string,description:string>>",
}


def _ordered(expr: str, when: str = "true") -> str:
    """An aggregate: a group's values in chunk order."""
    return f"transform(array_sort(collect_list(if({when}, struct(index, {expr} as v), null))), x -> x.v)"


def topic_union(results: DataFrame) -> DataFrame:
    """Distinct topics, topic lists and domains of a document, in byte order."""
    every = "concat(if(topic <> '', array(topic), array()), topics, domains)"
    return results.selectExpr("doc_id", f"explode({every}) as t").groupBy("doc_id").agg(F.expr("array_join(array_sort(collect_set(t)), '|')").alias("topics"))


def takeaways(results: DataFrame) -> DataFrame:
    some = "my_takeaway <> ''"
    return results.groupBy("doc_id").agg(F.expr(f"array_join({_ordered('my_takeaway', some)}, '|')").alias("takeaways"))


def doc_summary(results: DataFrame) -> DataFrame:
    """The first five distinct topics in order of appearance."""
    some = "topic <> ''"
    out = results.groupBy("doc_id").agg(F.expr(f"slice(array_distinct({_ordered('topic', some)}), 1, 5)").alias("f"))
    return out.selectExpr("doc_id", "if(size(f) = 0, '', concat('Document covering: ', array_join(f, ', '))) as summary")


def holistic_input(results: DataFrame) -> DataFrame:
    some = "summary <> ''"
    return results.groupBy("doc_id").agg(F.expr(f"array_join({_ordered('summary', some)}, '\\n\\n')").alias("text"))


def causal_input(results: DataFrame) -> DataFrame:
    line = "concat_ws('\\n', if(summary <> '', concat('[chunk ', index + 1, '] ', summary), null), if(size(key_points) > 0, concat('  Key points: ', array_join(key_points, '; ')), null))"
    some = "summary <> '' or size(key_points) > 0"
    return results.groupBy("doc_id").agg(F.expr(f"array_join({_ordered(line, some)}, '\\n')").alias("text"))


def reassemble_parts(parts: DataFrame) -> DataFrame:
    """``parts (doc_id, part_idx, part)`` -> (doc_id, text): cleaned parts joined in order."""
    every = "array_join(transform(array_sort(collect_list(struct(part_idx, part))), x -> x.part), '\\n\\n')"
    return parts.groupBy("doc_id").agg(F.expr(every).alias("text"))


def merge_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """Partial results of one chunk -> one: of each text the first that is not empty, of numbers the
    first above 0, in order of ``part``; lists one after the other."""
    out = []
    for f in results.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in (*keys, "part"):
            continue
        got = f"transform(array_sort(collect_list(struct(part, `{f.name}` as v))), x -> x.v)"
        if kind.startswith("array"):
            out.append(F.expr(f"flatten({got})").alias(f.name))
        else:
            none, some = ("''", "v <> ''") if kind == "string" else (f"cast(0 as {kind})", "v > 0")
            out.append(F.expr(f"coalesce(get(filter({got}, v -> {some}), 0), {none})").alias(f.name))
    return results.groupBy(*keys).agg(*out)


def _items(name: str, items: str) -> str:
    """SQL: a list's heading and its bullets; blanks are left out, and without items all is."""
    some = f"filter(transform({items}, k -> {trim('k')}), k -> k <> '')"
    return f"if(coalesce(size({items}), 0) > 0, concat('{name}:\\n', {bullets(some)}), '')"


def number(n: str, width: int = 2) -> str:
    """SQL: a number with leading zeros up to ``width`` digits, longer ones whole."""
    return f"lpad(cast({n} as string), greatest({width}, length(cast({n} as string))), '0')"


def _line(key: str, value: str) -> str:
    """SQL: ``key: value`` on one line whatever the value holds, nothing for a blank."""
    return f"if({trim(value)} = '', '', concat('{key}: ', {value}, '\\n'))"


def chunk_block(field=yaml_field, context: bool = True) -> str:
    """SQL: a chunk result as Markdown, each field by ``field``."""
    own = lambda *ks: [field(k, f"coalesce({k}, '')") for k in ks]
    parts = [
        *(own("context") if context else []), *own("type", "topic", "summary"), _items("key_points", "key_points"), *own("source_quote", "my_takeaway"),
        field("confidence", confidence("confidence")), *own("applicability"), _items("steps", "steps"),
    ]
    return f"concat('## chunk_', {number('index + 1')}, '\\n\\n', {', '.join(parts)})"


def _whole(results: DataFrame) -> DataFrame:
    """``results`` with the columns that a block may need."""
    for name, kind in {"context": "string", "steps": "array<string>"}.items():
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast(kind))
    return results


def frontmatter_block() -> str:
    """SQL: a document's frontmatter lines; the frontmatter's own values come first."""
    def get(k: str, other: str = "''") -> str:
        own = f"coalesce(try_element_at(frontmatter, '{k}'), '')"
        return f"if({trim(own)} <> '', {own}, {other})"

    def many(k: str) -> str:
        value = f"try_element_at(frontmatter, '{k}')"
        return f"if({value} is null, '', concat('{k}: [', array_join({string_list(value)}, ', '), ']\\n'))"

    lines = [
        yaml_field("id", "cast(doc_id as string)"), yaml_field("title", document_title("frontmatter", "source")), yaml_field("source_type", get("source_type", "source_type")),
        yaml_field("source", "source"), yaml_field("author", get("author")), yaml_field("date", get("date")), yaml_field("language", get("language", "'ru'")), many("topics"),
        yaml_field("confidence", get("confidence")), yaml_field("status", get("status", "'processed'")), yaml_field("my_relevance", get("my_relevance")), many("tags"),
    ]
    return f"concat('---\\n', {', '.join(lines)}, '---\\n\\n')"


def holistic_block() -> str:
    """SQL: what the analysis of the whole document found."""
    part = lambda name, items, body: f"if(coalesce(size({items}), 0) > 0, concat('\\n## {name}\\n\\n', {body}), '')"
    parts = [
        "if(core_thesis <> '', concat('## Holistic Analysis\\n\\n', core_thesis, '\\n'), '')", part("Causal Chains", "causal_chains", render_causal("causal_chains")),
        part("Preconditions", "preconditions", bullets("preconditions")), part("Counterfactuals", "counterfactuals", bullets("counterfactuals")),
    ]
    return f"concat({', '.join(parts)})"


def render(results: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """-> (doc_id, markdown): frontmatter between --- marks, the chunks in order, the analysis and the
    images; chunks with neither type nor summary are left out.  ``meta (doc_id, ...)`` has the columns
    of META that are known; a document with no row there has an id and the defaults."""
    place = "named_struct('kept', type <> '' or summary <> '', 'text', " + chunk_block() + ")"
    blocks = _whole(results).groupBy("doc_id").agg(F.expr(_ordered(place)).alias("blocks"))
    body = "array_join(transform(filter(transform(blocks, (b, i) -> struct(b.kept as kept, if(i > 0, concat('\\n', b.text), b.text) as text)), b -> b.kept), b -> b.text), '')"
    both = blocks.join(meta, "doc_id", "left") if meta is not None else blocks
    for name, kind in META.items():
        value = F.col(name).cast(kind) if name in both.columns else F.lit(None).cast(kind)
        both = both.withColumn(name, F.coalesce(value, F.lit("")) if kind == "string" else value)
    both = both.withColumn("frontmatter", F.expr("coalesce(frontmatter, cast(map() as map<string,string>))"))
    whole = both.selectExpr("doc_id", f"{frontmatter_block()} as head", f"{body} as body", f"{holistic_block()} as analysis", "images")
    image = "concat('![', x.description, '](', if(instr(x.path, '/') > 0, concat('images/', substring_index(x.path, '/', -1)), x.path), ')\\n\\n')"
    pictures = f"if(coalesce(size(images), 0) > 0, concat('\\n## Images\\n\\n', array_join(transform(images, x -> {image}), '')), '')"
    return whole.selectExpr("doc_id", f"concat(head, body, if(analysis <> '', concat('\\n', analysis), ''), {pictures}) as markdown")


def export_chunks(results: DataFrame) -> DataFrame:
    """-> (doc_id, name, text): each kept chunk as a file of its own, with its content; every field is
    one line."""
    text = f"concat({chunk_block(_line, context=False)}, if(content <> '', concat('\\n', content, '\\n'), ''))"
    return _whole(results).where("type <> '' or summary <> ''").selectExpr("doc_id", f"concat('chunk_', {number('index + 1', 3)}, '.md') as name", f"{text} as text")


def metadata(results: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Word count, chunk count, topics, takeaways, mean confidence bucket and status of a document;
    with ``meta`` its title, source and author too."""
    every = "concat(if(topic <> '', array(topic), array()), topics, domains)"
    some = "my_takeaway <> ''"
    out = results.withColumn("n_words", F.expr(f"size({fields('content')})")).groupBy("doc_id").agg(
        F.sum("n_words").alias("word_count"), F.count("*").alias("n_chunks"), F.expr(confidence("avg(confidence)")).alias("confidence"),
        F.expr(f"array_join(array_sort(array_distinct(flatten(collect_list({every})))), '|')").alias("topics"),
        F.expr(f"array_join({_ordered('my_takeaway', some)}, '|')").alias("takeaways"),
    ).withColumn("status", F.lit("processed"))
    if meta is None:
        return out
    own = meta.selectExpr("doc_id", f"{document_title('frontmatter', 'source')} as title", "source", "coalesce(try_element_at(frontmatter, 'author'), '') as author")
    return out.join(own, "doc_id", "left")


def metadata_json(documents: DataFrame, version: str = "1") -> DataFrame:
    """``documents`` as ``metadata`` gives them -> (doc_id, text): the record kept beside an export."""
    fields_ = "struct(source, title, word_count, {0} as version, split(topics, '[|]') as topics, author, n_chunks as chunks_total, 'completed' as status)"
    return documents.selectExpr("doc_id", f"to_json({fields_.format(version)}) as text")
