"""Folders of finished documents: versions, flat Markdown, checkpoints of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import byte_cap, display_cut, frontmatter, is_hash_name, strip_frontmatter, trim
from ..operators.resume import CHUNK


def source_hash(x: str) -> str:
    """SQL: the first eight hex digits of SHA-256."""
    return f"substr(sha2({x}, 256), 1, 8)"


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """-> (path, text): whole files, below the folder too."""
    src = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return src.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def in_workspace(path: str) -> str:
    """SQL: whether one of a file's folders is named as a document's hash."""
    return f"exists(split({path}, '/'), x -> {is_hash_name('x')})"


def is_workspace(paths: DataFrame) -> DataFrame:
    """``paths (path)`` of files -> one row (workspace): whether a folder is named as a document's hash."""
    return paths.agg(F.coalesce(F.bool_or(F.expr(in_workspace("path"))), F.lit(False)).alias("workspace"))


def final_versions(texts: DataFrame) -> DataFrame:
    """``texts (path, text)`` of .../<document>/versions/v<number>/final.md -> (doc_id, version, text): each
    document's highest version by number."""
    where = r"r'([^/]+)/versions/v?(\d+)/final[.]md$'"
    own = texts.selectExpr(f"regexp_extract(path, {where}, 1) as doc_id", f"try_cast(regexp_extract(path, {where}, 2) as int) as version", "text").where("doc_id <> ''")
    return own.groupBy("doc_id").agg(F.max_by(F.struct("version", "text"), "version").alias("v")).select("doc_id", "v.version", "v.text")


def flat_documents(texts: DataFrame) -> DataFrame:
    """``texts (path, text)`` of Markdown files -> (doc_id, text); a document's id is the hash of its file
    name."""
    name = "substring_index(path, '/', -1)"
    kept = f"(endswith({name}, '.md') or endswith({name}, '.markdown')) and not startswith({name}, '._')"
    return texts.where(kept).selectExpr(f"{source_hash(name)} as doc_id", "text")


def indexed_chunks(documents: DataFrame) -> DataFrame:
    """``documents (doc_id, text)`` -> (doc_id, chunk_idx, topic, summary, content) as the chunk parser
    reads them."""
    each = documents.selectExpr("doc_id", f"posexplode({parse.markdown_chunks('text')}) as (chunk_idx, c)")
    return each.selectExpr("doc_id", "chunk_idx", "c.topic", "c.summary", "c.content")


def chunk_number(path: str) -> str:
    """SQL: the number in a chunk file's name, null if it is none."""
    return f"try_cast(regexp_extract({path}, r'chunk[-_](\\d+)[.]md$', 1) as int)"


def read_chunks(texts: DataFrame) -> DataFrame:
    """``texts (path, text)`` of .../<document>/<folder>/chunk-NNN.md -> (doc_id, chunk_idx, text) in the order
    of the numbers, blank ones left out."""
    own = texts.selectExpr("element_at(split(path, '/'), -3) as doc_id", f"{chunk_number('path')} as n", "text").where(f"n is not null and {trim('text')} <> ''")
    by_doc = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("x"))
    return by_doc.selectExpr("doc_id", "posexplode(x) as (chunk_idx, c)").selectExpr("doc_id", "chunk_idx", "c.text")


def yaml_frontmatter(x: str) -> str:
    """SQL: the frontmatter as a map; empty unless the text begins with a whole block."""
    return f"if({x} rlike r'(?s)^---\\n.*?\\n---', {frontmatter(x)}, cast(map() as map<string,string>))"


def listing(documents: DataFrame) -> DataFrame:
    """``documents (doc_id, title, source, versions)`` as a list's cells: a missing title is a dash, long
    ones are cut."""
    named = documents.selectExpr("doc_id", "if(coalesce(title, '') = '', '-', title) as title", "coalesce(source, '') as source", "versions")
    return named.selectExpr("doc_id", f"{display_cut('title', 30)} as title", f"{display_cut('source', 20)} as source", "versions")


def body(x: str, most: int | None = None) -> str:
    """SQL: a document's text without its frontmatter, or its first bytes."""
    return byte_cap(strip_frontmatter(x), most) if most else strip_frontmatter(x)


def read_status(texts: DataFrame) -> DataFrame:
    """``texts (path, text)`` of .../<document>/status.yaml, as ``sinks.status_files`` writes them -> (doc_id, stage,
    chunks_total, failed_with, chunks array of CHUNK); a file that is not whole is left out, as if the document
    were new."""
    kind = f"stage string, chunks_total bigint, failed_with string, chunks array<struct<{', '.join(c.replace(' ', ':', 1) for c in CHUNK.split(', ')).replace(', ', ',')}>>"
    own = texts.where("endswith(path, '/status.yaml')").selectExpr("element_at(split(path, '/'), -2) as doc_id", f"if(try_parse_json(text) is null, null, from_json(text, '{kind}')) as s")
    return own.where("s.stage is not null").select("doc_id", "s.*")


def stored_chunks(status: DataFrame) -> DataFrame:
    """``read_status``'s table -> (doc_id, *CHUNK), a row a chunk."""
    return status.selectExpr("doc_id", "inline(chunks)")


def query_prompt(spark: SparkSession, prompt: str, context: str | None = None) -> str:
    """A search prompt, with the text of a context file behind it if one is named."""
    from ..operators.prompts import with_context

    return with_context(prompt, "" if context is None else spark.read.text(context, wholetext=True).first()[0])
