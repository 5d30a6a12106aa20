"""Sinks: tables as the files that the reading side expects.

A table of (doc_id, name, text) is written as one file a row below a folder, by the tasks that hold the
rows, through ``pyarrow.fs``; a file's name depends on its row alone, so a task that runs twice writes the
same file.  Telemetry and results go out as JSON lines through Spark's own writers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc_columns, trim
from ..operators.assemble import export_chunks, metadata_json, number
from ..shipping import map_arrow


def inside(doc: str | None, name: str | None) -> None:
    """ValueError unless both are paths that stay below the folder they are put into."""
    for x in (doc, name):
        if not x or x.startswith("/") or "\\" in x or "\0" in x or any(p in ("", ".", "..") for p in x.split("/")):
            raise ValueError(f"not a path inside the folder: {x!r}")


def write_files(rows: DataFrame, folder: str) -> int:
    """``rows (doc_id, name, text)`` to <folder>/<doc_id>/<name>; -> how many were written.  A document or name
    that would leave its folder (an absolute path, or one with ``..``) is an error, before anything of its row
    is written."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            n = 0
            for doc, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                inside(doc, name)
                place = f"{root}/{doc}/{name}"
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(place, compression=None) as out:
                    out.write((text or "").encode())
                n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]})

    src = rows.select(F.col("doc_id").cast("string"), F.col("name").cast("string"), F.col("text").cast("string"))
    return map_arrow(src, run, "n long").agg(F.sum("n")).first()[0] or 0


def chunk_files(chunks: DataFrame, mark: str = "-") -> DataFrame:
    """``chunks (doc_id, chunk_idx, text)`` -> (doc_id, name, text): chunk-NNN.md from 1 on, blank ones left
    out.  ``mark`` "_" is the form of an output folder."""
    return chunks.where(f"{trim('text')} <> ''").selectExpr("doc_id", f"concat('chunks/chunk{mark}', {number('chunk_idx + 1', 3)}, '.md') as name", "text")


def result_files(results: DataFrame) -> DataFrame:
    """Results -> (doc_id, name, text): one JSON object a chunk."""
    return results.selectExpr("doc_id", f"concat('results/result_', {number('index', 3)}, '.json') as name", "to_json(struct(*)) as text")


def result_arrays(results: DataFrame) -> DataFrame:
    """Results -> (doc_id, name, text): one JSON array a document, in chunk order."""
    one = results.select("doc_id", F.struct("index", F.struct("*").alias("v")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r.index", F.to_json("r.v").alias("j")))).alias("x"))
    return one.selectExpr("doc_id", "'results.json' as name", "concat('[', array_join(x.j, ','), ']') as text")


def stage_files(texts: DataFrame, stage: str) -> DataFrame:
    """``texts (doc_id, text)`` of a stage -> its file."""
    return texts.selectExpr("doc_id", f"'{stage}.md' as name", "text")


def status_files(states: DataFrame, chunks: DataFrame) -> DataFrame:
    """``states`` and ``chunks`` as ``resume`` gives them -> (doc_id, name, text): a status file in YAML (which
    JSON is)."""
    each = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in chunks.columns if c != "doc_id"]))).alias("chunks"))
    both = states.join(each, "doc_id", "left")
    return both.selectExpr("doc_id", "'status.yaml' as name", "to_json(struct(stage, chunks_total, failed_with, chunks), map('timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")) as text")


def export(results: DataFrame, markdown: DataFrame, documents: DataFrame, raw: DataFrame | None = None, cleaned: DataFrame | None = None) -> DataFrame:
    """All files of an export -> (doc_id, name, text): the raw and the cleaned text, the chunks, the final
    document twice (as final.md and under its title) and its record.  ``documents`` as ``metadata`` gives
    them with titles."""
    titled = markdown.join(nfc_columns(documents.select("doc_id", "title"), "title"), "doc_id")
    parts = [
        export_chunks(results).selectExpr("doc_id", "concat('chunks/', name) as name", "text"), stage_files(markdown.withColumnRenamed("markdown", "text"), "final"),
        titled.selectExpr("doc_id", "concat(title, '.md') as name", "markdown as text"), metadata_json(documents).selectExpr("doc_id", "'metadata.json' as name", "text"),
    ]
    parts += [stage_files(t, n) for t, n in ((raw, "raw"), (cleaned, "cleaned")) if t is not None]
    out = parts[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("doc_id", F.col("doc_id").cast("string")))
    return out


def append_telemetry(calls: DataFrame, folder: str) -> None:
    """Calls as JSON lines, added to those that are there."""
    calls.write.mode("append").json(folder)


def fan_out(calls: DataFrame, *sinks) -> None:
    """The same rows to several sinks; they are computed once."""
    kept = calls.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()
