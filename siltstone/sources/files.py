"""Scans: dispatch by path, Markdown, EPUB, FB2 and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EPUB_BOILERPLATE, FB2_BOILERPLATE, contains_any, html_text, strip_frontmatter, word_count
from ..shipping import map_arrow

#: File extensions by kind.
AUDIO, VIDEO = ["mp3", "wav", "flac", "ogg", "m4a", "aac"], ["mp4", "mkv", "avi", "mov", "webm", "flv"]


def kind(path: str) -> str:
    """SQL: a source's extractor, null if none; a URL wins over its extension."""
    low = f"lower({path})"
    ends = lambda xs: "(" + " or ".join(f"endswith({low}, '.{x}')" for x in xs) + ")"
    return (
        f"case when startswith({path}, 'http://') or startswith({path}, 'https://') then 'url' when {ends(AUDIO)} then 'audio' "
        f"when {ends(VIDEO)} then 'video' when {ends(['pdf'])} then 'pdf' when {ends(['epub'])} then 'epub' when {ends(['fb2', 'zip'])} then 'fb2' "
        f"when endswith({path}, '.md') or endswith({path}, '.markdown') then 'markdown' end"
    )


def content_type(k: str) -> str:
    return f"case when {k} in ('url', 'audio', 'video') then 'transcript' when {k} in ('pdf', 'epub', 'fb2') then 'book' when {k} = 'markdown' then 'clean' end"


def pick_content(content: str, description: str) -> str:
    """The description if the content is missing or has less than three tenths of its words."""
    return (
        f"case when {content} = '' then {description} when {description} = '' then {content} "
        f"when {word_count(content)} < {word_count(description)} * 30 div 100 then {description} else {content} end"
    )


def list_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder (not below it) that an extractor takes -> (path, kind), without their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return files.where("not startswith(substring_index(path, '/', -1), '._')").selectExpr("path", f"{kind('path')} as kind").where("kind is not null")


def list_directory(spark: SparkSession, folder: str) -> DataFrame:
    """``list_paths`` with the files' bytes -> (path, kind, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = "substring_index(path, '/', -1)"
    return files.where(f"not startswith({name}, '._')").selectExpr("path", f"{kind('path')} as kind", "content").where("kind is not null")


def fetched(raw: str) -> str:
    """SQL: what a page fetcher printed: of JSON the content or the description, else as it is."""
    get = lambda k: f"coalesce(try_variant_get(try_parse_json({raw}), '$.{k}', 'string'), '')"
    return f"if(startswith(ltrim({raw}), '{{') and try_parse_json({raw}) is not null, {pick_content(get('content'), get('description'))}, {raw})"


def page_count(info: str) -> str:
    """SQL: the number of pages in a PDF tool's report, 0 if it has none."""
    return f"coalesce(try_cast(regexp_extract({info}, r'Pages:\\s+(\\d+)', 1) as int), 0)"


def price_list(raw: DataFrame) -> DataFrame:
    """``raw (json)``: providers with models with costs -> (model, input_price, output_price), names in
    lower case; models without a cost are left out; of a model that several providers have, the first
    provider's in the order of their names."""
    kind = "map<string,struct<models:map<string,struct<cost:struct<input:double,output:double>>>>>"
    each = raw.selectExpr(f"explode(from_json(json, '{kind}')) as (provider, p)").selectExpr("provider", "explode(p.models) as (name, m)").where("m.cost is not null")
    first = each.groupBy(F.lower("name").alias("model")).agg(F.min_by("m", "provider").alias("m"))
    return first.selectExpr("model", "coalesce(m.cost.input, 0D) as input_price", "coalesce(m.cost.output, 0D) as output_price")


def model_names(raw: DataFrame) -> DataFrame:
    """``raw (json)``: a server's list of models, under data (with ids) or models (with names)."""
    kind = "struct<data:array<struct<id:string>>,models:array<struct<name:string,key:string>>>"
    both = raw.selectExpr(f"from_json(json, '{kind}') as j").selectExpr("explode(concat(coalesce(j.data.id, array()), coalesce(transform(j.models, m -> coalesce(m.name, m.key)), array()))) as model")
    return both.where("model <> ''").distinct()


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """-> (path, text) without frontmatter."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.where("(endswith(path, '.md') or endswith(path, '.markdown')) and not startswith(substring_index(path, '/', -1), '._')").selectExpr(
        "path", f"{strip_frontmatter('value')} as text"
    )


def read_epub(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, text, error): pages in archive order, front and back matter left
    out.  Only the unzipping is Python; a broken archive is an error value."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        names = [n for n in z.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")) and "toc" not in n.lower() and "nav" not in n.lower()]
                        rows += [(path, i, n.rsplit("/", 1)[-1], z.read(n).decode("utf-8", "replace"), None) for i, n in enumerate(names)] or [(path, 0, "", "", "no pages")]
                except Exception as e:  # noqa: BLE001 - a broken archive, or one member of it, is an error value
                    rows = [r for r in rows if r[0] != path] + [(path, 0, "", "", f"{type(e).__name__}: {e}")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["path", "ord", "name", "html", "error"])

    pages = map_arrow(files.select("path", "content"), run, "path string, ord int, name string, html string, error string")
    text = pages.selectExpr("path", "ord", "error", f"if({contains_any('name', EPUB_BOILERPLATE)}, '', {html_text('html')}) as t")
    return text.groupBy("path").agg(
        F.expr("array_join(transform(array_sort(collect_list(if(t <> '', struct(ord, t), null))), x -> x.t), '\\n\\n')").alias("text"), F.max("error").alias("error")
    ).selectExpr("path", "text", "coalesce(error, if(text = '', 'no text', null)) as error")


def _images(files: DataFrame, images_of) -> DataFrame:
    """(path, content) -> (path, name, alt_text, data, error), a row per image that ``images_of`` a
    file's bytes gives, or one with the error."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    got = [(path, *x, None) for x in images_of(data)]
                except Exception as e:  # noqa: BLE001 - a broken book is an error value
                    got = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=["path", "name", "alt_text", "data", "error"])

    return map_arrow(files.select("path", "content"), run, "path string, name string, alt_text string, data binary, error string")


def epub_images(data: bytes) -> list[tuple[str, str, bytes]]:
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith((".jpg", ".jpeg", ".png", ".gif", ".svg"))]
        return [(n, f"Image from EPUB: {n.rsplit('/', 1)[-1]}", z.read(n)) for n in names]


def fb2_images(data: bytes) -> list[tuple[str, str, bytes]]:
    """Pictures in an FB2 book's text; one that can't be decoded is left out."""
    import base64
    import binascii

    out = []
    for e in _fb2_root(data):
        if e.tag.rsplit("}", 1)[-1] == "binary":
            kind, name = e.get("content-type", ""), e.get("id", "")
            try:
                raw = base64.b64decode("".join((e.text or "").split()), validate=True)
            except binascii.Error:
                continue
            out.append((name + (".png" if "png" in kind else ".gif" if "gif" in kind else ".jpg"), f"Image from FB2: {name}", raw))
    return out


def read_epub_images(files: DataFrame) -> DataFrame:
    """An EPUB's images -> (path, name, alt_text, data, error)."""
    return _images(files, epub_images)


def read_fb2_images(files: DataFrame) -> DataFrame:
    """An FB2 book's images -> (path, name, alt_text, data, error)."""
    return _images(files, fb2_images)


def no_images(files: DataFrame) -> DataFrame:
    """Sources whose images aren't collected (URLs, audio, video, Markdown) have none."""
    return files.selectExpr("path", "cast(array() as array<struct<path:string,alt_text:string>>) as images")


def _fb2_root(data: bytes):
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read(next(n for n in z.namelist() if n.lower().endswith(".fb2")))
    return ET.fromstring(data)


def fb2_text(data: bytes) -> str:
    """Sections of an FB2 book (or a zip that holds one) as Markdown: titles as headings two
    levels below their depth, six at most, boilerplate titles left out."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    plain = lambda e: " ".join("".join(e.itertext()).split())
    out: list[str] = []
    todo = [(s, 0) for b in _fb2_root(data) if local(b) == "body" for s in b if local(s) == "section"][::-1]
    while todo:
        section, depth = todo.pop()
        for e in section:
            if local(e) == "title":
                out += [f"{'#' * min(depth + 2, 6)} {t}" for p in e if local(p) == "p" and (t := plain(p)) and not any(x in t.lower() for x in FB2_BOILERPLATE)]
        out += [t for e in section if local(e) == "p" and (t := plain(e))]
        todo += [(e, depth + 1) for e in section if local(e) == "section"][::-1]
    return "\n\n".join(out)


def read_fb2(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, text, error)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append((path, fb2_text(data), None))
                except Exception as e:  # noqa: BLE001 - a broken book is an error value
                    rows.append((path, "", f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "text", "error"])

    return map_arrow(files.select("path", "content"), run, "path string, text string, error string")


def read_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    text = html_text(f"coalesce({html_col}, '')")
    return pages.selectExpr(id_col, f"{text} as text")


def latest_versions(files: DataFrame) -> DataFrame:
    """(doc_id, version, content) -> each document's highest numbered version."""
    return files.groupBy("doc_id").agg(F.max_by(F.struct("version", "content"), F.regexp_extract("version", r"(\d+)", 1).cast("int")).alias("v")).select("doc_id", "v.*")


def pdf_pages_to_text(pages: DataFrame) -> DataFrame:
    """Extracted page texts (doc, page, text) -> (doc, text): tables of contents and boilerplate
    pages dropped, the rest joined in page order.  Extracting the pages is an external tool's job."""
    from ..functions.text import is_boilerplate_page, is_toc_page

    kept = pages.where(f"not {is_toc_page('text')} and not {is_boilerplate_page('text')}")
    return kept.groupBy("doc").agg(F.expr("array_join(transform(array_sort(collect_list(struct(page, text))), x -> x.text), '\\n\\n')").alias("text"))
