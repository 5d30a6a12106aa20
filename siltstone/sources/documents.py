"""Documents of a folder as a data source: ``spark.read.format("siltstone_documents").load(folder)``.

An ``Extractor`` says which files it takes and how one is read; a registry is a list of them, the first that takes a
file reads it.  Partitions are planned by files, small ones together and the members of a large archive apart.  A
row is a file's part: its text, or what ``documents`` turns into text on the JVM side (HTML pages).  A
file that can't be read is a row with an error.  Files are reached through ``pyarrow.fs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, content_type string, part int, member string, text string, error string"
#: Bytes of small files that one partition takes, and bytes and members of an archive's share.
TARGET, MEMBERS = 16 << 20, 64


class Extractor:
    """How files of one kind are read.  ``open_`` opens a path for reading bytes."""

    kind, content_type, endings = "", "", ()

    def detect(self, path: str) -> bool:
        return path.lower().endswith(self.endings)

    def members(self, open_, path: str) -> list[str]:
        """An archive's members that are parts of the document, in order; [] for a file that is one part."""
        return []

    def extract(self, open_, path: str, members: list[str]) -> Iterator[tuple[str, str]]:
        """(member, text) of a file, or of some members of an archive."""
        with open_(path) as f:
            yield "", f.read().decode("utf-8", "replace")


class Markdown(Extractor):
    kind, content_type, endings = "markdown", "clean", (".md", ".markdown")


class Checkpoint(Extractor):
    """Chunk files of a checkpoint, chunk-NNN.md in a folder ``chunks``; the member is the number."""

    kind, content_type = "chunk", "clean"

    def detect(self, path: str) -> bool:
        import re

        return re.search(r"/chunks/chunk[-_]\d+\.md$", path) is not None

    def extract(self, open_, path: str, members: list[str]) -> Iterator[tuple[str, str]]:
        for _, text in super().extract(open_, path, members):
            yield path.rsplit("chunk", 1)[1][1:-3], text


class Epub(Extractor):
    kind, content_type, endings = "epub", "book", (".epub",)

    def members(self, open_, path: str) -> list[str]:
        import zipfile

        with open_(path) as f, zipfile.ZipFile(f) as z:
            return [n for n in z.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")) and "toc" not in n.lower() and "nav" not in n.lower()]

    def extract(self, open_, path: str, members: list[str]) -> Iterator[tuple[str, str]]:
        import zipfile

        with open_(path) as f, zipfile.ZipFile(f) as z:
            for n in members:
                yield n, z.read(n).decode("utf-8", "replace")


class Fb2(Extractor):
    kind, content_type, endings = "fb2", "book", (".fb2", ".fb2.zip", ".zip")

    def extract(self, open_, path: str, members: list[str]) -> Iterator[tuple[str, str]]:
        from siltstone.sources.files import fb2_text

        with open_(path) as f:
            yield "", fb2_text(f.read())


EXTRACTORS = (Checkpoint(), Markdown(), Epub(), Fb2())


def find(path: str, extractors=EXTRACTORS) -> Extractor | None:
    """The first extractor that takes a file."""
    return next((e for e in extractors if e.detect(path)), None)


@dataclass
class Share(InputPartition):
    """Files that one task reads: (path, members or None for all, number of the first)."""

    files: list

    def __init__(self, files):
        super().__init__(None)
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, folder: str, extractors, target: int, members: int, strict: bool):
        self.folder, self.extractors, self.target, self.share, self.strict = folder, extractors, target, members, strict

    def _fs(self):
        from pyarrow import fs as pafs

        return pafs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def _open(self, path: str):
        fs, _ = self._fs()
        return fs.open_input_file(path)

    def partitions(self) -> list[Share]:
        from pyarrow import fs as pafs

        fs, root = self._fs()
        found = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith("._")]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            e = find(f.path, self.extractors)
            if e is None and not self.strict:
                continue
            names = []
            if e is not None and f.size > self.target:
                try:
                    names = e.members(self._open, f.path)
                except Exception:  # noqa: BLE001 - the task that reads it says what is wrong
                    names = []
            if len(names) > self.share:
                out += [Share([(f.path, names[i : i + self.share], i)]) for i in range(0, len(names), self.share)]
                continue
            if held and size + f.size > self.target:
                out.append(Share(held))
                held, size = [], 0
            held.append((f.path, None, 0))
            size += f.size
        return [*out, *([Share(held)] if held else [])]

    def read(self, partition: Share):
        for path, names, first in partition.files:
            e = find(path, self.extractors)
            if e is None:
                yield path, None, None, 0, None, None, "no extractor"
                continue
            n = first
            try:
                some = e.members(self._open, path) if names is None else names
                for member, text in e.extract(self._open, path, some):
                    yield path, e.kind, e.content_type, n, member, text, None
                    n += 1
                if n == first:
                    yield path, e.kind, e.content_type, n, None, None, "no pages"
            except Exception as x:  # noqa: BLE001 - a broken file is a row
                yield path, e.kind, e.content_type, n, None, None, f"{type(x).__name__}: {x}"


class Documents(DataSource):
    """Options: ``path``; ``target`` bytes and ``members`` of a partition; ``strict`` "true" for a row with an error
    where no extractor takes a file, which is else left out."""

    extractors = EXTRACTORS

    @classmethod
    def name(cls) -> str:
        return "siltstone_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        o = self.options
        return Reader(o["path"], self.extractors, int(o.get("target", TARGET)), int(o.get("members", MEMBERS)), o.get("strict") == "true")


def register(spark: SparkSession, *more: Extractor) -> None:
    """Make the format known to a session; ``more`` extractors come before the built-in ones."""
    import sys

    from pyspark import cloudpickle

    from ..shipping import ship

    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planning process has no shipped files
    spark.dataSource.register(type("Documents", (Documents,), {"extractors": (*more, *EXTRACTORS), "__module__": __name__}))


def documents(parts: DataFrame) -> DataFrame:
    """Rows of the format -> (path, kind, content_type, text, error): a document each, its parts joined in order;
    Markdown loses its frontmatter, EPUB pages become text and front and back matter is left out."""
    from ..functions.text import EPUB_BOILERPLATE, contains_any, html_text, strip_frontmatter

    page = f"if({contains_any('coalesce(substring_index(member, {0}, -1), {1})'.format(repr('/'), repr('')), EPUB_BOILERPLATE)}, '', {html_text('text')})"
    own = parts.selectExpr("path", "kind", "content_type", "part", f"case kind when 'epub' then {page} when 'markdown' then {strip_frontmatter('text')} else text end as t", "error")
    joined = "array_join(transform(array_sort(collect_list(if(coalesce(t, '') <> '', struct(part, t), null))), x -> x.t), '\\n\\n')"
    got = own.groupBy("path", "kind", "content_type").agg(F.expr(joined).alias("text"), F.max("error").alias("error"))
    return got.selectExpr("path", "kind", "content_type", "text", "coalesce(error, if(text = '', 'no text', null)) as error")
