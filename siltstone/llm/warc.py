"""WARC archives: a writer, and a splittable reader.

Each record is a gzip member of its own, with an id of its own.  A page's block is an HTTP response
whose body is the payload; a revisit's is its header alone, and it names the page it repeats by URI,
date and payload digest (and by X-Refers-To-Page).  A reader task owns the records whose member starts in
its byte range: it scans the range for gzip magic, accepts a candidate if its first bytes inflate
to a WARC header, then follows the members one after the other past the range's end, if the last
one reaches there.  Damage between members is skipped by scanning on; a member that begins as a
record but breaks off, or holds less than its Content-Length, gives a row of type ``damaged``.

Files are reached through ``pyarrow.fs``, so the folder may be any URI it knows (file, hdfs, s3,
gs).  A writing task's files count only if its manifest rows were committed, so retried and lost
tasks leave no duplicates.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import materialize, new_path, read, slices, small

SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
MIN_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "type string, record_id string, page_id long, refers_to long, uri string, date string, payload_digest string, payload_length long, payload binary"
HTTP = "application/http; msgtype=response"


def _clean(value) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex() for c in str(value))


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, names in lower case, and its block.  ValueError if it is not whole."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields.get("content-length", ""))
    if not 0 <= length <= len(rest):
        raise ValueError("the block is shorter than Content-Length")
    return fields, rest[:length]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP response, else the block."""
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def write_records(records: DataFrame, folder: str, date: dt.datetime | None = None) -> DataFrame:
    """``records (id, uri, payload string, refers_to, refers_to_uri)`` -> manifest (path, bytes,
    records), written out.  A record with ``refers_to`` is a revisit without payload; a null payload is
    empty.  All records take the date of the call if none is given."""
    when = (date or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for part in slices(batch, "payload"):
                for row in part.to_pylist():
                    if out is None:
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", when), ("Content-Type", "application/warc-fields")]
                        size += out.write(member(info, b"software: siltstone\r\n"))
                    data = (row["payload"] or "").encode()
                    old = row["refers_to"]
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                    fields = [
                        ("WARC-Type", "response" if old is None else "revisit"),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                        ("WARC-Date", when),
                        ("WARC-Target-URI", row["uri"]),
                        ("Content-Type", HTTP),
                        ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(data).hexdigest()),
                        ("X-Payload-Length", len(data)),
                        ("X-Page", row["id"]),
                    ]
                    if old is not None:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", row["refers_to_uri"]), ("WARC-Refers-To-Date", when), ("X-Refers-To-Page", old)]
                    size += out.write(member(fields, http + data if old is None else http))
                    n += 1
                    if size >= FILE_BYTES:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    cols = records.select(F.col("id").cast("long").alias("id"), F.col("uri").cast("string").alias("uri"), F.col("payload").cast("string").alias("payload"), F.col("refers_to").cast("long").alias("refers_to"), F.col("refers_to_uri").cast("string").alias("refers_to_uri"))
    return materialize(map_arrow(cols, run, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """Forward reads of a file: ``buf[at:]`` is what was read from ``base + at`` on.  Reads grow with
    what is held, and what was passed is dropped in large steps, so nothing is copied over and over."""

    def __init__(self, file, base: int, step: int = 1 << 18):
        self.file, self.base, self.step, self.buf, self.at = file, base, step, bytearray(), 0

    def fill(self) -> bool:
        if self.at > self.step and 2 * self.at > len(self.buf):
            del self.buf[: self.at]
            self.base, self.at = self.base + self.at, 0
        self.file.seek(self.base + len(self.buf))
        more = self.file.read(max(self.step, len(self.buf) - self.at))
        self.buf += more
        return bool(more)

    def head(self, n: int) -> bytes:
        while len(self.buf) - self.at < n and self.fill():
            pass
        return bytes(self.buf[self.at : self.at + n])


def is_record(head: bytes) -> bool:
    """Whether a gzip member that inflates to a WARC header starts here."""
    try:
        return zlib.decompressobj(31).decompress(head, 16).startswith(b"WARC/")
    except zlib.error:
        return False


def records_in(file, start: int, end: int):
    """The records (fields, block) whose members start in [start, end).  For a member that begins as
    a record but is not whole: (None, its place)."""
    w = _Window(file, start)
    while True:
        i = w.buf.find(MAGIC, w.at)
        if i < 0:
            w.at = max(w.at, len(w.buf) - 2)
            if w.base + w.at >= end or not w.fill():
                return
            continue
        if w.base + i >= end:
            return
        w.at = i
        if not is_record(w.head(4096)):
            w.at += 1
            continue
        z, out, used = zlib.decompressobj(31), [], 0
        try:
            while not z.eof:
                if w.at + used == len(w.buf) and not w.fill():
                    raise zlib.error("cut off")
                piece = bytes(w.buf[w.at + used : w.at + used + (1 << 20)])
                out.append(z.decompress(piece))
                used += len(piece) - len(z.unused_data)
            record = parse(b"".join(out))
        except (zlib.error, ValueError):
            yield None, w.base + w.at
            w.at += 1
            continue
        yield record
        w.at += used


def read_records(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``files (path, bytes)`` under ``folder``'s file system -> SCHEMA, a row per record but
    warcinfo; for a damaged one a row with its file as uri and its place as payload_length.  A file
    without records gives none."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(folder)
        text, whole = pa.string(), pa.int64()
        schema = pa.schema([("type", text), ("record_id", text), ("page_id", whole), ("refers_to", whole), ("uri", text), ("date", text), ("payload_digest", text), ("payload_length", whole), ("payload", pa.binary())])
        number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for s in batch.to_pylist():
                with fs.open_input_file(s["path"]) as file:
                    rows, size = [], 0
                    for h, block in records_in(file, s["start"], s["end"]):
                        if h is None:
                            rows.append(("damaged", None, None, None, s["path"], None, None, block, None))
                            continue
                        if h.get("warc-type") == "warcinfo":
                            continue
                        data = payload_of(h, block)
                        ids = [number(h.get(x)) for x in ("x-page", "x-refers-to-page")]
                        rows.append((h.get("warc-type"), h.get("warc-record-id"), *ids, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), number(h.get("x-payload-length")), data))
                        size += len(data)
                        if size > 4 << 20:
                            yield flush(rows)
                            rows, size = [], 0
                    if rows:
                        yield flush(rows)

    cut = files.where("bytes > 0").selectExpr("path", "bytes", f"explode(sequence(0L, bytes - 1, {split_bytes}L)) as start")
    cut = cut.selectExpr("path", "start", f"least(bytes, start + {split_bytes}) as end")
    n = max(1, cut.count())
    return map_arrow(cut.repartition(n, "path", "start"), run, SCHEMA)


def revisits(pages: DataFrame) -> DataFrame:
    """``pages (id, uri, digest, bytes)`` -> (id, digest, target, target_uri): pages whose payload of
    MIN_REVISIT bytes or more also belongs to a page with a larger id."""
    own = materialize(pages.where(f"bytes >= {MIN_REVISIT} and id is not null").select("id", "uri", "digest"), "digests")
    last = own.groupBy("digest").agg(F.max(F.struct("id", "uri")).alias("last"), F.count("*").alias("c")).where("c > 1").drop("c")
    both = own.join(materialize(last, "last"), "digest").where("id <> last.id")
    return both.selectExpr("id", "digest", "last.id as target", "last.uri as target_uri").distinct()


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: dt.datetime | None = None) -> DataFrame:
    """Write all pages as WARC records -> manifest.

    Null payloads are empty, and small ones are all responses; repeated rows are each written, with
    record ids of their own; different payloads under one id are judged each on its own.  A page
    without an id is a response that names no page.  An empty table writes nothing.
    """
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    old = materialize(revisits(src.selectExpr("id", "uri", "sha1(payload) as digest", "octet_length(payload) as bytes")), "revisits")
    old = small(old.toDF("page", "same", "refers_to", "refers_to_uri"))
    found = src.join(old, (F.col("id") == F.col("page")) & (F.sha1("payload") == F.col("same")), "left")
    return write_records(found, folder, date)


def op7(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    back = read_records(archive(read(spark, sf_dir, "pages"), folder), folder)
    return back.where("type in ('response', 'revisit')").selectExpr(
        "page_id",
        "if(type = 'response', cast(octet_length(payload) as bigint), payload_length) as payload_bytes",
        "if(type = 'response', sha1(payload), substr(payload_digest, 6)) as payload_digest",
        "type as record_type",
        "refers_to",
    )
