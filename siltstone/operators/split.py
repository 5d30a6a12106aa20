"""Byte-bounded paragraph chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fields, trim

#: Bytes of a chunk, and below which one is merged.
CHUNK_BYTES, MERGE_BYTES = 1500, 500
#: Fixed value: Unicode white space.
BLANK = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def paragraphs(x: str) -> str:
    return f"filter(transform(split({x}, '\\n\\n'), p -> {trim('p')}), p -> p <> '')"


def pack(items: str, most: int = CHUNK_BYTES) -> str:
    """Fold paragraphs into groups of at most ``most`` bytes; a longer paragraph stays whole."""
    full = f"(a.cur <> '' and octet_length(a.cur) + octet_length(p) + 2 > {most})"
    return (
        f"aggregate({items}, named_struct('done', cast(array() as array<string>), 'cur', ''), (a, p) -> named_struct("
        f"'done', if({full}, array_append(a.done, a.cur), a.done), "
        f"'cur', if(a.cur = '' or {full}, p, concat(a.cur, '\\n\\n', p))), "
        "a -> if(a.cur = '', a.done, array_append(a.done, a.cur)))"
    )


def merge_small(chunks: str, least: int = MERGE_BYTES) -> str:
    """Chunks below ``least`` bytes join the next larger one; a rest joins the last."""
    tail = "concat(slice(a.done, 1, size(a.done) - 1), array(concat(element_at(a.done, -1), '\\n\\n', a.wait)))"
    join = "if(a.wait = '', c, concat(a.wait, '\\n\\n', c))"
    fold = (
        f"aggregate(cs, named_struct('done', cast(array() as array<string>), 'wait', ''), (a, c) -> if(octet_length(c) < {least}, "
        f"named_struct('done', a.done, 'wait', {join}), named_struct('done', array_append(a.done, {join}), 'wait', '')), "
        f"a -> case when a.wait = '' then a.done when size(a.done) > 0 then {tail} else array(a.wait) end)"
    )
    return f"transform(array({chunks}), cs -> if(size(cs) <= 1, cs, {fold}))[0]"


def chunks(x: str, most: int = CHUNK_BYTES) -> str:
    """A text of at most ``most`` bytes as it is; else packed, merged, blanks dropped."""
    return f"if(octet_length({x}) <= {most}, array({x}), filter({merge_small(pack(paragraphs(x), most))}, c -> {trim('c')} <> ''))"


def cut(text: str, most: int = CHUNK_BYTES, least: int = MERGE_BYTES) -> list[str]:
    """``chunks`` in one linear pass over a text's paragraphs."""
    if len(text.encode()) <= most:
        return [text]
    packed: list[list[str]] = []
    sizes: list[int] = []
    for p in filter(None, (x.strip(BLANK) for x in text.split("\n\n"))):
        n = len(p.encode())
        if packed and sizes[-1] + n + 2 <= most:
            packed[-1].append(p)
            sizes[-1] += n + 2
        else:
            packed.append([p])
            sizes.append(n)
    if len(packed) <= 1:
        return ["\n\n".join(p) for p in packed]
    out: list[list[str]] = []
    wait: list[str] = []
    for p, n in zip(packed, sizes):
        if n < least:
            wait += p
        else:
            out.append(wait + p)
            wait = []
    if wait:
        if out:
            out[-1] += wait
        else:
            out.append(wait)
    return ["\n\n".join(p) for p in out]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CHUNK_BYTES, single_newlines: bool = True) -> DataFrame:
    """-> (id, chunk_idx, text, n_bytes).  ``single_newlines``: a line break parts paragraphs.

    On Arrow batches: where a chunk ends depends on the one before, and a fold in SQL copies its list
    at each step, which a very long text makes quadratic.  A null text has no chunks.
    """
    from ..shipping import map_arrow, parts_of

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts_of(whole, 1)):
            at, idx, out = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    cs = cut(text.replace("\n", "\n\n") if single_newlines else text, most)
                    at += [row] * len(cs)
                    idx += range(len(cs))
                    out += cs
            texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(idx, pa.int32()), texts], names=[id_col, "chunk_idx", "text"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    got = map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, chunk_idx int, text string")
    return got.withColumn("n_bytes", F.octet_length("text").cast("long"))


def parents_and_children(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parent: int = 512, child: int = 128) -> DataFrame:
    """-> (parent_id, id, text, content_hash): texts in parents of ``parent`` words, each in children of
    ``child``; the hash is that of the child's text."""
    slices = lambda w, n: f"transform(sequence(0, greatest(0, (size({w}) - 1) div {n})), i -> slice({w}, i * {n} + 1, {n}))"
    own = docs.selectExpr(f"{id_col} as d", f"{fields(text_col)} as w").where("size(w) > 0").selectExpr("d", f"posexplode({slices('w', parent)}) as (p, pw)")
    each = own.selectExpr("concat(d, ':', p) as parent_id", f"posexplode({slices('pw', child)}) as (c, cw)").selectExpr("parent_id", "concat(parent_id, ':', c) as id", "array_join(cw, ' ') as text")
    return each.withColumn("content_hash", F.sha2("text", 256))


def parts(text: str, most: int = 28_000) -> list[str]:
    """Cut a text into parts of at most ``most`` bytes, at a blank line or else a newline in a
    part's second half, or else between characters; the parts joined are the text."""
    data, out, at = text.encode(), [], 0
    while len(data) - at > most:
        cut = next((i for s in (b"\n\n", b"\n") if (i := data.rfind(s, at, at + most)) > at + most // 2), 0)
        if not cut:
            cut = at + most
            while cut > at + max(0, most - 3) and data[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(data[at:cut].decode())
        at = cut
    return [*out, data[at:].decode()] if at < len(data) or not out else out


def hard_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 28_000) -> DataFrame:
    """-> (id, part_idx, part): Arrow, since a cut depends on where the last one fell."""
    from ..shipping import map_arrow, parts_of

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts_of(whole, 1)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ps = parts(t or "", most)
                yield pa.RecordBatch.from_pydict({id_col: pa.array([i] * len(ps), pa.int64()), "part_idx": pa.array(range(len(ps)), pa.int32()), "part": ps})

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, f"{id_col} long, part_idx int, part string")
