"""Line dedup by winnowing over line hashes; DataFrame and SQL functions only.

A line is a newline- or sentence-terminated piece of text: real passages are pasted into the
middle of physical lines, and only so do their sentences stay comparable.  A run is a sequence of
consecutive lines of one document; it is repeated if an equal run of ``min_words`` words or more
stands earlier, in a document with a smaller id or further up in the same one.  Every line of a
repeated run is deleted; first occurrences stay.

1. Winnow: the window at a line is the shortest span from it with ``min_words`` words; each
   window's smallest line hash is selected (the first at a tie).  Windows depend on their content
   only, so equal runs of ``min_words`` words select a common fingerprint: that is guaranteed.
   Consecutive windows that select the same line are one posting (fingerprint, row, lo..hi).
2. Join positions: the postings of fingerprints selected twice or more go back to their documents,
   and their windows are joined with the first position that holds the same content.
3. Extend both ways: a match reaches one line further right if the shortest span of ``min_words``
   words that ends there has an earlier equal, and one further left if the shortest that starts
   there has.  Each step is a span of its own with its own first position, so a maximal repeated run
   is the union of its spans, and a line in a third of all documents costs one row per occurrence,
   never one per pair.
4. Delete the lines of each span whose content has an earlier occurrence.

Spans are equal if two hashes of every line are (96 bits); texts are not shipped to be compared.
Hot fingerprints and spans are counted before their shuffle; the joins back have a written table
on either side, so Spark can split a hot key's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, read

MIN_WORDS = 25
#: Cuts a text into lines; a text that holds the mark itself is cut by the slower, equal form.
MARK = "\ufdd0"
CUT = r"(?<=[.!?]\s|\n)(?=\S)"


def pieces(text: str) -> str:
    """SQL: a text cut into lines; joined, they are the text again."""
    t = f"coalesce({text}, '')"
    fast = rf"split(regexp_replace({t}, r'([.!?]\s|\n)(?=\S)', r'$1{MARK}'), '{MARK}')"
    return f"if(contains({t}, '{MARK}'), split({t}, r'{CUT}'), {fast})"


def _span(part: str, min_words: int) -> str:
    """SQL: how many leading elements of the array ``part`` reach ``min_words``; 0 if all don't."""
    most = min_words << 6
    return (
        f"aggregate({part}, 0L, (a, x) -> if(a >= {most}L, a, a + x * 64L + 1L), "
        f"a -> if(a >= {most}L, cast(a % 64 as int), 0))"
    )


def _short_span(min_words: int, most: int = 6) -> str:
    """SQL: the same for the elements of ``n`` from the i-th on, as plain sums; 0 beyond ``most``."""
    sums = (" + ".join(f"get(n, i + {k})" for k in range(-1, j)) for j in range(most))
    return "case " + " ".join(f"when {x} >= {min_words} then {j}" for j, x in enumerate(sums, 1)) + " else 0 end"


def _minimum() -> str:
    """SQL: in the window of ``w`` lines from the 0-based i on, the 1-based place of the smallest
    hash, the first at a tie; 0 for no window.  Most windows have three lines at most."""
    a, b, c, part = "get(h, i)", "get(h, i + 1)", "get(h, i + 2)", "slice(h, i + 1, w)"
    return (
        f"case w when 0 then 0 when 1 then 1 when 2 then if({a} <= {b}, 1, 2) "
        f"when 3 then if({a} <= {b}, if({a} <= {c}, 1, 3), if({b} <= {c}, 2, 3)) "
        f"else cast(array_position({part}, array_min({part})) as int) end"
    )


def signatures(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """-> (row, id, h, g, w, o): by line its two hashes, its window's length in lines (0: none) and the
    place in the window of the selected line.  A line's words are what single spaces part."""
    full = _span(f"slice(n, i + 1, {min_words})", min_words)
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
        .selectExpr("id", "xxhash64(id, t) as row", f"{pieces('t')} as p")
        .selectExpr("row", "id", r"transform(p, x -> trim(BOTH ' \n\r\t' FROM x)) as p")
        .selectExpr(
            "row", "id", "transform(p, x -> xxhash64(x)) as h", "transform(p, x -> hash(x)) as g",
            "transform(p, x -> least(1 + octet_length(x) - octet_length(replace(x, ' ', '')), 1000)) as n",
        )
        .selectExpr("*", f"transform(sequence(1, size(h)), i -> {_short_span(min_words)}) as s")
        .selectExpr("row", "id", "h", "g", f"transform(s, (x, i) -> if(x > 0, x, {full})) as w")
        .selectExpr("*", f"transform(w, (w, i) -> {_minimum()}) as o")
    )


def fingerprints(sig: DataFrame) -> DataFrame:
    """-> (row, f, lo, hi): each selected line's hash, with the first and last window that selects
    it.  What windows select never moves back, so a line's windows are neighbours."""
    changes = "filter(sequence(1, n), b -> b = 1 or p[b - 1] <> p[b - 2])"
    posting = "named_struct('f', h[p[b - 1] - 1], 'lo', b, 'hi', coalesce(get(lo, i + 1) - 1, n))"
    return (
        sig.selectExpr("row", "h", "transform(filter(o, x -> x > 0), (x, i) -> i + x) as p")
        .where("size(p) > 0").selectExpr("row", "h", "p", "size(p) as n")
        .selectExpr("row", "h", "p", "n", f"{changes} as lo")
        .selectExpr("row", f"inline(transform(lo, (b, i) -> {posting}))")
    )


def spans(sig: DataFrame, hits: DataFrame) -> DataFrame:
    """-> (m, k, id, row, b, e): the spans b..e of windows that select repeated fingerprints, and
    their extensions; (m, k) stands for the content.

    The window at b ends at b + w - 1.  It is the shortest span to the right of b; the shortest
    spans to the left of their ends start at b for the ends from there up to before the end of the
    next line's window.
    """
    starts = "flatten(transform(r, x -> sequence(x.lo, x.hi)))"
    stop = "if(b < size(h) and w[b] > 0, b + w[b] - 1, size(h))"
    ends = f"sequence(b + w[b - 1] - 1, greatest(b + w[b - 1] - 1, {stop}))"
    part = "slice({}, b, e - b + 1)".format
    row = f"named_struct('m', array_min({part('h')}), 'k', xxhash64({part('h')}, {part('g')}), 'b', b, 'e', e)"
    every = f"flatten(transform({starts}, b -> transform({ends}, e -> {row})))"
    return sig.join(hits, "row").selectExpr("id", "row", f"explode({every}) as s").select("s.m", "s.k", "id", "row", "s.b", "s.e")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """-> (row, cut): by document (row = xxhash64 of id and text) the 1-based lines to delete."""
    if not 1 <= min_words <= 63:
        raise ValueError("min_words must be in 1..63")
    sig = materialize(signatures(docs, id_col, text_col, min_words), "lines")
    fps = fingerprints(sig)
    often = materialize(fps.groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f"), "often")
    hits = fps.join(often, "f").groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    found = materialize(spans(sig, hits), "spans")
    first = materialize(
        found.groupBy("m", "k").agg(F.min(F.struct("id", "row", "b")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"),
        "first",
    )
    later = found.join(first, ["m", "k"]).where("struct(id, row, b) <> first")
    return later.groupBy("row").agg(F.collect_set(F.struct("b", "e")).alias("s")).selectExpr(
        "row", "array_distinct(flatten(transform(s, x -> sequence(x.b, x.e)))) as cut"
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines cut from the text, plus ``n_removed``.

    Every row is returned.  A null text stays null (none removed); a text whose
    lines are all repeated becomes empty.  Equal rows (same id and text) count as one document
    and stay equal; rows that share an id only are ordered by a hash of their text.  Null ids sort
    first.  Columns other than id and text pass through, save an n_removed (in any case) of their
    own, which is replaced.
    """
    base = docs.drop("n_removed")
    row, key, cut = (fresh(base, x) for x in ("row", "key", "cut"))
    gone = repeated_lines(docs, id_col, text_col, min_words).select(F.col("row").alias(row), F.col("cut").alias(cut))
    p = pieces(f"cast(`{text_col}` as string)")
    kept = f"transform(array({p}), p -> array_join(transform(array_except(sequence(1, size(p)), {cut}), i -> p[i - 1]), ''))[0]"
    out = (
        base.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
        .join(gone, F.col(key) == F.col(row), "left")
        .withColumn(text_col, F.expr(f"if({cut} is null, `{text_col}`, {kept})"))
        .withColumn("n_removed", F.expr(f"coalesce(size({cut}), 0)"))
    )
    return out.select(*base.columns, "n_removed")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)
