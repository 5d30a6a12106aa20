"""Benchmark decontamination over a positional inverted index; DataFrame and SQL functions only.

Index: one posting (term, document row, position) for each training token that is a benchmark
term, written to the shared folder, and one end-of-text posting per document that holds its word
count.  Items with the same words are one search.  For each window of a search the rarest term by
corpus frequency is its anchor; an anchor's postings, less its place in the item, are the alignments
(document, search, offset).  The offset-adjusted terms are intersected with the document's postings
there; 13 consecutive survivors (or the whole shorter item) are an exact phrase match.  Proximity
matches (op8's further columns) need most of a window's terms near each other, in any order: two of
its rarest terms must meet in a block of text, and the block's postings decide.

Postings are gathered in blocks of BLOCK words, so a very long text is many small rows; a block is looked
at only where an alignment, or two rare terms, fall into it.  Broadcast are only the benchmark's own terms, anchors and searches,
each counted (rows and bytes) first; larger ones are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, read, small, without

WINDOW = 13
#: Contaminated: at least one word in twenty is hit.
SHARE = 20
#: Words of a block; a posting's key is its term's number and its place in the block.
BLOCK, PLACES = 64, 128
#: So many of a window's rarest terms must meet before its other terms are looked for.
MEET = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str):
    """A text's words as an array; null has none."""
    cut = F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(cut, lambda w: w != "")


class PositionalIndex:
    """Postings of ``docs`` for the terms of ``items``.

    ``postings (tid, row, pos, id)``: ``row`` numbers the documents; ``tid`` -1 is the posting
    behind a document's last word, which alone carries ``id``.  ``items (irow, t)``: the different
    word sequences of items, as term numbers; ``names (irow, item_id)``: the items of each.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text"):
        spark = docs.sparkSession
        named = materialize(items.select(F.col(item_col).cast("string").alias("item_id"), words(item_text).alias("w")).where("size(w) > 0"), "items")
        own = materialize(named.select("w").distinct().withColumn("irow", F.monotonically_increasing_id()), "searches")
        self.names = materialize(named.join(own, "w").select("irow", "item_id").distinct(), "names")
        placed = own.select("irow", F.posexplode("w").alias("p", "term"))
        terms = materialize(placed.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
        by_place = placed.join(small(terms), "term").groupBy("irow").agg(F.array_sort(F.collect_list(F.struct("p", "tid"))).alias("t"))
        self.items = materialize(by_place.selectExpr("irow", "t.tid as t"), "item_terms")
        end = spark.sql("select '' as term, -1L as tid")
        texts = docs.select(F.col(id_col).alias("id"), words(text_col).alias("w")).withColumn("row", F.monotonically_increasing_id())
        tokens = texts.select("id", "row", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term"))
        lookup = small(materialize(terms.unionByName(end), "lookup"))
        self.postings = materialize(
            tokens.join(lookup, "term").select("tid", "row", "pos", F.when(F.col("tid") == -1, F.col("id")).alias("id")), "postings"
        )
        self.found = self.postings.where("tid >= 0").select("tid", "row", "pos")
        self.frequencies = materialize(self.found.groupBy("tid").agg(F.count("*").alias("cf")), "cf")

    def anchors(self, window: int = WINDOW) -> DataFrame:
        """-> (tid, irow, p): by search the places of its windows' rarest terms.  A window with a
        term that occurs nowhere has none."""
        placed = self.items.select("irow", F.posexplode("t").alias("p", "tid"))
        counted = (
            placed.join(small(self.frequencies), "tid", "left").groupBy("irow")
            .agg(F.array_sort(F.collect_list(F.struct("p", "tid", F.coalesce("cf", F.lit(0)).alias("cf")))).alias("a"))
            .selectExpr("irow", "a", "a.cf as c")
        )
        part = f"slice(c, s, {window})"
        places = (
            f"array_distinct(transform(filter(sequence(1, greatest(1, size(c) - {window - 1})), s -> array_min({part}) > 0), "
            f"s -> s - 1 + cast(array_position({part}, array_min({part})) as int)))"
        )
        return counted.selectExpr("irow", f"explode(transform({places}, i -> a[i - 1])) as x").select("x.tid", "irow", "x.p")

    def alignments(self, window: int = WINDOW) -> DataFrame:
        """-> (row, irow, shift): where a search's place 0 would stand in the document."""
        anchors = small(materialize(self.anchors(window), "anchors"))
        return self.found.join(anchors, "tid").selectExpr("row", "irow", "pos - p as shift").distinct()

    def lists(self, reach: int = 0) -> DataFrame:
        """-> (row, block, keys): the postings of each block and of the ``reach`` words behind it, a key
        being tid * PLACES + place in the block.  A document's postings stand together in the index, so
        a task gathers its blocks before they are shuffled."""
        blocks = f"pos div {BLOCK}" if not reach else f"explode(if(pos >= {BLOCK} and pos % {BLOCK} < {reach}, array(pos div {BLOCK}, pos div {BLOCK} - 1), array(pos div {BLOCK})))"
        dealt = self.found.selectExpr("tid", "row", "pos", f"{blocks} as block")
        return dealt.groupBy("row", "block").agg(F.collect_list(F.expr(f"tid * {PLACES} + pos - block * {BLOCK}")).alias("keys"))

    def matches(self, window: int = WINDOW) -> DataFrame:
        """Exact phrases -> (row, irow, hit array<bigint>): by alignment the document positions
        inside occurrences of the search's windows."""
        length = materialize(self.items.selectExpr("irow", "size(t) as words"), "lengths")
        touched = f"explode(sequence(greatest(0, shift) div {BLOCK}, greatest(0, shift + words - 1) div {BLOCK})) as block"
        at = materialize(self.alignments(window).join(small(length), "irow").selectExpr("row", "irow", "shift", touched), "alignments")
        need = (
            f"transform(filter(sequence(greatest(0, block * {BLOCK} - shift), least(size(t) - 1, block * {BLOCK} + {BLOCK - 1} - shift)), p -> shift + p >= 0), "
            f"p -> t[cast(p as int)] * {PLACES} + shift + p - block * {BLOCK})"
        )
        got = (
            at.join(self.lists(), ["row", "block"]).join(small(self.items), "irow")
            .selectExpr("row", "irow", "shift", "size(t) as words", f"transform(array_intersect({need}, keys), k -> k % {PLACES} + block * {BLOCK}) as g")
            .groupBy("row", "irow", "shift").agg(F.first("words").alias("words"), F.array_sort(F.flatten(F.collect_list("g"))).alias("g"))
        )
        whole = f"least({window}, words)"
        starts = f"filter(sequence(1, size(g)), i -> i + {whole} - 1 <= size(g) and g[i + {whole} - 2] - g[i - 1] = {whole} - 1)"
        return (
            got.where(f"size(g) >= {whole}")
            .selectExpr("row", "irow", f"array_distinct(flatten(transform({starts}, i -> sequence(g[i - 1], g[i - 1] + {whole} - 1)))) as hit")
            .where("size(hit) > 0")
        )

    def windows(self, share: float = 0.8) -> DataFrame:
        """-> (irow, win, words, ts, n, k): by search window its distinct terms, their number and
        how many of them make a match."""
        words = f"least({WINDOW}, size(t))"
        wins = self.items.selectExpr("irow", f"{words} as words", f"posexplode(transform(sequence(1, size(t) - {words} + 1), s -> array_distinct(slice(t, s, {words})))) as (win, ts)")
        return wins.selectExpr("irow", "win", "words", "ts", "size(ts) as n", f"cast(ceil({share!r}D * size(ts) - 1e-9D) as int) as k")

    def near_anchors(self, share: float = 0.8) -> DataFrame:
        """-> (irow, tid, need): of a window's n distinct terms k must be near, so of its n - k + m
        rarest ones m must be; m is MEET, or k if that is less.  ``need`` is the least m of the
        search's windows."""
        counted = self.windows(share).selectExpr("irow", "win", "n", "k", f"least(k, {MEET}) as m", "explode(ts) as tid").join(small(self.frequencies), "tid", "left")
        rarest = counted.groupBy("irow", "win", "n", "k", "m").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "tid"))).alias("a"))
        every = rarest.selectExpr("irow", "m", "explode(slice(a, 1, n - k + m)) as x").groupBy("irow", "x.tid").agg(F.min("m").alias("m"))
        need = rarest.groupBy("irow").agg(F.min("m").alias("need"))
        return every.select("irow", "tid").join(need, "irow")

    def proximity(self, span: int | None = None, share: float = 0.8) -> DataFrame:
        """Proximity matches -> (row, irow): documents where at least ``share`` of the distinct terms
        of one of a search's windows stand within ``span`` words (twice the window's own), in any
        order."""
        reach = (span or 2 * WINDOW) - 1
        if reach + BLOCK > PLACES:
            raise ValueError(f"span must be {PLACES - BLOCK + 1} words at most")
        anchors = small(materialize(self.near_anchors(share), "near_anchors"))
        blocks = f"sequence(greatest(0, pos - {reach}) div {BLOCK}, pos div {BLOCK})"
        at = (
            self.found.join(anchors, "tid").selectExpr("row", "irow", "need", "tid", f"explode({blocks}) as block").distinct()
            .groupBy("row", "irow", "block", "need").agg(F.count("*").alias("c")).where("c >= need")
        )
        at = materialize(at.select("row", "irow", "block"), "near_places")
        wins = materialize(self.windows(share).selectExpr("irow", f"{span or '2 * words'} as span", "k", "ts"), "near_windows")
        least = materialize(wins.groupBy("irow").agg(F.min("k").alias("least_k"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("every")), "near_items")
        got = f"array_intersect(array_distinct(transform(keys, x -> x div {PLACES})), every)"
        some = (
            at.join(self.lists(reach), ["row", "block"]).join(small(least), "irow")
            .selectExpr("row", "irow", "least_k", "keys", f"{got} as got").where("size(got) >= least_k")
        )
        own = f"array_sort(transform(filter(keys, x -> array_contains(ts, x div {PLACES})), x -> struct(x % {PLACES} as o, x div {PLACES} as t)))"
        there = f"exists(own, x -> x.o < {BLOCK} and size(array_distinct(transform(filter(own, y -> y.o >= x.o and y.o < x.o + span), y -> y.t))) >= k)"
        return (
            some.join(small(wins), "irow").where("size(array_intersect(got, ts)) >= k")
            .selectExpr("row", "irow", "span", "k", f"{own} as own").where(there).select("row", "irow").distinct()
        )

    def named(self, found: DataFrame, n: str, digest: str) -> DataFrame:
        """``found (row, irow)``, distinct -> (row, n, digest): the number of a document's items and
        the hash of their sorted ids.  Documents with the same searches share the work."""
        sets = materialize(found.groupBy("row").agg(F.array_sort(F.collect_list("irow")).alias("irows")), "found")
        ids = sets.select("irows").distinct().selectExpr("irows", "explode(irows) as irow").join(small(self.names), "irow")
        by_set = ids.groupBy("irows").agg(F.array_sort(F.collect_set("item_id")).alias("x")).selectExpr("irows", f"cast(size(x) as bigint) as {n}", f"sha2(array_join(x, ','), 256) as {digest}")
        return sets.join(by_set, "irows").select("row", n, digest)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, near: bool = False) -> DataFrame:
    """-> (id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``;
    with ``near`` also (n_near, near_sha256), the items that match by proximity.

    A null or wordless text has no words and no hit.  Items without words match nothing, and items
    without an id are counted nowhere but hit; of items with one id, any match counts once.  Rows that
    share an id are judged each on its own; empty tables give no rows, or no hits; other columns are
    not looked at.
    """
    index = PositionalIndex(docs, items, id_col, text_col)
    found = materialize(index.matches(window), "matches")
    hits = found.groupBy("row").agg(F.collect_list("hit").alias("hits")).selectExpr("row", "cast(size(array_distinct(flatten(hits))) as bigint) as n_hit")
    ends = index.postings.where("tid = -1").selectExpr("row", "id", "cast(pos as bigint) as n_words")
    empty = "sha2('', 256)"
    out = [
        "id",
        "n_words",
        "coalesce(n_hit, 0L) as n_hit",
        "coalesce(n_items, 0L) as n_items",
        f"coalesce(items_sha256, {empty}) as items_sha256",
        f"coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= n_words as contaminated",
    ]
    both = ends.join(hits, "row", "left").join(index.named(found.select("row", "irow").distinct(), "n_items", "items_sha256"), "row", "left")
    if near:
        both = both.join(index.named(index.proximity(), "n_near", "near_sha256"), "row", "left")
        out += ["coalesce(n_near, 0L) as n_near", f"coalesce(near_sha256, {empty}) as near_sha256"]
    return both.selectExpr(*out)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows.  Every row is judged by its own text, those without
    an id or with one id too; equal rows fare alike."""
    with_key, key = keyed(docs, id_col, text_col)
    bad = contamination(with_key, items, key, text_col).where("contaminated").select("id").distinct()
    return without(with_key, key, bad).drop(key)


def op8(spark, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), near=True)
    return out.withColumnRenamed("id", "doc_id")
