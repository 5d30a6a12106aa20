"""Registered queries over the driver's tables and their SQL twins (DuckDB dialect)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import assemble, cells, resume, search, split, stages, telemetry
from ..sinks import files as sinks
from ..sinks.collection import Collection
from ..scratch import new_folder
from ..sources import files, workspace
from ..streaming import calls as streamed
from ..streaming import progress as runs
from ..streaming import telemetry as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Derived inputs, in SQL that both engines read ------------------------------------------------
_FLAT = "replace(text, chr(10), ' ')"
RESULTS_SQL = f"""select source as doc_id, doc_id as index, lang as topic, {{a}}lang, concat('t', doc_id % 7){{z}} as topics, {{a}}concat('d', doc_id % 3){{z}} as domains,
  case when doc_id % 5 = 0 then '' else {_FLAT} end as summary, case when doc_id % 4 = 0 then '' else 'concept' end as type,
  {{a}}substr({_FLAT}, 1, 10), substr({_FLAT}, 11, 10){{z}} as key_points, case when doc_id % 3 = 0 then '' else concat('take ', doc_id) end as my_takeaway,
  cast(doc_id % 10 as double) / cast(10 as double) as confidence, case when doc_id % 8 = 1 then substr(text, 1, 300) else '' end as source_quote,
  case when doc_id % 6 = 1 then concat('first', chr(10), chr(10), 'then ', lang) else '  ' end as applicability, case when doc_id % 6 = 2 then concat('within ', source) else '' end as context,
  case when doc_id % 4 = 1 then {{a}}concat(' step ', doc_id), ' ', 'next'{{z}} else {{a}}{{z}} end as steps, text as content from {{docs}}"""
CALLS_SQL = """select event_id as seq, concat('s', user_id % 20) as source, event_type as stage, cast(event_id % 8 as int) as chunk_index,
  case event_id % 4 when 0 then 'm-large' when 1 then 'm-small:free' when 2 then 'm-mid-20250514' else 'other' end as model,
  cast(floor(abs(value) * 100) as bigint) as prompt_tokens, cast(floor(abs(value) * 37) as bigint) as completion_tokens,
  cast(floor(abs(value) * 400) as bigint) as prompt_chars, cast(floor(abs(value) * 150) as bigint) as completion_chars,
  cast(floor(abs(value) * 5) as bigint) as latency_ms, event_type <> 'error' as success, cast(ts as timestamp) as timestamp from {events}"""
PRICES_SQL = "select * from (values ('M-Large', cast(3 as double), cast(15 as double)), ('m-small', cast(0.5 as double), cast(1.5 as double)), ('m-mid', cast(1 as double), cast(4 as double))) as p(model, input_price, output_price)"
_R = "with r as (" + RESULTS_SQL.format(a="[", z="]", docs="documents") + ") "
_C = (
    "with c0 as (" + CALLS_SQL.format(events="events") + "), p as (" + PRICES_SQL + "), c as (select c0.*, cast(prompt_tokens as double) / 1e6 * coalesce(p1.input_price, p2.input_price, p3.input_price, 0) + "
    "cast(completion_tokens as double) / 1e6 * coalesce(p1.output_price, p2.output_price, p3.output_price, 0) as cost from c0 left join p p1 on lower(p1.model) = c0.model "
    "left join p p2 on lower(p2.model) = case when regexp_matches(c0.model, '-20[0-9]{6}$') then regexp_replace(c0.model, '-20[0-9]{6}$', '') end "
    "left join p p3 on lower(p3.model) = case when contains(c0.model, ':') then regexp_replace(c0.model, ':[^:]*$', '') end) "
)
#: White space as RE2 reads it, twice braced where a pattern is formatted.
_SP = text.SPACE
_SP2 = _SP.replace("{", "{{").replace("}", "}}")
_TRIM = f"regexp_replace({{}}, '^{_SP2}+|{_SP2}+$', '', 'g')"


def results(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RESULTS_SQL.format(a="array(", z=")", docs="{docs}"), docs=table(spark, d, "documents"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.sql(CALLS_SQL, events=table(spark, d, "events"))
    return telemetry.priced(raw, spark.sql(PRICES_SQL))


# Chunking and text ----------------------------------------------------------------------------
_PACKED = f"""with t as (select doc_id, lang, replace(text, chr(10), chr(10) || chr(10)) as t from documents),
p as (select doc_id, lang, t, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as ps from t),
g as (select doc_id, lang, t, list_reduce(ps, lambda a, x: {{'done': case when a.cur <> '' and strlen(a.cur) + strlen(x.cur) + 2 > 1500 then list_append(a.done, a.cur) else a.done end,
  'cur': case when a.cur = '' or strlen(a.cur) + strlen(x.cur) + 2 > 1500 then x.cur else a.cur || chr(10) || chr(10) || x.cur end}}) as a
  from (select doc_id, lang, t, list_transform(list_prepend('', ps), lambda x: {{'done': []::varchar[], 'cur': x}}) as ps from p)),
c as (select doc_id, lang, t, case when a.cur = '' then a.done else list_append(a.done, a.cur) end as cs from g),
m as (select doc_id, lang, t, cs, list_reduce(list_prepend({{'done': []::varchar[], 'wait': ''}}, list_transform(cs, lambda x: {{'done': []::varchar[], 'wait': x}})), lambda a, x:
  case when strlen(x.wait) < 500 then {{'done': a.done, 'wait': case when a.wait = '' then x.wait else a.wait || chr(10) || chr(10) || x.wait end}}
  else {{'done': list_append(a.done, case when a.wait = '' then x.wait else a.wait || chr(10) || chr(10) || x.wait end), 'wait': ''}} end) as a from c),
f as (select doc_id, lang, case when strlen(t) <= 1500 then [t] when len(cs) <= 1 then cs when a.wait = '' then a.done
  when len(a.done) > 0 then list_append(a.done[1:len(a.done) - 1], a.done[len(a.done)] || chr(10) || chr(10) || a.wait) else [a.wait] end as cs from m),
k as (select doc_id, lang, unnest(cs) as text, generate_subscripts(cs, 1) - 1 as chunk_idx from f) """


def _first_bytes(x: str, n: int) -> str:
    """DuckDB: the longest beginning of at most n bytes."""
    return f"case when strlen({x}) <= {n} then {x} else left({x}, list_max(list_filter(range({n} // 4, {n} + 1), lambda i: strlen(left({x}, i)) <= {n}))) end"


@query("chunk_documents", _PACKED + "select doc_id, cast(chunk_idx as integer) as chunk_idx, text, cast(strlen(text) as bigint) as n_bytes from k")
def chunk_documents(spark, d):
    return split.chunk_documents(table(spark, d, "documents"))


@query("chunk_size_stats", _PACKED + "select lang, count(*) as n_chunks, cast(sum(strlen(text)) as bigint) as n_bytes, cast(max(strlen(text)) as bigint) as max_bytes from k group by lang")
def chunk_size_stats(spark, d):
    docs = table(spark, d, "documents")
    got = split.chunk_documents(docs.select(F.struct("doc_id", "lang").alias("k"), "text"), "k")
    return got.groupBy(F.col("k.lang").alias("lang")).agg(F.count("*").alias("n_chunks"), F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("max_bytes"))


#: DuckDB: ``split.parts`` as a recursion over what is left of each text.
_PARTS = """with recursive f(doc_id, part_idx, part, rest) as (select doc_id, cast(-1 as integer), '', coalesce(text, '') from documents union all
  select doc_id, part_idx + 1, case when c is null then rest else left(rest, c) end, case when c is null then null else substr(rest, c + 1) end from
  (select *, case when p is null then null when strlen(left(p, nn)) > 1400 then nn when strlen(left(p, n1)) > 1400 then n1 else length(p) end as c from
  (select *, case when contains(p, repeat(chr(10), 2)) then length(p) - strpos(reverse(p), repeat(chr(10), 2)) - 1 else 0 end as nn, case when contains(p, chr(10)) then length(p) - strpos(reverse(p), chr(10)) else 0 end as n1 from
  (select doc_id, part_idx, rest, case when strlen(rest) > 2800 then left(rest, list_max(list_filter(range(700, 2801), lambda i: strlen(left(rest, i)) <= 2800))) end as p from f where rest is not null)))),
parts as (select doc_id, part_idx, part from f where part_idx >= 0)"""


@query("hard_parts", _PARTS + " select * from parts")
def hard_parts(spark, d):
    return split.hard_parts(table(spark, d, "documents"), most=2800)


def _html_sql() -> str:
    x = "html"
    for tag, new in text.BREAK_TAGS:
        x = f"replace({x}, '{tag}', {' || '.join(['chr(10)'] * (len(new) // 2))})"
    x = f"replace(regexp_replace({x}, '<[^>]*(>|$)', '', 'g'), '>', '')"
    for name, char in text.ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return f"select page_id, array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_TRIM.format('l')}), lambda l: l <> ''), chr(10)) as text from pages"


@query("html_to_text", _html_sql())
def html_to_text(spark, d):
    return files.read_pages(table(spark, d, "pages"))


_WORDS = f"list_filter(regexp_split_to_array(text, '{_SP}+'), lambda w: w <> '')"


@query(
    "repetition_flags",
    f"""with w as (select doc_id, list_transform({_WORDS}, lambda x: lower(x)) as w from documents), u as (select doc_id, len(w) as n, unnest(w) as x, generate_subscripts(w, 1) as i from w),
    b as (select *, case when x = lag(x) over (partition by doc_id order by i) then 0 else 1 end as new from u), s as (select *, sum(new) over (partition by doc_id order by i) as g from b),
    r as (select doc_id, max(c) as longest from (select doc_id, g, count(*) as c from s group by all) group by doc_id),
    t as (select doc_id, max(c) as most from (select doc_id, g, count(*) as c from (select doc_id, concat_ws(' ', x, lead(x) over o, lead(x, 2) over o) as g, lead(x, 2) over o as z from u window o as (partition by doc_id order by i)) where z is not null group by all) group by doc_id)
    select w.doc_id, cast(coalesce(longest, 0) as integer) as longest_run, cast(coalesce(most, 0) as bigint) as most_trigram, len(w.w) >= 10 and (coalesce(longest, 0) > 10 or coalesce(most, 0) > 5) as repetitive from w left join r using (doc_id) left join t using (doc_id)""",
)
def repetition_flags(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{text.fields('text')} as w")
    each = docs.selectExpr("doc_id", "size(w) as n", f"{text.longest_run('w')} as longest_run", f"{text.most_trigram('w')} as most_trigram")
    return each.selectExpr("doc_id", "longest_run", "most_trigram", "n >= 10 and (longest_run > 10 or most_trigram > 5) as repetitive")


@query(
    "ocr_gate",
    """with x as (select doc_id, text from documents union all select 100000000 + doc_id, substr(replace(text, ' ', ''), 1, 150) from documents),
    c as (select doc_id, text, regexp_extract_all(text, '\\p{L}') as l, string_split(text, '') as c from x)
    select doc_id, strlen(text) < 100 or len(l) = 0 or len(list_distinct(l)) / cast(len(l) as double) < 0.05
      or len(list_filter(range(2, len(c) + 1), lambda i: c[i] = c[i - 1])) / cast(len(c) as double) > 0.3 as needs_ocr from c""",
)
def ocr_gate(spark, d):
    docs = table(spark, d, "documents")
    both = docs.select("doc_id", "text").unionByName(docs.selectExpr("100000000 + doc_id as doc_id", "substr(replace(text, ' ', ''), 1, 150) as text"))
    return both.selectExpr("doc_id", f"{text.needs_ocr('text')} as needs_ocr")


_PAGE = "case when doc_id % 3 = 0 then replace(text, ' ', chr(10)) when doc_id % 3 = 1 then replace(text, ' ', concat(' ', doc_id % 9, chr(10))) else text end"


@query(
    "toc_boilerplate_pages",
    f"""with p as (select doc_id, {_PAGE} as t from documents), l as (select doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda l: {_TRIM.format('l')}), lambda l: l <> '') as ls from p)
    select doc_id, len(string_split(t, chr(10))) >= 5 and len(ls) > 0 and
      (case when len(list_filter(ls, lambda l: regexp_matches(l, '(?i)(глава|chapter|раздел|section|часть|part|unit|module)\\s+\\d+') and regexp_matches(l, '[.]{{3,}}\\s*\\d+\\s*$'))) / cast(len(ls) as double) > 0.2 then 1 else 0 end
      + case when len(list_filter(ls, lambda l: regexp_matches(l, '\\s\\d{{1,4}}\\s*$'))) / cast(len(ls) as double) > 0.4 then 1 else 0 end
      + case when list_sum(list_transform(ls, lambda l: strlen(l))) // len(ls) < 40 then 1 else 0 end) >= 2 as is_toc,
      strlen({_TRIM.format('t')}) < 50 or regexp_matches({_TRIM.format('t')}, '^[0-9]+$') as is_boilerplate from l""",
)
def toc_boilerplate_pages(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{_PAGE} as t").selectExpr(
        "doc_id", f"{text.is_toc_page('t')} as is_toc", f"{text.is_boilerplate_page('t')} as is_boilerplate"
    )


_BOOK = "case when doc_id % 5 = 0 then concat(doc_id, chr(10), ' ', doc_id) when doc_id % 5 = 1 then repeat('7', 60) when doc_id % 5 = 2 then replace(text, ' ', concat(' .... ', doc_id % 7, chr(10), 'Chapter 1 ')) else concat(text, repeat(concat(chr(10), substr(text, 1, 5), ' ', doc_id % 99), cast(doc_id % 30 as int))) end"


@query(
    "pdf_text",
    f"""with p as (select doc_id // 10 as doc, doc_id as page, {_BOOK} as t from documents),
    l as (select doc, page, t, list_filter(list_transform(string_split(t, chr(10)), lambda l: {_TRIM.format('l')}), lambda l: l <> '') as ls from p),
    k as (select doc, page, t from l where not (strlen({_TRIM.format('t')}) < 50 or regexp_matches({_TRIM.format('t')}, '^[0-9]+$')) and not (len(string_split(t, chr(10))) >= 5 and len(ls) > 0 and
      (case when len(list_filter(ls, lambda l: regexp_matches(l, '(?i)(глава|chapter|раздел|section|часть|part|unit|module)\\s+\\d+') and regexp_matches(l, '[.]{{3,}}\\s*\\d+\\s*$'))) / cast(len(ls) as double) > 0.2 then 1 else 0 end
      + case when len(list_filter(ls, lambda l: regexp_matches(l, '\\s\\d{{1,4}}\\s*$'))) / cast(len(ls) as double) > 0.4 then 1 else 0 end
      + case when list_sum(list_transform(ls, lambda l: strlen(l))) // len(ls) < 40 then 1 else 0 end) >= 2))
    select doc, string_agg(t, chr(10) || chr(10) order by page) as text from k group by doc""",
)
def pdf_text(spark, d):
    return files.pdf_pages_to_text(table(spark, d, "documents").selectExpr("doc_id div 10 as doc", "cast(doc_id as bigint) as page", f"{_BOOK} as text"))


@query("word_counts", "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> '')) as integer) as n_words, cast(strlen(text) as integer) as n_bytes from documents")
def word_counts(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{text.word_count('text')} as n_words", "octet_length(text) as n_bytes")


_RAW = "concat(case when doc_id % 4 = 0 then '  ' else '' end, case when doc_id % 7 = 0 then '' else concat('---', chr(10), 'author: \"', source, '\"', chr(10), 'no colon here', chr(10), 'author : ', source, doc_id % 3, chr(10), 'lang:', lang, chr(10), case when doc_id % 2 = 0 then concat('language: ', 'x:', lang, chr(10)) else '' end, '---', chr(10), chr(10)) end, text)"
_FM = "regexp_extract(raw, '(?s)^---\\n(.*?)\\n---', 1)"
_FV = "nullif(regexp_extract_all({}, '(?m)^[ \\t]*{}[ \\t]*:(.*)$', 1)[-1], '')"


@query(
    "frontmatter_roundtrip",
    f"""with r as (select doc_id, {_RAW} as raw from documents), m as (select doc_id, raw, {_FM} as m from r),
    v as (select doc_id, raw, {_TRIM.format(_FV.format("m", "author"))} as a, {_TRIM.format(_FV.format("m", "language"))} as g, {_TRIM.format(_FV.format("m", "lang"))} as l from m)
    select doc_id, regexp_replace(regexp_replace(a, '^["\\x27]', ''), '["\\x27]$', '') as author, coalesce(g, l) as language,
    regexp_replace(regexp_replace(raw, '^[ \t\n\x0B\f\r]+(---)', '\\1'), '(?s)^---.*?---[\n\r]*', '') as body from v""",
)
def frontmatter_roundtrip(spark, d):
    md = table(spark, d, "documents").selectExpr("doc_id", f"{_RAW} as raw")
    return md.selectExpr("doc_id", f"{text.frontmatter('raw')} as m", f"{text.strip_frontmatter('raw')} as body").selectExpr(
        "doc_id", "m['author'] as author", "coalesce(try_element_at(m, 'language'), m['lang']) as language", "body"
    )


_PATH = "concat('dir/doc', doc_id, case doc_id % 9 when 0 then '.md' when 1 then '.MD' when 2 then '.pdf' when 3 then '.epub' when 4 then '.fb2' when 5 then '.mp3' when 6 then '.MP4' when 7 then '.zip' else '.txt' end)"


@query(
    "source_dispatch",
    f"""with p as (select {_PATH} as path from documents union all select url from pages), k as (select path, case when starts_with(path, 'http://') or starts_with(path, 'https://') then 'url'
    when regexp_matches(lower(path), '[.](mp3|wav|flac|ogg|m4a|aac)$') then 'audio' when regexp_matches(lower(path), '[.](mp4|mkv|avi|mov|webm|flv)$') then 'video' when lower(path) like '%.pdf' then 'pdf' when lower(path) like '%.epub' then 'epub'
    when lower(path) like '%.fb2' or lower(path) like '%.zip' then 'fb2' when path like '%.md' or path like '%.markdown' then 'markdown' end as kind from p)
    select path, kind, case when kind in ('url', 'audio', 'video') then 'transcript' when kind in ('pdf', 'epub', 'fb2') then 'book' when kind = 'markdown' then 'clean' end as content_type from k""",
)
def source_dispatch(spark, d):
    paths = table(spark, d, "documents").selectExpr(f"{_PATH} as path").union(table(spark, d, "pages").select("url"))
    return paths.selectExpr("path", f"{files.kind('path')} as kind").selectExpr("path", "kind", f"{files.content_type('kind')} as content_type")


_WC = "len(list_filter(regexp_split_to_array({}, '[ \\n\\t]+'), lambda w: w <> ''))"


@query(
    "content_or_description",
    f"""with x as (select a.doc_id, case when a.doc_id % 7 = 0 then '' else a.text end as c, case when a.doc_id % 6 = 0 then '' else coalesce(b.text, '') end as de from documents a left join documents b on b.doc_id = a.doc_id + 1)
    select doc_id, case when c = '' then de when de = '' then c when {_WC.format('c')} < {_WC.format('de')} * 30 // 100 then de else c end as picked from x""",
)
def content_or_description(spark, d):
    """Each text against the next document's."""
    docs = table(spark, d, "documents")
    both = docs.select("doc_id", "text").join(docs.selectExpr("doc_id - 1 as doc_id", "text as other"), "doc_id", "left")
    x = both.selectExpr("doc_id", "if(doc_id % 7 = 0, '', text) as c", "if(doc_id % 6 = 0, '', coalesce(other, '')) as de")
    return x.selectExpr("doc_id", f"{files.pick_content('c', 'de')} as picked")


# Parsers --------------------------------------------------------------------------------------
_REPLY = (
    f"concat('type: ', case when doc_id % 4 = 0 then '<type>' when doc_id % 9 = 0 then '' else 'fact' end, chr(10), 'topic: ', lang, ', ', source, ',, x', chr(10), 'Summary: ', "
    f"case when doc_id % 5 = 0 then '<summary>' else substr({_FLAT}, 1, 60) end, chr(10), 'confidence: 0.', doc_id % 10, chr(10), 'topic: ', lang, ', ', source)"
)


@query(
    "kv_parse",
    f"""with r as (select doc_id, {_REPLY} as r from documents), f as (select doc_id, {_TRIM.format("regexp_extract_all(r, '(?im)^[ \\t]*type:(.*)$', 1)[-1]")} as type, {_TRIM.format("regexp_extract_all(r, '(?im)^[ \\t]*topic:(.*)$', 1)[-1]")} as topic,
    {_TRIM.format("regexp_extract_all(r, '(?im)^[ \\t]*summary:(.*)$', 1)[-1]")} as summary from r)
    select doc_id, type, array_to_string(list_filter(list_transform(string_split(topic, ','), lambda t: trim(t)), lambda t: t <> ''), '|') as topics, summary,
    type <> '' and not regexp_matches(type, '<\\w+>') and (case when regexp_matches(type, '<\\w+>') then 1 else 0 end + case when regexp_matches(summary, '<\\w+>') then 1 else 0 end) < 2 as valid from f""",
)
def kv_parse(spark, d):
    m = table(spark, d, "documents").selectExpr("doc_id", f"{_REPLY} as r").selectExpr("doc_id", f"{parse.key_values('r')} as m")
    return m.selectExpr("doc_id", "m['type'] as type", f"array_join({text.comma_list("m['topic']")}, '|') as topics", "m['summary'] as summary", f"{parse.valid_result('m')} as valid")


_LONG = "concat('type: fact', chr(10), 'summary: ', text, chr(10), chr(10), 'ignored', chr(10), ' my_takeaway: a', chr(10), 'b', chr(10), 'topic: x', chr(10), 'not joined', chr(10), 'source_quote:', chr(10), 'lost', chr(10), 'Applicability: y', chr(10), 'z')"
_KEY = "regexp_extract(lower({}), '^(type|title|topic|summary|key_points|source_quote|my_takeaway|confidence|applicability):', 1)"
_LONG_SQL = f"""with l as (select doc_id, unnest(string_split({_LONG}, chr(10))) as l, generate_subscripts(string_split({_LONG}, chr(10)), 1) as i from documents),
t as (select doc_id, i, {_TRIM.format('l')} as t from l), k as (select *, {_KEY.format('t')} as k from t),
g as (select *, sum(case when k <> '' or t = '' then 1 else 0 end) over (partition by doc_id order by i) as g from k),
h as (select doc_id, g, first_value(k) over w as k, first_value({_TRIM.format("substr(t, instr(t, ':') + 1)")}) over w as v, i, t, row_number() over w as n from g window w as (partition by doc_id, g order by i)),
v as (select doc_id, k, g, any_value(v) as v, string_agg(case when n > 1 then concat(' ', t) else '' end, '' order by i) as rest from h where k <> '' group by all),
m as (select doc_id, k, arg_max(case when v <> '' and k in ('summary', 'source_quote', 'my_takeaway', 'applicability') then v || rest else v end, g) as v from v group by all) """


@query(
    "kv_parse_multiline",
    _LONG_SQL + "select doc_id, " + ", ".join(f"max(case when k = '{k}' then v end) as {k}" for k in ("type", "summary", "my_takeaway", "topic", "source_quote", "applicability")) + " from m group by doc_id",
)
def kv_parse_multiline(spark, d):
    r = table(spark, d, "documents").selectExpr("doc_id", f"{_LONG} as r").selectExpr("doc_id", f"{parse.key_values('r')} as m")
    return r.selectExpr("doc_id", *[f"m['{k}'] as {k}" for k in ("type", "summary", "my_takeaway", "topic", "source_quote", "applicability")])


_TURN = "concat('> ', role, ': turn=', turn, ', k=v, =w', chr(10), text, case when turn % 3 = 2 then '' else concat(chr(10), '<', chr(10), 'between') end)"


@query(
    "typed_blocks",
    f"""with r as (select conv_id, string_agg({_TURN}, chr(10) order by turn) as r from conversations group by conv_id),
    l as (select conv_id, unnest(string_split(r, chr(10))) as l, generate_subscripts(string_split(r, chr(10)), 1) as i from r),
    s as (select *, regexp_matches(trim(l), '^> \\S') as s, trim(l) = '<' as e from l),
    b as (select *, sum(case when s then 1 else 0 end) over (partition by conv_id order by i) as b from s),
    c as (select *, sum(case when e then 1 else 0 end) over (partition by conv_id, b order by i) as closed from b where b > 0),
    g as (select conv_id, b, max(case when s then substr(trim(l), 3) end) as h, {_TRIM.format("coalesce(string_agg(case when not s and closed = 0 then l end, chr(10) order by i), '')")} as content from c group by all)
    select conv_id, cast(b - 1 as integer) as idx, trim(string_split(h, ': ')[1]) as type, nullif(regexp_extract(h, 'turn=([0-9]+)', 1), '') as turn, content from g""",
)
def typed_blocks(spark, d):
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_TURN} as b")
    reply = turns.groupBy("conv_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(turn, b))), x -> x.b), '\\n')").alias("r"))
    return reply.selectExpr("conv_id", f"posexplode({parse.typed_blocks('r')}) as (idx, b)").selectExpr("conv_id", "idx", "b.type", "b.params['turn'] as turn", "b.content")


_MD = "concat('before', chr(10), string_agg(concat('## chunk_', turn, chr(10), 'type: x', chr(10), case when turn % 2 = 0 then concat('topic: ', role, chr(10)) else '' end, 'summary: s', turn, chr(10), 'key_points:', chr(10), '- a', turn, chr(10), 'confidence: low', chr(10), '- b', chr(10), case when turn % 3 = 0 then chr(10) else '' end, '- c', chr(10), case when turn % 4 = 3 then '' else text end), chr(10) order by turn))"


@query(
    "chunk_markdown_parse",
    f"""with r as (select conv_id, {_MD} as r from conversations group by conv_id), l as (select conv_id, unnest(string_split(r, chr(10))) as l, generate_subscripts(string_split(r, chr(10)), 1) as i from r),
    c as (select *, sum(case when starts_with(l, '## chunk_') then 1 else 0 end) over (partition by conv_id order by i) as c from l),
    k as (select *, last_value(case when starts_with(l, 'key_points:') then 1 when l = '' or starts_with(l, 'topic: ') or starts_with(l, 'summary: ') or starts_with(l, '## chunk_') then 0 end ignore nulls) over (partition by conv_id, c order by i) as kp from c where c > 0),
    f as (select conv_id, c, i, l, starts_with(l, '- ') and lag(kp, 1, 0) over (partition by conv_id, c order by i) = 1 as point, l = '' and lag(kp, 1, 0) over (partition by conv_id, c order by i) = 1 as closing,
      regexp_matches(l, '^(## chunk_|topic: |summary: |key_points:|type: |source_quote: |my_takeaway: |confidence: |applicability: |steps:|context: )') as known from k),
    b as (select conv_id, c, coalesce(max(case when starts_with(l, 'topic: ') then substr(l, 8) end), '') as topic, coalesce(max(case when starts_with(l, 'summary: ') then substr(l, 10) end), '') as summary, coalesce(string_agg(case when point then substr(l, 3) end, '|' order by i), '') as key_points,
      ltrim(coalesce(string_agg(case when not known and not point and not closing then l end, chr(10) order by i), ''), chr(10)) as content from f group by all)
    select conv_id, cast(row_number() over (partition by conv_id order by c) - 1 as integer) as idx, topic, summary, key_points, content from b where content <> ''""",
)
def chunk_markdown_parse(spark, d):
    c = table(spark, d, "conversations")
    md = c.groupBy("conv_id").agg(F.expr(_MD.replace("string_agg(concat('## chunk_'", "array_join(transform(array_sort(collect_list(struct(turn, concat('## chunk_'").replace("text end), chr(10) order by turn)", "text end)))), x -> x.col2), chr(10))")).alias("r"))
    return md.selectExpr("conv_id", f"posexplode({parse.markdown_chunks('r')}) as (idx, c)").selectExpr("conv_id", "idx", "c.topic", "c.summary", "array_join(c.key_points, '|') as key_points", "c.content")


@query(
    "query_variants",
    """with l as (select conv_id, string_agg(concat(turn + 1, case when turn % 2 = 0 then '. ' else ' - ' end, replace(text, chr(10), ' ')), chr(10) order by turn) as t from conversations group by conv_id),
    v as (select conv_id, list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: case when length(x) > 2 then regexp_replace(x, '^[0-9][^.]{0,3}[.][ \\t\\n\\x0B\\f\\r]*', '') else x end), lambda x: x <> '') as v from l)
    select conv_id, cast(len(v) as integer) as n, array_to_string(v, '|') as variants from v""",
)
def query_variants(spark, d):
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", "concat(turn + 1, if(turn % 2 = 0, '. ', ' - '), replace(text, '\\n', ' ')) as l")
    t = c.groupBy("conv_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(turn, l))), x -> x.l), '\\n')").alias("t"))
    return t.selectExpr("conv_id", f"{parse.variants('t')} as v").selectExpr("conv_id", "size(v) as n", "array_join(v, '|') as variants")


_THESIS = f"concat('core_thesis: old', chr(10), case when doc_id % 3 = 0 then '' else concat('Core_Thesis: ', substr({_FLAT}, 1, 50), chr(10)) end, 'noise', chr(10), ' domains: ', lang, chr(10), 'Domains: ', source, ', ,x')"


@query(
    "holistic_parse",
    f"""with r as (select doc_id, {_THESIS} as r from documents), l as (select doc_id, unnest(string_split(r, chr(10))) as l, generate_subscripts(string_split(r, chr(10)), 1) as i from r), t as (select doc_id, i, {_TRIM.format('l')} as t from l),
    d as (select doc_id, i, unnest(string_split(substr(t, 9), ',')) as x, generate_subscripts(string_split(substr(t, 9), ','), 1) as j from t where starts_with(lower(t), 'domains:'))
    select doc_id, thesis, domains from (select doc_id, {_TRIM.format("arg_max(substr(t, 13), i)")} as thesis from t where starts_with(lower(t), 'core_thesis:') group by doc_id)
    join (select doc_id, string_agg({_TRIM.format('x')}, '|' order by i, j) as domains from d where {_TRIM.format('x')} <> '' group by doc_id) using (doc_id)""",
)
def holistic_parse(spark, d):
    r = table(spark, d, "documents").selectExpr("doc_id", f"{_THESIS} as r").selectExpr("doc_id", f"{text.holistic('r')} as h")
    return r.selectExpr("doc_id", "h.core_thesis as thesis", "array_join(h.domains, '|') as domains")


_CAUSES = f"concat('- cause: ', lang, chr(10), 'mechanism: m', chr(10), 'effect: ', source, chr(10), 'relation: leads_to', chr(10), case when doc_id % 2 = 0 then concat('- cause: b', chr(10), 'effect: c', chr(10)) else '' end, 'preconditions:', chr(10), '- ', substr({_FLAT}, 1, 20), chr(10), '  - second', chr(10), 'counterfactuals:', chr(10), '- none')"


@query(
    "causal_parse",
    f"""with l as (select doc_id, unnest(string_split({_CAUSES}, chr(10))) as l, generate_subscripts(string_split({_CAUSES}, chr(10)), 1) as i from documents), t as (select doc_id, i, {_TRIM.format('l')} as t from l),
    s as (select *, lower(t) as w, sum(case when starts_with(lower(t), '- cause:') then 1 else 0 end) over (partition by doc_id order by i) as c, last_value(case when lower(t) in ('preconditions:', 'counterfactuals:') then lower(t) end ignore nulls) over (partition by doc_id order by i) as sec from t),
    f as (select doc_id, c, max(case when starts_with(w, '- cause:') then {_TRIM.format('substr(t, 9)')} end) as ca, coalesce(max(case when starts_with(w, 'mechanism:') then {_TRIM.format('substr(t, 11)')} end), '') as me, coalesce(max(case when starts_with(w, 'effect:') then {_TRIM.format('substr(t, 8)')} end), '') as ef,
      coalesce(max(case when starts_with(w, 'relation:') then {_TRIM.format('substr(t, 10)')} end), '') as re from s where sec is null and c > 0 group by all),
    x as (select doc_id, string_agg(concat('- **', ca, '** → ', case when me = '' then '' else concat(me, ' → ') end, '**', ef, '** *(', re, ')*', chr(10)), '' order by c) as chains from f group by doc_id),
    b as (select doc_id, string_agg(case when sec = 'preconditions:' then {_TRIM.format('substr(t, 3)')} end, '|' order by i) as p, string_agg(case when sec = 'counterfactuals:' then {_TRIM.format('substr(t, 3)')} end, '|' order by i) as q from s where starts_with(w, '- ') and not starts_with(w, '- cause:') group by doc_id)
    select doc_id, chains, p as preconditions, q as counterfactuals from x join b using (doc_id)""",
)
def causal_parse(spark, d):
    r = table(spark, d, "documents").selectExpr("doc_id", f"{_CAUSES} as r")
    return r.selectExpr("doc_id", f"{parse.causal('r')} as c").selectExpr("doc_id", f"{parse.render_causal('c.chains')} as chains", "array_join(c.preconditions, '|') as preconditions", "array_join(c.counterfactuals, '|') as counterfactuals")


# Aggregation and assembly ---------------------------------------------------------------------
@query("topic_union", _R + "select doc_id, string_agg(t, '|' order by t) as topics from (select distinct doc_id, unnest(list_concat(case when topic <> '' then [topic] else [] end, topics, domains)) as t from r) group by doc_id")
def topic_union(spark, d):
    return assemble.topic_union(results(spark, d))


@query("takeaways", _R + "select doc_id, coalesce(string_agg(my_takeaway, '|' order by index) filter (where my_takeaway <> ''), '') as takeaways from r group by doc_id")
def takeaways(spark, d):
    return assemble.takeaways(results(spark, d))


@query("doc_summary", _R + ", t as (select doc_id, topic, min(index) as i from r where topic <> '' group by all), n as (select *, row_number() over (partition by doc_id order by i) as n from t) select doc_id, 'Document covering: ' || string_agg(topic, ', ' order by i) as summary from n where n <= 5 group by doc_id")
def doc_summary(spark, d):
    return assemble.doc_summary(results(spark, d))


@query("holistic_input", _R + "select doc_id, coalesce(string_agg(summary, chr(10) || chr(10) order by index) filter (where summary <> ''), '') as text from r group by doc_id")
def holistic_input(spark, d):
    return assemble.holistic_input(results(spark, d))


@query("causal_input", _R + "select doc_id, string_agg(concat(case when summary <> '' then concat('[chunk ', index + 1, '] ', summary, chr(10)) else '' end, '  Key points: ', array_to_string(key_points, '; ')), chr(10) order by index) as text from r group by doc_id")
def causal_input(spark, d):
    return assemble.causal_input(results(spark, d))


_META = """select source as doc_id, concat('lib/', source, '.v1.md') as path, case when length(source) % 2 = 0 then 'Own title' else '' end as title, case when length(source) % 3 = 0 then 'de' else '' end as language, concat('[', source, ' , ,b', ']') as topics,
  concat('Thesis of ', source) as core_thesis from (select distinct source from {docs})"""


def meta(spark, d) -> DataFrame:
    m = spark.sql(_META, docs=table(spark, d, "documents"))
    return m.selectExpr(
        "doc_id", "path as source", "'book' as source_type", "map('title', title, 'author', doc_id, 'language', language, 'topics', topics, 'date', '2024-01-02', 'tags', '[]') as frontmatter", "core_thesis",
        "array(named_struct('cause', 'a', 'mechanism', '', 'effect', 'b', 'relation', 'r'), named_struct('cause', 'c', 'mechanism', 'm', 'effect', doc_id, 'relation', 'q')) as causal_chains",
        "array('one', 'two') as preconditions", "cast(array() as array<string>) as counterfactuals", "array(named_struct('path', 'x/y/z.png', 'description', 'A plan'), named_struct('path', 'w.jpg', 'description', '')) as images",
    )


@query(
    "assemble_metadata",
    _R + f""", m as ({_META.format(docs="documents")}), t as (select doc_id, string_agg(t, '|' order by t) as topics from (select distinct doc_id, unnest(list_concat(case when topic <> '' then [topic] else [] end, topics, domains)) as t from r) group by doc_id)
    select doc_id, word_count, n_chunks, confidence, t.topics, takeaways, 'processed' as status, case when title <> '' then title else concat(doc_id, '.v1') end as title, path as source, doc_id as author from
    (select doc_id, cast(sum(len(list_filter(regexp_split_to_array(content, '{_SP}+'), lambda w: w <> ''))) as bigint) as word_count, count(*) as n_chunks, case when avg(confidence) >= 0.7 then 'high' when avg(confidence) >= 0.4 then 'medium' else 'low' end as confidence,
      coalesce(string_agg(my_takeaway, '|' order by index) filter (where my_takeaway <> ''), '') as takeaways from r group by doc_id) join t using (doc_id) join m using (doc_id)""",
)
def assemble_metadata(spark, d):
    return assemble.metadata(results(spark, d), meta(spark, d))


def _field(key: str, value: str) -> str:
    block = f"concat('{key}: |', chr(10), array_to_string(list_transform(string_split({value}, chr(10)), lambda l: concat('  ', l, chr(10))), ''))"
    return f"case when {_TRIM.format(value)} = '' then '' when contains({value}, chr(10)) then {block} else concat('{key}: ', {value}, chr(10)) end"


def _list(key: str) -> str:
    items = f"list_filter(list_transform({key}, lambda k: {_TRIM.format('k')}), lambda k: k <> '')"
    return f"case when len({key}) > 0 then concat('{key}:', chr(10), coalesce(array_to_string(list_transform({items}, lambda k: concat('- ', k, chr(10))), ''), '')) else '' end"


_LEVEL = "case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'low' end"
_BLOCK = f"""concat('## chunk_', printf('%02d', cast(index + 1 as integer)), chr(10), chr(10), {_field('context', 'context')}, {_field('type', 'type')}, {_field('topic', 'topic')}, {_field('summary', 'summary')}, {_list('key_points')},
  {_field('source_quote', 'source_quote')}, {_field('my_takeaway', 'my_takeaway')}, {_field('confidence', _LEVEL)}, {_field('applicability', 'applicability')}, {_list('steps')})"""


@query(
    "assemble_markdown",
    _R + f""", m as ({_META.format(docs="documents")}), n as (select *, row_number() over (partition by doc_id order by index) as n from r),
    b as (select doc_id, coalesce(string_agg(concat(case when n > 1 then chr(10) else '' end, {_BLOCK}), '' order by index) filter (where type <> '' or summary <> ''), '') as body from n group by doc_id)
    select doc_id, concat('---', chr(10), 'id: ', doc_id, chr(10), 'title: ', case when title <> '' then title else concat(doc_id, '.v1') end, chr(10), 'source_type: book', chr(10), 'source: ', path, chr(10), 'author: ', doc_id, chr(10), 'date: 2024-01-02', chr(10),
      'language: ', case when language <> '' then language else 'ru' end, chr(10), 'topics: [', doc_id, ', b]', chr(10), 'status: processed', chr(10), 'tags: []', chr(10), '---', chr(10), chr(10), body, chr(10), '## Holistic Analysis', chr(10), chr(10), core_thesis, chr(10), chr(10),
      '## Causal Chains', chr(10), chr(10), '- **a** → **b** *(r)*', chr(10), '- **c** → m → **', doc_id, '** *(q)*', chr(10), chr(10), '## Preconditions', chr(10), chr(10), '- one', chr(10), '- two', chr(10),
      chr(10), '## Images', chr(10), chr(10), '![A plan](images/z.png)', chr(10), chr(10), '![](w.jpg)', chr(10), chr(10)) as markdown from b join m using (doc_id)""",
)
def assemble_markdown(spark, d):
    return assemble.render(results(spark, d), meta(spark, d))


@query("assemble_without_meta", _R + f""", n as (select *, row_number() over (partition by doc_id order by index) as n from r)
    select doc_id, concat('---', chr(10), 'id: ', doc_id, chr(10), 'title: unnamed_document', chr(10), 'language: ru', chr(10), 'status: processed', chr(10), '---', chr(10), chr(10),
      coalesce(string_agg(concat(case when n > 1 then chr(10) else '' end, {_BLOCK}), '' order by index) filter (where type <> '' or summary <> ''), '')) as markdown from n group by doc_id""")
def assemble_without_meta(spark, d):
    return assemble.render(results(spark, d))


def _one_line(key: str, value: str) -> str:
    return f"case when {_TRIM.format(value)} = '' then '' else concat('{key}: ', {value}, chr(10)) end"


@query("export_chunks", _R + f"""select doc_id, printf('chunk_%03d.md', cast(index + 1 as integer)) as name, concat('## chunk_', printf('%02d', cast(index + 1 as integer)), chr(10), chr(10), {_one_line('type', 'type')}, {_one_line('topic', 'topic')}, {_one_line('summary', 'summary')}, {_list('key_points')},
  {_one_line('source_quote', 'source_quote')}, {_one_line('my_takeaway', 'my_takeaway')}, {_one_line('confidence', _LEVEL)}, {_one_line('applicability', 'applicability')}, {_list('steps')}, case when content <> '' then concat(chr(10), content, chr(10)) else '' end) as text from r where type <> '' or summary <> ''""")
def export_chunks(spark, d):
    return assemble.export_chunks(results(spark, d))


_FILE = "concat('dir/', case when doc_id % 5 = 0 then '.' else '' end, replace(substr(text, 1, 30), '/', '?'), ' \"a:b*', chr(9), ' <', doc_id, '>', case doc_id % 3 when 0 then '.v1.md' when 1 then '' else '.PDF' end)"


@query(
    "titles",
    f"""with p as (select doc_id, {_FILE} as path from documents), b as (select doc_id, path, regexp_extract(path, '[^/]*$') as b from p),
    s as (select doc_id, path, case when strlen(b) - strlen(regexp_extract(b, '[.][^.]*$')) > 0 then left(b, length(b) - length(regexp_extract(b, '[.][^.]*$'))) else b end as s from b)
    select doc_id, path, {_TRIM.format(f"regexp_replace(replace(regexp_replace(s, '[\\\\:*?<>|]', '-', 'g'), chr(34), chr(39)), '{_SP2}+', ' ', 'g')").replace("{{", "{").replace("}}", "}")} as title from s""",
)
def titles(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{_FILE} as path").selectExpr("doc_id", "path", f"{text.title('path')} as title")


# Telemetry ------------------------------------------------------------------------------------
_SUMS = "count(*) as calls, round(sum(cost), 6) as cost, cast(sum(prompt_tokens) as bigint) as tokens_in, cast(sum(completion_tokens) as bigint) as tokens_out"


@query("llm_cost", _C + "select seq, model, round(cost, 10) as cost from c")
def llm_cost(spark, d):
    return calls(spark, d).selectExpr("seq", "model", "round(cost, 10) as cost")


@query("telemetry_totals", _C + f"select {_SUMS}, cast(sum(prompt_chars) as bigint) as chars_in, cast(sum(completion_chars) as bigint) as chars_out from c")
def telemetry_totals(spark, d):
    return telemetry.totals(calls(spark, d))


@query("stage_breakdown", _C + f"select stage, {_SUMS} from c where stage <> '' group by stage")
def stage_breakdown(spark, d):
    return telemetry.stage_breakdown(calls(spark, d))


@query("model_usage", _C + f"select model, {_SUMS} from c where success and model <> '' group by model")
def model_usage(spark, d):
    return telemetry.model_usage(calls(spark, d))


@query("chunk_cost", _C + "select source, chunk_index, arg_max(model, seq) as model, round(arg_max(cost, seq), 10) as cost, arg_max(latency_ms, seq) as latency_ms from c where success and cost > 0 group by all")
def chunk_cost(spark, d):
    return telemetry.chunk_cost(calls(spark, d)).selectExpr("source", "chunk_index", "model", "round(cost, 10) as cost", "latency_ms")


@query(
    "status_stats",
    _C + """, k as (select source, success as done, not success as failed, latency_ms, prompt_tokens, completion_tokens, cost from c) select source, cast(count_if(done) as bigint) as chunks_done, cast(count_if(failed) as bigint) as chunks_failed, count(*) as chunks_total,
    cast(sum(case when done then latency_ms else 0 end) // count_if(done) as bigint) as avg_latency_ms, cast(sum(case when done then prompt_tokens else 0 end) // count_if(done) as bigint) as avg_tokens_in, round(sum(case when done then cost else 0 end) / count_if(done), 8) as avg_cost,
    cast(count_if(done) as double) / count(*) as success_rate from k group by source""",
)
def status_stats(spark, d):
    c = calls(spark, d).selectExpr("source", "success as done", "not success as failed", "latency_ms as duration_ms", "prompt_tokens as tokens_in", "completion_tokens as tokens_out", "cost")
    return telemetry.status_stats(c)


@query(
    "stage_timing",
    _C + """, t as (select source, stage, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000 as ms from c group by all), s as (select *, (ms + 500) // 1000 as x from t) select source, stage, cast(ms as bigint) as ms,
    concat(case when x >= 86400 then concat(x // 86400, 'd ') else '' end, case when x >= 3600 then concat(x // 3600 % 24, 'h ') else '' end, case when x >= 60 then concat(x // 60 % 60, 'm ') else '' end, x % 60, 's') as human from s""",
)
def stage_timing(spark, d):
    return telemetry.stage_timing(calls(spark, d))


_STATES = "select source, case seq % 5 when 0 then 'skipped' when 1 then 'failed' else 'done' end as state, prompt_tokens as tokens_in, cost from {c}"


@query(
    "batch_rollup",
    _C + ", s as (" + _STATES.format(c="c") + ") select cast(count_if(state = 'done') as bigint) as processed, cast(count_if(state = 'skipped') as bigint) as skipped, cast(count_if(state = 'failed') as bigint) as failed, cast(sum(case when state = 'done' then tokens_in else 0 end) as bigint) as tokens_in, round(sum(case when state = 'done' then cost else 0 end), 6) as cost from s",
)
def batch_rollup(spark, d):
    return telemetry.rollup(spark.sql(_STATES, c=calls(spark, d)))


@query("resume_work", _PACKED + ", r as (select doc_id, chunk_idx from k where (doc_id + chunk_idx) % 3 <> 0 and not (doc_id % 5 = 0)) select doc_id, cast(chunk_idx as integer) as chunk_idx from k where (doc_id, chunk_idx) not in (select (doc_id, chunk_idx) from r)")
def resume_work(spark, d):
    chunks = split.chunk_documents(table(spark, d, "documents")).select("doc_id", "chunk_idx")
    stored = chunks.where("(doc_id + chunk_idx) % 3 <> 0").selectExpr("doc_id", "chunk_idx", "if(doc_id % 5 = 0, '', 's') as summary", "'' as type")
    return telemetry.remaining(chunks, stored)


@query("telemetry_windows", _C + "select date_trunc('hour', timestamp) as window_start, stage, count(*) as calls, cast(sum(prompt_tokens + completion_tokens) as bigint) as tokens, cast(count_if(not success) as bigint) as failures from c group by all")
def telemetry_windows(spark, d):
    return streams.windows(calls(spark, d))


@query(
    "sse_reassembly",
    "select conv_id as call_id, string_agg(text, '' order by turn) as content, true as finished from conversations group by conv_id",
)
def sse_reassembly(spark, d):
    c = table(spark, d, "conversations")
    one = "concat('data: ', to_json(named_struct('choices', array(named_struct('delta', named_struct('content', text))))))"
    lines = c.selectExpr("conv_id as call_id", "turn * 2 as seq", f"{one} as line").unionByName(c.selectExpr("conv_id as call_id", "turn * 2 + 1 as seq", "if(turn = 0, 'data: {broken', 'data: [DONE]') as line"))
    done = c.selectExpr("conv_id as call_id", "cast(1000000 as bigint) as seq", "'data: [DONE]' as line").distinct()
    return telemetry.reassemble(lines.unionByName(done))


# Retrieval ------------------------------------------------------------------------------------
_ID = "cast(list_reduce(list_transform(range(1, 9), lambda i: cast(ascii(substr(sha256({x}), i, 1)) as hugeint)), lambda a, b: a * 256 + b) as bigint)"


@query("point_ids", _PACKED + f"select concat(doc_id, ':chunk_', chunk_idx) as chunk_id, {_ID.format(x="concat(doc_id, ':chunk_', chunk_idx)")} as point_id from k")
def point_ids(spark, d):
    c = split.chunk_documents(table(spark, d, "documents")).selectExpr("concat(doc_id, ':chunk_', chunk_idx) as chunk_id")
    return c.selectExpr("chunk_id", f"{text.point_id('chunk_id')} as point_id")


@query(
    "upsert_points",
    "with n as (select vec_id + label as id, vec_id as seq, label from embeddings), l as (select id, max(seq) as seq, arg_max(label, seq) as label from n group by id) select * from l union all select vec_id as id, vec_id as seq, label from embeddings where vec_id not in (select id from l)",
)
def upsert_points(spark, d):
    e = table(spark, d, "embeddings")
    return search.upsert(e.selectExpr("vec_id as id", "vec_id as seq", "label"), e.selectExpr("vec_id + label as id", "vec_id as seq", "label"))


TOP = 10
#: The queries: every row whose id is divisible by this.
EVERY = 50
_DENSE = f"""dq as (select vec_id as query, embedding::double[] as q from embeddings where vec_id % {EVERY} = 0),
dr as (select query, id, score, row_number() over (partition by query order by score desc, id) as rank from (select query, vec_id as id, round(list_cosine_similarity(embedding::double[], q), 9) as score from embeddings, dq) qualify rank <= {2 * TOP})"""


def dense_hits(spark, d, k: int) -> DataFrame:
    points = table(spark, d, "embeddings")
    return search.dense_topk(points, points.where(f"vec_id % {EVERY} = 0").selectExpr("vec_id as query", "embedding as vector"), k, "vec_id", "embedding")


@query("dense_topk", f"with {_DENSE} select query, id, score, rank from dr")
def dense_topk(spark, d):
    """Each vector whose id is divisible by 50 against all vectors."""
    return dense_hits(spark, d, 2 * TOP).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


_BM25 = f"""w as (select doc_id as id, list_filter(regexp_split_to_array(lower(text), '{_SP}+'), lambda x: x <> '') as w from documents), st as (select count(*) as n, avg(len(w)) as avgdl from w),
tf as (select id, dl, term, count(*) as tf from (select id, len(w) as dl, unnest(w) as term from w) group by all), df as (select term, count(*) as df from tf group by term),
sc as (select q.id as query, tf.id as id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.dl / avgdl))), 9) as score
  from (select id, term from tf where id % {EVERY} = 0) q join df using (term) join tf using (term), st group by q.id, tf.id),
sr as (select query, id, score, row_number() over (partition by query order by score desc, id) as rank from sc qualify rank <= {2 * TOP})"""


def sparse_hits(spark, d, k: int) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.bm25(docs, docs.where(f"doc_id % {EVERY} = 0").selectExpr("doc_id as query", "text"), k)


@query("bm25_topk", f"with {_BM25} select query, id, round(score, 6) as score, rank from sr")
def bm25_topk(spark, d):
    """Each text whose id is divisible by 50, whole, as a query against all texts."""
    return sparse_hits(spark, d, 2 * TOP).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FUSED = f"""{_DENSE}, {_BM25}, nd as (select query, count(*) as nd from dr group by query), ns as (select query, count(*) as ns from sr group by query),
f as (select coalesce(dr.query, sr.query) as query, coalesce(dr.id, sr.id) as id, coalesce(dr.score, sr.score) as score, dr.rank as a, sr.rank as b from dr full join sr on dr.id = sr.id and dr.query = sr.query),
g as (select f.query, id, score, coalesce(a, coalesce(nd, 0) + 1) as dense_rank, coalesce(b, coalesce(ns, 0) + 1) as sparse_rank from f left join nd using (query) left join ns using (query)),
h as (select *, 1.0::double / (60 + dense_rank) + 1.0::double / (60 + sparse_rank) as rrf_score from g), hybrid as (select *, row_number() over (partition by query order by rrf_score desc, id) as rank from h qualify rank <= {TOP})"""


@query(
    "rrf_hybrid",
    f"with {_FUSED} select query, id, round(score, 6) as score, cast(dense_rank as bigint) as dense_rank, cast(sparse_rank as bigint) as sparse_rank, round(rrf_score, 12) as rrf_score, rank from hybrid",
)
def rrf_hybrid(spark, d):
    out = search.rrf(dense_hits(spark, d, 2 * TOP), sparse_hits(spark, d, 2 * TOP), TOP)
    return out.selectExpr("query", "id", "round(score, 6) as score", "cast(dense_rank as bigint) as dense_rank", "cast(sparse_rank as bigint) as sparse_rank", "round(rrf_score, 12) as rrf_score", "cast(rank as bigint) as rank")


@query("rrf_without_sparse", f"with {_DENSE}, h as (select query, id, score, rank from dr where score >= 0.2) select query, id, score, rank as dense_rank, cast(1 as bigint) as sparse_rank, row_number() over (partition by query order by rank) as rank from h qualify rank <= {TOP}")
def rrf_without_sparse(spark, d):
    """The fusion over a store without sparse vectors, with a least retrieval score."""
    dense = dense_hits(spark, d, 2 * TOP)
    return search.rrf(dense, dense.limit(0), TOP, min_score=0.2).selectExpr("query", "id", "score", "cast(dense_rank as bigint) as dense_rank", "cast(sparse_rank as bigint) as sparse_rank", "cast(rank as bigint) as rank")


_CONTENT = f"case when strlen(text) > 500 then concat({{cut}}, '...') else text end"


@query("ann_topk")
def ann_topk(spark, d):
    """Each vector whose id is divisible by 50 against the cells nearest to it, of all vectors: as many cells as
    a recall of 0.95 needs."""
    points = table(spark, d, "embeddings")
    index = cells.build(points, new_folder(spark, "cells"), "vec_id", "embedding")
    probes = cells.probes_for(index, points, id_col="vec_id", vec_col="embedding")
    asked = points.where(f"vec_id % {EVERY} = 0").selectExpr("vec_id as query", "embedding as vector")
    return cells.search(index, asked, 2 * TOP, probes).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("ann_exact", f"with {_DENSE} select query, id, score, rank from dr where score >= 0.1")
def ann_exact(spark, d):
    """The same index looked into whole gives what the exact search gives, from a least score on."""
    points = table(spark, d, "embeddings")
    index = cells.build(points, new_folder(spark, "cells"), "vec_id", "embedding", cells=8)
    asked = points.where(f"vec_id % {EVERY} = 0").selectExpr("vec_id as query", "embedding as vector")
    return cells.search(index, asked, 2 * TOP, 8, least=0.1).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("search_output", f"with {_FUSED} select query, id, concat(source, ':chunk_', id) as chunk_id, source as file, lang as topic, {_CONTENT.format(cut=_first_bytes('text', 500))} as content, strlen(text) as bytes from hybrid join documents on doc_id = id")
def search_output(spark, d):
    """Hits as JSON objects, content cut to 500 bytes, read back."""
    docs = table(spark, d, "documents").selectExpr("doc_id as id", "source", "lang as topic", "text")
    hits = rrf_hybrid(spark, d).join(docs, "id")
    lines = hits.selectExpr("query", "id", "octet_length(text) as bytes", f"to_json(struct(concat(source, ':chunk_', id) as chunk_id, source as file, score, rrf_score, topic, {text.byte_cut('text', 500)} as content)) as line")
    get = lambda k: f"get_json_object(line, '$.{k}') as {k}"
    return lines.selectExpr("query", "id", get("chunk_id"), get("file"), get("topic"), get("content"), "cast(bytes as bigint) as bytes")


@query(
    "pairwise_similarity",
    "select vec_id as id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 9) as score from embeddings where vec_id <> 7",
)
def pairwise_similarity(spark, d):
    return search.pairwise(table(spark, d, "embeddings"), 7, "vec_id", "embedding")


@query(
    "parents_of_hits",
    f"with {_DENSE}, c as (select query, id // 10 as parent_id, count(*) as n_hits from dr group by all) select *, row_number() over (partition by query order by n_hits desc, parent_id) as rank from c qualify rank <= 3",
)
def parents_of_hits(spark, d):
    children = table(spark, d, "embeddings").selectExpr("vec_id as id", "vec_id div 10 as parent_id")
    return search.parents_of_hits(dense_hits(spark, d, 2 * TOP), children, 3).withColumn("rank", F.col("rank").cast("long"))


@query(
    "rerank_by_overlap",
    f"with {_BM25}, k as (select sr.query, sr.id, len(list_intersect(list_distinct(a.w), b.w)) as o from sr join w a on a.id = sr.query join w b on b.id = sr.id) select query, id, cast(o as integer) as overlap, row_number() over (partition by query order by o desc, id) as rank from k qualify rank <= {TOP}",
)
def rerank_by_overlap(spark, d):
    """BM25 hits in the order of the words they share with the query."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = sparse_hits(spark, d, 2 * TOP).select("query", "id")

    def words(key, name):  # of each text once, not of each pair
        return docs.withColumnRenamed("doc_id", key).join(hits.select(key), key, "left_semi").selectExpr(key, f"{text.different_words('text')} as {name}")

    both = hits.join(words("query", "q"), "query").join(words("id", "w"), "id")
    scored = both.selectExpr("query", "id", "size(array_intersect(q, w)) as rerank_score")
    return search.rerank(hits, scored, TOP).selectExpr("query", "id", "rerank_score as overlap", "cast(rank as bigint) as rank")


_MODEL = "case event_id % 6 when 0 then 'bge-m3' when 1 then 'nomic-embed' when 2 then 'text-embedding-3-small' when 3 then 'text-embedding-3-large' when 4 then 'text-embedding-ada-002' else event_type end"


@query(
    "vector_sizes",
    f"with m as (select event_id, {_MODEL} as model from events) select event_id, cast(case when contains(model, 'bge-m3') then 1024 when contains(model, 'nomic') then 768 when contains(model, '3-small') or contains(model, 'ada') then 1536 when contains(model, '3-large') then 3072 else 1024 end as integer) as width from m",
)
def vector_sizes(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{_MODEL} as model").selectExpr("event_id", f"{text.vector_size('model')} as width")


# Resuming -------------------------------------------------------------------------------------
_EVENTS = "select user_id as doc_id, event_id as seq, case event_id % 6 when 0 then 'new' when 1 then 'stage' when 2 then 'chunks' when 3 then 'failed' when 4 then 'stage' else 'completed' end as event, case event_id % 6 when 1 then 'split' when 2 then cast(event_id % 40 as varchar(9)) when 3 then concat('error ', event_id) when 4 then 'holistic' end as value from {e}"
_STATE = f"""e as ({_EVENTS.format(e="events")}), st as (select doc_id, arg_max(case event when 'new' then 'extracted' when 'stage' then value when 'failed' then 'failed' else 'done' end, seq) filter (where event <> 'chunks') as stage,
  cast(arg_max(value, seq) filter (where event = 'chunks') as bigint) as chunks_total, arg_max(value, seq) filter (where event = 'failed') as failed_with from e group by doc_id)"""


def states(spark, d) -> DataFrame:
    return resume.document_state(spark.sql(_EVENTS.replace("varchar(9)", "string"), e=table(spark, d, "events")))


@query("document_state", f"with {_STATE} select * from st")
def document_state(spark, d):
    return states(spark, d)


@query(
    "stages_past",
    f"with {_STATE}, o as (select unnest(['extracted', 'cleaned', 'split', 'processing', 'holistic', 'causal', 'context_enrichment', 'done']) as s, unnest(range(8)) as i) select doc_id, coalesce(a.i, -1) > 2 and stage <> 'failed' as past_split, coalesce(a.i, -1) > 4 and stage <> 'failed' as past_holistic from st left join o a on a.s = stage",
)
def stages_past(spark, d):
    return states(spark, d).selectExpr("doc_id", f"{resume.stage_past('stage', repr('split'))} as past_split", f"{resume.stage_past('stage', repr('holistic'))} as past_holistic")


@query("files_to_do", f"with {_STATE} select c_custkey as doc_id, c_name as path from customer where c_custkey not in (select doc_id from st where stage = 'done')")
def files_to_do(spark, d):
    return resume.todo(table(spark, d, "customer").selectExpr("c_custkey as doc_id", "c_name as path"), states(spark, d))


_CHUNK_EVENTS = "select user_id as doc_id, cast(event_id % 5 as int) as index, event_id as seq, case event_type when 'error' then 'failed' when 'purchase' then 'done' else 'started' end as event, cast(ts as timestamp) as at, case when event_type = 'error' then concat('e', event_id) else '' end as error from {e}"


@query(
    "chunk_state",
    f"""with e as ({_CHUNK_EVENTS.format(e="events")}), l as (select doc_id, index, max(seq) filter (where event <> 'started') as seq from e group by all), x as (select l.doc_id, l.index, l.seq, e.event, e.at, e.error from l left join e on e.doc_id = l.doc_id and e.seq = l.seq),
    b as (select x.doc_id, x.index, max(e.at) as begun from x join e on e.doc_id = x.doc_id and e.index = x.index and e.event = 'started' and (x.seq is null or e.seq < x.seq) where e.seq = (select max(f.seq) from e f where f.doc_id = x.doc_id and f.index = x.index and f.event = 'started' and (x.seq is null or f.seq < x.seq)) group by all)
    select x.doc_id, x.index, coalesce(event = 'done', false) as done, coalesce(event = 'failed', false) as failed, case when event = 'failed' then error else '' end as error, cast(coalesce((epoch_us(x."at") - epoch_us(begun)) // 1000, 0) as bigint) as duration_ms from x left join b on b.doc_id = x.doc_id and b.index = x.index""",
)
def chunk_state(spark, d):
    return resume.chunk_state(spark.sql(_CHUNK_EVENTS, e=table(spark, d, "events")))


@query(
    "restored_results",
    """select doc_id, cast(doc_id % 9 as integer) as index, case when doc_id % 2 = 0 and doc_id % 3 <> 0 then 'status' when doc_id % 3 <> 0 and doc_id % 5 <> 0 then 'file' when doc_id % 7 = 0 then 'legacy' end as origin,
    case when doc_id % 3 <> 0 and (doc_id % 2 = 0 or doc_id % 5 <> 0) then case when doc_id % 5 = 0 then '' else lang end when doc_id % 7 = 0 then source end as summary,
    case when doc_id % 3 <> 0 and (doc_id % 2 = 0 or doc_id % 5 <> 0) then 'new' when doc_id % 7 = 0 then 'old' end as type from documents""",
)
def restored_results(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "cast(doc_id % 9 as int) as index", "lang", "source")
    done = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "index", "true as done")
    stored = docs.where("doc_id % 3 <> 0").selectExpr("doc_id", "index", "if(doc_id % 5 = 0, '', lang) as summary", "'new' as type")
    return resume.restored(docs.select("doc_id", "index"), done, stored, docs.where("doc_id % 7 = 0").selectExpr("doc_id", "index", "source as summary", "'old' as type"))


@query(
    "restored_texts",
    f"""with {_STATE} select d.doc_id, case when coalesce(stage, '') in ('cleaned', 'split', 'processing', 'holistic', 'causal', 'context_enrichment', 'done') and d.doc_id % 2 = 0 then text when d.doc_id % 3 = 0 then lang end as text from documents d left join st on st.doc_id = d.doc_id""",
)
def restored_texts(spark, d):
    docs = table(spark, d, "documents")
    return resume.restored_text(docs, states(spark, d), docs.where("doc_id % 2 = 0").select("doc_id", "text"), docs.where("doc_id % 3 = 0").selectExpr("doc_id", "lang as text"))


@query("stored_or_new_chunks", "select doc_id, case when doc_id % 4 = 0 then 'k2' else 'k1' end as key, case when doc_id % 4 = 0 or doc_id % 3 = 0 then text else 'kept' end as text from documents")
def stored_or_new_chunks(spark, d):
    docs = table(spark, d, "documents")
    new = docs.selectExpr("doc_id", "if(doc_id % 4 = 0, 'k2', 'k1') as key", "text")
    return resume.stored_or_new(docs.where("doc_id % 3 <> 0").selectExpr("doc_id", "'k1' as key", "'kept' as text"), new)


# Sources and sinks ----------------------------------------------------------------------------
_FETCHED = "case doc_id % 4 when 0 then text when 1 then {broken} else {json} end"


@query(
    "fetched_pages",
    f"""with x as (select doc_id, text, case when doc_id % 3 = 0 then '' else lang end as c, case when doc_id % 5 = 0 then '' else text end as de from documents)
    select doc_id, case doc_id % 4 when 0 then text when 1 then concat('{{not json', lang_) else case when c = '' then de when de = '' then c when {_WC.format('c')} < {_WC.format('de')} * 30 // 100 then de else c end end as text from (select x.*, l.lang as lang_ from x join documents l using (doc_id))""",
)
def fetched_pages(spark, d):
    """What a fetcher printed: plain text, broken JSON, or JSON whose content or description counts."""
    json = "to_json(named_struct('title', source, 'content', if(doc_id % 3 = 0, '', lang), 'description', if(doc_id % 5 = 0, '', text)))"
    raw = table(spark, d, "documents").selectExpr("doc_id", f"case doc_id % 4 when 0 then text when 1 then concat('{{not json', lang) else {json} end as raw")
    return raw.selectExpr("doc_id", f"{files.fetched('raw')} as text")


@query(
    "price_list",
    """with p as (select lower(p_name) as model, concat('prov', p_size % 5) as provider, min_by(p_retailprice, p_partkey) as price from part where p_size % 7 <> 0 group by all) select model, arg_min(price, provider) as input_price, arg_min(price * 4, provider) as output_price from p group by model""",
)
def price_list(spark, d):
    """A provider list in pages of JSON objects; models without a cost are left out."""
    part = table(spark, d, "part").selectExpr("concat('prov', p_size % 5) as provider", "if(p_size % 2 = 0, upper(p_name), p_name) as name", "p_partkey", "p_size", "if(p_size % 7 = 0, null, p_retailprice) as price")
    first = part.where("price is not null").groupBy("provider", F.lower("name").alias("name")).agg(F.min_by("price", "p_partkey").alias("price"))
    free = part.where("price is null").selectExpr("provider", "concat('free ', p_partkey) as name", "price")
    models = first.unionByName(free).groupBy("provider", F.expr("substr(md5(name), 1, 3)").alias("page")).agg(F.expr("map_from_entries(collect_list(struct(name, struct(if(price is null, null, struct(price as input, price * 4 as output)) as cost))))").alias("models"))
    raw = models.selectExpr("to_json(map(provider, struct(models))) as json")
    return files.price_list(raw)


@query("page_counts", "select doc_id, case when doc_id % 3 = 0 then 0 else cast(doc_id as integer) end as n from documents")
def page_counts(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", "concat('Title: x', chr(10), if(doc_id % 3 = 0, 'Pages: none', concat('Pages:        ', doc_id)), chr(10)) as info").selectExpr("doc_id", f"{files.page_count('info')} as n")


_VERSION = "concat('ws/', substr(md5(source), 1, 8), '/versions/v', doc_id, '/final.md')"


@query("final_versions", f"select substr(md5(source), 1, 8) as doc_id, cast(max(doc_id) as integer) as version, arg_max(text, doc_id) as text from documents group by source")
def final_versions(spark, d):
    return workspace.final_versions(table(spark, d, "documents").selectExpr(f"{_VERSION} as path", "text"))


@query("workspace_detect", "select lang, bool_or(doc_id % 2 = 0 and substr(md5(source), 1, 1) = 'a') as workspace from documents group by lang")
def workspace_detect(spark, d):
    """Whether a language's files lie in a workspace: some folder is named as a document's hash."""
    named = "if(doc_id % 2 = 0 and startswith(md5(source), 'a'), substr(md5(source), 1, 8), 'plain')"
    paths = table(spark, d, "documents").selectExpr("lang", f"concat('ws/', {named}, '/versions/v', doc_id, '/final.md') as path")
    return paths.groupBy("lang").agg(F.expr(f"bool_or({workspace.in_workspace('path')})").alias("workspace"))


@query("flat_documents", "select substr(sha256(concat('n', doc_id, case doc_id % 3 when 0 then '.md' else '.markdown' end)), 1, 8) as doc_id, text from documents where doc_id % 3 < 2 and doc_id % 5 > 0")
def flat_documents(spark, d):
    return workspace.flat_documents(table(spark, d, "documents").selectExpr("concat('a/', if(doc_id % 5 = 0, '._', ''), 'n', doc_id, case doc_id % 3 when 0 then '.md' when 1 then '.markdown' else '.MD' end) as path", "text"))


@query(
    "checkpoint_chunks",
    f"with c as (select source as doc_id, doc_id as n, text from documents where {_TRIM.format('text')} <> '') select doc_id, cast(row_number() over (partition by doc_id order by n) - 1 as integer) as chunk_idx, text from c",
)
def checkpoint_chunks(spark, d):
    """Chunk files in the order of their numbers, not of their names."""
    names = table(spark, d, "documents").selectExpr("concat('cp/', source, '/chunks/chunk-', doc_id, '.md') as path", "text").unionByName(table(spark, d, "documents").selectExpr("concat('cp/', source, '/chunks/notes.md') as path", "text"))
    return workspace.read_chunks(names)


def _listed(x: str, n: int) -> str:
    return f"case when strlen({x}) > {n} then concat({_first_bytes(x, n - 3)}, '...') else {x} end"


@query(
    "document_listing",
    f"with x as (select doc_id, coalesce(left(replace(text, chr(10), ' '), doc_id % 60), '') as t, coalesce(concat(source, case when doc_id % 2 = 0 then concat(' in é ', lang, ' and the rest') else '' end), '') as s from documents) select doc_id, case when t = '' then '-' else {_listed('t', 30)} end as title, {_listed('s', 20)} as source, cast(1 as integer) as versions from x",
)
def document_listing(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "left(replace(text, chr(10), ' '), cast(doc_id % 60 as int)) as title", "concat(source, if(doc_id % 2 = 0, concat(' in é ', lang, ' and the rest'), '')) as source", "1 as versions")
    return workspace.listing(docs)


@query("chunk_files", _PACKED + f"select doc_id, printf('chunks/chunk-%03d.md', cast(chunk_idx + 1 as integer)) as name, text from k where {_TRIM.format('text')} <> ''")
def chunk_files(spark, d):
    return sinks.chunk_files(split.chunk_documents(table(spark, d, "documents")))


# Model stages ---------------------------------------------------------------------------------
#: Recorded replies by stage, in SQL that both engines read: {i} is the chunk's number, {n} the bytes asked.
_RECORDED = {
    "chunk": "concat('Type: ', case when doc_id % 9 = 4 then '<type>' else 'concept' end, chr(10), 'topic: about ', doc_id % 13 + {i} % 3, chr(10), 'summary: ', case when {i} % 4 = 3 then '' else concat('says ', {i}, ' of ', doc_id) end, chr(10), "
    "case when {i} % 2 = 0 then concat('and more', chr(10)) else '' end, 'key_points: k', {i}, ', , l', chr(10), 'confidence: 0.', doc_id % 10)",
    "context": "concat('  part ', {i}, ' of ', doc_id, ' ')",
    "holistic": "concat('core_thesis: thesis of ', doc_id, ' over ', {n}, chr(10), 'domains: a, b')",
    "causal": "concat('causal_chains:', chr(10), '- cause: c', doc_id, chr(10), '  mechanism: ', case when doc_id % 2 = 0 then 'm' else '' end, chr(10), '  effect: over ', {n}, chr(10), '  relation: causes', chr(10), chr(10), 'preconditions:', chr(10), '- p', doc_id, chr(10), chr(10), 'counterfactuals:', chr(10), '- q')",
}


def recorded(asked: DataFrame, stage: str) -> DataFrame:
    """``asked (doc_id, chunk_idx, text)`` with the stage's recorded replies, as ``call_model`` gives fresh ones."""
    said = _RECORDED[stage].format(i="chunk_idx", n="octet_length(text)")
    known = asked.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("response", F.expr(said))
    return known.selectExpr(
        "cast(doc_id as string) as doc_id", "chunk_idx", "text", "response", "1 as attempts", "cast(null as string) as error", "cast(octet_length(text) as bigint) as prompt_chars", "cast(octet_length(response) as bigint) as completion_chars",
        "0L as prompt_tokens", "0L as completion_tokens", "'m' as model", "0L as latency_ms",
    )


def recorded_chunks(spark, d) -> DataFrame:
    return recorded(split.chunk_documents(table(spark, d, "documents")), "chunk")


_SAID = f"""{_PACKED}, r as (select doc_id, chunk_idx as index, case when doc_id % 9 = 4 then '<type>' else 'concept' end as type, concat('about ', doc_id % 13 + chunk_idx % 3) as topic,
  case when chunk_idx % 4 = 3 then '' else concat('says ', chunk_idx, ' of ', doc_id, case when chunk_idx % 2 = 0 then ' and more' else '' end) end as summary, [concat('k', chunk_idx), 'l'] as key_points, '' as source_quote, '' as my_takeaway,
  cast(doc_id % 10 as double) / 10 as confidence, '' as applicability, []::varchar[] as steps, text as content, case when text <> '' and chunk_idx % 4 <> 3 then concat('part ', chunk_idx, ' of ', doc_id) else '' end as context from k)"""


@query(
    "model_stages",
    f"""{_SAID}, n as (select *, row_number() over (partition by doc_id order by index) as n from r),
    b as (select doc_id, string_agg(concat(case when n > 1 then chr(10) else '' end, {_BLOCK}), '' order by index) as body, strlen(string_agg(summary, chr(10) || chr(10) order by index) filter (where summary <> '')) as h,
      strlen(string_agg(concat(case when summary <> '' then concat('[chunk ', index + 1, '] ', summary, chr(10)) else '' end, '  Key points: k', index, '; l'), chr(10) order by index)) as c from n group by doc_id)
    select cast(doc_id as varchar) as doc_id, concat('---', chr(10), 'id: ', doc_id, chr(10), 'title: unnamed_document', chr(10), 'language: ru', chr(10), 'status: processed', chr(10), '---', chr(10), chr(10), body, chr(10), '## Holistic Analysis', chr(10), chr(10), 'thesis of ', doc_id, ' over ', h, chr(10),
      chr(10), '## Causal Chains', chr(10), chr(10), '- **c', doc_id, '** → ', case when doc_id % 2 = 0 then 'm → ' else '' end, '**over ', c, '** *(causes)*', chr(10), chr(10), '## Preconditions', chr(10), chr(10), '- p', doc_id, chr(10), chr(10), '## Counterfactuals', chr(10), chr(10), '- q', chr(10)) as markdown from b""",
)
def model_stages(spark, d):
    """Recorded replies of all stages, each to what its stage asks, parsed and rendered."""
    chunk = recorded_chunks(spark, d)
    results = stages.chunk_results(chunk)
    own = [recorded(asked, stage) for stage, asked in (("context", stages.context_calls(results)), ("holistic", stages.holistic_prompts(results)), ("causal", stages.causal_prompts(results)))]
    return stages.rendered(chunk, *own)


_NEAR = "cast({d} * 7 + {i} as bigint) % 100"


@query(
    "index_pipeline",
    f"""{_SAID}, pt as (select concat(doc_id, ':chunk_', index) as id, doc_id, index, topic, summary, doc_id % 9 <> 4 as valid, content, vec_id, label from r join embeddings on vec_id = {_NEAR.format(d="doc_id", i="index")})
    select id, {_ID.format(x="id")} as point_id, topic, summary, valid, content, vec_id, label from pt union all
    select concat(doc_id, ':old') as id, {_ID.format(x="concat(doc_id, ':old')")} as point_id, 'old' as topic, '' as summary, false as valid, '' as content, cast(null as bigint) as vec_id, cast(null as integer) as label from documents""",
)
def index_pipeline(spark, d):
    """Chunks with their recorded replies and recorded vectors, parsed and put into a store by point id: what
    the store had under an id is replaced, the rest stays."""
    results = stages.chunk_results(recorded_chunks(spark, d))
    vectors = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    found = results.join(vectors, F.expr("vec_id = " + _NEAR.format(d="cast(doc_id as bigint)", i="index"))).selectExpr("concat(doc_id, ':chunk_', index) as id", "topic", "summary", "valid", "content", "vec_id", "label", "embedding as vector", "1L as seq")
    docs = table(spark, d, "documents")
    old = "'old' as topic", "'' as summary", "false as valid", "'' as content", "cast(null as bigint) as vec_id", "cast(null as int) as label", "cast(null as array<float>) as vector", "0L as seq"
    store = found.selectExpr("id", *old).unionByName(docs.selectExpr("concat(doc_id, ':old') as id", *old))
    return search.upsert(store, found).selectExpr("id", f"{text.point_id('id')} as point_id", "topic", "summary", "valid", "content", "vec_id", "label")


@query(
    "context_prompts",
    _R + f""", a as (select *, row_number() over (partition by doc_id order by i) as n from (select doc_id, topic, min(index) as i from r where topic <> '' group by all)), s as (select doc_id, 'Document covering: ' || string_agg(topic, ', ' order by i) as about from a where n <= 5 group by doc_id)
    select doc_id, index, concat('Document summary: ', about, chr(10), chr(10), 'Chunk content:', chr(10), {_first_bytes('content', 1000)}) as text from r join s using (doc_id) where content <> '' and summary <> '' and context = ''""",
)
def context_prompts(spark, d):
    return stages.context_prompts(results(spark, d))


@query(
    "causal_reload",
    _R + """select doc_id, index, case when index % 3 = 0 then ['- a → b (causes)', concat('- ', topic)] else ['- x'] end as chains, case when index % 2 = 0 then ['one', 'two'] else [] end as preconditions, ['q'] as counterfactuals from r""",
)
def causal_reload(spark, d):
    """Saved causal analyses read again."""
    saved = "concat('## Causal Chains\n\n', if(index % 3 = 0, concat('- a → b (causes)\n  \n - ', topic), '- x'), '\n\n## Preconditions\n\n', if(index % 2 = 0, 'one\n two', ''), '\n\n## Counterfactuals\n\nq\n')"
    got = results(spark, d).selectExpr("doc_id", "index", f"{parse.saved_causal(saved)} as c")
    return got.selectExpr("doc_id", "index", "c.chains.cause as chains", "c.preconditions", "c.counterfactuals")


@query("cleaned_by_parts", f"""{_PARTS} select cast(doc_id as varchar) as doc_id, case when min(length(s)) > 0 then string_agg(s, chr(10) || chr(10) order by part_idx) end as text, case when min(length(s)) = 0 then 'empty reply' end as error
    from (select doc_id, part_idx, {_TRIM.format("part")} as s from parts where doc_id in (select doc_id from documents where {_TRIM.format("text")} <> '')) group by doc_id""")
def cleaned_by_parts(spark, d):
    """Cleaning in one call where a text fits into one, else in parts; here each reply is the part itself."""
    calls_ = stages.cleaning_calls(table(spark, d, "documents"), most=2800)
    return stages.cleaned(calls_.selectExpr("doc_id", "chunk_idx", "concat(' ', text, chr(10)) as response", "cast(null as string) as error"))


@query(
    "partial_merge",
    "select doc_id // 4 as doc_id, coalesce(arg_min(case when doc_id % 3 = 0 then '' else lang end, doc_id) filter (where doc_id % 3 <> 0), '') as topic, coalesce(arg_min(cast(doc_id % 2 as double), doc_id) filter (where doc_id % 2 > 0), 0) as confidence, string_agg(source, '|' order by doc_id) as points from documents group by doc_id // 4",
)
def partial_merge(spark, d):
    parts = table(spark, d, "documents").selectExpr("doc_id div 4 as doc_id", "doc_id as part", "if(doc_id % 3 = 0, '', lang) as topic", "cast(doc_id % 2 as double) as confidence", "array(source) as points")
    return assemble.merge_results(parts, ["doc_id"]).withColumn("points", F.array_join("points", "|"))


@query("cleaned_parts", "select doc_id // 5 as doc_id, string_agg(text, chr(10) || chr(10) order by doc_id) as text from documents group by doc_id // 5")
def cleaned_parts(spark, d):
    return assemble.reassemble_parts(table(spark, d, "documents").selectExpr("doc_id div 5 as doc_id", "doc_id as part_idx", "text as part"))


@query(
    "object_stream",
    "select conv_id as call_id, coalesce(string_agg(text, '' order by turn), '') as content, true as finished, cast(max(turn) * 3 as bigint) as prompt_tokens, cast(7 as bigint) as completion_tokens from conversations group by conv_id",
)
def object_stream(spark, d):
    """Recorded lines of JSON objects, nested and flat, with broken lines and lines after the end."""
    c = table(spark, d, "conversations")
    one = "if(turn % 2 = 0, to_json(named_struct('message', named_struct('content', text), 'done', false, 'prompt_eval_count', turn * 3)), to_json(named_struct('content', text, 'done', false, 'prompt_eval_count', turn * 3)))"
    end = c.groupBy("conv_id").agg(F.max("turn").alias("t"))
    lines = c.selectExpr("conv_id as call_id", "turn * 2 as seq", f"{one} as line").unionByName(c.selectExpr("conv_id as call_id", "turn * 2 + 1 as seq", "'{broken' as line"))
    lines = lines.unionByName(end.selectExpr("conv_id as call_id", "t * 2 + 2 as seq", "to_json(named_struct('done', true, 'eval_count', 7)) as line")).unionByName(end.selectExpr("conv_id as call_id", "t * 2 + 3 as seq", "to_json(named_struct('content', 'late')) as line"))
    return telemetry.reassemble_objects(lines)


@query("prompt_chars", "select conv_id, cast(sum(strlen(text)) as bigint) as chars from conversations group by conv_id")
def prompt_chars(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    return m.selectExpr("conv_id", f"{telemetry.prompt_chars('messages')} as chars")


@query("chunk_cost_of_all_calls", _C + "select source, chunk_index, arg_max(model, seq) as model, round(arg_max(cost, seq), 10) as cost from c where success group by all")
def chunk_cost_of_all_calls(spark, d):
    return telemetry.chunk_cost(calls(spark, d), paid_only=False).selectExpr("source", "chunk_index", "model", "round(cost, 10) as cost")


_EVENT_KIND = "case event_id % 9 when 0 then 'split_done' when 1 then 'processing_chunk' when 2 then 'processing_retry' when 3 then 'holistic_done' when 4 then 'other' when 5 then 'pre_clean' when 6 then 'completed' when 7 then 'splitting' else 'assembling' end"


@query(
    "event_labels",
    f"""with e as (select event_id, {_EVENT_KIND} as e from events) select event_id, case e when 'split_done' then concat(event_id, ' chunks') when 'processing_chunk' then concat('chunk ', event_id % 5, '/9') when 'processing_retry' then concat('chunk ', event_id % 5, ' retry ', event_id % 3)
    when 'holistic_done' then 'holistic' when 'pre_clean' then 'cleaning' when 'completed' then 'done' when 'splitting' then 'splitting' when 'assembling' then 'assembling' end as label,
    case when event_id % 4 = 0 then concat('ERROR: bad ', event_id) else concat(e, ' attempt=', event_id % 3, ' chunk=', event_id % 5, ' chunks=', event_id, ' total=9') end as line from e""",
)
def event_labels(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{_EVENT_KIND} as e", "map('total', '9', 'chunk', cast(event_id % 5 as string), 'chunks', cast(event_id as string), 'attempt', cast(event_id % 3 as string)) as data", "if(event_id % 4 = 0, concat('bad ', event_id), '') as error")
    return e.selectExpr("event_id", f"{text.stage_label('e', 'data')} as label", f"{text.event_line('e', 'error', 'data')} as line")


@query(
    "remaining_time",
    """with x as (select event_id, event_id % 7 as done, event_id * 97 as took, event_id % 5 as active from events), y as (select *, 60 - done - 5 - 5 as rest, case when done > 0 and active > 0 then ((60 - done - 5 - 5) * (took // done) // active + 500) // 1000 end as s from x)
    select event_id, case when done < 1 or active = 0 then 'ETA ...' when rest <= 0 then 'done' when s < 60 then concat('ETA ', s, 's') when s >= 3600 then printf('ETA %dh%02dm', s // 3600, s % 3600 // 60) when s % 60 > 0 then printf('ETA %dm%02ds', s // 60, s % 60) else concat('ETA ', s // 60, 'm') end as eta from y""",
)
def remaining_time(spark, d):
    x = table(spark, d, "events").selectExpr("event_id", "event_id % 7 as done", "event_id * 97 as took", "event_id % 5 as active")
    return x.selectExpr("event_id", f"{text.eta('done', 'took', '60', '5', '5', 'active')} as eta")


@query("image_types", "select doc_id, case doc_id % 5 when 0 then 'image/png' when 1 then 'image/gif' when 2 then 'image/webp' when 3 then 'image/bmp' else 'image/jpeg' end as type from documents")
def image_types(spark, d):
    head = "unhex(case doc_id % 5 when 0 then '89504E470D0A' when 1 then '474946383961' when 2 then '524946460000000057454250' when 3 then '424D0000' else 'FFD8FFE0' end)"
    return table(spark, d, "documents").selectExpr("doc_id", f"{head} as b").selectExpr("doc_id", f"split(substr({text.data_url('b')}, 6), ';')[0] as type")


@query(
    "query_forms",
    f"""with q as (select conv_id, turn, {_TRIM.format('text')} as t from conversations) select conv_id, turn, case when ends_with(t, '?') or regexp_matches(lower(t), '^(как|что|почему)([^\\p{{L}}]|$)') then 'question'
    when regexp_matches(lower(t), '^(напиши|объясни|расскажи)([^\\p{{L}}]|$)') then 'command' when {_WC.format('t')} < 4 then 'fragment' else 'statement' end as form from q""",
)
def query_forms(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{text.query_format('text')} as form")


@query("retryable_errors", "select event_id, event_id % 4 in (0, 2) as retry from events")
def retryable_errors(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "case event_id % 4 when 0 then 'server said 503' when 1 then 'no such model' when 2 then concat('timeout after ', 'x') else 'bad key' end as m")
    return e.selectExpr("event_id", f"{text.retryable_error('m')} as retry")


_TOKENS = "list_filter(regexp_split_to_array(text, '{sp}+'), lambda w: w <> '')".format(sp=_SP)


@query(
    "parent_child_chunks",
    f"""with w as (select doc_id, {_TOKENS} as w from documents), p as (select doc_id, unnest(range(0, len(w), 512)) as a, w from w), q as (select doc_id, a, list_slice(w, a + 1, a + 512) as p from p), c as (select doc_id, a, unnest(range(0, len(p), 128)) as b, p from q)
    select concat(doc_id, ':', a // 512) as parent_id, concat(doc_id, ':', a // 512, ':', b // 128) as id, array_to_string(list_slice(p, b + 1, b + 128), ' ') as text, sha256(array_to_string(list_slice(p, b + 1, b + 128), ' ')) as content_hash from c""",
)
def parent_child_chunks(spark, d):
    return split.parents_and_children(table(spark, d, "documents"))


@query("context_blocks", f"with {_DENSE} select query, concat('Source [', rank, ']: ', lang) as block from dr join documents on doc_id = id")
def context_blocks(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id as id", "lang")
    return search.context_block(dense_hits(spark, d, 2 * TOP).join(docs, "id"), "lang").select("query", "block")


@query("delete_document", "select vec_id as id, label from embeddings where label <> 3")
def delete_document(spark, d):
    return search.delete_document(table(spark, d, "embeddings").selectExpr("vec_id as id", "label", "label as doc_id"), 3).select("id", "label")


@query("point_count", "select count(*) as n, sum(label) as labels, true as ready, false as dropped from (select vec_id as id, label from embeddings where vec_id % 7 <> 1 union all select vec_id + 1000000 as id, label + 1 as label from embeddings)")
def point_count(spark, d):
    """A collection made, filled, changed by key, and counted from its manifest; another one dropped."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    points = Collection(spark, new_folder(spark, "points")).init(e.schema, buckets=8)
    points.upsert(e)
    points.upsert(e.selectExpr("id + 1000000 as id", "label + 1 as label").unionByName(e.where("id % 5 = 2")))
    points.delete(e.where("id % 7 = 1").select("id"))
    other = Collection(spark, new_folder(spark, "points")).init(e.schema)
    other.drop()
    return points.read().agg(F.sum("label").alias("labels")).select(F.lit(points.count()).cast("long").alias("n"), "labels", F.lit(points.exists()).alias("ready"), F.lit(other.exists()).alias("dropped"))


@query(
    "collection_upserts",
    "with n as (select vec_id + label as id, vec_id as seq, label from embeddings), l as (select id, max(seq) as seq, arg_max(label, seq) as label from n group by id) select * from l union all select vec_id as id, vec_id as seq, label from embeddings where vec_id not in (select id from l)",
)
def collection_upserts(spark, d):
    """Points put into a stored collection: of a key's new rows the last counts, others stay."""
    e = table(spark, d, "embeddings")
    old = e.selectExpr("vec_id as id", "vec_id as seq", "label")
    points = Collection(spark, new_folder(spark, "points")).init(old.schema, buckets=8)
    points.upsert(old)
    points.upsert(e.selectExpr("vec_id + label as id", "vec_id as seq", "label"), order="seq")
    return points.read()


# Status, calls and runs --------------------------------------------------------------------------
_STATUS_EVENTS = """select user_id as doc_id, event_id as seq, case event_id % 9 when 0 then 'chunks' when 1 then 'started' when 2 then 'done' when 3 then 'cost' when 4 then 'failed' when 5 then 'started' when 6 then 'cost' when 7 then 'done' else 'started' end as event,
  cast((event_id * 7) % 6 as int) as index, cast(ts as timestamp) as at, cast(case when event_id % 9 = 0 then 1 + event_id % 7 end as int) as total, event_type as stage, concat('e', event_id) as error, cast(event_id % 10 as double) / 4 as cost, event_id % 100 as tokens_in, event_id % 90 as tokens_out, concat('m', event_id % 3) as model, event_id % 80 as latency_ms from {e}"""
_STATUS_FOLD = f"""with e as ({_STATUS_EVENTS.format(e="events")}), w as (select *, last_value(total ignore nulls) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding) as cur, min(total) over (partition by doc_id order by seq rows between 1 following and unbounded following) as later from e),
k as (select * from w where event <> 'chunks' and cur > index and coalesce(later, 1000) > index),
x as (select doc_id, index, max(seq) filter (where event in ('done', 'failed')) as es, max(seq) filter (where event = 'started') as ss, max(seq) filter (where event = 'cost') as cs from k group by all),
b as (select x.doc_id, x.index, arg_max(k."at", k.seq) as begun from x join k on k.doc_id = x.doc_id and k.index = x.index and k.event = 'started' and k.seq < x.es group by all),
g as (select doc_id, cast(unnest(range(n)) as integer) as index from (select doc_id, arg_max(total, seq) as n from e where event = 'chunks' group by doc_id))
select g.doc_id, g.index, coalesce(ee.event = 'done', false) as done, coalesce(ee.event = 'failed', false) as failed, case when ee.event = 'failed' then ee.error else '' end as error, se."at" as started_at, ee."at" as completed_at,
  cast(coalesce((epoch_us(ee."at") - epoch_us(begun)) // 1000, 0) as bigint) as duration_ms, coalesce(ce.cost, 0) as cost, coalesce(ce.tokens_in, 0) as tokens_in, coalesce(ce.tokens_out, 0) as tokens_out, coalesce(ce.model, '') as model, coalesce(ce.latency_ms, 0) as latency_ms, coalesce(se.stage, '') as stage
from g left join x on x.doc_id = g.doc_id and x.index = g.index left join b on b.doc_id = g.doc_id and b.index = g.index left join e ee on ee.doc_id = g.doc_id and ee.seq = es left join e se on se.doc_id = g.doc_id and se.seq = ss left join e ce on ce.doc_id = g.doc_id and ce.seq = cs"""


def chunk_fold_of(spark, d) -> DataFrame:
    return resume.chunk_fold(spark.sql(_STATUS_EVENTS, e=table(spark, d, "events")))


@query("chunk_fold", _STATUS_FOLD)
def chunk_fold(spark, d):
    """The status of chunks over their documents' re-sizings, cost fields kept."""
    return chunk_fold_of(spark, d)


@query("status_roundtrip", f"select doc_id::varchar as doc_id, * exclude (doc_id) from ({_STATUS_FOLD}) where doc_id is not null")
def status_roundtrip(spark, d):
    """Status written as files, read, taken as events and folded again."""
    chunks = chunk_fold_of(spark, d)
    docs = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_total")).selectExpr("doc_id", "'processing' as stage", "chunks_total", "cast(null as string) as failed_with")
    stored = workspace.read_status(sinks.status_files(docs, chunks).selectExpr("concat('ws/', doc_id, '/', name) as path", "text"))
    return resume.chunk_fold(resume.status_events(workspace.stored_chunks(stored)))


def call_events(spark, d) -> DataFrame:
    """Conversations as streamed calls: opened, a piece a turn, then closed, failed or never heard of again."""
    c = table(spark, d, "conversations")
    at = lambda s: f"timestamp_millis(1704067200000 + {s} * 1000 + conv_id % 7) as at"
    null = lambda **k: [f"cast({k.get(c.split()[0], 'null')} as {c.split()[1]}) as {c.split()[0]}" for c in streamed.EVENTS.split(", ")[3:]]
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    known = "cast(conv_id as string) as call_id"
    return (
        ends.selectExpr(known, "-1L as seq", at("0"), *null(event="'open'", source="concat('s', conv_id)", stage="'chunk'", chunk_index="conv_id % 3", retry_attempt="0", model="'m'", prompt_chars="conv_id * 2"))
        .unionByName(c.selectExpr(known, "cast(turn * 2 as long) as seq", at("turn"), *null(event="'piece'", piece="text", model="if(turn = 1, 'm-large', null)")))
        .unionByName(ends.where("conv_id % 5 > 1").selectExpr(known, "cast(turn * 2 + 1 as long) as seq", at("(turn + 2)"), *null(event="'close'", prompt_tokens="conv_id", completion_tokens="turn")))
        .unionByName(ends.where("conv_id % 5 = 1").selectExpr(known, "1L as seq", at("1"), *null(event="'error'", error="'broken'")))
    )


@query(
    "call_facts",
    """with c as (select conv_id, turn, text, max(turn) over (partition by conv_id) as n from conversations), k as (select *, conv_id % 5 = 1 as bad, conv_id % 5 = 0 as silent from c),
    f as (select conv_id, any_value(n) as n, any_value(bad) as bad, any_value(silent) as silent, bool_or(turn = 1 and not bad) as large, sum(coalesce(strlen(text), 0)) filter (where not bad or turn = 0) as chars, max(turn) as last from k group by conv_id)
    select cast(conv_id as varchar) as call_id, concat('s', conv_id) as source, 'chunk' as stage, cast(conv_id % 3 as integer) as chunk_index, cast(0 as integer) as retry_attempt, case when large then 'm-large' else 'm' end as model, case when bad or silent then 0 else conv_id end as prompt_tokens,
      case when bad or silent then 0 else cast(n as bigint) end as completion_tokens, conv_id * 2 as prompt_chars, cast(coalesce(chars, 0) as bigint) as completion_chars, ms as latency_ms, not (bad or silent) as success,
      case when bad then 'broken' when silent then 'no event before the time limit' end as error, epoch_ms(1704067200000 + ms + conv_id % 7) as timestamp
    from (select *, cast(case when bad then 1000 when silent then last * 1000 + 60000 else (n + 2) * 1000 end as bigint) as ms from f)""",
)
def call_facts(spark, d):
    """One fact a streamed call, closed, failed or silent."""
    return streamed.recorded_facts(call_events(spark, d), "1 minute", until="2025-01-01")


_RUN_EVENTS = "select concat('r', user_id % 5) as run, concat('f', event_id % 11) as name, event_id as seq, cast(ts as timestamp) as at, case event_id % 6 when 0 then 'file_start' when 1 then 'file_start' when 2 then 'file_done' when 3 then 'file_error' when 4 then 'file_skip' else 'other' end as event, case when event_id % 6 = 3 then concat('e', event_id) end as error from {e}"
_OUTCOMES = f"""e as ({_RUN_EVENTS.format(e="events")}), r as (select *, coalesce(sum(case when event in ('file_done', 'file_error') then 1 else 0 end) over (partition by run, name order by seq rows between unbounded preceding and 1 preceding), 0) as round from e),
p as (select *, last_value(case when event = 'file_start' then "at" end ignore nulls) over (partition by run, name, round order by seq rows between unbounded preceding and 1 preceding) as began from r),
o as (select run, name, case event when 'file_done' then 'done' when 'file_error' then 'failed' else 'skipped' end as outcome, epoch_ms(epoch_us("at") // 1000) as "at", case when event <> 'file_skip' then epoch_us("at") // 1000 - epoch_us(began) // 1000 end as duration_ms, error from p where event in ('file_done', 'file_error', 'file_skip'))"""


def outcomes_of(spark, d) -> DataFrame:
    return runs.recorded_outcomes(spark.sql(_RUN_EVENTS, e=table(spark, d, "events")))


@query("run_outcomes", f"with {_OUTCOMES} select * from o")
def run_outcomes(spark, d):
    """Ends of files paired with their starts."""
    return outcomes_of(spark, d)


@query(
    "run_summary",
    f"with {_OUTCOMES}, c as (select run, count_if(outcome = 'done') as done, count_if(outcome = 'failed') as failed, count_if(outcome = 'skipped') as skipped, cast(coalesce(sum(duration_ms), 0) as bigint) as ms from o group by run) select run, cast(100000 as bigint) as total, done, failed, skipped, cast(3 as bigint) as active, ms // done as mean_ms, 100000 - done - failed - skipped as remaining, (100000 - done - failed - skipped) * (ms // done) // 3 as wait_ms from c",
)
def run_summary(spark, d):
    """Counts, mean time and time left of a run."""
    ended = outcomes_of(spark, d)
    total = ended.select("run").distinct().selectExpr("run", "100000L as total", "3L as active")
    return runs.summary(ended, total).drop("lost", "wait")
