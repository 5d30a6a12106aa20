"""Text functions as SQL expressions (JVM-side).  Lengths are UTF-8 bytes; blank means Unicode white
space.  Each function takes SQL expressions and returns one, so it nests in any plan."""

from __future__ import annotations

#: Fixed value: Unicode white space, as a regular expression class that Java and RE2 both read.
SPACE = r"[ \t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: White space at either end.
EDGES = f"r'^{SPACE}+|{SPACE}+$'"
#: Tags that become line breaks, in order.
BREAK_TAGS = [
    ("<br>", "\\n"), ("<br/>", "\\n"), ("<br />", "\\n"), ("</p>", "\\n\\n"), ("</div>", "\\n"), ("</li>", "\\n"),
    ("</h1>", "\\n\\n"), ("</h2>", "\\n\\n"), ("</h3>", "\\n\\n"), ("</h4>", "\\n\\n"), ("</tr>", "\\n"),
]
#: Entities, decoded in this order (so a doubly escaped one decodes twice).
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
#: Phrases of front and back matter in file names and section titles.
EPUB_BOILERPLATE = ["copyright", "title page", "table of contents", "about the author", "acknowledgments", "dedication", "also by", "other books", "about this book"]
FB2_BOILERPLATE = ["содержание", "оглавление", "об авторе", "обложка", "титул", "посвящение", "благодарности", "contents", "about the author", "cover", "title page"]


def trim(x: str) -> str:
    return f"regexp_replace({x}, {EDGES}, '')"


def word_count(x: str) -> str:
    """Maximal runs of anything but space, tab and newline."""
    return f"size(filter(split({x}, r'[ \\n\\t]+'), w -> w <> ''))"


def fields(x: str) -> str:
    """Words between Unicode white space."""
    return f"filter(split({x}, r'{SPACE}+'), w -> w <> '')"


def html_text(x: str) -> str:
    """Block tags to newlines, tags dropped (an unclosed one to the end), entities decoded, lines
    trimmed, blank ones dropped."""
    for tag, new in BREAK_TAGS:
        x = f"replace({x}, '{tag}', '{new}')"
    x = f"replace(regexp_replace({x}, r'<[^>]*(>|$)', ''), '>', '')"
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return f"array_join(filter(transform(split({x}, '\\n'), l -> {trim('l')}), l -> l <> ''), '\\n')"


def strip_frontmatter(x: str) -> str:
    """Without a leading block between --- marks and the newlines behind it."""
    return f"regexp_replace(regexp_replace({x}, r'^[ \\t\\n\\x0B\\f\\r]+(?=---)', ''), r'(?s)^---.*?---[\\n\\r]*', '')"


def frontmatter(x: str) -> str:
    """The leading block's ``key: value`` lines as a map, the last of a key winning; quotes off."""
    body = f"regexp_extract({x}, r'(?s)^---\\n(.*?)\\n---', 1)"
    lines = f"filter(split({body}, '\\n'), l -> instr(l, ':') > 0)"
    key = trim("substring_index(l, ':', 1)")
    value = trim("substr(l, instr(l, ':') + 1)")
    pair = f"named_struct('k', {key}, 'v', regexp_replace({value}, r'^[\"\\x27]|[\"\\x27]$', ''))"
    pairs = f"transform({lines}, l -> {pair})"
    last = "aggregate(ps, cast(array() as array<struct<k:string,v:string>>), (a, p) -> array_append(filter(a, q -> q.k <> p.k), p))"
    return f"transform(array({pairs}), ps -> map_from_entries({last}))[0]"


def needs_ocr(x: str) -> str:
    """Too short, no letters, too few different letters, or too many doubled characters."""
    letters = f"regexp_extract_all({x}, r'(\\p{{L}})', 1)"
    chars = f"split({x}, '')"
    doubled = f"size(filter(zip_with(slice(cs, 2, size(cs)), slice(cs, 1, size(cs) - 1), (a, b) -> a = b), e -> e))"
    return (
        f"(octet_length({x}) < 100 or transform(array(named_struct('l', {letters}, 'c', {chars})), s -> size(s.l) = 0 "
        f"or cast(size(array_distinct(s.l)) as double) / size(s.l) < 0.05D "
        f"or transform(array(s.c), cs -> cast({doubled} as double) / size(cs))[0] > 0.3D)[0])"
    )


def is_toc_page(x: str) -> str:
    """At least two of: chapter lines with dotted leaders, lines ending in a page number, short
    lines."""
    chapter = r"r'(?iu)(глава|chapter|раздел|section|часть|part|unit|module)\s+\d+'"
    leader, number = r"r'[.]{3,}\s*\d+\s*$'", r"r'\s\d{1,4}\s*$'"
    lines = f"filter(transform(split({x}, '\\n'), l -> {trim('l')}), l -> l <> '')"
    share = lambda cond: f"cast(size(filter(ls, l -> {cond})) as double) / size(ls)"
    signals = (
        f"if({share(f'l rlike {chapter} and l rlike {leader}')} > 0.2D, 1, 0)"
        f" + if({share(f'l rlike {number}')} > 0.4D, 1, 0)"
        " + if(aggregate(ls, 0L, (a, l) -> a + octet_length(l)) div size(ls) < 40, 1, 0)"
    )
    return f"(size(split({x}, '\\n')) >= 5 and transform(array({lines}), ls -> if(size(ls) = 0, false, {signals} >= 2))[0])"


def is_boilerplate_page(x: str) -> str:
    return f"(octet_length({trim(x)}) < 50 or {trim(x)} rlike r'^[0-9]+$')"


def contains_any(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({x}), '{p}')" for p in phrases) + ")"


def longest_run(words: str) -> str:
    """The longest run of equal neighbours in an array, ignoring case."""
    step = "named_struct('w', w, 'n', if(w = a.w, a.n + 1, 1), 'm', greatest(a.m, if(w = a.w, a.n + 1, 1)))"
    return f"aggregate(transform({words}, w -> lower(w)), named_struct('w', cast(null as string), 'n', 0, 'm', 0), (a, w) -> {step}, a -> a.m)"


def most_trigram(words: str) -> str:
    """How often the most frequent 3-gram of an array of words occurs, ignoring case: its grams'
    hashes, sorted, and their longest equal stretch.  Nothing leaves the row."""
    grams = "transform(sequence(1, size(lw) - 2), i -> xxhash64(lw[i - 1], lw[i], lw[i + 1]))"
    step = "named_struct('g', g, 'n', if(g = a.g, a.n + 1L, 1L), 'm', greatest(a.m, if(g = a.g, a.n + 1L, 1L)))"
    fold = f"aggregate(array_sort({grams}), named_struct('g', cast(null as bigint), 'n', 0L, 'm', 0L), (a, g) -> {step}, a -> a.m)"
    return f"transform(array(transform({words}, w -> lower(w))), lw -> if(size(lw) < 3, 0L, {fold}))[0]"


def comma_list(x: str) -> str:
    return f"filter(transform(split({x}, ','), p -> {trim('p')}), p -> p <> '')"


def field(x: str, key: str) -> str:
    """The last ``key: value`` line's value, or ''."""
    found = f"regexp_extract_all({x}, r'(?im)^[ \\t]*{key}:(.*)$', 1)"
    return f"coalesce({trim(f'try_element_at({found}, -1)')}, '')"


def confidence(x: str) -> str:
    return f"case when {x} >= 0.7D then 'high' when {x} >= 0.4D then 'medium' else 'low' end"


#: Characters a file name may not hold, and what each becomes.
RESERVED, REPLACEMENT = r'/\:*?"<>|', "-----'---"


def sanitize_filename(x: str) -> str:
    """Reserved characters to hyphens, double quotes to single, NUL dropped, white space collapsed
    (input in Unicode NFC: ``nfc`` brings it there)."""
    cleaned = f"replace(translate({x}, {literal(RESERVED)}, {literal(REPLACEMENT)}), chr(0), '')"
    return trim(f"regexp_replace({cleaned}, r'{SPACE}+', ' ')")


def literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def title(path: str) -> str:
    """A path's base name without its last extension; hidden files keep theirs."""
    base = f"substring_index({path}, '/', -1)"
    stem = f"regexp_replace({base}, r'(?s)^(.+)[.][^.]*$', '$1')"
    return f"if({path} = '', 'unnamed_document', {sanitize_filename(stem)})"


def document_title(frontmatter: str, path: str) -> str:
    """The frontmatter's title if it has one, else the path's."""
    own = trim(f"coalesce(try_element_at({frontmatter}, 'title'), '')")
    return f"if({own} <> '', {own}, {title(path)})"


def duration(seconds: str) -> str:
    """Whole seconds as Nd Nh Nm Ns without leading zero units."""
    d, h, m, s = f"{seconds} div 86400", f"{seconds} div 3600 % 24", f"{seconds} div 60 % 60", f"{seconds} % 60"
    return (
        f"concat(if({d} > 0, concat({d}, 'd '), ''), if({d} > 0 or {h} > 0, concat({h}, 'h '), ''), "
        f"if({d} > 0 or {h} > 0 or {m} > 0, concat({m}, 'm '), ''), {s}, 's')"
    )


def byte_cut(x: str, n: int) -> str:
    """At most n bytes, ending at a character boundary, with ... if cut."""
    cuts = f"transform(sequence(0, 3), i -> cast(substring(encode({x}, 'utf-8'), 1, {n} - i) as string))"
    return f"if(octet_length({x}) <= {n}, {x}, concat(filter({cuts}, c -> is_valid_utf8(c))[0], '...'))"


def yaml_field(key: str, value: str) -> str:
    """``key: value`` with a newline, a literal block for several lines, nothing for a blank."""
    block = f"concat('{key}: |\\n', array_join(transform(split({value}, '\\n'), l -> concat('  ', l, '\\n')), ''))"
    return f"case when {trim(value)} = '' then '' when contains({value}, '\\n') then {block} else concat('{key}: ', {value}, '\\n') end"


def bullets(items: str) -> str:
    return f"array_join(transform({items}, i -> concat('- ', i, '\\n')), '')"


def point_id(x: str) -> str:
    """The first eight hex characters of SHA-256, read as eight ASCII bytes, big-endian."""
    return f"cast(conv(hex(substr(sha2({x}, 256), 1, 8)), 16, 10) as bigint)"


def cosine(a: str, b: str) -> str:
    """Cosine in double precision; 0 if a norm is 0."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p as double) * cast(q as double)), 0D, (s, v) -> s + v)"
    norm = f"sqrt({dot(a, a)}) * sqrt({dot(b, b)})"
    return f"if({norm} = 0D, 0D, {dot(a, b)} / ({norm}))"


def price_keys(model: str) -> str:
    """Price look-up keys in order: the name, without a trailing -20YYMMDD, without what follows
    the last colon; all lower case."""
    m = f"lower({model})"
    dated = f"if({m} rlike r'^((?!-20).)+-20[0-9]{{6}}$', regexp_replace({m}, r'-20[0-9]{{6}}$', ''), null)"
    suffix = f"if(instr({m}, ':') > 0, regexp_replace({m}, r':[^:]*$', ''), null)"
    return f"array({m}, {dated}, {suffix})"


def vector_size(model: str) -> str:
    return (
        f"case when contains({model}, 'bge-m3') or contains({model}, 'qwen3-embedding') then 1024 when contains({model}, 'nomic') then 768 "
        f"when contains({model}, 'text-embedding-3-small') then 1536 when contains({model}, 'text-embedding-3-large') then 3072 "
        f"when contains({model}, 'text-embedding-ada') then 1536 else 1024 end"
    )


def retryable(status: str) -> str:
    """Whether an HTTP status is worth another try."""
    return f"({status} in (429, 500, 502, 503, 504))"


#: Parts of the messages of errors that are worth another try.
RETRYABLE = ["rate limit", "timeout", "5xx", "503", "502", "429", "too many requests", "unavailable"]


def retryable_error(message: str) -> str:
    return "(" + " or ".join(f"contains({message}, '{x}')" for x in RETRYABLE) + ")"


#: First words of questions and commands, as the published behaviour description lists
#: them.
QUESTION_WORDS, COMMAND_WORDS = ["как", "что", "почему"], ["напиши", "объясни", "расскажи"]


def query_format(x: str) -> str:
    """A query's form: a question mark at the end or a question word first makes a question, an
    imperative first a command; of the rest up to three words are a fragment, more a statement."""
    first = f"regexp_extract(lower({trim(x)}), r'^([\\p{{L}}]+)', 1)"
    among = lambda ws: f"{first} in ({', '.join(literal(w) for w in ws)})"
    return (
        f"case when endswith({trim(x)}, '?') or {among(QUESTION_WORDS)} then 'question' when {among(COMMAND_WORDS)} then 'command' "
        f"when {word_count(x)} < 4 then 'fragment' else 'statement' end"
    )


def different_words(x: str) -> str:
    """The different words of a text, ignoring case."""
    return f"array_distinct({fields(f'lower({x})')})"


def keyword_overlap(query: str, x: str) -> str:
    """How many different words of a query a text holds, ignoring case."""
    return f"size(array_intersect({different_words(query)}, {different_words(x)}))"


def byte_cap(x: str, n: int) -> str:
    """The longest beginning of at most n bytes that ends at a character boundary."""
    cuts = f"transform(sequence(0, 3), i -> substring(encode({x}, 'utf-8'), 1, {n} - i))"
    return f"if(octet_length({x}) <= {n}, {x}, cast(filter({cuts}, c -> is_valid_utf8(cast(c as string)))[0] as string))"


def display_cut(x: str, n: int) -> str:
    """At most n bytes for a listing, the last three of a cut one being dots."""
    return f"if(octet_length({x}) > {n}, concat({byte_cap(x, n - 3)}, '...'), {x})"


def is_hash_name(x: str) -> str:
    """Whether a folder's name is a document's hash: eight hex digits."""
    return f"({x} rlike r'^[0-9a-f]{{8}}$')"


def eta(done: str, took_ms: str, total: str, failed: str, skipped: str, active: str) -> str:
    """The time that remaining files take at the mean pace of the finished ones."""
    left = f"({total} - {done} - {failed} - {skipped})"
    sec = f"cast(({left} * ({took_ms} div {done}) div {active} + 500) div 1000 as bigint)"
    h, m, s = f"{sec} div 3600", f"{sec} % 3600 div 60", f"{sec} % 60"
    two = lambda v: f"lpad(cast({v} as string), 2, '0')"
    return (
        f"case when {done} < 1 or {active} = 0 then 'ETA ...' when {left} <= 0 then 'done' when {sec} < 60 then concat('ETA ', {sec}, 's') "
        f"when {h} > 0 then concat('ETA ', {h}, 'h', {two(m)}, 'm') when {s} > 0 then concat('ETA ', {m}, 'm', {two(s)}, 's') else concat('ETA ', {m}, 'm') end"
    )


#: The stage that an event stands for.
EVENT_STAGES = {
    "pipeline_start": "pipeline", "pre_clean": "cleaning", "pre_clean_done": "cleaning", "splitting": "splitting", "processing_start": "processing",
    "holistic_analysis": "holistic", "holistic_done": "holistic", "causal_extraction": "causal", "causal_done": "causal",
    "context_enrichment": "enriching", "context_enrichment_done": "enriching", "assembling": "assembling", "completed": "done",
}


def stage_label(event: str, data: str) -> str:
    """An event's stage, null where it keeps the current one.  ``data``: map<string,string>."""
    get = lambda k: f"coalesce({data}['{k}'], '0')"
    plain = " ".join(f"when {event} = '{k}' then '{v}'" for k, v in EVENT_STAGES.items())
    return (
        f"case when {event} = 'split_done' then if(coalesce(size({data}), 0) > 0, concat({get('chunks')}, ' chunks'), 'splitting') "
        f"when {event} = 'processing_chunk' and size({data}) > 0 then concat('chunk ', {get('chunk')}, '/', {get('total')}) "
        f"when {event} = 'processing_retry' and size({data}) > 0 then concat('chunk ', {get('chunk')}, ' retry ', {get('attempt')}) {plain} end"
    )


def event_line(event: str, error: str, data: str) -> str:
    """An event as a line: its error, or its type and data in the order of the keys, values cut."""
    pairs = f"transform(array_sort(map_keys({data})), k -> concat(' ', k, '=', {byte_cut(f'{data}[k]', 80)}))"
    return f"if(coalesce({error}, '') <> '', concat('ERROR: ', {error}), concat({event}, coalesce(array_join({pairs}, ''), '')))"


def mime(data: str) -> str:
    """An image's type by its first bytes; JPEG if unknown."""
    head = f"hex(substring({data}, 1, 12))"
    return (
        f"case when startswith({head}, '89504E47') then 'image/png' when startswith({head}, '47494638') then 'image/gif' "
        f"when startswith({head}, '52494646') and endswith({head}, '57454250') then 'image/webp' when startswith({head}, '424D') then 'image/bmp' else 'image/jpeg' end"
    )


def data_url(data: str) -> str:
    return f"concat('data:', {mime(data)}, ';base64,', base64({data}))"


def string_list(x: str) -> str:
    """A list written as a string: brackets off, cut at commas, blanks dropped."""
    return comma_list(f"regexp_replace({x}, r'^[\\[\\]]+|[\\[\\]]+$', '')")


def holistic(x: str) -> str:
    """A reply's thesis (the last of its lines) and all its domains."""
    every = "flatten(transform(regexp_extract_all(" + x + r", r'(?im)^[ \t]*domains:(.*)$', 1), d -> " + comma_list("d") + "))"
    return f"named_struct('core_thesis', {field(x, 'core_thesis')}, 'domains', {every})"


def holistic_reload(x: str) -> str:
    """A stored analysis, ``thesis`` and behind ``Domains: `` its list."""
    parts = f"split({x}, '\n\nDomains: ', 2)"
    return f"named_struct('core_thesis', ({parts})[0], 'domains', if(size({parts}) > 1, split(({parts})[1], ', '), cast(array() as array<string>)))"


def nfc_columns(df, *columns: str):
    """``df`` with string columns in Unicode NFC, for which Spark has no function."""
    from ..shipping import map_arrow

    def run(batches):
        import unicodedata

        import pyarrow as pa

        def nfc(column):
            return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in column.to_pylist()], column.type)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([nfc(c) if n in columns else c for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    return map_arrow(df, run, df.schema)
