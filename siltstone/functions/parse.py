"""Parsers of model replies and Markdown as folds over lines (SQL expressions)."""

from __future__ import annotations

from .text import trim

#: Reply keys, and those whose value may go on over the next lines.
KEYS = ["type", "title", "topic", "summary", "key_points", "source_quote", "my_takeaway", "confidence", "applicability"]
LONG_KEYS = ["summary", "source_quote", "my_takeaway", "applicability"]


def key_values(x: str) -> str:
    """A reply as a map of its keys: the last value of a key wins; lines after a long, non-empty
    value are appended to it until a blank line or another key."""
    key = f"regexp_extract(lower({trim('l')}), r'^({'|'.join(KEYS)}):', 1)"
    value = trim(f"substr({trim('l')}, instr({trim('l')}, ':') + 1)")
    known = ", ".join(f"'{k}'" for k in LONG_KEYS)
    new = "map_concat(map_filter(a.m, (k, v) -> k <> {k}), map({k}, {v}))"
    step = f"""case
        when {key} <> '' then named_struct('m', {new.format(k=key, v=value)}, 'at', {key})
        when {trim('l')} = '' then named_struct('m', a.m, 'at', '')
        when a.at in ({known}) and a.m[a.at] <> '' then named_struct('m', {new.format(k='a.at', v=f"concat(a.m[a.at], ' ', {trim('l')})")}, 'at', a.at)
        else a end"""
    return f"aggregate(split({x}, '\\n'), named_struct('m', cast(map() as map<string,string>), 'at', ''), (a, l) -> {step}, a -> a.m)"


def valid_result(m: str) -> str:
    """Whether a parsed reply has a type, and fewer than two placeholders."""
    get = lambda k: f"coalesce({m}['{k}'], '')"
    count = " + ".join(f"if({get(k)} rlike r'<\\w+>', 1, 0)" for k in ("type", "topic", "summary", "my_takeaway", "applicability"))
    return f"({get('type')} <> '' and not {get('type')} rlike r'<\\w+>' and {count} < 2)"


def typed_blocks(x: str) -> str:
    """``> type: k=v, k2=v2`` blocks, each up to a ``<`` line, the next block or the end; a text
    without blocks is one block of type text, a blank one none."""
    blank = "cast(null as struct<type:string,params:map<string,string>,content:string>)"
    head = "substr(trim(l), 3)"
    rest = f"if(instr({head}, ': ') > 0, substr({head}, instr({head}, ': ') + 2), '')"
    pairs = f"filter(split({rest}, ', '), p -> instr(p, '=') > 1)"
    params = f"if(size({pairs}) = 0, cast(null as map<string,string>), map_from_entries(transform({pairs}, p -> named_struct('k', trim(substring_index(p, '=', 1)), 'v', trim(substr(p, instr(p, '=') + 1))))))"
    opened = f"named_struct('type', trim(substring_index({head}, ': ', 1)), 'params', {params}, 'content', cast(null as string))"
    done = "if(a.cur is null, a.done, array_append(a.done, a.cur))"
    step = f"""case
        when trim(l) rlike r'^> \\S' and a.cur is null or trim(l) rlike r'^> \\S' then named_struct('done', {done}, 'cur', {opened})
        when trim(l) = '<' then named_struct('done', {done}, 'cur', {blank})
        when a.cur is not null then named_struct('done', a.done, 'cur', named_struct('type', a.cur.type, 'params', a.cur.params, 'content', if(a.cur.content is null, l, concat(a.cur.content, '\\n', l))))
        else a end"""
    fold = f"aggregate(split({x}, '\\n'), named_struct('done', cast(array() as array<struct<type:string,params:map<string,string>,content:string>>), 'cur', {blank}), (a, l) -> {step}, a -> {done})"
    content = trim("coalesce(b.content, '')")
    clean = f"transform({fold}, b -> named_struct('type', b.type, 'params', b.params, 'content', {content}))"
    whole = f"array(named_struct('type', 'text', 'params', cast(null as map<string,string>), 'content', {trim(x)}))"
    return f"case when {trim(x)} = '' then cast(array() as array<struct<type:string,params:map<string,string>,content:string>>) else transform(array({clean}), bs -> if(size(bs) = 0, {whole}, bs))[0] end"


def markdown_chunks(x: str) -> str:
    """Chunks of an assembled document: topic, summary, key points and the other lines as content;
    chunks without content are dropped, and without any the document is one general chunk."""
    chunk = "struct<topic:string,summary:string,key_points:array<string>,content:string>"
    new = "named_struct('topic', '', 'summary', '', 'key_points', cast(array() as array<string>), 'content', '')"
    put = lambda **k: "named_struct(" + ", ".join(f"'{f}', " + k.get(f, f"a.c.{f}") for f in ("topic", "summary", "key_points", "content")) + ")"
    state = lambda c, kp, done="a.done": f"named_struct('done', {done}, 'c', {c}, 'kp', {kp})"
    done = "if(a.c is null or a.c.content = '', a.done, array_append(a.done, a.c))"
    step = f"""case
        when startswith(l, '## chunk_') then {state(new, 'false', done)}
        when a.c is null then a
        when startswith(l, 'topic: ') then {state(put(topic="substr(l, 8)"), 'false')}
        when startswith(l, 'summary: ') then {state(put(summary="substr(l, 10)"), 'false')}
        when startswith(l, 'key_points:') then {state('a.c', 'true')}
        when startswith(l, '- ') and a.kp then {state(put(key_points="array_append(a.c.key_points, substr(l, 3))"), 'true')}
        when l = '' and a.kp then {state('a.c', 'false')}
        when l rlike r'^(type: |source_quote: |my_takeaway: |confidence: |applicability: |steps:|context: )' then a
        else {state(put(content="if(a.c.content = '', l, concat(a.c.content, chr(10), l))"), 'a.kp')} end"""
    fold = f"aggregate(split({x}, '\\n'), named_struct('done', cast(array() as array<{chunk}>), 'c', cast(null as {chunk}), 'kp', false), (a, l) -> {step}, a -> {done})"
    whole = f"array(named_struct('topic', 'general', 'summary', '', 'key_points', cast(array() as array<string>), 'content', {x}))"
    return f"transform(array({fold}), cs -> if(size(cs) = 0, {whole}, cs))[0]"


def variants(x: str) -> str:
    """The items of a numbered list or plain lines."""
    item = r"regexp_replace(l, r'^[0-9][^.]{0,3}[.][ \t\n\x0B\f\r]*', '')"
    return f"filter(transform(filter(transform(split({x}, '\\n'), l -> {trim('l')}), l -> l <> ''), l -> if(length(l) > 2, {item}, l)), l -> l <> '')"


def causal(x: str) -> str:
    """Causal chains, preconditions and counterfactuals.  A bullet that ends a chain counts for
    its section."""
    link = "struct<cause:string,mechanism:string,effect:string,relation:string>"
    none = f"cast(null as {link})"
    t, low = trim("l"), f"lower({trim('l')})"
    put = lambda **k: "named_struct(" + ", ".join(f"'{f}', " + k.get(f, f"a.c.{f}") for f in ("cause", "mechanism", "effect", "relation")) + ")"
    st = lambda done="a.done", c="a.c", pre="a.pre", cf="a.cf", sec="a.sec": f"named_struct('done', {done}, 'c', {c}, 'pre', {pre}, 'cf', {cf}, 'sec', {sec})"
    done = "if(a.c is null, a.done, array_append(a.done, a.c))"
    after = lambda n: trim(f"substr({t}, {n})")
    start = f"named_struct('cause', {after(9)}, 'mechanism', '', 'effect', '', 'relation', '')"
    step = f"""case
        when startswith({low}, '- cause:') then {st(done=done, c=start)}
        when {low} = 'preconditions:' then {st(done=done, c=none, sec="'p'")}
        when {low} = 'counterfactuals:' then {st(done=done, c=none, sec="'c'")}
        when a.c is not null and startswith({low}, 'mechanism:') then {st(c=put(mechanism=after(11)))}
        when a.c is not null and startswith({low}, 'effect:') then {st(c=put(effect=after(8)))}
        when a.c is not null and startswith({low}, 'relation:') then {st(c=put(relation=after(10)))}
        when startswith({low}, '- ') then {st(done=done, c=none, pre=f"if(a.sec = 'p', array_append(a.pre, {after(3)}), a.pre)", cf=f"if(a.sec = 'c', array_append(a.cf, {after(3)}), a.cf)")}
        else a end"""
    empty = "cast(array() as array<string>)"
    return (
        f"aggregate(split({x}, '\\n'), named_struct('done', cast(array() as array<{link}>), 'c', {none}, 'pre', {empty}, 'cf', {empty}, 'sec', ''), (a, l) -> {step}, "
        f"a -> named_struct('chains', {done}, 'preconditions', a.pre, 'counterfactuals', a.cf))"
    )


def render_causal(chains: str) -> str:
    return f"array_join(transform({chains}, c -> concat('- **', c.cause, '** → ', if(c.mechanism = '', '', concat(c.mechanism, ' → ')), '**', c.effect, '** *(', c.relation, ')*\\n')), '')"


def saved_causal(x: str) -> str:
    """A saved causal analysis (## Causal Chains, ## Preconditions, ## Counterfactuals) as ``causal`` gives a
    fresh one: each line that is not blank counts for its section, and a chain's line is both its cause
    and its effect."""
    part = lambda name: f"filter(transform(flatten(transform(filter(split({x}, '## '), s -> startswith(s, '{name}')), s -> split(substr(s, {len(name) + 1}), '\n'))), l -> {trim('l')}), l -> l <> '')"
    link = "named_struct('cause', l, 'mechanism', '', 'effect', l, 'relation', '')"
    return f"named_struct('chains', transform({part('Causal Chains')}, l -> {link}), 'preconditions', {part('Preconditions')}, 'counterfactuals', {part('Counterfactuals')})"
