"""The registered queries and the SQL twins (DuckDB) of those that SQL can express.

The twins take the plain way: all pairs, all windows, a fold by recursion.  A classifier, Golay keys on
XXH64, byte-pair merges and keyed permutations are beyond SQL; tests compare those with brute force.
"""

from __future__ import annotations

from . import bpe, centroids, decontam, licenses, lines, lsh, pii, quality, sharding, simhash, toxicity, upsert, warc

QUERIES = {
    "op1_quality_classifier": quality.op1,
    "op2_embedding_near_dedup": lsh.op2,
    "op3_bpe_round_trip": bpe.op3,
    "op4_sharding": sharding.op4,
    "op5_pii_pseudonyms": pii.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_warc": warc.op7,
    "op8_decontamination": decontam.op8,
    "op9_line_dedup": lines.op9,
    "op10_license_scan": licenses.op10,
    "op11_upsert": upsert.op11,
    "op12_toxicity": toxicity.op12,
    "op13_centroid_clustering": centroids.op13,
}

_EMBEDDINGS = """with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a), c as (select a, min(b) as c from r group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, c as component_id, c = vec_id as kept from embeddings left join n on n.a = vec_id join c on c.a = vec_id"""

_HASH = "cast(concat('0x', substr(md5({}), 1, 8)) as bigint)"
_SHARDING = f"""with recursive s as (select i, concat('shard-', lpad(cast(i as varchar), 3, '0')) as shard from range({sharding.SHARDS}) t(i)),
h as (select list(shard order by i) as names, list({_HASH.format("concat(shard, '#1')")} % {sharding.SIZE} order by i) as base, list({_HASH.format("concat(shard, '#2')")} % {sharding.SIZE - 1} + 1 order by i) as skip from s),
f(t, own, pos) as (select 0, list_transform(range({sharding.SIZE}), lambda x: cast(-1 as bigint)), list_transform(range({sharding.SHARDS}), lambda x: cast(0 as bigint)) union all
  select t + 1, list_transform(own, lambda x, i: case when i = slot then cast(m as bigint) else x end), list_transform(pos, lambda x, i: case when i = m + 1 then k + 1 else x end)
  from (select t, own, pos, m, k, (b + k * z) % {sharding.SIZE} + 1 as slot from (select *, list_filter(range(pos[m + 1], {sharding.SIZE}), lambda q: own[(b + q * z) % {sharding.SIZE} + 1] < 0)[1] as k
    from (select f.*, t % {sharding.SHARDS} as m, base[t % {sharding.SHARDS} + 1] as b, skip[t % {sharding.SHARDS} + 1] as z from f, h where t < {sharding.SIZE})))),
o as (select own, names from f, h where t = {sharding.SIZE})
select doc_id, cast(slot as integer) as slot, names[own[slot + 1] + 1] as shard from (select doc_id, {_HASH.format("coalesce(cast(doc_id as varchar), chr(0))")} % {sharding.SIZE} as slot from documents), o"""

_WARC = f"""with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
m as (select payload_digest as g, max(page_id) as last from d where payload_bytes >= {warc.MIN_REVISIT} group by payload_digest)
select page_id, payload_bytes, payload_digest, case when last > page_id then 'revisit' else 'response' end as record_type, case when last > page_id then last end as refers_to from d left join m on g = payload_digest"""

_MARK = r"regexp_replace({}, '([.!?]\s|\n)([^\s\x{{FDD0}}])', concat('\1', chr(64976), '\2'), 'g')"
_LINES = f"""with t as (select doc_id, text, string_split({_MARK.format(_MARK.format("coalesce(text, '')"))}, chr(64976)) as p from documents),
x as (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i from t),
l as (select doc_id, i, trim(x, concat(' ', chr(10), chr(13), chr(9))) as s from x),
c as (select doc_id, i, s, least(1 + length(s) - length(replace(s, ' ', '')), 1000) as n, sum(least(1 + length(s) - length(replace(s, ' ', '')), 1000)) over (partition by doc_id order by i) as c from l),
w as (select a.doc_id, a.i as b, e.i as e, a.n as nb, e.n as ne, e.c - a.c + a.n as words from c a join c e on a.doc_id = e.doc_id and e.i between a.i and a.i + {lines.MIN_WORDS - 1}),
g as (select doc_id, b, e from w where words >= {lines.MIN_WORDS} and (words - ne < {lines.MIN_WORDS} or words - nb < {lines.MIN_WORDS})),
k as (select g.doc_id, g.b, g.e, string_agg(s, chr(1) order by i) as k from g join c on c.doc_id = g.doc_id and c.i between g.b and g.e group by all),
o as (select *, first_value(doc_id) over z as fd, first_value(b) over z as fb from k window z as (partition by k order by doc_id, b)),
q as (select distinct doc_id, unnest(range(b, e + 1)) as i from o where (doc_id, b) <> (fd, fb)),
r as (select doc_id, list(i) as cut from q group by doc_id)
select t.doc_id, case when cut is null then text else array_to_string(list_filter(p, lambda y, j: not list_contains(cut, j)), '') end as text, cast(coalesce(len(cut), 0) as integer) as n_removed from t left join r on r.doc_id = t.doc_id"""

_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_WINDOWS = f"""with d as (select doc_id, {_SPLIT.format("text")} as w from documents), b as (select item_id, {_SPLIT.format("text")} as w from benchmark),
iw as (select distinct item_id, least({decontam.WINDOW}, len(w)) as n, unnest(list_transform(range(1, len(w) - least({decontam.WINDOW}, len(w)) + 2), lambda s: w[s:s + least({decontam.WINDOW}, len(w)) - 1])) as g from b where len(w) > 0),
dw as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda s: {{'s': s, 'g': w[s:s + n - 1]}})) as x from d, (select distinct n from iw) where len(w) >= n),
m as (select distinct doc_id, x.s as s, dw.n as n, item_id from dw join iw on iw.n = dw.n and iw.g = x.g),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from m)) group by doc_id),
f as (select doc_id, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as i from m) group by doc_id),
nw as (select row_number() over () as win, * from (select item_id, n, list_distinct(g) as ts, cast(ceil(0.8 * len(list_distinct(g)) - 1e-9) as integer) as k from iw)),
nt as (select win, item_id, 2 * n as span, k, unnest(ts) as t from nw),
dp as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as p from d),
ca as (select doc_id, win from (select distinct doc_id, t from dp) join nt using (t) group by doc_id, win having count(*) >= any_value(k)),
po as (select ca.doc_id, ca.win, item_id, span, k, dp.p, dp.t from ca join nt on nt.win = ca.win join dp on dp.doc_id = ca.doc_id and dp.t = nt.t),
ne as (select distinct doc_id, item_id from (select x.doc_id, x.win, any_value(x.item_id) as item_id, x.p from po x join po y on x.doc_id = y.doc_id and x.win = y.win and y.p between x.p and x.p + x.span - 1 group by x.doc_id, x.win, x.p having count(distinct y.t) >= any_value(x.k))),
nf as (select doc_id, count(*) as n_near, sha256(string_agg(i, ',' order by i)) as near_sha256 from (select doc_id, cast(item_id as varchar) as i from ne) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {decontam.SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near, coalesce(near_sha256, sha256('')) as near_sha256
from d left join h using (doc_id) left join f using (doc_id) left join nf using (doc_id)"""

ORACLES: dict[str, str] = {"op2_embedding_near_dedup": _EMBEDDINGS, "op4_sharding": _SHARDING, "op7_warc": _WARC, "op8_decontamination": _WINDOWS, "op9_line_dedup": _LINES}
