"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op3_exact_dedup"] = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), g as (select text_sha256, min(doc_id) as keep_id, count(*)::bigint as group_size from t group by 1)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256
from t join g using (text_sha256)
"""

ORACLES["op10_mix_sources"] = r"""
with d as (
  select doc_id, source,
    coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
    (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source
), l as (
  select *, sum(source_size) over () - coalesce(sum(cap) over w, 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over w, 0) as rest_weight
  from s window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), c as (select *, cap * rest_weight <= rest * weight as capped from l), v as (
  select *, (sum(source_size) over () - coalesce(sum(case when capped then cap end) over (), 0))::double
    / (sum(case when not capped then weight end) over ())::double as level
  from c
), t as (
  select source, source_size, case when capped then cap::double else weight::double * level end as target from v
), r as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then least(t.target / t.source_size, 3.0) else 0.0 end as rate,
    (('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint)::double / 4503599627370496.0 as draw
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (floor(rate)::bigint + (draw < rate - floor(rate))::bigint))::bigint as taken
from r
"""

ORACLES["op6_exact_topk"] = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

ORACLES["op7_substring_dedup"] = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, unnest(range(1, len(w) - 18)) as i, w from d where len(w) >= 20
), h as (
  select doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) as h from s
), r as (
  select doc_id, i from (select *, row_number() over (partition by h order by doc_id, i) as k from h) where k > 1
), c as (
  select distinct doc_id, unnest(range(i, i + 20)) as p from r
), g as (
  select doc_id, list(p) as gone from c group by doc_id
), k as (
  select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
    case when gone is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(gone, z[2])), lambda z: z[1]) end as kept
  from d left join g on d.doc_id = g.doc_id
)
select doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k
"""

ORACLES["op1_minhash_dedup"] = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select distinct doc_id, array_to_string(case when len(w) < 4 then w else w[i:i + 3] end, ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id), o as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all
), e as (
  select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)
), r as (
  select doc_id, doc_id as root from d union select e.a, r.root from r join e on e.b = r.doc_id
), c as (select doc_id, min(root) as component_id from r group by doc_id)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept
from c left join n using (doc_id)
"""
