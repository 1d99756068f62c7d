"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op7_bpe_codec
from .jaccard_join import op8_jaccard_join
from .language_id import op4_language_id
from .license_scan import op1_license_scan
from .packing import op9_best_fit_packing
from .quality_classifier import op3_quality_classifier
from .quality_rules import op2_quality_rules
from .sharding import op5_sharding
from .suffix_dedup import op10_suffix_dedup
from .topk_search import op6_topk_search

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_quality_classifier, op4_language_id, op5_sharding, op6_topk_search, op7_bpe_codec, op8_jaccard_join, op9_best_fit_packing, op10_suffix_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op6_topk_search": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op8_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when ws is null or len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
n as (select doc_id, len(sh) as n from s),
t as (select doc_id, unnest(sh) as g from s),
o as (select a.doc_id as x, b.doc_id as y, count(*) as k from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from o join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 80 * (nx.n + ny.n - k)),
e as (select x, y from l union select y, x from l),
reach(a, b) as (select doc_id, doc_id from n union select r.a, e.y from reach r join e on e.x = r.b),
c as (select a, min(b) as component_id from reach group by a)
select doc_id, cast(n as bigint) as n_shingles, component_id from n join c on c.a = n.doc_id""",
}
