"""DuckDB SQL of the queries of this subpackage that SQL can express.

The others hash words, sort suffixes, train weights or encode tokens; tests hold them
against brute force.
"""

from __future__ import annotations

_REPLICA = """
select record_id, record_id // 4096 as file, strlen(record) as length, sha256(record) as sha256,
  sum(strlen(record)) over (partition by record_id // 4096 order by record_id, sha256(record)) - strlen(record) as start,
  row_number() over (partition by record_id order by sha256(record)) - 1 as copy
from (
  select page_id as record_id, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || coalesce(url, '')
    || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(coalesce(html, '')) || nl || nl || coalesce(html, '') || nl || nl as record
  from {pages}, (select chr(13) || chr(10) as nl) where page_id is not null)
"""

_OP4 = f"""
with damaged as (
  select page_id, url, case when page_id % 1000 in (7, 407, 807) then 'x' || substr(html, 2) when page_id % 1000 = 123 then left(html, greatest(length(html) - 1, 0)) else html end as html
  from pages where page_id % 1000 <> 661),
a as ({_REPLICA.format(pages="pages")}), b as ({_REPLICA.format(pages="damaged")}),
d as (
  select coalesce(a.record_id, b.record_id) as record_id, coalesce(a.file, b.file) as file, coalesce(a.copy, b.copy) as copy,
    case when b.sha256 is null then 'missing' when a.sha256 is null then 'extra' when a.sha256 <> b.sha256 then 'changed' end as state,
    a.start as offset_a, a.length as length_a, a.sha256 as sha256_a, b.start as offset_b, b.length as length_b, b.sha256 as sha256_b
  from a full join b on a.record_id = b.record_id and a.copy = b.copy)
select record_id, copy, state, offset_a, length_a, sha256_a, offset_b, length_b, sha256_b,
  sum(coalesce(length_b, 0) - coalesce(length_a, 0)) over (partition by file order by record_id, copy) as shift
from d where state is not null
"""

_OP5 = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
fine as (
  select * from v where vec_id is not null and label is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from fine a join fine b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id, vec_id as r from v union select reach.vec_id, links.b from reach join links on links.a = reach.r),
comp as (select vec_id, min(r) as component_id from reach group by vec_id),
n as (select a as vec_id, count(*) as n_links from links group by a)
select v.vec_id, coalesce(n.n_links, 0) as n_links, comp.component_id, v.vec_id = comp.component_id as kept
from v left join comp on comp.vec_id = v.vec_id left join n on n.vec_id = v.vec_id
"""



def _op12(clusters: int = 40, rounds: int = 5, width: int = 64) -> str:
    """Lloyd's rounds one after the other, over all rows; the vectors are lists of whole numbers."""
    near = "(select vec_id, q, k, d from (select v.vec_id, v.row, v.q, c.k, list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v, {c} c) as x qualify row_number() over (partition by row order by d, k) = 1)"
    parts = [
        f"v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by h, q) - 1 as k, q as c from (select sha256('2:' || vec_id) as h, q from v where vec_id is not null order by h, q limit {clusters}) as x)",
    ]
    # Whole-number division goes toward zero, so the remainder is taken off first.
    floor = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    for i in range(rounds):
        parts += [
            f"a{i} as materialized {near.format(c=f'c{i}')}",
            f"m{i} as (select k, j, {floor} as x from (select k, unnest(range({width})) as j, unnest(q) as x from a{i}) as y group by k, j)",
            f"c{i + 1} as materialized (select c.k, coalesce(n.c, c.c) as c from c{i} c left join (select k, list(x::bigint order by j) as c from m{i} group by k) n using (k))",
        ]
    parts.append(f"a as materialized {near.format(c=f'c{rounds}')}")
    return (
        f"with {', '.join(parts)} select a.vec_id, a.k::integer as cluster, a.d::bigint as distance, sum(a.d) over (partition by a.k)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia, "
        f"sha256(array_to_string(c.c, ',')) as centroid_sha256 from a join c{rounds} c using (k)"
    )


ORACLES: dict[str, str] = {"op4_warc_fixity": _OP4, "op5_embedding_dedup": _OP5, "op12_centroid_clusters": _op12()}
