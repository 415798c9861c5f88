"""Query of the near-duplicate vectors over all embeddings, with its SQL."""

from __future__ import annotations

from geosieve.llm.tables import read
from geosieve.llm.vectors import near_vectors


def op5_vector_dedup(spark, folder):
    return near_vectors(read(spark, folder, "embeddings"))


SQL = """
with recursive v as (select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings),
ok as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as n from v where label is not null and e is not null
 and len([x for x in e if x is null or isnan(x) or isinf(x)]) = 0 and list_inner_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
 where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(id, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from reach r join links l on l.a = r.id),
roots as (select id, min(root) as root from reach group by id)
select e.vec_id, coalesce(n, 0) as n_links, root as component_id, e.vec_id = root as kept
from embeddings e left join (select a, count(*) as n from links group by a) l on l.a = e.vec_id join roots on roots.id = e.vec_id
"""

QUERIES = {"op5_vector_dedup": op5_vector_dedup}
ORACLES = {"op5_vector_dedup": SQL}
