"""Query of the near-duplicate search over all documents, with its SQL."""

from __future__ import annotations

from geosieve.llm.minhash import near_duplicates
from geosieve.llm.tables import read


def op2_minhash_dedup(spark, folder):
    return near_duplicates(read(spark, folder, "documents"))


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
sh as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as s from
 (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
sets as (select doc_id, md5(string_agg(s, chr(10) order by s)) as k from sh group by doc_id),
reps as (select min(doc_id) as rep, k from sets group by k),
rs as (select sh.* from sh join reps on sh.doc_id = reps.rep),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from rs a join rs b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
sides as (select a, b from links union all select b, a from links),
reach(id, root) as (select rep, rep from reps union select s.b, r.root from reach r join sides s on s.a = r.id),
roots as (select id, min(root) as root from reach group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(roots.root, d.doc_id) as component_id,
 d.doc_id = coalesce(roots.root, d.doc_id) as kept
from d left join n using (doc_id) left join sets using (doc_id) left join reps using (k) left join roots on roots.id = reps.rep
"""

QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
ORACLES = {"op2_minhash_dedup": SQL}
