"""Query of the removal of repeated byte strings over all documents, with its SQL."""

from __future__ import annotations

from geosieve.llm.suffixes import remove_repeats
from geosieve.llm.tables import read


def op6_suffix_dedup(spark, folder):
    return remove_repeats(read(spark, folder, "documents"))


SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
g as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d)),
hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as lo from g) where lo < doc_id),
runs as (select doc_id, min(i) as b, max(i) + 50 as e from
 (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from
  (select doc_id, i, case when i - lag(i, 1, -1000) over (partition by doc_id order by i) > 50 then 1 else 0 end as fresh from hit))
 group by doc_id, run),
cut as (select doc_id, count(*) as n, sum(e - b) as r, list(b order by b) as bs, list(e order by b) as es from runs group by doc_id),
kept as (select c.doc_id, string_agg(substr(h, 2 * cast(case when k = 1 then 0 else es[k - 1] end as bigint) + 1,
  2 * cast(case when k = n + 1 then length(h) // 2 else bs[k] end - case when k = 1 then 0 else es[k - 1] end as bigint)), '' order by k) as x
 from (select *, unnest(range(1, n + 2)) as k from cut) c join d on d.doc_id = c.doc_id group by c.doc_id)
select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(r, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans,
 sha256(unhex(coalesce(x, h))) as kept_sha256
from d left join cut using (doc_id) left join kept using (doc_id)
"""

QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES = {"op6_suffix_dedup": SQL}
