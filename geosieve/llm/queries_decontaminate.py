"""Query of the benchmark decontamination over all documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.llm.decontaminate import contamination
from geosieve.llm.tables import read


def op1_decontaminate(spark, folder):
    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select doc_id, coalesce({WORDS.format('text')}, []) as w from documents),
b as (select item_id, coalesce({WORDS.format('text')}, []) as w from benchmark),
wins as (select distinct item_id, least(13, len(w)) as n,
 array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as g
 from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from b where len(w) > 0)),
spans as (select distinct n from wins),
placed as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from
 (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, spans where len(w) >= n)),
hit as (select a.doc_id, a.i, a.n, x.item_id from placed a join wins x on x.n = a.n and x.g = a.g),
cov as (select doc_id, count(distinct j) as n_hit from
 (select doc_id, unnest(generate_series(i, i + n - 1)) as j from (select distinct doc_id, i, n from hit)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names from
 (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
 sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": SQL}
