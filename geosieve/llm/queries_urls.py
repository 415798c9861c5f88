"""Query of the URL filter over all pages, with its SQL."""

from __future__ import annotations

from geosieve.llm.tables import read
from geosieve.llm.urls import judge_urls

# Fixed values of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_url_filter(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, folder, "pages"), rules).drop("url")


SQL = """
with rules(host, path, verdict) as (values {rules}),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
urls as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
 coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') as path from cut),
met as (select u.*, r.host || r.path as rule, r.verdict, row_number() over (partition by u.page_id
  order by length(r.host) + length(r.path) desc nulls last, length(r.host) desc) as rn
 from urls u left join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from met where rn = 1
""".format(rules=", ".join(str(r) for r in RULES))

QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {"op3_url_filter": SQL}
