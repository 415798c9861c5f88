"""Query of the prefix trie over all conversations, with its SQL."""

from __future__ import annotations

from geosieve.llm.prefixes import prefix_trie
from geosieve.llm.tables import read


def op12_prefix_trie(spark, folder):
    return prefix_trie(read(spark, folder, "conversations"))


# The checksum of an id by its table, byte by byte; a node is known by a digest of its turns; a node's
# subtree is all nodes whose first conversation passes through it.
SQL = """
with recursive bits(i, k, v) as (
 select i, 0, i from range(256) t(i) union all
 select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bits where k < 8),
sizes as (select conv_id, cast(conv_id as varchar) as s, count(*) as own from conversations where conv_id is not null group by conv_id),
sums(conv_id, s, place, v) as (
 select conv_id, s, 0, cast(4294967295 as bigint) from sizes union all
 select w.conv_id, w.s, w.place + 1, xor(b.v, w.v // 256) from sums w join bits b on b.k = 8 and b.i = xor(w.v % 256, ascii(substr(w.s, w.place + 1, 1)))
 where w.place < length(w.s)),
convs as (
 select z.conv_id, z.own, z.conv_id - z.conv_id % 100 as base, xor(c.v, 4294967295) % 6 as h, least(xor(c.v, 4294967295) % 6, coalesce(b.own, 0)) as taken
 from sizes z join sums c on c.conv_id = z.conv_id and c.place = length(z.s) left join sizes b on b.conv_id = z.conv_id - z.conv_id % 100),
ranked as (
 select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
turns as (
 select c.conv_id, r.pos as d, r.role, r.text from convs c join ranked r on r.conv_id = c.base and r.pos <= c.h
 union all select c.conv_id, r.pos - c.h + c.taken, r.role, r.text from convs c join ranked r on r.conv_id = c.conv_id and r.pos > c.h),
paths(conv_id, d, node, parent, chars) as (
 select conv_id, cast(0 as bigint), '', '', cast(0 as bigint) from convs union all
 select t.conv_id, t.d, sha256(p.node || sha256(t.role) || sha256(t.text)), p.node, cast(length(t.text) as bigint)
 from paths p join turns t on t.conv_id = p.conv_id and t.d = p.d + 1),
ends as (select conv_id, max(d) as d from paths group by conv_id),
nodes as (
 select p.d, p.node, min(p.parent) as parent, min(p.conv_id) as conv_id, count(*) as n, max(p.chars) as chars,
  string_agg(case when e.d = p.d then cast(p.conv_id as varchar) end, ',' order by p.conv_id) as ids
 from paths p join ends e on e.conv_id = p.conv_id group by p.d, p.node),
kids as (select d - 1 as d, parent as node, count(*) as n from nodes where d > 0 group by d, parent),
below as (
 select a.d, a.node, sum(case when k.n is null then 1 else 0 end) as leaves, sum((y.n - 1) * y.chars) as saved
 from nodes y join paths a on a.conv_id = y.conv_id and a.d <= y.d left join kids k on k.d = y.d and k.node = y.node group by a.d, a.node)
select x.conv_id, x.d as depth, u.conv_id as parent_conv_id, x.n as n_convs, coalesce(k.n, 0) as n_children,
 cast(b.leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens, sha256(coalesce(x.ids, '')) as ends_sha256
from nodes x join below b on b.d = x.d and b.node = x.node left join kids k on k.d = x.d and k.node = x.node
left join nodes u on x.d > 0 and u.d = x.d - 1 and u.node = x.parent
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": SQL}
