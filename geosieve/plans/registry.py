"""Named queries over the given tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geosieve.plans.fixtures import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` and the statement with the same result."""
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return build

    return register


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(power(sin((radians({lat2})-radians({lat1}))/2e0),2) + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*power(sin((radians({lon2})-radians({lon1}))/2e0),2))"
    )
    return f"(2e0*6371008.8e0*atan2(sqrt({a}), sqrt(greatest(0e0, 1e0-{a}))))"


def split_distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(power(sin((radians({lat2})-radians({lat1}))/2e0),2) + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*power(sin((radians({lon2})-radians({lon1}))/2e0),2))"
    )
    return f"(2e0*6371000e0*asin(sqrt(least(1e0, {a}))))"


WORLD = "134217728e0"


def world_lat_sql(py: str) -> str:
    n = f"(pi()-2e0*pi()*({py})/{WORLD})"
    return f"degrees(atan((exp({n})-exp(-{n}))/2e0))"


# Every detection lies within 0.72 km of its zone's centre site, so the window of
# +-0.02 and +-0.03 degrees always holds the nearest site.
NEAR = f"""
near as (
 select * from (
  select d.*, s.sup_id as nearest_sup_id, s.latitude as site_lat, s.longitude as site_lon,
   {haversine_sql('d.latitude', 'd.longitude', 's.latitude', 's.longitude')} as dist,
   row_number() over (partition by d.detection_id order by
    {haversine_sql('d.latitude', 'd.longitude', 's.latitude', 's.longitude')}, s.sup_id) as rn
  from detections d join sites s on s.latitude between d.latitude-0.02 and d.latitude+0.02
   and s.longitude between d.longitude-0.03 and d.longitude+0.03) q where rn = 1)
"""
FAR = NEAR + ", far as (select * from near where dist >= 150)"
# Close pairs of far detections, their components and the cluster table.
PAIRS = FAR + f""", pairs as (
 select a.zone_id, a.detection_id as a, b.detection_id as b from far a join far b
  on a.zone_id = b.zone_id and a.detection_id <> b.detection_id
  and abs(a.latitude - b.latitude) < 0.001
  and {haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 30)"""
COMPONENTS = PAIRS + """, reach(id, root) as (
 select detection_id, detection_id from far
 union select p.b, r.root from reach r join pairs p on p.a = r.id),
 comp as (select id, min(root) as component from reach group by id)"""
CLUSTERS = COMPONENTS + """, placed as (
 select f.*, c.component, row_number() over (partition by c.component order by f.confidence desc, f.detection_id) as place,
  count(*) over (partition by c.component) as n, max(f.confidence) over (partition by c.component) as top,
  max(f.dist) over (partition by c.component) as far_m,
  string_agg(cast(f.detection_id as varchar), ',') over (partition by c.component order by f.detection_id rows between unbounded preceding and unbounded following) as ids
 from far f join comp c on c.id = f.detection_id),
 clusters as (select * from placed where place = 1),
 numbered as (select *, row_number() over (order by zone_id, confidence desc, component) as no,
  row_number() over (partition by zone_id order by confidence desc, component) as zone_no,
  row_number() over (partition by zone_id order by confidence desc, detection_id) as review_no from clusters)"""
