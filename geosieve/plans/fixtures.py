"""Geographic tables derived from the given ones.

One SQL text per table, valid in Spark and in DuckDB alike, so a query and its
SQL check start from the same rows. All of them cover the whole given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DERIVED = {
    # One row per site and station; the station is null for a site without order.
    "raw_sites": """
select cast(c.c_custkey as varchar(20)) as sup_id, cast(o.o_orderkey as varchar(20)) as station_id,
 c.c_nationkey as nature_id,
 concat('7', cast(n.n_regionkey as varchar(20)), lpad(cast(c.c_custkey % 1000 as varchar(20)),3,'0')) as insee,
 48 as lat_deg,
 cast(floor(((c.c_custkey*c.c_custkey*31 + c.c_custkey*7919) % 1801)/60e0) as bigint) as lat_min,
 ((c.c_custkey*c.c_custkey*31 + c.c_custkey*7919) % 1801) % 60 as lat_sec, 'N' as lat_dir,
 2 as lon_deg,
 cast(floor(((c.c_custkey*c.c_custkey*17 + c.c_custkey*104729) % 2003)/60e0) as bigint) as lon_min,
 ((c.c_custkey*c.c_custkey*17 + c.c_custkey*104729) % 2003) % 60 as lon_sec,
 case when c.c_custkey % 7 = 0 then 'W' else 'E' end as lon_dir, c.c_acctbal as height
from customer c join nation n on n.n_nationkey=c.c_nationkey left join orders o on o.o_custkey=c.c_custkey
""",
    "sites": """
select sup_id, count(distinct station_id) as nb_stations, min(nature_id) as nature_id,
 min(insee) as insee, min(height) as height,
 min(lat_deg + lat_min/60e0 + lat_sec/3600e0) as latitude,
 min((lon_deg + lon_min/60e0 + lon_sec/3600e0)*case when lon_dir='W' then -1e0 else 1e0 end) as longitude
from raw_sites group by sup_id
""",
    # k is the site at the zone's centre; 5 x 5 patches of 1024 px at zoom 19.
    "boxes": """
select event_id as detection_id, event_id % 150 as k, concat('Z', cast(event_id % 150 as varchar(20))) as zone_id,
 cast(floor(event_id/150e0) as bigint) % 5 as prow,
 (cast(floor(event_id/150e0) as bigint) + cast(floor(event_id/750e0) as bigint)) % 5 as pcol,
 value/1000e0 as confidence,
 (event_id*event_id*13+event_id*89) % 953 as x1, (event_id*event_id*29+event_id*53) % 947 as y1,
 (event_id*event_id*13+event_id*89) % 953 + 16 + event_id % 48 as x2,
 (event_id*event_id*29+event_id*53) % 947 + 16 + (event_id*7) % 48 as y2
from events
""",
    "site_px": """
select sup_id, (longitude+180e0)/360e0*134217728e0 as px,
 (1e0 - ln(tan(radians(latitude)) + sqrt(tan(radians(latitude))*tan(radians(latitude))+1e0))/pi())/2e0*134217728e0 as py
from sites
""",
    "box_px": """
select b.*, z.px - 2560e0 + b.pcol*1024 + (b.x1+b.x2)/2e0 as gx, z.py - 2560e0 + b.prow*1024 + (b.y1+b.y2)/2e0 as gy
from boxes b join site_px z on z.sup_id = cast(b.k as varchar(20))
""",
    "detections": """
select detection_id, zone_id, confidence, x1,y1,x2,y2, gx/134217728e0*360e0-180e0 as longitude,
 degrees(atan((exp(pi()-2e0*pi()*gy/134217728e0)-exp(-(pi()-2e0*pi()*gy/134217728e0)))/2e0)) as latitude
from box_px
""",
    "annotations": """
select cast(c_custkey as varchar(20)) as sup_id, concat('site_', cast(c_custkey as varchar(20)), '.jpg') as image,
 case when cast(floor(c_custkey/10e0) as bigint) % 10 < 7 then 'train' when cast(floor(c_custkey/10e0) as bigint) % 10 = 7 then 'val' else 'test' end as split,
 case when c_custkey % 10 = 0 then 'ambigu' when c_custkey % 10 = 1 then 'non_visible' else 'visible' end as status,
 case when c_custkey % 10 > 1 then 400e0 + (c_custkey*37) % 150 end as x1,
 case when c_custkey % 10 > 1 then 380e0 + (c_custkey*53) % 170 end as y1,
 case when c_custkey % 10 > 1 then 440e0 + (c_custkey*37) % 150 + c_custkey % 80 end as x2,
 case when c_custkey % 10 > 1 then 420e0 + (c_custkey*53) % 170 + (c_custkey*7) % 80 end as y2,
 c_mktsegment as classe_niveau2
from customer
""",
    "predictions": """
select event_id as pred_id, concat('site_', cast(event_id % 150 as varchar(20)), '.jpg') as image, value/1000e0 as confidence,
 370e0 + ((event_id % 150)*37) % 150 + (event_id*7) % 61 as x1, 350e0 + ((event_id % 150)*53) % 170 + (event_id*11) % 61 as y1,
 410e0 + ((event_id % 150)*37) % 150 + (event_id % 150) % 80 + (event_id*7) % 61 as x2,
 390e0 + ((event_id % 150)*53) % 170 + ((event_id % 150)*7) % 80 + (event_id*11) % 61 as y2
from events
""",
    # Review of detections; every fifth is not reviewed, some statuses need trimming.
    "reviews": """
select event_id as detection_id,
 case when event_id % 5 = 0 then 'plausible' when event_id % 5 = 1 then ' faux_positif ' when event_id % 5 = 2 then 'incertain'
  when event_id % 5 = 3 then 'plausible' end as review_status,
 event_type as support_type,
 case when event_id % 11 = 0 then 'Oui' when event_id % 11 = 1 then 'true' when event_id % 11 = 2 then '1' when event_id % 11 = 3 then 'no'
  when event_id % 11 = 4 then null else 'False' end as selection_finale
from events
""",
    # Image names as users write them: bare id, prefixed, with other numbers, none.
    "images": """
select event_id as image_no,
 case when event_id % 4 = 0 then concat(cast(event_id % 997 as varchar(20)), '.jpg')
  when event_id % 4 = 1 then concat('in/support_', cast(event_id % 997 as varchar(20)), '.png')
  when event_id % 4 = 2 then concat('scan99999999_', cast(event_id % 997 as varchar(20)), '_v2.jpeg')
  else concat('photo_', event_type, '.jpg') end as filename
from events
""",
    # Training histories of 40 runs; the order's key is the epoch.
    "history": """
select concat('run_', cast(o_custkey % 40 as varchar(20))) as run, o_orderkey as epoch,
 cast((o_orderkey*7919) % 1000 as double)/1000e0 as map50, cast((o_orderkey*104729) % 500 as double)/1000e0 as map50_95,
 cast((o_orderkey*31) % 997 as double)/997e0 as prec, cast((o_orderkey*17) % 991 as double)/991e0 as rec
from orders
""",
    "experiments": """
select p_partkey as experiment_id, p_name as experiment, p_brand as evaluation_split,
 cast((p_partkey*7919) % 10007 as double)/10007e0 as map50
from part
""",
}

def with_tables(body: str) -> str:
    """Put the definitions of the derived tables a statement mentions before it."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for other in DERIVED:
            if other != name and re.search(rf"\b{other}\b", DERIVED[name]) and other not in chosen:
                add(other)
        if name not in chosen:
            chosen.append(name)

    for name in DERIVED:
        if re.search(rf"\b{name}\b", body):
            add(name)
    parts = [f"{name} as ({DERIVED[name].strip()})" for name in chosen]
    if not parts:
        return body
    text = body.lstrip()
    if re.match(r"with\s+recursive\b", text, re.I):
        rest = re.sub(r"^with\s+recursive\s+", "", text, flags=re.I)
        return "with recursive " + ",\n".join(parts) + ",\n" + rest
    if re.match(r"with\b", text, re.I):
        rest = re.sub(r"^with\s+", "", text, flags=re.I)
        return "with " + ",\n".join(parts) + ",\n" + rest
    return "with " + ",\n".join(parts) + "\n" + text


class Tables:
    """The given and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, body: str) -> DataFrame:
        """Run a statement over given and derived tables."""
        statement = with_tables(body)
        used = [n for n in BASE if re.search(rf"\b(from|join)\s+{n}\b", statement)]
        frames = {n: self.base(n) for n in used}
        marked = statement
        for n in used:
            marked = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}} {n}", marked)
            marked = re.sub(rf"\}} {n} ([a-z])\b(?!\.)", r"} \1", marked)
        return self.spark.sql(marked, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    @property
    def raw_export(self) -> DataFrame:
        """raw_sites under the source format's column names, all text."""
        t = self.raw_sites
        names = {
            "sup_id": "SUP_ID", "station_id": "STA_NM_ANFR", "nature_id": "NAT_ID",
            "lat_deg": "COR_NB_DG_LAT", "lat_min": "COR_NB_MN_LAT", "lat_sec": "COR_NB_SC_LAT",
            "lat_dir": "COR_CD_NS_LAT", "lon_deg": "COR_NB_DG_LON", "lon_min": "COR_NB_MN_LON",
            "lon_sec": "COR_NB_SC_LON", "lon_dir": "COR_CD_EW_LON", "height": "SUP_NM_HAUT",
            "insee": "COM_CD_INSEE",
        }
        return t.select(*[t[a].cast("string").alias(b) for a, b in names.items()])

    @property
    def natures(self) -> DataFrame:
        return self.base("nation").selectExpr("n_nationkey as NAT_ID", "n_name as NAT_LB_NOM")

    @property
    def catalogue(self) -> DataFrame:
        """The site catalogue under its usual column names."""
        return self.sql(
            "select s.sup_id as SUP_ID, s.nb_stations as NB_STATIONS_ANFR, s.nature_id as NAT_ID, "
            "n.n_name as NAT_LB_NOM, s.latitude, s.longitude, s.height as SUP_NM_HAUT, "
            "s.insee as COM_CD_INSEE from sites s join nation n on n.n_nationkey = s.nature_id"
        )
