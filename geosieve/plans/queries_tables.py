"""Queries on sources, sinks, cleaning, checks and row-local expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.config import Imagery
from geosieve.functions import boxes, geo, text
from geosieve.operators import annotations as ann
from geosieve.operators import catalogue as cat
from geosieve.operators import checks, evaluation, images, review, zones
from geosieve.operators.candidates import far_filter
from geosieve.operators.spread import scratch_path
from geosieve.plans.registry import (
    WORLD, haversine_sql, query, split_distance_sql, world_lat_sql,
)
from geosieve.sources import readers, writers

MAP_URL = "https://example.org/lonlat/"


def num(text_sql: str) -> str:
    return (
        f"case when regexp_matches(trim({text_sql}), '{text.NUMBER}') "
        f"then try_cast(trim({text_sql}) as double) end"
    )


# ---- sources and sinks -------------------------------------------------------

CATALOGUE_SQL = "select sup_id, nb_stations, round(latitude, 9) as latitude, round(longitude, 9) as longitude from sites"


def _catalogue_out(df):
    return df.select(
        F.col("SUP_ID").alias("sup_id"), F.col("NB_STATIONS_ANFR").cast("long").alias("nb_stations"),
        F.round(F.col("latitude").cast("double"), 9).alias("latitude"),
        F.round(F.col("longitude").cast("double"), 9).alias("longitude"),
    )


@query("src_csv", CATALOGUE_SQL)
def src_csv(t):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.catalogue, path)
    return _catalogue_out(readers.read_csv(t.spark, path))


@query("src_semicolon_encodings", """
select e.enc, s.sup_id, s.insee, concat('Pylône ', n.n_name) as nature from sites s
 join nation n on n.n_nationkey = s.nature_id join (select 'latin1' as enc union all select 'utf8') e on true
""")
def src_semicolon_encodings(t):
    named = t.catalogue.withColumn("NAT_LB_NOM", F.concat(F.lit("Pylône "), "NAT_LB_NOM"))
    parts = []
    for tag, encoding in (("latin1", "ISO-8859-1"), ("utf8", "UTF-8")):
        path = scratch_path(t.spark, "semicolon")
        writers.write_csv(named, path, sep=";", encoding=encoding)
        df = readers.read_semicolon(t.spark, path)
        parts.append(df.select(
            F.lit(tag).alias("enc"), F.col("SUP_ID").alias("sup_id"),
            F.col("COM_CD_INSEE").alias("insee"), F.col("NAT_LB_NOM").alias("nature"),
        ))
    return parts[0].unionByName(parts[1])


@query("src_sniff_sep", """
select e.sep, s.sup_id, s.insee, cast(s.nature_id as varchar) as nature_id from sites s
 join (select ',' as sep union all select ';') e on true
""")
def src_sniff_sep(t):
    parts = []
    for sep in (",", ";"):
        path = scratch_path(t.spark, "sniff")
        writers.write_csv(t.catalogue, path, sep=sep)
        df = readers.read_any_csv(t.spark, path)
        parts.append(df.select(
            F.lit(sep).alias("sep"), F.col("SUP_ID").alias("sup_id"),
            F.col("COM_CD_INSEE").alias("insee"), F.col("NAT_ID").alias("nature_id"),
        ))
    return parts[0].unionByName(parts[1])


@query("src_multi_tagged", """
select split as source, sup_id, status, x1, case when split = 'train' then classe_niveau2 end as kind from annotations
""")
def src_multi_tagged(t):
    folder = scratch_path(t.spark, "tagged")
    paths = []
    for split in ("train", "val", "test"):
        part = t.annotations.filter(F.col("split") == split).drop("split")
        if split != "train":
            part = part.drop("classe_niveau2")
        paths.append(f"{folder}/{split}.csv")
        writers.write_csv(part.withColumnRenamed("sup_id", "SUP_ID"), paths[-1])
    df = readers.read_tagged(t.spark, paths)
    return df.select(
        "source", F.col("SUP_ID").alias("sup_id"), "status", "x1",
        F.col("classe_niveau2").alias("kind"),
    )


@query("src_csv_line_breaks", "select cast(doc_id as varchar) as doc_id, text, lang from documents")
def src_csv_line_breaks(t):
    path = scratch_path(t.spark, "breaks")
    writers.write_csv(t.base("documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(t.spark, path)


@query("src_null_words", """
select sup_id, case when nature_id % 3 <> 0 then insee end as insee, case when nature_id % 5 <> 0 then round(latitude, 9) end as latitude from sites
""")
def src_null_words(t):
    path = scratch_path(t.spark, "words")
    words = F.element_at(F.lit(["NA", "n/a", "null", "None", "#N/A"]), F.pmod(F.xxhash64("SUP_ID"), F.lit(5)).cast("int") + 1)
    named = t.catalogue.select(
        "SUP_ID", F.when(F.col("NAT_ID") % 3 == 0, words).otherwise(F.col("COM_CD_INSEE")).alias("COM_CD_INSEE"),
        F.when(F.col("NAT_ID") % 5 == 0, F.lit("NaN")).otherwise(F.col("latitude").cast("string")).alias("latitude"))
    writers.write_csv(named, path)
    df = readers.read_csv(t.spark, path)
    return df.select(F.col("SUP_ID").alias("sup_id"), F.col("COM_CD_INSEE").alias("insee"), F.round("latitude", 9).alias("latitude"))


SWEEP_CTE = """
with usable as (select * from annotations where status <> 'ambigu'),
th(threshold) as (values {values}),
m as (select p.image, p.confidence, case when u.status = 'visible' then {iou} end as iou
 from predictions p join usable u on u.image = p.image),
per as (select t.threshold, u.image, u.status, count(m.image) as n, coalesce(max(m.iou), 0e0) as best
 from th t cross join usable u left join m on m.image = u.image and m.confidence >= t.threshold group by all),
tot as (select threshold, sum(case when status='visible' and best >= 0.5 then 1 else 0 end)::bigint as tp,
 sum(n - case when status='visible' and best >= 0.5 then 1 else 0 end)::bigint as fp,
 sum(case when status='visible' and best < 0.5 then 1 else 0 end)::bigint as fn from per group by threshold),
rates as (select *, case when tp+fp > 0 then tp/(tp+fp) else 0e0 end as pr, case when tp+fn > 0 then tp/(tp+fn) else 0e0 end as rc from tot),
f as (select *, case when pr+rc > 0 then 2e0*pr*rc/(pr+rc) else 0e0 end as f1 from rates)
"""
IOU_SQL = (
    "(greatest(0e0, least(p.x2,u.x2)-greatest(p.x1,u.x1))*greatest(0e0, least(p.y2,u.y2)-greatest(p.y1,u.y1)))"
    "/((p.x2-p.x1)*(p.y2-p.y1)+(u.x2-u.x1)*(u.y2-u.y1)"
    "-greatest(0e0, least(p.x2,u.x2)-greatest(p.x1,u.x1))*greatest(0e0, least(p.y2,u.y2)-greatest(p.y1,u.y1)))"
)
SWEEP = SWEEP_CTE.format(values=", ".join(f"({v}::double)" for v in evaluation.THRESHOLDS), iou=IOU_SQL)


def named_annotations(t):
    return t.annotations.withColumnRenamed("sup_id", "SUP_ID")


def sweep(t):
    return evaluation.threshold_sweep(t.predictions, named_annotations(t))


@query("src_json", SWEEP + """
select threshold, tp, fp, fn, round(pr, 9) as "precision", round(rc, 9) as recall, round(f1, 9) as f1,
 (select threshold from f order by f1 desc, threshold limit 1) as best_threshold from f
""")
def src_json(t):
    rows = F.struct("threshold", "TP", "FP", "FN", "precision", "recall", "f1")
    document = sweep(t).agg(
        F.max(F.when(F.col("is_best"), F.col("threshold"))).alias("best_threshold"),
        F.array_sort(F.collect_list(rows)).alias("all_thresholds"),
    )
    path = scratch_path(t.spark, "sweep")
    writers.write_summary(document, path)
    df = readers.read_sweep(t.spark, path)
    return df.select(
        "threshold", F.col("TP").alias("tp"), F.col("FP").alias("fp"), F.col("FN").alias("fn"),
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "best_threshold",
    )


@query("src_run_histories", "select run, epoch, map50, map50_95, prec, rec from history")
def src_run_histories(t):
    path = scratch_path(t.spark, "histories")
    table = t.history.withColumnsRenamed({
        "map50": "metrics/mAP50(B)", "map50_95": "metrics/mAP50-95(B)",
        "prec": "metrics/precision(B)", "rec": "metrics/recall(B)",
    })
    writers.write_csv(table, path, partition_by="run")
    df = readers.read_histories(t.spark, path, "run=*/*.csv", r"run=([^/]+)/[^/]+$")
    return df.select("run", "epoch", "map50", "map50_95", "prec", "rec")


def _label_shards(t):
    labels = ann.human_labels(named_annotations(t))
    number = F.col("SUP_ID").cast("long")
    return labels.select(
        F.floor(number / 1000).cast("long").alias("shard"), number.alias("no"),
        F.concat_ws(" ", "image", F.rtrim(F.regexp_replace("label", "\n", ""))).alias("line"),
    )


LABEL_SQL = """
case when status = 'visible' then printf('0 %.8f %.8f %.8f %.8f', (x1+x2)/2e0/1024e0, (y1+y2)/2e0/1024e0, (x2-x1)/1024e0, (y2-y1)/1024e0) else '' end
"""


@query("src_file_inventory", f"""
with l as (select cast(floor(cast(sup_id as bigint)/1000e0) as bigint) as shard, cast(sup_id as bigint) as no,
 concat(image, ' ', {LABEL_SQL}) as line from annotations where status <> 'ambigu'),
f as (select shard, string_agg(line || chr(10), '' order by no) as content from l group by shard)
select concat('shard-', cast(shard as varchar)) as file, true as present, true as size_ok, true as sha256_ok,
 cast(strlen(content) as bigint) as length, sha256(content) as sha256 from f
""")
def src_file_inventory(t):
    shards = _label_shards(t)
    path = scratch_path(t.spark, "inventory")
    # One file per shard of at most 1000 label lines.
    ordered = shards.repartition("shard").sortWithinPartitions("shard", "no")
    ordered.select("shard", F.col("line").alias("value")).write.partitionBy("shard").text(path)
    files = readers.list_files(t.spark, path, "*.txt", digest=True)
    shard = F.regexp_extract("path", r"shard=(\d+)/", 1)
    files = files.withColumn("file", F.concat(F.lit("shard-"), shard))
    content = F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    manifest = shards.groupBy("shard").agg(content.alias("content")).select(
        F.concat(F.lit("shard-"), F.col("shard").cast("string")).alias("file"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    checked = readers.check_inventory(files, manifest)
    return checked.join(files.select("file", "length", "sha256"), "file")


DETECTION_OUT = """select detection_id, zone_id, round(confidence, 6) as confidence, round(latitude, 7) as latitude,
 round(longitude, 7) as longitude from detections"""


def _detections_out(df):
    return df.select(
        "detection_id", "zone_id", F.round("confidence", 6).alias("confidence"),
        F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"),
    )


@query("sink_csv", DETECTION_OUT)
def sink_csv(t):
    path = scratch_path(t.spark, "detections")
    writers.write_csv(t.detections, path)
    return _detections_out(readers.read_csv(t.spark, path))


@query("sink_geojson", """
select detection_id, zone_id, round(confidence, 6) as confidence, round(latitude, 7) as latitude,
 round(longitude, 7) as longitude, 'Feature' as type, 'Point' as geometry from detections
""")
def sink_geojson(t):
    path = scratch_path(t.spark, "features")
    writers.write_geojson_lines(t.detections, path, ["detection_id", "zone_id", "confidence"])
    schema = (
        "type string, geometry struct<type:string, coordinates:array<double>>, "
        "properties struct<detection_id:bigint, zone_id:string, confidence:double>"
    )
    df = t.spark.read.schema(schema).json(path)
    return df.select(
        "properties.detection_id", "properties.zone_id",
        F.round("properties.confidence", 6).alias("confidence"),
        F.round(F.col("geometry.coordinates")[1], 7).alias("latitude"),
        F.round(F.col("geometry.coordinates")[0], 7).alias("longitude"),
        "type", F.col("geometry.type").alias("geometry"),
    )


@query("sink_detection_json", """
select image, pred_id, confidence, x1, cast(floor((row_number() over (partition by image order by confidence desc, pred_id) - 1) / 50e0) as integer) as part,
 (row_number() over (partition by image order by confidence desc, pred_id) - 1) % 50 as place, 100e0 as ground_m from predictions
""")
def sink_detection_json(t):
    documents = writers.detection_documents(
        t.predictions, ["pred_id", "confidence", "x1"], "pred_id", chunk=50
    )
    schema = (
        "image_size_meters double, image_pixels array<int>, "
        "detections array<struct<pred_id:bigint, confidence:double, x1:double>>"
    )
    parsed = documents.withColumn("d", F.from_json("document", schema))
    return parsed.select(
        "image", "part", F.col("d.image_size_meters").alias("ground_m"),
        F.posexplode("d.detections").alias("place", "item"),
    ).select("image", "part", "ground_m", "place", "item.*")


@query("sink_detection_stream", """
select image, pred_id, confidence, x1, count(*) over (partition by image) as n, 100e0 as ground_m from predictions
""")
def sink_detection_stream(t):
    path = scratch_path(t.spark, "documents")
    writers.write_detection_documents(t.predictions, ["pred_id", "confidence", "x1"], "pred_id", path)
    lines = t.spark.read.text(path)
    item = F.from_json(F.regexp_replace("value", "^,", ""), "pred_id bigint, confidence double, x1 double")
    items = lines.filter(F.col("value").rlike("^,?[{].*[}]$")).select("image", item.alias("d")).select("image", "d.*")
    # The head opens the document of each image, the end closes it.
    heads = lines.filter(F.col("value").endswith(":[")).select("image", F.get_json_object(
        F.concat("value", F.lit("]}")), "$.image_size_meters").cast("double").alias("ground_m"))
    ends = lines.filter("value = ']}'").select("image")
    counts = items.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    return items.join(counts, "image").join(heads, "image").join(ends, "image").select("image", "pred_id", "confidence", "x1", "n", "ground_m")


@query("sink_labels", f"select sup_id, split, {LABEL_SQL} as label from annotations where status <> 'ambigu'")
def sink_labels(t):
    path = scratch_path(t.spark, "labels")
    writers.write_labels(ann.human_labels(named_annotations(t)), path)
    df = t.spark.read.parquet(path)
    return df.select(F.col("SUP_ID").alias("sup_id"), "split",
                     F.regexp_replace("label", "\n", "").alias("label"))


# ---- cleaning, filters, checks ------------------------------------------------

TEXTS = """
select event_id, case event_id % 8 when 0 then cast(event_id as varchar(20)) when 1 then '7,9' when 2 then '1d'
 when 3 then 'abc' when 4 then null when 5 then ' 3.5 ' when 6 then concat('-', cast(event_id as varchar(20)), '.25') else '1e3' end as raw from events
"""


@query("coerce_numeric", f"with x as ({TEXTS}) select event_id, {num('raw')} as value from x")
def coerce_numeric(t):
    return t.sql(TEXTS).select("event_id", text.to_number("raw").alias("value"))


@query("coerce_decimal_comma", f"""with x as ({TEXTS}) select event_id, {num("replace(raw, ',', '.')")} as value from x""")
def coerce_decimal_comma(t):
    return t.sql(TEXTS).select("event_id", text.to_number_comma("raw").alias("value"))


DIRTY = """
select c_custkey as no, cast(c_custkey % 700 as varchar(20)) as sup_id,
 case when c_custkey % 10 = 0 then null when c_custkey % 10 = 1 then 'x' when c_custkey % 10 = 2 then '95.5'
  else cast(40 + c_custkey % 50 as varchar(20)) end as latitude,
 cast((c_custkey * 7) % 200 as varchar(20)) as longitude from customer
"""


@query("sites_clean", f"""
with x as ({DIRTY}), y as (select no, sup_id, {num('latitude')} as latitude, {num('longitude')} as longitude from x),
z as (select *, row_number() over (partition by sup_id order by no) as rn from y
 where latitude between -90 and 90 and longitude between -180 and 180)
select no, sup_id, latitude, longitude from z where rn = 1
""")
def sites_clean(t):
    return cat.clean_sites(t.sql(DIRTY).withColumnRenamed("sup_id", "SUP_ID"), [F.col("no")]).select(
        "no", F.col("SUP_ID").alias("sup_id"), "latitude", "longitude")


@query("required_columns", "select sup_id, insee from sites")
def required_columns(t):
    kept = checks.require_columns(t.catalogue, ["SUP_ID", "latitude", "longitude", "COM_CD_INSEE"])
    return kept.select(F.col("SUP_ID").alias("sup_id"), F.col("COM_CD_INSEE").alias("insee"))


@query("department_filter", "select sup_id, insee from sites where substring(insee, 1, 2) = '72'")
def department_filter(t):
    return cat.department(t.catalogue, "72").select(
        F.col("SUP_ID").alias("sup_id"), F.col("COM_CD_INSEE").alias("insee"))


DIRECTIONS = """
select o_orderkey as no, case o_orderkey % 7 when 0 then 'x' when 1 then null when 2 then ' s ' else 'N' end as ns,
 case o_orderkey % 5 when 0 then 'O' when 1 then 'w' else ' E' end as ew from orders
"""


@query("direction_check", f"""
with x as ({DIRECTIONS})
select 'latitude direction' as "check", count(*) filter (where coalesce(upper(trim(ns)) not in ('N','S'), true)) as violations from x
union all select 'longitude direction', count(*) filter (where coalesce(upper(trim(ew)) not in ('E','W'), true)) from x
""")
def direction_check(t):
    df = t.sql(DIRECTIONS).withColumnsRenamed({"ns": "COR_CD_NS_LAT", "ew": "COR_CD_EW_LON"})
    return checks.count_violations(df, checks.bad_direction())


POINTS = "select event_id, value - 100e0 as latitude, value - 200e0 as longitude from events"


@query("coord_check", f"""
with x as ({POINTS}) select 'coordinates' as "check",
 count(*) filter (where not (latitude between -90 and 90 and longitude between -180 and 180)) as violations from x
""")
def coord_check(t):
    return checks.count_violations(t.sql(POINTS), {"coordinates": checks.bad_coordinates()})


MIXED = """
select sup_id, case when cast(station_id as bigint) % 9 = 0 then nature_id + 1 else nature_id end as nature_id,
 case when cast(station_id as bigint) % 11 = 0 then null else insee end as insee, height from raw_sites
"""


@query("id_consistency", f"""
with x as ({MIXED}), y as (select sup_id, count(distinct nature_id) as a, count(distinct insee) as b,
 count(insee) as bn, count(*) as n, count(distinct height) as c from x group by sup_id)
select sup_id, concat_ws(',', case when a > 1 then 'nature_id' end, case when b > 1 or (bn > 0 and bn < n) then 'insee' end) as columns
from y where a > 1 or b > 1 or (bn > 0 and bn < n) or c > 1
""")
def id_consistency(t):
    found = checks.inconsistent_ids(t.sql(MIXED), "sup_id", ["nature_id", "insee", "height"])
    return found.select("sup_id", F.array_join("columns", ",").alias("columns"))


@query("unique_key_check", "select sup_id, count(*) as n from raw_sites group by sup_id having count(*) > 1")
def unique_key_check(t):
    return checks.duplicated_keys(t.raw_sites, "sup_id")


NATURES = "select c_custkey, case when c_custkey % 9 = 0 then null else n_name end as nature from customer join nation on n_nationkey = c_nationkey"


@query("nature_exclusion", f"with x as ({NATURES}) select * from x where nature is null or nature not in ('NATION_3', 'NATION_7', 'NATION_12')")
def nature_exclusion(t):
    df = t.sql(NATURES).withColumnRenamed("nature", "NAT_LB_NOM")
    return cat.exclude_natures(df, ["NATION_3", "NATION_7", "NATION_12"]).withColumnRenamed("NAT_LB_NOM", "nature")


DISTANCES = """
select event_id as detection_id, event_type as zone_id, value as confidence, 48e0 as latitude, 2e0 as longitude,
 case when event_id % 9 = 0 then null when event_id % 9 = 1 then 150e0 else value * 10 end as nearest_ANFR_distance_m from events
"""


@query("far_filter", f"with x as ({DISTANCES}) select detection_id, nearest_ANFR_distance_m as dist from x where nearest_ANFR_distance_m >= 150")
def far_filter_query(t):
    return far_filter(t.sql(DISTANCES)).select(
        "detection_id", F.col("nearest_ANFR_distance_m").alias("dist"))


STATUS = "select detection_id, review_status as status from reviews"


@query("status_normalise", f"with x as ({STATUS}) select detection_id, trim(coalesce(status, '')) as status, trim(coalesce(status,'')) not in ('visible','non_visible','ambigu') as bad from x")
def status_normalise(t):
    df = t.sql(STATUS)
    return df.select("detection_id", text.clean_status().alias("status"), checks.bad_status().alias("bad"))


@query("visible_filter", "select sup_id, x1 from annotations where status = 'visible'")
def visible_filter(t):
    return ann.visible(t.annotations).select("sup_id", "x1")


@query("usable_filter", "select sup_id, status from annotations where status <> 'ambigu'")
def usable_filter(t):
    return ann.usable(t.annotations).select("sup_id", "status")


@query("bbox_check", """
select 'box' as "check", count(*) filter (where status = 'visible' and not coalesce(0 <= x1 and x1 < x2 and x2 <= 600 and 0 <= y1 and y1 < y2 and y2 <= 600, false)) as violations
from annotations
""")
def bbox_check(t):
    return checks.count_violations(t.annotations, {"box": checks.bad_box(600)})


@query("type_filter", "select s.sup_id, n.n_name as type from sites s join nation n on n.n_nationkey = s.nature_id where n.n_name in ('NATION_3','NATION_9')")
def type_filter(t):
    return cat.of_types(cat.harmonise(t.catalogue), ["NATION_3", "NATION_9"]).select(
        F.col("SUP_ID").alias("sup_id"), F.col("TYPE").alias("type"))


@query("id_search", "select sup_id from sites where regexp_matches(sup_id, '1[02]', 'i')")
def id_search(t):
    return cat.search_id(t.catalogue, "1[02]").select(F.col("SUP_ID").alias("sup_id"))


IDS = "select c_custkey, case when c_custkey % 3 = 0 then concat(cast(c_custkey as varchar(20)), '.0') when c_custkey % 3 = 1 then concat(' ', cast(c_custkey as varchar(20)), ' ') else concat(cast(c_custkey as varchar(20)), '.05') end as raw from customer"


@query("id_normalise", f"with x as ({IDS}) select c_custkey, trim(regexp_replace(raw, '\\.0$', '')) as id from x")
def id_normalise(t):
    return t.sql(IDS).select("c_custkey", text.clean_id("raw").alias("id"))


@query("schema_harmonise", """
select sup_id, station_id, 'Non renseigné' as type, round(lat_deg + lat_min/60e0 + lat_sec/3600e0, 9) as latitude,
 round((lon_deg + lon_min/60e0 + lon_sec/3600e0) * case when lon_dir = 'W' then -1e0 else 1e0 end, 9) as longitude,
 cast(null as varchar) as address from raw_sites
""")
def schema_harmonise(t):
    return cat.harmonise(t.raw_export).select(
        F.col("SUP_ID").alias("sup_id"), F.col("STA_NM_ANFR").alias("station_id"),
        F.col("TYPE").alias("type"), F.round("latitude", 9).alias("latitude"),
        F.round("longitude", 9).alias("longitude"), F.col("ADR_LB_LIEU").alias("address"))


@query("project_existing", "select sup_id, nature_id as nat_id, insee as com_cd_insee from sites")
def project_existing(t):
    df = cat.project_existing(t.catalogue, ["SUP_ID", "ADR_LB_LIEU", "NAT_ID", "COM_CD_INSEE"])
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


@query("label_map", "select event_id, case event_type when 'click' then 'Clic' when 'view' then 'Vue' else event_type end as label from events")
def label_map(t):
    return t.base("events").select("event_id", text.relabel("event_type", {"click": "Clic", "view": "Vue"}).alias("label"))


@query("parse_bool", "select detection_id, coalesce(lower(trim(selection_finale)) in ('1','true','yes','oui'), false) as chosen from reviews")
def parse_bool(t):
    return t.reviews.select("detection_id", text.is_true("selection_finale").alias("chosen"))


@query("layer_class", """
select detection_id, case when detection_id in (5, 14, 23) or coalesce(lower(trim(selection_finale)) in ('1','true','yes','oui'), false) then 'final'
 when trim(review_status) in ('plausible','faux_positif','incertain') then trim(review_status) else 'non_revu' end as layer from reviews
""")
def layer_class(t):
    return review.layer_class(t.reviews, ["5", "14", "23"], "detection_id").select("detection_id", "layer")


SPLITS = "select o_orderkey, case o_orderkey % 6 when 0 then 'train' when 1 then 'val' when 2 then 'test' when 3 then 'TRAIN' when 4 then null else '' end as split from orders"


@query("split_domain_check", f"""with x as ({SPLITS}) select 'split' as "check", count(*) filter (where coalesce(split not in ('train','val','test'), true)) as violations from x""")
def split_domain_check(t):
    return checks.count_violations(t.sql(SPLITS), {"split": checks.bad_split()})


@query("missing_files", "select sup_id, image from annotations where concat(sup_id, '.jpg') not in (select filename from images)")
def missing_files(t):
    manifest = t.annotations.withColumn("file", F.concat("sup_id", F.lit(".jpg")))
    listed = t.images.select(F.concat(F.lit("in/"), "filename").alias("path"))
    return ann.missing_files(manifest, listed, "file").select("sup_id", "image")


SIZES = """select concat('in/', cast(event_id as varchar(20)), '.png') as path, case when event_id % 7 = 0 then 512 else 1024 end as width,
 case when event_id % 11 = 0 then 1000 else 1024 end as height from events"""


@query("wrong_image_size", f"with x as ({SIZES}) select * from x where width <> 1024 or height <> 1024")
def wrong_image_size(t):
    return ann.wrong_image_size(t.sql(SIZES))


# ---- row-local geometry and boxes ----------------------------------------------

@query("dms_to_decimal", """
select sup_id, station_id, round(lat_deg + lat_min/60e0 + lat_sec/3600e0, 9) as latitude,
 round((lon_deg + lon_min/60e0 + lon_sec/3600e0) * case when lon_dir = 'W' then -1e0 else 1e0 end, 9) as longitude from raw_sites
""")
def dms_to_decimal(t):
    return t.raw_sites.select(
        "sup_id", "station_id",
        F.round(geo.dms_to_decimal("lat_deg", "lat_min", "lat_sec", "lat_dir"), 9).alias("latitude"),
        F.round(geo.dms_to_decimal("lon_deg", "lon_min", "lon_sec", "lon_dir"), 9).alias("longitude"))


@query("validate_latlon", f"with x as ({POINTS}) select event_id, latitude between -90 and 90 and longitude between -180 and 180 as valid from x")
def validate_latlon(t):
    return t.sql(POINTS).select("event_id", geo.valid_latlon("latitude", "longitude").alias("valid"))


@query("latlon_to_world_pixel", "select sup_id, round(px, 2) as px, round(py, 2) as py from site_px")
def latlon_to_world_pixel(t):
    world = Imagery().world_size
    return t.sites.select("sup_id", F.round(geo.world_x("longitude", world), 2).alias("px"),
                          F.round(geo.world_y("latitude", world), 2).alias("py"))


@query("world_pixel_to_latlon", f"select detection_id, round({world_lat_sql('gy')}, 9) as latitude, round(gx/{WORLD}*360e0-180e0, 9) as longitude from box_px")
def world_pixel_to_latlon(t):
    world = Imagery().world_size
    return t.box_px.select("detection_id", F.round(geo.world_lat("gy", world), 9).alias("latitude"),
                           F.round(geo.world_lon("gx", world), 9).alias("longitude"))


ZONE_PAIRS = """
select d.detection_id, d.latitude, d.longitude, s.latitude as slat, s.longitude as slon
from detections d join sites s on s.sup_id = substring(d.zone_id, 2)
"""


@query("haversine_m", f"with x as ({ZONE_PAIRS}) select detection_id, round({haversine_sql('latitude','longitude','slat','slon')}, 4) as dist from x")
def haversine(t):
    return t.sql(ZONE_PAIRS).select("detection_id", F.round(geo.haversine_m("latitude", "longitude", "slat", "slon"), 4).alias("dist"))


@query("haversine_legacy_m", f"with x as ({ZONE_PAIRS}) select detection_id, round({split_distance_sql('latitude','longitude','slat','slon')}, 4) as dist from x")
def haversine_legacy(t):
    return t.sql(ZONE_PAIRS).select("detection_id", F.round(geo.haversine_split_m("latitude", "longitude", "slat", "slon"), 4).alias("dist"))


@query("planar_xy", """
select sup_id, round(6371008.8e0*radians(longitude)*cos((select avg(radians(latitude)) from sites)), 3) as x_m,
 round(6371008.8e0*radians(latitude), 3) as y_m from sites
""")
def planar_xy(t):
    return zones.with_planar(t.sites).select("sup_id", F.round("x_m", 3).alias("x_m"), F.round("y_m", 3).alias("y_m"))


@query("map_link", f"select detection_id, concat('{MAP_URL}', printf('%.6f', longitude), '/', printf('%.6f', latitude)) as url from detections")
def map_link(t):
    return t.detections.select("detection_id", geo.map_link(MAP_URL, "latitude", "longitude").alias("url"))


@query("box_center", "select detection_id, (x1+x2)/2e0 as center_x, (y1+y2)/2e0 as center_y from boxes")
def box_center(t):
    cx, cy = boxes.center()
    return t.boxes.select("detection_id", cx.alias("center_x"), cy.alias("center_y"))


PATCHED = "select b.*, z.px - 2560e0 + b.pcol*1024 as world_left, z.py - 2560e0 + b.prow*1024 as world_top from boxes b join site_px z on z.sup_id = cast(b.k as varchar(20))"


@query("geolocate_box", "select detection_id, round(latitude, 9) as latitude, round(longitude, 9) as longitude from detections")
def geolocate_box(t):
    cx, cy = boxes.center()
    lat, lon = boxes.geolocate("world_left", "world_top", cx, cy, Imagery().world_size)
    return t.sql(PATCHED).select("detection_id", F.round(lat, 9).alias("latitude"), F.round(lon, 9).alias("longitude"))


VISUAL_SQL = f"""
select a.sup_id, a.split, s.latitude, s.longitude, {world_lat_sql("p.py + (a.y1+a.y2)/2e0 - 512e0")} as vlat,
 (p.px + (a.x1+a.x2)/2e0 - 512e0)/{WORLD}*360e0-180e0 as vlon
from annotations a join sites s on s.sup_id = a.sup_id join site_px p on p.sup_id = a.sup_id where a.status = 'visible'
"""


def located_annotations(t):
    return t.sql("select a.*, s.latitude, s.longitude from annotations a join sites s on s.sup_id = a.sup_id").withColumnsRenamed(
        {"sup_id": "SUP_ID", "split": "source"})


@query("visual_offset_position", f"with v as ({VISUAL_SQL}) select sup_id, round(vlat, 9) as lat, round(vlon, 9) as lon from v")
def visual_offset_position(t):
    placed = ann.visual_positions(ann.visible(located_annotations(t)))
    return placed.select(F.col("SUP_ID").alias("sup_id"), F.round("visual_latitude", 9).alias("lat"),
                         F.round("visual_longitude", 9).alias("lon"))


@query("local_offset_m", """
select pred_id, true as rounded, round_even((x1+x2)/2e0, 1) as centre_x, round_even((y1+y2)/2e0, 1) as centre_y,
 round_even(sqrt(power(((x1+x2)/2e0-512e0)*(100e0/1024e0),2)+power(((y1+y2)/2e0-512e0)*(100e0/1024e0),2)), 2) as distance_centre_m from predictions
""")
def local_offset_m(t):
    # Ties in the confidence's fifth decimal depend on its binary form, so the SQL
    # side only asks that the rounded value is a nearest one.
    rounded = F.abs(F.col("confiance") - F.col("confidence")) <= 5.0000001e-5
    return images.local_offsets(t.predictions).select(
        "pred_id", rounded.alias("rounded"), "centre_x", "centre_y", "distance_centre_m")


@query("bbox_to_normalised", f"select sup_id, {LABEL_SQL} as label from annotations where status = 'visible'")
def bbox_to_normalised(t):
    line = boxes.label_line(boxes.normalised(1024.0))
    return ann.visible(t.annotations).select("sup_id", F.regexp_replace(line, "\n", "").alias("label"))


@query("weak_box", "select sup_id, split, 0.5e0 as x_center_norm, 0.15625e0 as width_norm, '0 0.50000000 0.50000000 0.15625000 0.15625000' as label from annotations")
def weak_box(t):
    labels = ann.weak_labels(named_annotations(t))
    return labels.select(F.col("SUP_ID").alias("sup_id"), "split", "x_center_norm", "width_norm",
                         F.regexp_replace("label", "\n", "").alias("label"))


# Round half to even, as the pixel grid does; exact in both engines.
PATCH_SQL = f"""
with c as (select sup_id, cast(round_even(px - 2560e0, 0) as bigint) as l0, cast(round_even(py - 2560e0, 0) as bigint) as t0 from site_px),
p as (select concat('Z', sup_id) as zone_id, r.r as "row", q.q as col, l0 + q.q*1024 as world_left, t0 + r.r*1024 as world_top
 from c join (select unnest([0,1,2,3,4]) as r) r on true join (select unnest([0,1,2,3,4]) as q) q on true),
patches as (select *, printf('%s_r%02d_c%02d.jpg', zone_id, "row", col) as image from p)
"""


def zone_centres(t):
    """Every site is a zone centre, named Z<site>."""
    return t.sites.select(F.concat(F.lit("Z"), "sup_id").alias("zone_id"), "latitude", "longitude")


@query("grid_patches", PATCH_SQL + f"""
select zone_id, image, "row", col, world_left, world_top, world_left + 1024 as world_right,
 round({world_lat_sql('world_top + 512')}, 8) as center_latitude, round((world_left+512)/{WORLD}*360e0-180e0, 8) as center_longitude,
 round({world_lat_sql('world_top')}, 8) as north, round({world_lat_sql('world_top + 1024')}, 8) as south,
 round(world_left/{WORLD}*360e0-180e0, 8) as west, round((world_left+1024)/{WORLD}*360e0-180e0, 8) as east from patches
""")
def grid_patches(t):
    df = zones.grid_patches(zone_centres(t))
    return df.select("zone_id", "image", "row", "col", "world_left", "world_top", "world_right",
                     *[F.round(c, 8).alias(c) for c in (
                         "center_latitude", "center_longitude", "north", "south", "west", "east")])


@query("centred_patch", "select sup_id, concat('support_', sup_id, '.jpg') as image, cast(round_even(px - 512e0, 0) as bigint) as world_left, cast(round_even(py - 512e0, 0) as bigint) as world_top from site_px")
def centred_patch(t):
    df = zones.centred_patches(t.catalogue)
    return df.select(F.col("SUP_ID").alias("sup_id"), "image", "world_left", "world_top")


TILE_SQL = """
with p as (select concat('support_', sup_id, '.jpg') as image, cast(round_even(px - 512e0, 0) as bigint) as world_left, cast(round_even(py - 512e0, 0) as bigint) as world_top from site_px),
e as (select *, cast(floor(world_left/256e0) as bigint) as x0, cast(floor((world_left+1023)/256e0) as bigint) as x1,
 cast(floor(world_top/256e0) as bigint) as y0, cast(floor((world_top+1023)/256e0) as bigint) as y1 from p),
tiles as (select e.*, x0 + i.i as tile_x, y0 + j.j as tile_y from e
 join (select unnest([0,1,2,3,4]) as i) i on x0 + i.i <= x1 join (select unnest([0,1,2,3,4]) as j) j on y0 + j.j <= y1)
"""


@query("patch_tiles", TILE_SQL + "select distinct tile_x, tile_y from tiles")
def patch_tiles(t):
    return zones.patch_tiles(zones.centred_patches(t.catalogue)).select("tile_x", "tile_y").distinct()


@query("tile_mosaic_offset", TILE_SQL + """
select image, tile_x, tile_y, (tile_x - x0)*256 as paste_x, (tile_y - y0)*256 as paste_y, world_left - x0*256 as crop_left, world_top - y0*256 as crop_top from tiles
""")
def tile_mosaic_offset(t):
    return zones.patch_tiles(zones.centred_patches(t.catalogue)).select(
        "image", "tile_x", "tile_y", "paste_x", "paste_y", "crop_left", "crop_top")


@query("box_iou", f"select p.pred_id, round({IOU_SQL}, 9) as iou from predictions p join annotations u on u.image = p.image and u.status = 'visible'")
def box_iou(t):
    return evaluation.match_boxes(t.predictions, ann.visible(t.annotations)).select(
        "pred_id", F.round("iou", 9).alias("iou"))
