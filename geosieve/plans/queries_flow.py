"""Queries on joins, aggregates, rankings and the multi-step operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from geosieve.config import Detection, Imagery
from geosieve.operators import annotations as ann
from geosieve.operators import candidates as cand
from geosieve.operators import catalogue as cat
from geosieve.operators import checks, evaluation, images, review, sampling, zones
from geosieve.operators.cells import Metric
from geosieve.operators.nearest import nearest_site
from geosieve.operators.proximity import close_groups, count_within, label_groups
from geosieve.operators.spread import materialize, rank_rows, scratch_path
from geosieve.plans import area
from geosieve.plans.queries_tables import (
    IOU_SQL, PATCH_SQL, SWEEP, VISUAL_SQL, located_annotations, named_annotations, sweep,
    zone_centres,
)
from geosieve.plans.registry import (
    CLUSTERS, COMPONENTS, NEAR, PAIRS, WORLD, haversine_sql, query, split_distance_sql,
)
from geosieve.sources import writers


def located(t):
    """Detections with their nearest site, written once for the steps that follow."""
    return materialize(nearest_site(t.detections, t.catalogue, ["detection_id"]), "located")


def far_located(t):
    """As ``located``, but only detections far from every site, which are all that candidates come from."""
    far = nearest_site(t.detections, t.catalogue, ["detection_id"], beyond=Detection().min_distance_m)
    return materialize(far, "located")


# ---- joins -----------------------------------------------------------------------


@query("station_count_join", """
with f as (select sup_id, station_id, row_number() over (partition by sup_id order by cast(station_id as bigint) nulls first) as rn from raw_sites),
c as (select sup_id, count(distinct station_id) as nb_stations from raw_sites group by sup_id)
select f.sup_id, f.station_id, c.nb_stations from f join c on c.sup_id = f.sup_id where rn = 1
""")
def station_count_join(t):
    raw = t.raw_export
    first = cat.first_per_key(raw, "SUP_ID", [F.col("STA_NM_ANFR").cast("long").asc_nulls_first()])
    return first.join(cat.station_counts(raw), "SUP_ID", "left").select(
        F.col("SUP_ID").alias("sup_id"), F.col("STA_NM_ANFR").alias("station_id"),
        F.col("NB_STATIONS_ANFR").alias("nb_stations"))


@query("nature_join", "select r.sup_id, r.station_id, n.n_name as nature from raw_sites r left join nation n on n.n_nationkey = r.nature_id")
def nature_join(t):
    return cat.with_natures(t.raw_export, t.natures).select(
        F.col("SUP_ID").alias("sup_id"), F.col("STA_NM_ANFR").alias("station_id"),
        F.col("NAT_LB_NOM").alias("nature"))


@query("reference_prepare", """
with f as (select sup_id, min(cast(station_id as bigint)) as station_id from raw_sites group by sup_id)
select s.sup_id, cast(f.station_id as varchar) as station_id, s.nb_stations, n.n_name as nature, round(s.latitude, 9) as latitude,
 round(s.longitude, 9) as longitude, s.insee from sites s join f on f.sup_id = s.sup_id join nation n on n.n_nationkey = s.nature_id
where substring(s.insee, 1, 2) = '71'
""")
def reference_prepare(t):
    ready = cat.prepare_reference(
        t.raw_export, t.natures, "71", [F.col("STA_NM_ANFR").cast("long").asc()])
    return ready.select(
        F.col("SUP_ID").alias("sup_id"), F.col("STA_NM_ANFR").alias("station_id"),
        F.col("NB_STATIONS_ANFR").alias("nb_stations"), F.col("NAT_LB_NOM").alias("nature"),
        F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"),
        F.col("COM_CD_INSEE").alias("insee"))


def boxes_on_patches(t):
    return t.boxes.withColumn("image", F.format_string("%s_r%02d_c%02d.jpg", "zone_id", "prow", "pcol")).drop("k", "prow", "pcol")


def area_of(t, **options):
    """A run over all sites as zones; the columns it takes of the catalogue are worked out once."""
    catalogue = materialize(
        t.catalogue.select("SUP_ID", "latitude", "longitude", "NAT_LB_NOM", "SUP_NM_HAUT"), "catalogue")
    centres = catalogue.select(F.concat(F.lit("Z"), "SUP_ID").alias("zone_id"), "latitude", "longitude")
    return area.run_zones(zones.grid_patches(centres), boxes_on_patches(t), catalogue, **options)


PATCHED_SQL = PATCH_SQL + f""", on_patch as (
 select b.detection_id, b.zone_id, p.image, p."row", p.col, b.confidence, b.x1, b.y1, b.x2, b.y2,
  (p.world_left + (b.x1+b.x2)/2e0)/{WORLD}*360e0-180e0 as longitude,
  degrees(atan((exp(pi()-2e0*pi()*(p.world_top + (b.y1+b.y2)/2e0)/{WORLD})-exp(-(pi()-2e0*pi()*(p.world_top + (b.y1+b.y2)/2e0)/{WORLD})))/2e0)) as latitude
 from boxes b join patches p on p.zone_id = b.zone_id and p."row" = b.prow and p.col = b.pcol)
"""


@query("patch_join", PATCHED_SQL + 'select detection_id, zone_id, image, "row", col, round(latitude, 8) as latitude, round(longitude, 8) as longitude from on_patch')
def patch_join(t):
    placed = area.locate_boxes(boxes_on_patches(t), zones.grid_patches(zone_centres(t)))
    return placed.select("detection_id", "zone_id", "image", "row", "col",
                         F.round("latitude", 8).alias("latitude"), F.round("longitude", 8).alias("longitude"))


@query("nearest_site", f"with {NEAR} select detection_id, nearest_sup_id, round(dist, 3) as dist from near")
def nearest_site_query(t):
    near = nearest_site(t.detections, t.catalogue, ["detection_id"])
    return near.select("detection_id", F.col("nearest_SUP_ID").alias("nearest_sup_id"),
                       F.round("nearest_ANFR_distance_m", 3).alias("dist"))


OWN_SQL = haversine_sql("latitude", "longitude", "vlat", "vlon")


@query("own_site_distance", f"with v as ({VISUAL_SQL}) select sup_id, round({OWN_SQL}, 3) as dist from v")
def own_site_distance(t):
    placed = ann.visual_positions(ann.visible(located_annotations(t)))
    return ann.own_site_distance(placed).select(
        F.col("SUP_ID").alias("sup_id"), F.round("distance_to_own_anfr_m", 3).alias("dist"))


@query("radius_self_pairs", f"""with {PAIRS} select f.zone_id, f.detection_id, count(p.b) as close from far f
 left join pairs p on p.a = f.detection_id group by f.zone_id, f.detection_id""")
def radius_self_pairs(t):
    far = materialize(cand.far_filter(far_located(t)).select(
        "zone_id", "detection_id", "latitude", "longitude"), "far")
    counted = count_within(far, "detection_id", Metric(30.0), group=["zone_id"], name="n")
    return counted.select("zone_id", "detection_id", (F.col("n") - 1).alias("close"))


GROUP_PAIRS = f"""
gp as (select a.sup_id as a, b.sup_id as b from sites a join sites b on a.sup_id <> b.sup_id
 and b.latitude between a.latitude - 0.003 and a.latitude + 0.003 and b.longitude between a.longitude - 0.005 and a.longitude + 0.005
 and {split_distance_sql('a.latitude','a.longitude','b.latitude','b.longitude')} < 200)
"""


@query("group_pairs", f"with {GROUP_PAIRS} select s.sup_id, count(g.b) as close from sites s left join gp g on g.a = s.sup_id group by s.sup_id")
def group_pairs(t):
    sites = materialize(t.sites.select("sup_id", "latitude", "longitude"), "sites")
    counted = count_within(sites, "sup_id", sampling.split_metric(), name="n")
    return counted.select("sup_id", (F.col("n") - 1).alias("close"))


DENSITY = """
flat as (select sup_id, latitude, longitude, 6371008.8e0*radians(longitude)*cos((select avg(radians(latitude)) from sites)) as x,
 6371008.8e0*radians(latitude) as y from sites),
dens as (select a.sup_id, a.latitude, a.longitude, count(*) as density from flat a join flat b
 on b.y between a.y - 501 and a.y + 501 and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 250000e0 group by a.sup_id, a.latitude, a.longitude)
"""


@query("density_counts", f"with {DENSITY} select sup_id, density from dens")
def density_counts(t):
    thin = t.catalogue.select("SUP_ID", "latitude", "longitude")
    return zones.density_counts(thin).select(F.col("SUP_ID").alias("sup_id"), "density")


@query("far_enough", f"""select sup_id from sites where {haversine_sql('latitude','longitude','48.2e0','2.2e0')} >= 5000
 and {haversine_sql('latitude','longitude','48.4e0','2.4e0')} >= 5000""")
def far_enough(t):
    return zones.far_enough(t.sites, [(48.2, 2.2), (48.4, 2.4)]).select("sup_id")


@query("min_inter_split_distance", f"""
with x as (select s.*, a.split from sites s join annotations a on a.sup_id = s.sup_id)
select round(min({split_distance_sql('a.latitude','a.longitude','b.latitude','b.longitude')}), 3) as min_distance_m
from x a join x b on a.split < b.split
""")
def min_inter_split_distance(t):
    df = t.sql("select s.sup_id as SUP_ID, s.latitude, s.longitude, a.split from sites s join annotations a on a.sup_id = s.sup_id")
    return sampling.min_split_distance(df).select(F.round("min_distance_m", 3).alias("min_distance_m"))


@query("sites_in_extent", PATCH_SQL + f""", ext as (select zone_id, count(*) as patches,
 max(degrees(atan((exp(pi()-2e0*pi()*world_top/{WORLD})-exp(-(pi()-2e0*pi()*world_top/{WORLD})))/2e0))) as north,
 min(degrees(atan((exp(pi()-2e0*pi()*(world_top+1024)/{WORLD})-exp(-(pi()-2e0*pi()*(world_top+1024)/{WORLD})))/2e0))) as south,
 min(world_left/{WORLD}*360e0-180e0) as west, max((world_left+1024)/{WORLD}*360e0-180e0) as east from patches group by zone_id)
select e.zone_id, e.patches, count(s.sup_id) as sites_in_extent from ext e left join sites s
 on s.latitude between e.south and e.north and s.longitude between e.west and e.east group by e.zone_id, e.patches
""")
def sites_in_extent(t):
    extents = zones.zone_extents(zones.grid_patches(zone_centres(t)))
    return zones.sites_in_extents(extents, t.sites).select("zone_id", "patches", "sites_in_extent")


@query("image_reference_match", """
with s as (select *, regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem from images),
k as (select image_no, filename, unnest(list_concat([stem], regexp_extract_all(stem, '\\d+'))) as token,
 unnest(range(1 + len(regexp_extract_all(stem, '\\d+')))) as pos from s),
m as (select k.image_no, c.sup_id, row_number() over (partition by k.image_no order by k.pos) as rn from k join sites c on c.sup_id = k.token)
select i.image_no, i.filename, m.sup_id from images i left join m on m.image_no = i.image_no and m.rn = 1
""")
def image_reference_match(t):
    found = images.match_images(t.images, t.catalogue, "image_no")
    return found.select("image_no", "filename", F.col("SUP_ID").alias("sup_id"))


# Every customer is a listed image; those of every seventh have another name, so their predictions are unlisted.
IMAGE_SITES = """select concat(case when c_custkey % 7 > 0 then 'site_' else 'plan_' end, cast(c_custkey as varchar(20)), '.jpg') as image,
 case when c_custkey % 3 > 0 then cast(c_custkey as varchar(20)) end as sup_id from customer"""
OFFSET_SQL = "round_even(sqrt(power(((p.x1+p.x2)/2e0-512e0)*(100e0/1024e0),2)+power(((p.y1+p.y2)/2e0-512e0)*(100e0/1024e0),2)), 2)"


@query("detection_compare", f"""
with i as ({IMAGE_SITES})
select p.pred_id, p.image, i.sup_id, case when i.sup_id is null then '{images.NO_REFERENCE}' when {OFFSET_SQL} <= 15 then '{images.NEAR_SITE}'
 else '{images.FAR_FROM_SITE}' end as statut from predictions p left join i on i.image = p.image
union all select null, i.image, i.sup_id, '{images.NOT_DETECTED.replace("'", "''")}' from i where i.sup_id is not null and i.image not in (select image from predictions)
""")
def detection_compare(t):
    listed = t.sql(IMAGE_SITES).withColumnRenamed("sup_id", "SUP_ID")
    judged = images.compare_detections(listed, images.local_offsets(t.predictions), 15.0)
    return judged.select("pred_id", "image", F.col("SUP_ID").alias("sup_id"), "statut")


def reviewed_candidates(t, detections):
    far = cand.far_filter(detections)
    unique = cand.dedup_candidates(far)
    reviews = t.reviews.withColumn("review_status", F.trim("review_status"))
    return far, review.join_reviews(unique, reviews, ["detection_id"])


REVIEWED = CLUSTERS + """, reviewed as (select n.*, coalesce(trim(r.review_status), 'non_revu') as review_status, r.support_type, r.selection_finale
 from numbered n left join reviews r on r.detection_id = n.detection_id)"""


@query("review_join", f"with recursive {REVIEWED} select detection_id, zone_id, review_status, support_type from reviewed")
def review_join(t):
    _, reviewed = reviewed_candidates(t, far_located(t))
    return reviewed.select("detection_id", "zone_id", "review_status", "support_type")


@query("leakage_semi", """
select distinct a.sup_id from annotations a join (select cast(o_custkey as varchar) as sup_id from orders) o on o.sup_id = a.sup_id where a.split = 'train'
""")
def leakage_semi(t):
    train = t.annotations.filter("split = 'train'")
    other = t.sql("select cast(o_custkey as varchar(20)) as sup_id from orders")
    return sampling.leaked_ids(train, other, "sup_id")


@query("pred_gt_match", f"""
with m as (select p.image, p.pred_id, {IOU_SQL} as iou from predictions p join annotations u on u.image = p.image and u.status = 'visible')
select image, count(*) as n, round(max(iou), 9) as best_iou from m group by image
""")
def pred_gt_match(t):
    matched = evaluation.match_boxes(t.predictions, ann.visible(t.annotations))
    return matched.groupBy("image").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("iou"), 9).alias("best_iou"))


# ---- aggregates --------------------------------------------------------------------


@query("station_counts", "select sup_id, count(distinct station_id) as nb_stations from raw_sites group by sup_id")
def station_counts(t):
    return cat.station_counts(t.raw_export).select(
        F.col("SUP_ID").alias("sup_id"), F.col("NB_STATIONS_ANFR").alias("nb_stations"))


@query("catalogue_kpis", """
select count(*) as sites, count(distinct n_name) as types, count(*) as located, count(*) filter (where sel) as selected,
 count(*) filter (where sel) as selected_located, count(distinct case when sel then n_name end) as selected_types
from (select s.*, n.n_name, n.n_name in ('NATION_3','NATION_9','NATION_12') and regexp_matches(s.sup_id, '4') as sel from sites s join nation n on n.n_nationkey = s.nature_id) q
""")
def catalogue_kpis(t):
    return cat.kpis(cat.harmonise(t.catalogue), ["NATION_3", "NATION_9", "NATION_12"], "4")


TYPED = "select case when c_custkey % 13 = 0 then null else n_name end as type from customer join nation on n_nationkey = c_nationkey"


@query("type_counts", f"with x as ({TYPED}) select type, count(*) as n, round(count(*)/(select count(type) from x), 9) as share from x where type is not null group by type")
def type_counts(t):
    df = cat.type_counts(t.sql(TYPED).withColumnRenamed("type", "TYPE"))
    return df.select(F.col("TYPE").alias("type"), "n", F.round("share", 9).alias("share"))


@query("top_natures", f"with x as ({TYPED}) select coalesce(type, 'Non renseigné') as nature, count(*) as n from x group by 1 order by n desc, nature limit 10")
def top_natures(t):
    df = cat.top_natures(t.sql(TYPED).withColumnRenamed("type", "NAT_LB_NOM"))
    return df.withColumnRenamed("NAT_LB_NOM", "nature")


@query("visible_type_counts", "select classe_niveau2 as kind, count(*) as n from annotations where status = 'visible' group by 1")
def visible_type_counts(t):
    return ann.visible_type_counts(t.annotations).withColumnRenamed("classe_niveau2", "kind")


@query("annotation_coverage", """
select split, count(*) as total, count(*) filter (where status = 'visible') as visible, count(*) filter (where status = 'non_visible') as non_visible,
 count(*) filter (where status = 'ambigu') as ambigu, count(*) filter (where status <> 'ambigu') as usable from annotations group by split
""")
def annotation_coverage(t):
    return ann.coverage(t.annotations)


CALIBRATION_SQL = f"""
v as ({VISUAL_SQL}),
cal as (select * from (select v.*, s.sup_id as nearest_sup_id, {OWN_SQL.replace('latitude', 'v.latitude').replace('longitude', 'v.longitude')} as own,
 {haversine_sql('v.vlat', 'v.vlon', 's.latitude', 's.longitude')} as near,
 row_number() over (partition by v.sup_id order by {haversine_sql('v.vlat', 'v.vlon', 's.latitude', 's.longitude')}, s.sup_id) as rn
 from v join sites s on s.latitude between v.vlat-0.01 and v.vlat+0.01 and s.longitude between v.vlon-0.02 and v.vlon+0.02) q where rn = 1)
"""


def calibration_table(t):
    return materialize(ann.calibrate(located_annotations(t), t.catalogue), "calibration")


@query("calibration", f"with {CALIBRATION_SQL} select sup_id, split as source, round(own, 3) as own, nearest_sup_id, round(near, 3) as near from cal")
def calibration(t):
    return calibration_table(t).select(
        F.col("SUP_ID").alias("sup_id"), "source", F.round("distance_to_own_anfr_m", 3).alias("own"),
        F.col("nearest_SUP_ID").alias("nearest_sup_id"),
        F.round("distance_to_nearest_anfr_m", 3).alias("near"))


@query("calibration_summary", f"""
with {CALIBRATION_SQL} select count(*) as n, round(avg(near), 4) as mean_m, round(quantile_cont(near, 0.5), 4) as median_m,
 round(quantile_cont(near, 0.95), 4) as p95_m, round(quantile_cont(near, 0.975), 4) as p97_5_m, round(quantile_cont(near, 0.99), 4) as p99_m,
 round(max(near), 4) as max_m, 150e0 as threshold_m from cal
""")
def calibration_summary(t):
    df = ann.calibration_summary(calibration_table(t))
    return df.select(
        F.col("visible_supports_used").alias("n"),
        *[F.round(c, 4).alias(c) for c in ("mean_m", "median_m", "p95_m", "p97_5_m", "p99_m", "max_m")],
        F.col("candidate_distance_threshold_m").alias("threshold_m"))


@query("distance_histogram", f"""
with {CALIBRATION_SQL}, e as (select min(near) as lo, max(near) as hi from cal),
b as (select unnest(range(24)) as bin), c as (select least(cast(floor((near - e.lo)/((e.hi-e.lo)/24)) as bigint), 23) as bin, count(*) as n from cal, e group by 1)
select cast(b.bin as integer) as bin, round(e.lo + b.bin*((e.hi-e.lo)/24), 4) as lo, coalesce(c.n, 0) as n from b join e on true left join c on c.bin = b.bin
""")
def distance_histogram(t):
    df = ann.distance_histogram(calibration_table(t))
    return df.select("bin", F.round("lo", 4).alias("lo"), "n")


@query("cluster_agg", f"""with recursive {CLUSTERS} select zone_id, detection_id, n as detections_in_cluster, ids as cluster_detection_ids,
 round(top, 6) as cluster_max_confidence, round(far_m, 3) as cluster_max_distance from clusters""")
def cluster_agg(t):
    table = cand.cluster_table(cand.cluster_detections(cand.far_filter(far_located(t))))
    return table.select("zone_id", "detection_id", "detections_in_cluster", "cluster_detection_ids",
                        F.round("cluster_max_confidence", 6).alias("cluster_max_confidence"),
                        F.round("cluster_max_distance_anfr_m", 3).alias("cluster_max_distance"))


@query("funnel", f"""
with recursive {REVIEWED} select 1 as step, 'raw' as stage, (select count(*) from detections) as n
union all select 2, 'far', (select count(*) from far) union all select 3, 'unique', (select count(*) from reviewed)
union all select 4, 'plausible', (select count(*) from reviewed where review_status = 'plausible')
""")
def funnel(t):
    far, reviewed = reviewed_candidates(t, far_located(t))
    return review.funnel(t.detections, far, materialize(reviewed, "reviewed"))


@query("zone_summary", f"""
with recursive {REVIEWED},
z as (select zone_id, count(distinct concat(cast(prow as varchar), '-', cast(pcol as varchar))) as patches from boxes group by zone_id),
d as (select zone_id, count(*) as n from detections group by zone_id), g as (select zone_id, count(*) as n from far group by zone_id),
r as (select zone_id, count(*) as n, count(*) filter (where review_status='plausible') as p, count(*) filter (where review_status='faux_positif') as f,
 count(*) filter (where review_status='incertain') as i from reviewed group by zone_id)
select z.zone_id, z.patches, coalesce(d.n,0) as detections_brutes, coalesce(g.n,0) as detections_far, coalesce(r.n,0) as candidats_uniques,
 coalesce(r.p,0) as plausibles, coalesce(r.f,0) as faux_positifs, coalesce(r.i,0) as incertains,
 round(100e0*r.p/r.n, 6) as taux_plausibles_pct from z left join d on d.zone_id=z.zone_id left join g on g.zone_id=z.zone_id left join r on r.zone_id=z.zone_id
""")
def zone_summary(t):
    far, reviewed = reviewed_candidates(t, far_located(t))
    used = t.boxes.groupBy("zone_id").agg(F.count_distinct("prow", "pcol").alias("patches"))
    table = review.zone_summary(used, t.detections, far, materialize(reviewed, "reviewed"))
    return table.withColumn("taux_plausibles_pct", F.round("taux_plausibles_pct", 6))


@query("review_status_counts", "select coalesce(review_status, '') as review_status, count(*) as n from reviews group by 1")
def review_status_counts(t):
    return review.status_counts(t.reviews)


@query("plausible_types", "select support_type, count(*) as n from reviews where review_status = 'plausible' group by 1")
def plausible_types(t):
    return review.plausible_types(t.reviews)


@query("map_center", "select round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude from detections")
def map_center(t):
    df = review.map_center(t.detections, t.sites)
    return df.select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("detection_kpis", f"""
select image, count(*) as detections, max(confidence) as confidence_max, count(*) filter (where {OFFSET_SQL} <= 15) as near_site from predictions p group by image
""")
def detection_kpis(t):
    offsets = images.local_offsets(t.predictions).withColumn("confiance", F.col("confidence"))
    return images.detection_kpis(offsets, 15.0)


EVAL = f"""
u as (select * from annotations where status <> 'ambigu'),
m as (select p.image, p.confidence, p.pred_id, case when u.status = 'visible' then {IOU_SQL} end as iou from predictions p join u on u.image = p.image),
ev as (select u.sup_id, u.image, u.status, count(m.image) as nb_predictions, case when u.status = 'visible' then coalesce(max(m.iou), 0e0) end as best_iou
 from u left join m on m.image = u.image and m.confidence >= 0.05 group by u.sup_id, u.image, u.status),
details as (select *, case when status='visible' and best_iou >= 0.5 then 1 else 0 end as tp,
 nb_predictions - case when status='visible' and best_iou >= 0.5 then 1 else 0 end as fp,
 case when status='visible' and best_iou < 0.5 then 1 else 0 end as fn from ev)
"""


@query("image_eval", f"with {EVAL} select sup_id, image, status, nb_predictions, round(best_iou, 9) as best_iou, tp, fp, fn from details")
def image_eval(t):
    df = evaluation.image_eval(t.predictions, named_annotations(t))
    return df.select(F.col("SUP_ID").alias("sup_id"), "image", "status", "nb_predictions",
                     F.round("best_iou", 9).alias("best_iou"),
                     *[F.col(c).alias(c.lower()) for c in ("TP", "FP", "FN")])


@query("eval_totals", f"""
with {EVAL}, s as (select count(*) as images, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from details)
select *, round(tp/(tp+fp), 9) as "precision", round(tp/(tp+fn), 9) as recall, round(2e0*tp/(2*tp+fp+fn), 9) as f1 from s
""")
def eval_totals(t):
    df = evaluation.eval_totals(evaluation.image_eval(t.predictions, named_annotations(t)))
    return df.select("images", *[F.col(c).alias(c.lower()) for c in ("TP", "FP", "FN")],
                     *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("threshold_sweep", SWEEP + """
select threshold, tp, fp, fn, round(pr, 9) as "precision", round(rc, 9) as recall, round(f1, 9) as f1,
 row_number() over (order by f1 desc, threshold) = 1 as is_best from f
""")
def threshold_sweep(t):
    return sweep(t).select("threshold", *[F.col(c).alias(c.lower()) for c in ("TP", "FP", "FN")],
                           *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "is_best")


@query("detection_ap", f"""
with {EVAL}, lv as (select unnest(range(10)) as level), pos as (select count(*) as n from u where status = 'visible'),
r as (select *, row_number() over (order by confidence desc, pred_id) as rk from m),
h as (select r.rk, r.image, lv.level, row_number() over (partition by lv.level, r.image order by r.rk) as first from r join lv on r.iou >= (50 + 5*lv.level)/100e0),
tp as (select level, rk, row_number() over (partition by level order by rk) as tp from h where first = 1),
cv as (select level, tp/rk as prec, tp/pos.n as rec, tp, pos.n as n from tp, pos),
g as (select lv.level, k.k from lv join (select unnest(range(101)) as k) k on true),
ap as (select g.level, avg(coalesce((select max(prec) from cv where cv.level = g.level and g.k * cv.n <= 100 * cv.tp), 0e0)) as ap from g group by g.level),
best as (select prec, rec from cv where level = 0 order by 2e0*prec*rec/(prec+rec) desc, rec desc limit 1)
select round(max(case when level = 0 then ap end), 9) as ap50, round(avg(ap), 9) as ap50_95, round((select prec from best), 9) as "precision", round((select rec from best), 9) as recall from ap
""")
def detection_ap(t):
    df = evaluation.detection_ap(t.predictions, named_annotations(t))
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("experiment_compare", "select case experiment when 'small ring' then 'Premier' else experiment end as label, map50 from experiments where evaluation_split = 'Brand#1'")
def experiment_compare(t):
    df = review.compare_experiments(t.experiments, "Brand#1", {"small ring": "Premier"})
    return df.select("label", "map50")


# ---- ranking, ordering, sampling -----------------------------------------------------


@query("first_per_key", """
select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) q where rn = 1
""")
def first_per_key(t):
    df = cat.first_per_key(t.base("orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")])
    return df


@query("detection_numbering", """
select zone_id, detection_id as box_no, row_number() over (partition by zone_id order by prow, pcol, detection_id) as detection_id from boxes
""")
def detection_numbering(t):
    df = t.boxes.select("zone_id", "prow", "pcol", F.col("detection_id").alias("box_no"))
    return cand.number_detections(df, ["prow", "pcol", "box_no"]).select("zone_id", "box_no", "detection_id")


@query("candidate_numbering", f"with recursive {CLUSTERS} select zone_id, detection_id, case when no < 1000 then printf('C%03d', no) else 'C' || no end as candidate_id from numbered")
def candidate_numbering(t):
    df = cand.dedup_candidates(cand.far_filter(far_located(t)))
    return df.select("zone_id", "detection_id", "candidate_id")


@query("zone_candidate_ids", f"with recursive {CLUSTERS} select zone_id, detection_id, printf('%s%03d', upper(substring(zone_id, 1, 1)), review_no) as unique_candidate_id from numbered")
def zone_candidate_ids(t):
    df = cand.dedup_candidates(cand.far_filter(far_located(t)))
    return cand.zone_candidate_ids(df).select("zone_id", "detection_id", "unique_candidate_id")


@query("best_epoch", """
select run, epoch, map50, map50_95, prec, rec from (select *, row_number() over (partition by run order by map50 desc, epoch) as rn from history) q where rn = 1
""")
def best_epoch(t):
    return review.best_epochs(t.history)


@query("training_curve", "select epoch, map50, map50_95 from history where run = 'run_7'")
def training_curve(t):
    return review.training_curve(t.history, "run_7")


@query("hard_negatives", f"""
with {EVAL}, w as (select image, pred_id, coalesce(iou, 0e0) as iou, row_number() over (partition by image order by confidence desc, pred_id) as rang from m where coalesce(iou, 0e0) < 0.1)
select image, pred_id, round(iou, 9) as iou, rang from w where rang <= 5
""")
def hard_negatives(t):
    df = evaluation.hard_negatives(t.predictions, named_annotations(t))
    return df.select("image", "pred_id", F.round("iou", 9).alias("iou"), "rang")


@query("error_summary", f"""
with {EVAL}, q as (select image, count(*) as n, max(confidence) as top, max(iou) as best from m group by image),
b as (select m.image, max(m.confidence) as c from m join q on q.image = m.image and m.iou = q.best and q.best > 0 group by m.image)
select u.image, u.status = 'visible' as gt_present, coalesce(q.n, 0) as n, coalesce(q.top, 0e0) as confidence_max, round(coalesce(q.best, 0e0), 9) as best_iou, b.c as confidence_best_iou
from u left join q on q.image = u.image left join b on b.image = u.image
""")
def error_summary(t):
    df = evaluation.error_summary(t.predictions, named_annotations(t))
    return df.select("image", "gt_present", F.col("nombre_predictions").alias("n"), "confidence_max",
                     F.round("best_iou_avec_gt", 9).alias("best_iou"), "confidence_best_iou")


FINAL = {"5": 1, "14": 3, "23": 2}


@query("final_selection", "select detection_id, support_type, case detection_id when 5 then 1 when 14 then 3 else 2 end as rang_final from reviews where detection_id in (5, 14, 23)")
def final_selection(t):
    keyed = t.reviews.withColumn("detection_key", F.col("detection_id").cast("string"))
    return review.final_selection(keyed, FINAL, "detection_key").select("detection_id", "support_type", "rang_final")


@query("sort_sites", "select sup_id, insee, row_number() over (order by sup_id) as place from sites")
def sort_sites(t):
    df = t.catalogue.select(F.col("SUP_ID").alias("sup_id"), F.col("COM_CD_INSEE").alias("insee"))
    return rank_rows(df, [F.col("sup_id").asc()], name="place").orderBy("sup_id")


@query("seeded_sample", """
select s.sup_id from sites s join nation n on n.n_nationkey = s.nature_id where n.n_name not in ('NATION_3','NATION_7')
order by md5(concat('42-', s.sup_id)), s.sup_id limit 100
""")
def seeded_sample(t):
    drawn = sampling.select_sites(t.catalogue, 100, 42, ["NATION_3", "NATION_7"])
    return drawn.select(F.col("SUP_ID").alias("sup_id"))


# ---- multi-step operators --------------------------------------------------------------


@query("connected_components", f"with recursive {COMPONENTS} select f.zone_id, f.detection_id, c.component from far f join comp c on c.id = f.detection_id")
def connected_components(t):
    far = materialize(cand.far_filter(far_located(t)).select(
        "zone_id", "detection_id", "latitude", "longitude"), "far")
    metric = Metric(30.0)
    groups = close_groups(far, "detection_id", metric, group=["zone_id"])
    return label_groups(far, "detection_id", groups, metric).select("zone_id", "detection_id", "component")


CANDIDATE_SQL = """select zone_id, detection_id, nearest_sup_id, round(dist, 3) as dist, round(confidence, 6) as confidence,
 n as detections_in_cluster, ids as cluster_detection_ids, case when no < 1000 then printf('C%03d', no) else 'C' || no end as candidate_id from numbered"""


def candidate_columns(df):
    return df.select(
        "zone_id", "detection_id", F.col("nearest_SUP_ID").alias("nearest_sup_id"),
        F.round("nearest_ANFR_distance_m", 3).alias("dist"), F.round("confidence", 6).alias("confidence"),
        "detections_in_cluster", "cluster_detection_ids", "candidate_id")


@query("dedup_candidates", f"""with recursive {CLUSTERS} select zone_id, detection_id, round(latitude, 8) as latitude, round(longitude, 8) as longitude,
 n as detections_in_cluster, round(far_m, 3) as cluster_max_distance from numbered""")
def dedup_candidates(t):
    df = cand.dedup_candidates(cand.far_filter(far_located(t)))
    return df.select("zone_id", "detection_id", F.round("latitude", 8).alias("latitude"),
                     F.round("longitude", 8).alias("longitude"), "detections_in_cluster",
                     F.round("cluster_max_distance_anfr_m", 3).alias("cluster_max_distance"))


@query("cluster_members", f"""with recursive {COMPONENTS} select f.zone_id, f.detection_id,
 count(*) over (partition by c.component) as n, min(f.detection_id) over (partition by c.component) as first
 from far f join comp c on c.id = f.detection_id""")
def cluster_members(t):
    _, members = cand.merge_candidates(cand.far_filter(far_located(t)))
    sizes = members.groupBy("zone_id", "root").agg(F.count(F.lit(1)).alias("n"), F.min("detection_id").alias("first"))
    return members.join(sizes, ["zone_id", "root"]).select("zone_id", "detection_id", "n", "first")


LOOSE = """select detection_id, case when detection_id % 7 = 0 then null else zone_id end as zone_id,
 case when detection_id % 5 = 0 then cast('NaN' as double) else confidence end as confidence,
 case when detection_id % 11 = 0 then null else round(latitude, 3) end as latitude, round(longitude, 3) as longitude, 200e0 as distance from detections"""


@F.pandas_udf(DoubleType())
def world_latitude(gy: pd.Series) -> pd.Series:
    """The latitudes of ``detections`` to the last digit of the C library."""
    turns = math.pi - 2.0 * math.pi * gy / 134217728.0
    return turns.map(lambda x: math.degrees(math.atan((math.exp(x) - math.exp(-x)) / 2.0)))


@query("dedup_incomplete", f"""with x as ({LOOSE}),
c as (select *, case when isnan(confidence) then null else confidence end as conf,
 coalesce('=' || zone_id, '') || '|' || coalesce(cast(latitude as varchar) || '|' || cast(longitude as varchar), 'none ' || detection_id) as spot from x),
r as (select *, row_number() over (partition by spot order by conf desc nulls last, detection_id) as rn, count(*) over (partition by spot) as n from c)
select zone_id, detection_id, n as detections_in_cluster, conf as confidence from r where rn = 1""")
def dedup_incomplete(t):
    # A latitude on a tie is rounded by its last digit, in which exp and atan of Spark and of the C library differ.
    loose = LOOSE.replace("round(latitude, 3)", "gy").replace(
        "from detections", "from (select *, gx/134217728e0*360e0-180e0 as longitude from box_px)")
    placed = F.when(F.col("latitude").isNotNull(), F.round(world_latitude("latitude"), 3))
    df = t.sql(loose).withColumn("latitude", placed).withColumnRenamed("distance", "nearest_ANFR_distance_m")
    df = cand.dedup_candidates(df, 1.0)
    confidence = F.nanvl(F.col("confidence"), F.lit(None))
    return df.select("zone_id", "detection_id", "detections_in_cluster", confidence.alias("confidence"))


@query("build_candidates", f"with recursive {CLUSTERS} {CANDIDATE_SQL}")
def build_candidates(t):
    _, unique = cand.build_candidates(far_located(t))
    return candidate_columns(unique)


AREA_SQL = PATCHED_SQL.replace("with c as", "c as", 1).strip() + """, strong as (select * from on_patch where confidence >= 0.05)"""
AREA_CLUSTERS = AREA_SQL + ", " + CLUSTERS.replace("from detections d join", "from strong d join")


@query("area_run", f"""
with recursive {AREA_CLUSTERS}, pc as (select zone_id, count(*) as patches from patches group by zone_id),
d as (select zone_id, count(*) as n from strong group by zone_id), g as (select zone_id, count(*) as n from far group by zone_id), r as (select zone_id, count(*) as n from numbered group by zone_id)
select pc.zone_id, pc.patches, coalesce(d.n, 0) as detections, coalesce(g.n, 0) as detections_min_distance, coalesce(r.n, 0) as candidates_unique,
 0.05e0 as confidence_threshold from pc left join d on d.zone_id = pc.zone_id left join g on g.zone_id = pc.zone_id left join r on r.zone_id = pc.zone_id
""")
def area_run(t):
    run = area_of(t)
    return run.summary.select("zone_id", "patches", "detections", "detections_min_distance",
                              "candidates_unique", "confidence_threshold")


@query("sink_summary_json", f"""
with recursive {AREA_CLUSTERS} select (select count(*) from patches) as patches, (select count(*) from strong) as detections,
 (select count(*) from far) as detections_min_distance, (select count(*) from numbered) as candidates_unique, 150e0 as min_anfr_distance_m
""")
def sink_summary_json(t):
    run = area_of(t)
    names = ["patches", "detections", "detections_min_distance", "candidates_unique"]
    summary = run.summary.agg(*[F.sum(n).alias(n) for n in names],
                              F.max("min_anfr_distance_m").alias("min_anfr_distance_m"),
                              F.max("warning").alias("warning"))
    path = scratch_path(t.spark, "summary")
    writers.write_summary(summary, path)
    schema = ", ".join(f"{n} bigint" for n in names) + ", min_anfr_distance_m double"
    return t.spark.read.schema(schema).json(path)


@query("multizone_run", f"""
with recursive {AREA_CLUSTERS} select zone_id, detection_id, nearest_sup_id, round(dist, 3) as dist, ids as cluster_detection_ids,
 case when zone_no < 1000 then printf('C%03d', zone_no) else 'C' || zone_no end as candidate_id,
 concat('https://example.org/lonlat/', printf('%.6f', longitude), '/', printf('%.6f', latitude)) as map_url from numbered
""")
def multizone_run(t):
    run = area_of(t, imagery=Imagery(), settings=Detection(), map_url="https://example.org/lonlat/")
    return run.candidates.select(
        "zone_id", "detection_id", F.col("nearest_SUP_ID").alias("nearest_sup_id"),
        F.round("nearest_ANFR_distance_m", 3).alias("dist"), "cluster_detection_ids", "candidate_id", "map_url")


@query("spatial_split", f"""
with recursive {GROUP_PAIRS}, reach(id, root) as (select sup_id, sup_id from sites union select g.b, r.root from reach r join gp g on g.a = r.id),
comp as (select id, min(root) as grp from reach group by id),
sz as (select grp, count(*) as size from comp group by grp),
o as (select grp, size, row_number() over (order by size desc, md5(concat('42-', grp)), grp) as i from sz),
tot as (select sum(size)::bigint as n from sz),
tg as (select n - 2*cast(round_even(0.15e0*n, 0) as bigint) as tr, cast(round_even(0.15e0*n, 0) as bigint) as va, cast(round_even(0.15e0*n, 0) as bigint) as te from tot),
run(i, tr, va, te, ntr, nva, nte, size) as (select 0::bigint, tr, va, te, 0::bigint, 0::bigint, 0::bigint, 0::bigint from tg
 union all select o.i, case when r.tr >= r.va and r.tr >= r.te then r.tr - o.size else r.tr end,
  case when r.va > r.tr and r.va >= r.te then r.va - o.size else r.va end,
  case when r.te > r.tr and r.te > r.va then r.te - o.size else r.te end,
  case when r.size = o.size then r.ntr else 0 end + case when r.tr >= r.va and r.tr >= r.te then 1 else 0 end,
  case when r.size = o.size then r.nva else 0 end + case when r.va > r.tr and r.va >= r.te then 1 else 0 end,
  case when r.size = o.size then r.nte else 0 end + case when r.te > r.tr and r.te > r.va then 1 else 0 end, o.size
 from run r join o on o.i = r.i + 1),
q as (select size, max(ntr) as ntr, max(nva) as nva, max(nte) as nte from run where i > 0 group by size),
p as (select o.grp, row_number() over (partition by o.size order by o.i) as place, q.* from o join q on q.size = o.size)
select c.id as sup_id, c.grp as split_group, case when p.place <= p.ntr then 'train' when p.place <= p.ntr + p.nva then 'val' else 'test' end as split
from comp c join p on p.grp = c.grp
""")
def spatial_split(t):
    df = sampling.spatial_split(t.catalogue.select("SUP_ID", "latitude", "longitude"))
    return df.select(F.col("SUP_ID").alias("sup_id"), "split_group", "split")


ZONE_ROW = "sup_id, latitude, longitude, density"


@query("contrasting_zones", f"""
with {DENSITY}, a as (select {ZONE_ROW} from dens order by density desc, sup_id limit 1),
p1 as (select d.* from dens d, a where {haversine_sql('d.latitude','d.longitude','a.latitude','a.longitude')} >= 5000),
b as (select {ZONE_ROW} from p1 order by abs(density - (select median(density) from p1)), sup_id limit 1),
p2 as (select d.*, least({haversine_sql('d.latitude','d.longitude','a.latitude','a.longitude')}, {haversine_sql('d.latitude','d.longitude','b.latitude','b.longitude')}) as away
 from dens d, a, b where {haversine_sql('d.latitude','d.longitude','a.latitude','a.longitude')} >= 5000 and {haversine_sql('d.latitude','d.longitude','b.latitude','b.longitude')} >= 5000),
c as (select {ZONE_ROW} from p2 order by density, away desc, sup_id limit 1)
select 'dense' as zone_id, sup_id, density as supports_within from a union all select 'intermediaire', sup_id, density from b union all select 'peu_dense', sup_id, density from c
""")
def contrasting_zones(t):
    df = zones.contrasting_zones(t.catalogue)
    return df.select("zone_id", F.col("SUP_ID").alias("sup_id"), "supports_within")


@query("weak_labels", "select sup_id, split, concat('support_', sup_id, '.txt') as label_file, 0.15625e0 as width_norm from annotations")
def weak_labels(t):
    return ann.weak_labels(named_annotations(t)).select(
        F.col("SUP_ID").alias("sup_id"), "split", "label_file", "width_norm")


@query("human_labels", """
select split, count(*) as total_reviewed, count(*) filter (where status <> 'ambigu') as usable, count(*) filter (where status = 'visible') as visible,
 count(*) filter (where status = 'non_visible') as non_visible, count(*) filter (where status = 'ambigu') as ambiguous_excluded,
 count(*) filter (where status = 'visible') as lines from annotations group by split
""")
def human_labels(t):
    named = named_annotations(t)
    lines = ann.human_labels(named).groupBy("split").agg(
        F.count(F.when(F.col("label") != "", 1)).alias("lines"))
    return ann.human_label_counts(named).join(lines, "split")


@query("result_checks", f"""
with recursive {REVIEWED}, x(c, e, a) as (
 select 'candidates cover far detections', (select count(*) from far), (select sum(n) from reviewed)
 union all select 'one candidate per detection', (select count(*) from reviewed), (select count(distinct detection_id) from reviewed)
 union all select 'far detections', (select count(*) from near where dist >= 150), (select count(*) from far)
 union all select 'candidates without a far row', 0, 0)
select c as "check", cast(cast(e as bigint) as varchar) as expected, cast(cast(a as bigint) as varchar) as actual, true as ok from x
""")
def result_checks(t):
    detections = located(t)
    far, reviewed = reviewed_candidates(t, detections)
    reviewed = materialize(reviewed, "reviewed")
    far_rows = far.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    wanted = detections.agg(
        F.count(F.when(F.col("nearest_ANFR_distance_m") >= 150, 1)).alias("n")).select("n").scalar()
    keys = checks.same_rows(reviewed.select("zone_id", "detection_id").distinct(),
                            reviewed.join(far.select("zone_id", "detection_id"),
                                          ["zone_id", "detection_id"], "left_semi")
                            .select("zone_id", "detection_id"))
    return checks.check_table([
        checks.expectation(reviewed, "candidates cover far detections",
                           F.sum("detections_in_cluster"), far_rows),
        checks.expectation(reviewed, "one candidate per detection",
                           F.count_distinct("detection_id"), F.count(F.lit(1))),
        checks.expectation(far, "far detections", F.count(F.lit(1)), wanted),
        checks.expectation(keys, "candidates without a far row", F.sum("only_left"), 0),
    ])


@query("box_nms", """
with recursive r as (select *, row_number() over (partition by image order by confidence desc, pred_id) as k from predictions),
nms(image, k, kept) as (
 select image, cast(0 as bigint), [] :: struct(id bigint, x1 double, y1 double, x2 double, y2 double)[] from (select distinct image from r)
 union all
 select r.image, r.k, case when len([b for b in kept if
   greatest(0e0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0e0, least(b.y2, r.y2) - greatest(b.y1, r.y1))
   > 0.5e0 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)
    - greatest(0e0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0e0, least(b.y2, r.y2) - greatest(b.y1, r.y1)))]) > 0
  then kept else list_append(kept, {'id': r.pred_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}) end
 from nms join r on r.image = nms.image and r.k = nms.k + 1),
done as (select image, kept, row_number() over (partition by image order by k desc) as last from nms)
select p.pred_id, p.image, round(p.confidence, 6) as confidence from predictions p
join (select unnest([b.id for b in kept]) as id from done where last = 1) w on w.id = p.pred_id
""")
def box_nms(t):
    kept = evaluation.box_nms(t.predictions)
    return kept.select("pred_id", "image", F.round("confidence", 6).alias("confidence"))


# ---- set operations ----------------------------------------------------------------------


@query("union", "select sup_id, 'site' as origin from sites union all select sup_id, 'annotation' from annotations")
def union(t):
    return t.sites.select("sup_id", F.lit("site").alias("origin")).unionByName(
        t.annotations.select("sup_id", F.lit("annotation").alias("origin")))


@query("intersection", "select sup_id from sites intersect select cast(o_custkey as varchar) from orders")
def intersection(t):
    other = t.sql("select cast(o_custkey as varchar(20)) as sup_id from orders")
    return t.sites.select("sup_id").intersect(other)


@query("set_equality", """
select (select count(*) from sites) - (select count(*) from (select cast(o_custkey as varchar) as k from orders group by 1) o join sites s on s.sup_id = o.k) as only_left, 0::bigint as only_right
""")
def set_equality(t):
    other = t.sql("select distinct cast(o_custkey as varchar(20)) as sup_id from orders")
    return checks.same_rows(t.sites.select("sup_id"), other)


@query("distinct", "select distinct event_type, user_id from events")
def distinct(t):
    return t.base("events").select("event_type", "user_id").distinct()
