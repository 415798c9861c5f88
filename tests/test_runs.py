import json

import pytest
from pyspark.sql import functions as F

from geosieve.operators import images, review
from geosieve.operators.zones import grid_patches
from geosieve.plans import area


def setup(spark):
    zones = spark.createDataFrame([("A", 48.8, 2.1), ("B", 45.0, 5.0)], "zone_id string, latitude double, longitude double")
    patches = grid_patches(zones)
    boxes = [(1, "A", "A_r02_c02.jpg", 0.9, 500.0, 500.0, 524.0, 524.0),
             (2, "A", "A_r00_c00.jpg", 0.6, 10.0, 10.0, 30.0, 30.0), (3, "A", "A_r00_c00.jpg", 0.7, 12.0, 12.0, 32.0, 32.0),
             (1, "B", "B_r04_c04.jpg", 0.4, 900.0, 900.0, 1000.0, 1000.0), (2, "B", "B_r04_c04.jpg", 0.01, 1.0, 1.0, 5.0, 5.0)]
    df = spark.createDataFrame(boxes, "detection_id long, zone_id string, image string, confidence double, "
                                      "x1 double, y1 double, x2 double, y2 double")
    sites = spark.createDataFrame([("S1", 48.8, 2.1, "Pylône", "30"), ("S2", 45.0, 5.0, "Mât", "7,9")],
                                  "SUP_ID string, latitude double, longitude double, NAT_LB_NOM string, SUP_NM_HAUT string")
    return patches, df, sites


def test_box_at_the_patch_centre_is_at_the_site(spark):
    patches, boxes, sites = setup(spark)
    row = area.attach_sites(area.locate_boxes(boxes, patches), sites).filter("zone_id = 'A' and detection_id = 1").first()
    assert row.latitude == pytest.approx(48.8, abs=1e-6) and row.longitude == pytest.approx(2.1, abs=1e-6)
    assert row.nearest_ANFR_distance_m < 0.1  # the patch grid is rounded to whole pixels
    assert (row.nearest_SUP_ID, row.nearest_ANFR_nature, row.nearest_ANFR_height) == ("S1", "Pylône", "30")


def test_run_over_two_zones(spark, tmp_path):
    patches, boxes, sites = setup(spark)
    run = area.run_zones(patches, boxes, sites, map_url="https://maps.example/")
    got = {(r.zone_id, r.detection_id, r.candidate_id, r.detections_in_cluster) for r in run.candidates.collect()}
    assert got == {("A", 3, "C001", 2), ("B", 1, "C001", 1)}
    summary = {r.zone_id: (r.patches, r.detections, r.detections_min_distance, r.candidates_unique) for r in run.summary.collect()}
    assert summary == {"A": (25, 3, 2, 1), "B": (25, 1, 1, 1)}
    area.write_run(run, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/candidats_uniques")
    assert back.count() == 2 and "map_url" in back.columns
    docs = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/resume").collect()]
    assert {d["zone_id"] for d in docs} == {"A", "B"} and docs[0]["dedup_distance_m"] == 30.0


def test_run_searches_far_detections_only(spark, monkeypatch):
    """The sites of near detections are searched when they are asked for, and patches without boxes are not joined."""
    patches, boxes, sites = setup(spark)
    asked, search = [], area.nearest_site
    monkeypatch.setattr(area, "nearest_site", lambda *a, **k: asked.append(k.get("beyond")) or search(*a, **k))
    run = area.run_zones(patches, boxes, sites)
    assert asked == [150.0]
    key = lambda df: {(r.zone_id, r.detection_id, r.nearest_SUP_ID, r.nearest_ANFR_nature) for r in df.collect()}
    assert key(run.far) == {("A", 2, "S1", "Pylône"), ("A", 3, "S1", "Pylône"), ("B", 1, "S2", "Mât")}
    assert key(run.detections) == key(run.far) | {("A", 1, "S1", "Pylône")} and asked == [150.0, None]
    with pytest.raises(ValueError, match="2 boxes lie on no known patch"):
        area.locate_boxes(boxes, patches.filter("image <> 'A_r00_c00.jpg'"))


def test_review_reports(spark):
    rows = [("D1", "plausible", "mat", "False"), ("D2", " faux_positif", "x", "oui"), ("D3", None, None, None), ("D4", "?", "y", None)]
    df = spark.createDataFrame(rows, "unique_candidate_id string, review_status string, support_type string, selection_finale string")
    layers = {r.unique_candidate_id: r.layer for r in review.layer_class(df, ["D4"]).collect()}
    assert layers == {"D1": "plausible", "D2": "final", "D3": "non_revu", "D4": "final"}
    assert {r.review_status: r.n for r in review.status_counts(df).collect()}[""] == 1
    assert [tuple(r) for r in review.plausible_types(df).collect()] == [("mat", 1)]
    final = review.final_selection(df, {"D4": 1, "D1": 2}).collect()
    assert {(r.unique_candidate_id, r.rang_final) for r in final} == {("D4", 1), ("D1", 2)}


def test_zone_summary_share(spark):
    ids = spark.createDataFrame([("a", 25), ("b", 25)], "zone_id string, patches int")
    detections = spark.createDataFrame([("a",)] * 4, "zone_id string")
    reviewed = spark.createDataFrame([("a", "plausible"), ("a", "incertain")], "zone_id string, review_status string")
    got = {r.zone_id: r for r in review.zone_summary(ids, detections, detections.limit(3), reviewed).collect()}
    assert (got["a"].detections_brutes, got["a"].detections_far, got["a"].candidats_uniques, got["a"].taux_plausibles_pct) == (4, 3, 2, 50.0)
    assert got["b"].candidats_uniques == 0 and got["b"].taux_plausibles_pct is None


def test_map_center_falls_back(spark):
    schema = "latitude double, longitude double"
    some = spark.createDataFrame([(48.0, 2.0), (50.0, None)], schema)
    none = spark.createDataFrame([(None, None)], schema)
    assert tuple(review.map_center(some, none).first()) == (49.0, 2.0)
    assert tuple(review.map_center(none, some).first()) == (49.0, 2.0)
    assert tuple(review.map_center(none, none).first()) == (48.8, 2.1)


def test_best_epoch_takes_the_first_of_equals(spark):
    rows = [("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7), ("s", 9, 0.1)]
    df = spark.createDataFrame(rows, "run string, epoch long, map50 double").withColumns(
        {c: F.lit(0.0) for c in ("map50_95", "prec", "rec")})
    assert {r.run: r.epoch for r in review.best_epochs(df).collect()} == {"r": 2, "s": 9}


def test_image_names(spark):
    sites = spark.createDataFrame([("105408",), ("7",), ("img7",)], "SUP_ID string")
    names = ["105408.jpg", "ANFR_105408.jpg", "99_7_105408.png", "img7.jpg", "none.jpg", "in/7.tiff"]
    df = spark.createDataFrame(list(enumerate(names)), "no int, filename string")
    got = {r.filename: r.SUP_ID for r in images.match_images(df, sites, "no").collect()}
    assert got == dict(zip(names, ["105408", "105408", "7", "img7", None, "7"]))


def test_comparison_with_the_site(spark):
    listed = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "image string, SUP_ID string")
    boxes = [(1, "a", 0.5, 510.0, 510.0, 514.0, 514.0), (2, "a", 0.25, 0.0, 0.0, 4.0, 4.0), (3, "b", 0.5, 0.0, 0.0, 4.0, 4.0)]
    df = spark.createDataFrame(boxes, "pred_id long, image string, confidence double, x1 double, y1 double, x2 double, y2 double")
    offsets = images.local_offsets(df)
    got = {(r.pred_id, r.image): (r.statut, r.correspondance) for r in images.compare_detections(listed, offsets, 15.0).collect()}
    assert got == {(1, "a"): (images.NEAR_SITE, True), (2, "a"): (images.FAR_FROM_SITE, False),
                   (3, "b"): (images.NO_REFERENCE, False), (None, "c"): (images.NOT_DETECTED, False)}
    kpi = {r.image: (r.detections, r.confidence_max, r.near_site) for r in images.detection_kpis(offsets, 15.0).collect()}
    assert kpi == {"a": (2, 0.5, 1), "b": (1, 0.5, 0)}
