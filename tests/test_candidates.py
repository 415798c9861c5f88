import random

import pytest
from pyspark.sql import functions as F

from geosieve.operators import candidates as cand

SCHEMA = ("detection_id long, zone_id string, confidence double, latitude double, "
          "longitude double, nearest_ANFR_distance_m double")


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


FOUR = [(11, "N", 0.35, 45.2, 5.7, 420.0), (12, "N", 0.62, 45.20008, 5.70003, 431.5),
        (13, "N", 0.95, 45.3, 5.9, 12.0), (14, "S", 0.21, 45.20008, 5.70003, 299.0)]


def test_filter_and_merge(spark):
    far, unique = cand.build_candidates(make(spark, FOUR))
    assert far.count() == 3
    rows = unique.orderBy("candidate_id").collect()
    assert [(r.detection_id, r.candidate_id, r.detections_in_cluster, r.cluster_detection_ids) for r in rows] == [
        (12, "C001", 2, "11,12"), (14, "C002", 1, "14")]
    assert rows[0].cluster_max_distance_anfr_m == 431.5 and rows[0].cluster_max_confidence == 0.62


def test_result_does_not_depend_on_partitions(spark):
    def result(n):
        _, unique = cand.build_candidates(make(spark, FOUR).repartition(n))
        return sorted(tuple(r) for r in unique.select("detection_id", "candidate_id").collect())

    assert result(1) == result(7)


def test_limit_is_inclusive_and_unknown_distance_is_dropped(spark):
    rows = [(1, "A", 0.1, 48.0, 2.0, 150.0), (2, "A", 0.1, 48.0, 3.0, 149.999),
            (3, "A", 0.1, 48.0, 4.0, None), (4, "A", 0.1, 48.0, 5.0, float("nan"))]
    assert [r.detection_id for r in cand.far_filter(make(spark, rows)).collect()] == [1]
    text = make(spark, rows).withColumn("nearest_ANFR_distance_m", F.lit("151,0"))
    assert cand.far_filter(text).count() == 0


def test_wrong_arguments(spark):
    df = make(spark, FOUR)
    with pytest.raises(ValueError, match="confidence"):
        cand.far_filter(df.drop("confidence"))
    with pytest.raises(ValueError):
        cand.far_filter(df, -1.0)
    with pytest.raises(ValueError):
        cand.cluster_detections(df, 0.0)


def test_chains_merge_zones_do_not_and_ties_go_to_the_first(spark):
    step = 0.00025  # about 28 m of latitude
    rows = [(10 + i, "A", 0.5, 48.0 + i * step, 2.0, 200.0 + i) for i in range(4)]
    rows += [(20, "B", 0.5, 48.0, 2.0, 300.0), (21, "B", 0.5, 48.0, 2.0, 310.0)]
    unique = cand.dedup_candidates(make(spark, rows)).orderBy("candidate_id").collect()
    assert [(r.zone_id, r.detection_id, r.detections_in_cluster) for r in unique] == [("A", 10, 4), ("B", 20, 2)]
    assert unique[0].cluster_max_distance_anfr_m == 203.0


def test_merging_twice_changes_nothing(spark):
    rows = [(i, "A", i / 100, 48.0 + (i % 7) * 0.0002, 2.0 + (i % 5) * 0.0009, 200.0) for i in range(60)]
    once = cand.dedup_candidates(make(spark, rows))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    twice = cand.dedup_candidates(once.select(*columns))
    assert once.select("detection_id").exceptAll(twice.select("detection_id")).isEmpty()
    assert once.count() == twice.count()


def test_no_far_detection_gives_an_empty_table(spark):
    unique = cand.dedup_candidates(make(spark, FOUR).filter("detection_id > 99"))
    assert unique.count() == 0 and "candidate_id" in unique.columns


def test_clusters_of_any_size_list_their_members(spark):
    rows = [(i, "A", 0.5, 48.0, 2.0 + i * 1e-7, 200.0) for i in range(20)] + [(50, "A", 0.5, 49.0, 2.0, 200.0)]
    table, members = cand.merge_candidates(make(spark, rows))
    lists = {r.detections_in_cluster: r.cluster_detection_ids for r in table.collect()}
    assert lists == {20: ",".join(map(str, range(20))), 1: "50"}
    assert sorted(r["count"] for r in members.groupBy("root").count().collect()) == [1, 20]


def test_large_clusters_are_listed_in_pages(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "A", 0.5, 48.0, 2.0 + i * 1e-7, 200.0) for i in rng.sample(range(1000), 90)]
    rows += [(2000 + i, None, 0.5, 48.0, 2.0, 200.0) for i in range(4)] + [(3000, "B", 0.5, 48.0, 2.0, 200.0)]
    ids = sorted(r[0] for r in rows if r[1] == "A")
    clusters = cand.cluster_detections(make(spark, rows))
    pages = sorted((r.zone_id, r.page, r.ids) for r in clusters.pages(40).collect())
    assert pages == [("", 0, [2000, 2001, 2002, 2003]), ("=A", 0, ids[:40]), ("=A", 1, ids[40:80]), ("=A", 2, ids[80:])]
    monkeypatch.setattr(cand, "PAGE", 7)
    got = {r.zone_id: r.cluster_detection_ids for r in cand.dedup_candidates(make(spark, rows)).collect()}
    assert got == {"A": ",".join(map(str, ids)), None: "2000,2001,2002,2003", "B": "3000"}


def test_incomplete_detections_stay(spark):
    rows = [(1, "A", 0.5, None, 2.0, 200.0), (2, "A", float("nan"), 44.0, 2.0, 200.0), (3, "A", 0.1, 44.0, 2.0, 210.0),
            (4, None, 0.2, 44.0, 2.0, 200.0), (5, None, 0.3, 44.0, 2.0, 200.0), (6, None, None, None, None, 200.0)]
    got = sorted((r.detection_id, r.zone_id, r.cluster_detection_ids) for r in cand.dedup_candidates(make(spark, rows)).collect())
    assert got == [(1, "A", "1"), (3, "A", "2,3"), (5, None, "4,5"), (6, None, "6")]

def test_numbers_restart_per_zone_when_asked(spark):
    unique = cand.dedup_candidates(cand.far_filter(make(spark, FOUR)), per_zone=True)
    assert {r.zone_id: r.candidate_id for r in unique.collect()} == {"N": "C001", "S": "C001"}


def test_review_ids(spark):
    rows = [("dense", 1, 0.4), ("dense", 2, 0.9), ("peu_dense", 3, 0.1)]
    df = spark.createDataFrame(rows, "zone_id string, detection_id long, confidence double")
    got = {r.detection_id: r.unique_candidate_id for r in cand.zone_candidate_ids(df).collect()}
    assert got == {1: "D002", 2: "D001", 3: "P001"}
