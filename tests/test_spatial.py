"""Grid searches against brute force, with limits small enough to reach every branch."""

import math
import random

import pytest
from brute import components, haversine
from pyspark.sql import functions as F

from geosieve.operators import nearest
from geosieve.operators.cells import Metric
from geosieve.operators.nearest import nearest_site
from geosieve.operators.proximity import (
    close_groups, connected_components, count_within, label_groups,
)


def scatter(seed, n, lat, lon, spread_m):
    rng = random.Random(seed)
    points = []
    for _ in range(n):
        dy, dx = rng.uniform(-spread_m, spread_m), rng.uniform(-spread_m, spread_m)
        la = lat + math.degrees(dy / 6371008.8)
        lo = lon + math.degrees(dx / 6371008.8 / max(0.01, math.cos(math.radians(lat))))
        points.append((max(-90.0, min(90.0, la)), (lo + 180.0) % 360.0 - 180.0))
    return points


def crowd():
    """A dense spot, copies, a sparse field, both sides of the date line, a pole."""
    points = scatter(1, 60, 48.8, 2.1, 40) + scatter(2, 40, 48.8, 2.1, 400)
    points += [points[0]] * 5 + scatter(3, 30, 10.0, 180.0, 80) + scatter(4, 20, 90.0, 0.0, 100)
    return points


def frame(spark, points):
    rows = [(i, "z", la, lo) for i, (la, lo) in enumerate(points)]
    return spark.createDataFrame(rows, "id long, zone_id string, latitude double, longitude double")


@pytest.mark.parametrize("open_pairs", [1024, 4])
def test_counts_match_brute_force(spark, open_pairs):
    points = crowd()
    got = count_within(frame(spark, points), "id", Metric(60.0), group=["zone_id"], name="n",
                       open_pairs=open_pairs)
    want = {i: sum(haversine(p, q) <= 60.0 for q in points) for i, p in enumerate(points)}
    assert {r.id: r.n for r in got.collect()} == want


@pytest.mark.parametrize("open_pairs", [1024, 1])
def test_groups_match_brute_force(spark, open_pairs):
    points = crowd()
    metric = Metric(30.0)
    df = frame(spark, points)
    groups = close_groups(df, "id", metric, group=["zone_id"], open_pairs=open_pairs)
    got = {r.id: r.component for r in label_groups(df, "id", groups, metric).collect()}
    n = len(points)
    linked = [(i, j) for i in range(n) for j in range(i) if haversine(points[i], points[j]) <= 30.0]
    assert got == dict(enumerate(components(n, linked)))


def test_strict_and_inclusive_limits(spark):
    step = math.degrees(200.0 / 6371000.0)
    df = frame(spark, [(0.0, 0.0), (0.0, step * (1 - 1e-9)), (0.0, 3 * step)])
    metric = Metric(200.0, strict=True, radius=6371000.0, legacy=True)
    got = {r.id: r.n for r in count_within(df, "id", metric, name="n").collect()}
    assert got == {0: 2, 1: 2, 2: 1}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [("c", i, i + 1) for i in range(300)]
    star = [("s", 0, i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star, "g string, a long, b long")
    roots = connected_components(edges, ["g"]).groupBy("g").agg(
        F.count_distinct("root").alias("roots"), F.count("*").alias("n")).collect()
    assert {r.g: (r.roots, r.n) for r in roots} == {"c": (1, 301), "s": (1, 200)}
    assert connected_components(edges.limit(0), ["g"]).count() == 0


def test_components_with_joins_beyond_broadcast(spark, monkeypatch):
    import geosieve.operators.proximity as proximity
    import geosieve.operators.spread as spread

    monkeypatch.setattr(proximity, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(spread, "HOT_ROWS", 5)
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = connected_components(edges).collect()
    assert len({r.root for r in got if r.id < 100}) == 1
    assert len({r.root for r in got}) == 2


def test_crowds_at_exactly_the_limit(spark):
    """Two specks of a micrometre whose distance is the limit: halving cells would not end."""
    rng = random.Random(12)
    step = math.degrees(30.0 / 6371008.8)
    speck = lambda la: {(la + rng.uniform(-1e-11, 1e-11), 2.1 + rng.uniform(-1e-11, 1e-11)) for _ in range(700)}
    points = sorted(speck(48.8)) + sorted(speck(48.8 + step))
    df = frame(spark, points)
    got = {r.id: r.n for r in count_within(df, "id", Metric(30.0), name="n").collect()}
    near = [sum(haversine(p, q) <= 30.0 for q in points) for p in points[::40]]
    assert [got[i] for i in range(0, len(points), 40)] == near and len(set(near)) > 1
    groups = close_groups(df, "id", Metric(30.0))
    labels = {r.id: r.component for r in label_groups(df, "id", groups, Metric(30.0)).collect()}
    assert set(labels.values()) == {0}


def best_site(p, sites):
    return min((haversine(p, (la, lo)), s) for s, la, lo in sites)


@pytest.mark.parametrize("limits", [{}, {"list_max": 3}, {"list_max": 3, "finest": 19}])
def test_nearest_matches_brute_force(spark, limits):
    spots = scatter(5, 80, 48.8, 2.1, 300) + scatter(6, 30, 48.8, 2.1, 20_000)
    sites = [(f"s{i}", la, lo) for i, (la, lo) in enumerate(spots)]
    sites.append(("a-copy", *spots[3]))
    points = (scatter(7, 60, 48.8, 2.1, 500) + scatter(8, 20, 49.5, 3.0, 50_000)
              + [(0.0, 180.0), (-90.0, 0.0), (10.0, -179.9), spots[3]])
    df = frame(spark, points)
    catalogue = spark.createDataFrame(sites, "SUP_ID string, latitude double, longitude double")
    got = {r.id: r for r in nearest_site(df, catalogue, ["id"], **limits).collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        distance, site = best_site(p, sites)
        assert got[i].nearest_ANFR_distance_m == pytest.approx(distance, abs=1e-6)
        assert got[i].nearest_SUP_ID == site
    assert got[len(points) - 1].nearest_SUP_ID == "a-copy"


@pytest.mark.parametrize("limits", [{}, {"list_max": 3, "finest": 19}])
def test_far_points_alone(spark, limits):
    """``beyond`` gives the rows that a filter on the distance would leave, whatever the lists."""
    spots = scatter(5, 80, 48.8, 2.1, 900) + scatter(6, 30, 48.8, 2.1, 20_000)
    sites = [(f"s{i}", la, lo) for i, (la, lo) in enumerate(spots)]
    points = scatter(7, 150, 48.8, 2.1, 1_500) + scatter(8, 20, 49.5, 3.0, 50_000) + [(0.0, 180.0), (-48.8, -177.9), spots[3]]
    catalogue = spark.createDataFrame(sites, "SUP_ID string, latitude double, longitude double")
    near = {i: best_site(p, sites) for i, p in enumerate(points)}
    for beyond in (150.0, 30_000.0):
        far = nearest_site(frame(spark, points), catalogue, ["id"], beyond=beyond, **limits).collect()
        got = {r.id: r.nearest_SUP_ID for r in far}
        assert got == {i: site for i, (distance, site) in near.items() if distance >= beyond}


def test_nearest_among_many_sites_in_one_cell(spark):
    """10^5 sites within one kilometre, points inside, near and far: no windows, and brute force agrees."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = 100_000
    la, lo = 48.8 + rng.uniform(0, 0.009, n), 2.1 + rng.uniform(0, 0.013, n)
    px = np.concatenate([48.8 + rng.uniform(-0.002, 0.011, 150), rng.uniform(-80, 80, 20)])
    py = np.concatenate([2.1 + rng.uniform(-0.002, 0.015, 150), rng.uniform(-180, 180, 20)])
    import pandas as pd

    catalogue = spark.createDataFrame(pd.DataFrame({"SUP_ID": [f"s{i}" for i in range(n)], "latitude": la, "longitude": lo}))
    points = spark.createDataFrame(pd.DataFrame({"id": range(len(px)), "latitude": px, "longitude": py}))
    found = nearest_site(points, catalogue, ["id"])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.nearest_ANFR_distance_m for r in found.collect()}
    for i, (a, b) in enumerate(zip(np.radians(px), np.radians(py))):
        h = np.sin((np.radians(la) - a) / 2) ** 2 + np.cos(a) * np.cos(np.radians(la)) * np.sin((np.radians(lo) - b) / 2) ** 2
        want = (2 * 6371008.8 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0, 1 - h)))).min()
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_nearest_of_another_label(spark):
    rng = random.Random(9)
    rows = [(f"s{i:02d}", rng.choice(["train", "val", "test"]), la, lo)
            for i, (la, lo) in enumerate(scatter(10, 40, 48.0, 2.0, 30_000))]
    df = spark.createDataFrame(rows, "SUP_ID string, split string, latitude double, longitude double")
    got = {r.SUP_ID: r for r in nearest_site(df, df, ["SUP_ID"], apart="split").collect()}
    for s, split, la, lo in rows:
        want = min(haversine((la, lo), (b, c)) for _, other, b, c in rows if other != split)
        assert got[s].nearest_ANFR_distance_m == pytest.approx(want, abs=1e-6)


def test_nearest_needs_a_site(spark):
    none = spark.createDataFrame([("x", None, 1.0)], "SUP_ID string, latitude double, longitude double")
    with pytest.raises(ValueError):
        nearest_site(frame(spark, [(0.0, 0.0)]), none, ["id"])


def test_nearest_joins_with_a_hot_cell(spark, monkeypatch):
    import geosieve.operators.nearest as nearest
    import geosieve.operators.spread as spread

    monkeypatch.setattr(nearest, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(spread, "HOT_ROWS", 7)
    sites = [(f"s{i}", la, lo) for i, (la, lo) in enumerate(scatter(11, 10, 48.8, 2.1, 400))]
    points = scatter(12, 50, 48.8, 2.1, 30)
    catalogue = spark.createDataFrame(sites, "SUP_ID string, latitude double, longitude double")
    got = {r.id: r.nearest_SUP_ID for r in nearest_site(frame(spark, points), catalogue, ["id"]).collect()}
    assert got == {i: best_site(p, sites)[1] for i, p in enumerate(points)}


@pytest.mark.parametrize("served", [0, 4])
def test_nearest_site_of_crowded_points_with_lists_of_finer_cells(spark, monkeypatch, served):
    # 4,000 points in half a square kilometre, 300 sites within, two of them at one position.
    monkeypatch.setattr(nearest, "SERVED", served)
    rng = random.Random(5)
    spots = [(48.0 + rng.random() * 0.006, 2.0 + rng.random() * 0.01) for _ in range(300)]
    spots[7] = spots[3]
    points = [(48.0 + rng.random() * 0.006, 2.0 + rng.random() * 0.01) for _ in range(4000)]
    sites = spark.createDataFrame([(f"s{i}", *p) for i, p in enumerate(spots)], "SUP_ID string, latitude double, longitude double")
    got = {r.id: r for r in nearest_site(frame(spark, points), sites, ["id"]).collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        best = min((haversine(p, s), f"s{k}") for k, s in enumerate(spots))
        row = got[i]
        assert row.nearest_SUP_ID == best[1] and abs(row.nearest_ANFR_distance_m - best[0]) < 1e-6


def test_bound_of_a_list_is_worked_out_once(spark):
    # Worked out for every item, this takes 10^10 steps.
    df = spark.range(1).selectExpr("transform(sequence(1, 100000), x -> x + id) as near")
    kept = nearest._kept("near", "x -> x", "array_min(transform(near, x -> x + 10))")
    assert df.selectExpr(f"size({kept}) as n").first().n == 11
