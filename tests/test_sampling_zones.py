import math
import random

import pytest
from brute import components, haversine
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geosieve.config import Imagery
from geosieve.operators import sampling, zones

SHARES = sampling.SHARES
LEGACY = 6371000.0


def greedy(sizes, targets, shares):
    left = dict(targets)
    counts = {}
    for size in sorted(sizes, reverse=True):
        options = [s for s in left if left[s] > 0]
        chosen = max(options, key=lambda s: (left[s], shares[s]))
        left[chosen] -= size
        counts[size, chosen] = counts.get((size, chosen), 0) + 1
    return counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=3, max_size=120))
def test_quota_plan_equals_placing_one_group_at_a_time(sizes):
    total = sum(sizes)
    targets = {s: round(v * total) for s, v in SHARES.items()}
    targets["train"] += total - sum(targets.values())
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    got = {}
    for size, split, first, last in sampling.plan_quotas(histogram, targets, SHARES):
        got[size, split] = last - first + 1
    assert got == greedy(sizes, targets, SHARES)


def sites(spark, n, seed, spread_deg=0.05):
    rng = random.Random(seed)
    rows = [(f"{i}", "Mât" if i % 5 else "Tunnel", 48.0 + rng.random() * spread_deg, 2.0 + rng.random() * spread_deg)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "SUP_ID string, NAT_LB_NOM string, latitude double, longitude double")


def test_sample_is_exact_reproducible_and_eligible(spark):
    _, df = sites(spark, 60, 1)
    drawn = [r.SUP_ID for r in sampling.select_sites(df, 20).collect()]
    again = [r.SUP_ID for r in sampling.select_sites(df.repartition(5), 20).collect()]
    other = [r.SUP_ID for r in sampling.select_sites(df, 20, seed=7).collect()]
    assert drawn == again == sorted(drawn) and len(drawn) == 20 and drawn != other
    assert all(int(s) % 5 for s in drawn)
    for bad in (0, 49):
        with pytest.raises(ValueError):
            sampling.select_sites(df, bad)
    with pytest.raises(ValueError, match="one row"):
        sampling.select_sites(df.union(df), 5)


def test_split_keeps_neighbours_together(spark):
    rows, df = sites(spark, 150, 2)
    got = {r.SUP_ID: r.split for r in sampling.spatial_split(df).collect()}
    assert len(got) == 150
    spots = [(la, lo) for _, _, la, lo in rows]
    linked = [(i, j) for i in range(150) for j in range(i) if haversine(spots[i], spots[j], LEGACY) < 200]
    for i, j in linked:
        assert got[str(i)] == got[str(j)]
    counts = {s: sum(v == s for v in got.values()) for s in SHARES}
    label = components(150, linked)
    sizes = [label.count(c) for c in set(label)]
    targets = {"train": 150 - 44, "val": 22, "test": 22}
    want = greedy(sizes, targets, SHARES)
    assert counts == {s: sum(size * n for (size, to), n in want.items() if to == s) for s in SHARES}
    split = df.join(spark.createDataFrame(list(got.items()), "SUP_ID string, split string"), "SUP_ID")
    least = sampling.min_split_distance(split).first()[0]
    assert least == pytest.approx(min(
        haversine(spots[i], spots[j], LEGACY) for i in range(150) for j in range(i)
        if got[str(i)] != got[str(j)]), abs=1e-6)
    assert least >= 200


def test_split_arguments(spark):
    _, df = sites(spark, 5, 3)
    with pytest.raises(ValueError):
        sampling.spatial_split(df, shares={"train": 0.5, "val": 0.4})
    with pytest.raises(ValueError):
        sampling.spatial_split(df, 0.0)
    with pytest.raises(ValueError):
        sampling.spatial_split(df.limit(2))


def planar_counts(spots, radius):
    mean = sum(math.radians(la) for la, _ in spots) / len(spots)
    xy = [(6371008.8 * math.radians(lo) * math.cos(mean), 6371008.8 * math.radians(la)) for la, lo in spots]
    return [sum((a - c) ** 2 + (b - d) ** 2 <= radius**2 for c, d in xy) for a, b in xy]


def test_density_and_zones(spark):
    rows, df = sites(spark, 120, 4, spread_deg=0.4)
    near = [(f"n{i}", "Mât", 48.2 + i * 1e-4, 2.2) for i in range(8)]
    df = df.union(spark.createDataFrame(near, df.schema))
    rows = rows + near
    counts = planar_counts([(la, lo) for _, _, la, lo in rows], 500.0)
    got = {r.SUP_ID: r.density for r in zones.density_counts(df).collect()}
    assert got == {r[0]: c for r, c in zip(rows, counts)}

    table = sorted(((r[0], (r[2], r[3]), c) for r, c in zip(rows, counts)))
    dense = min(table, key=lambda t: (-t[2], t[0]))
    pool = [t for t in table if haversine(t[1], dense[1]) >= 5000]
    densities = sorted(t[2] for t in pool)
    middle = len(densities) // 2
    median = densities[middle] if len(densities) % 2 else (densities[middle - 1] + densities[middle]) / 2
    medium = min(pool, key=lambda t: (abs(t[2] - median), t[0]))
    pool = [t for t in table if haversine(t[1], dense[1]) >= 5000 and haversine(t[1], medium[1]) >= 5000]
    sparse = min(pool, key=lambda t: (t[2], -min(haversine(t[1], dense[1]), haversine(t[1], medium[1])), t[0]))
    chosen = [(r.zone_id, r.SUP_ID, r.supports_within) for r in zones.contrasting_zones(df).collect()]
    assert chosen == [("dense", dense[0], dense[2]), ("intermediaire", medium[0], medium[2]),
                      ("peu_dense", sparse[0], sparse[2])]
    with pytest.raises(ValueError, match="far enough"):
        zones.contrasting_zones(df, separation_m=1e6)
    with pytest.raises(ValueError, match="three located sites"):
        zones.contrasting_zones(df.limit(2))
    with pytest.raises(ValueError, match="1 sites have no position"):
        zones.density_counts(df.union(df.limit(1).withColumn("latitude", F.lit(None).cast("double"))))


def test_patches_follow_half_even_and_tile(spark):
    zone = spark.createDataFrame([("z", 48.7975, 2.13)], "zone_id string, latitude double, longitude double")
    patches = zones.grid_patches(zone)
    rows = {(r.row, r.col): r for r in patches.collect()}
    assert len(rows) == 25 and rows[0, 0].image == "z_r00_c00.jpg"
    assert (rows[0, 0].world_left, rows[0, 0].world_top) == (67900426, 46205620)
    assert rows[0, 0].north == pytest.approx(48.8020230146336, abs=1e-12)
    assert rows[4, 4].world_right - rows[0, 0].world_left == 5 * 1024
    tiles = zones.patch_tiles(patches).filter("row = 0 and col = 0").collect()
    assert len(tiles) == 25
    for t in tiles:
        assert 0 <= t.crop_left < 256 and t.tile_x * 256 - t.paste_x + t.crop_left == t.world_left
    cfg = Imagery(zoom=1, grid_size=1, patch_size=2)
    even = spark.createDataFrame([("z", 0.0, 0.5 / 512 * 360 - 180 + 1.0 / 512 * 360)], "zone_id string, latitude double, longitude double")
    assert zones.grid_patches(even, cfg).first().world_left == 0  # 0.5 rounds to even


def test_sites_in_extents(spark):
    rows, df = sites(spark, 300, 5, spread_deg=0.02)
    extents = spark.createDataFrame(
        [("a", 48.013, 48.004, 2.003, 2.016), ("none", 10.0, 9.99, 2.0, 2.01), ("edge", rows[0][2], 48.0, 2.0, rows[0][3])],
        "zone_id string, north double, south double, west double, east double")
    got = {r.zone_id: r.sites_in_extent for r in zones.sites_in_extents(extents, df).collect()}
    def inside(n, s, w, e):
        return sum(s <= la <= n and w <= lo <= e for _, _, la, lo in rows)
    assert got == {"a": inside(48.013, 48.004, 2.003, 2.016), "none": 0, "edge": inside(rows[0][2], 48.0, 2.0, rows[0][3])}


def test_cover_of_a_country_is_short_and_exact(spark):
    extents = spark.createDataFrame(
        [("land", 51.1, 41.3, -5.2, 9.6), ("all", 90.0, -90.0, -180.0, 180.0), ("spot", 2.5, 2.5, 3.25, 3.25), ("back", 1.0, 2.0, 0.0, 1.0)],
        "zone_id string, north double, south double, west double, east double")
    counts = {r.zone_id: r.n for r in zones._cover(extents, 16.0, 14).groupBy("zone_id").agg(F.count("*").alias("n")).collect()}
    assert counts["land"] < 100_000 and counts["spot"] <= 4 and "back" not in counts
    # A small pyramid: every cell of the finest level is covered once, inside or on the rim as it should be.
    small = spark.createDataFrame([("z", 6.3, -2.2, 0.4, 9.0)], "zone_id string, north double, south double, west double, east double")
    seen = {}
    for r in zones._cover(small, 4.0, 4).collect():
        k = 2 ** (3 - r.level)
        for i in range(r.ci * k, (r.ci + 1) * k):
            for j in range(r.cj * k, (r.cj + 1) * k):
                assert (i, j) not in seen
                seen[i, j] = r.inside
    want = {(i, j): -2.2 < i * 0.5 and (i + 1) * 0.5 < 6.3 and 0.4 < j * 0.5 and (j + 1) * 0.5 < 9.0 for i in range(-5, 13) for j in range(0, 19)}
    assert seen == want
    rows, df = sites(spark, 400, 6, spread_deg=30.0)
    got = {r.zone_id: r.sites_in_extent for r in zones.sites_in_extents(extents, df).collect()}
    for z, n, s, w, e in [tuple(r) for r in extents.collect()]:
        assert got[z] == sum(s <= la <= n and w <= lo <= e for _, _, la, lo in rows)
