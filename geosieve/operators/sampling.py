"""Seeded samples and a train/val/test split that keeps neighbours together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import geo, text
from geosieve.operators import checks
from geosieve.operators.catalogue import exclude_natures
from geosieve.operators.cells import Metric
from geosieve.operators.nearest import nearest_site
from geosieve.operators.proximity import close_groups, label_groups
from geosieve.operators.spread import (
    BROADCAST_ROWS, materialize, materialize_with, rank_rows, skew_join,
)

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def seeded_order(seed: int, column: str):
    """A reproducible shuffle: the digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(column).cast("string")))


def split_metric(distance_m: float = 200.0) -> Metric:
    return Metric(distance_m, strict=True, radius=geo.SPLIT_RADIUS_M, legacy=True)


def select_sites(
    sites: DataFrame, count: int = 300, seed: int = 42, excluded: list[str] | None = None
) -> DataFrame:
    """Exactly ``count`` eligible sites, the same ones for the same seed, by id as text."""
    checks.require_columns(sites, ["SUP_ID", "NAT_LB_NOM", "latitude", "longitude"])
    if count <= 0:
        raise ValueError("count must be positive")
    if not checks.duplicated_keys(sites, "SUP_ID").isEmpty():
        raise ValueError("the catalogue must have one row per SUP_ID")
    positions = text.numbers(sites, ["latitude", "longitude"])
    eligible = exclude_natures(sites.withColumns(positions), excluded)
    found = eligible.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(checks.bad_coordinates().cast("int")), F.lit(0)).alias("bad"),
    ).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} sites have invalid coordinates")
    if count > found["n"]:
        raise ValueError(f"cannot select {count} of {found['n']} sites")
    drawn = eligible.orderBy(seeded_order(seed, "SUP_ID"), "SUP_ID").limit(count)
    return drawn.orderBy(F.col("SUP_ID").cast("string"))


def plan_quotas(
    sizes: list[tuple[int, int]], targets: dict[str, int], shares: dict[str, float]
) -> list[tuple[int, str, int, int]]:
    """How many groups of each size go to each split.

    Each group, largest first, goes to the split with most room left (on a tie
    the larger share, then the earlier name). Room only depends on sizes, so all
    groups of one size are placed at once: they take the highest values of the
    falling series room, room - size, room - 2*size, ... of the splits. Returns
    (size, split, first rank, last rank) with ranks from 1 inside the size.
    """
    left = dict(targets)
    names = sorted(left, key=lambda s: (-shares[s], list(left).index(s)))
    plan = []
    for size, count in sorted(sizes, reverse=True):
        low = min(left.values()) - size * count - size
        high = max(left.values()) + 1
        # The least room value at which no more than `count` groups are placed.
        while high - low > 1:
            mid = (low + high) // 2
            if sum(max(0, (left[s] - mid) // size + 1) for s in names) > count:
                low = mid
            else:
                high = mid
        taken = {s: max(0, (left[s] - high) // size + 1) for s in names}
        spare = count - sum(taken.values())
        for s in names:
            if spare and left[s] - taken[s] * size == high - 1:
                taken[s] += 1
                spare -= 1
        start = 1
        for s in left:
            if taken[s]:
                plan.append((size, s, start, start + taken[s] - 1))
                start += taken[s]
            left[s] -= taken[s] * size
    return plan


def spatial_split(
    sites: DataFrame,
    distance_m: float = 200.0,
    seed: int = 42,
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """Assign splits so that sites linked by steps under ``distance_m`` stay together."""
    shares = shares or SHARES
    checks.require_columns(sites, ["SUP_ID", "latitude", "longitude"])
    if distance_m <= 0:
        raise ValueError("distance_m must be positive")
    if not math.isclose(sum(shares.values()), 1.0, abs_tol=1e-9):
        raise ValueError("shares must sum to 1")
    metric = split_metric(distance_m)
    kept = materialize(sites, "selected")
    groups = close_groups(kept, "SUP_ID", metric)
    grouped = materialize(label_groups(kept, "SUP_ID", groups, metric, "split_group"), "grouped")
    sizes = grouped.groupBy("split_group").agg(F.count(F.lit(1)).alias("size"))
    # Different sizes number at most the square root of twice the sites.
    histogram = [(r["size"], r["n"]) for r in
                 sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    total = sum(size * n for size, n in histogram)
    if total < len(shares):
        raise ValueError("not enough sites for the splits")
    targets = {s: round(share * total) for s, share in shares.items()}
    targets[next(iter(targets))] += total - sum(targets.values())
    plan = plan_quotas(histogram, targets, shares)
    order = seeded_order(seed, "split_group")
    ranked = rank_rows(
        sizes.withColumn("_draw", order), [F.col("_draw").asc(), F.col("split_group").asc()],
        within=["size"], name="_place",
    ).drop("_draw")
    spark = sites.sparkSession
    ranges = spark.createDataFrame(plan, "size long, split string, lo long, hi long")
    # At most one range per size and split, collected above.
    chosen = ranked.alias("g").join(
        F.broadcast(ranges).alias("q"),
        (F.col("g.size") == F.col("q.size")) & F.col("_place").between(F.col("lo"), F.col("hi")),
    ).select("split_group", "split")
    chosen, seen = materialize_with(chosen, "chosen")
    return skew_join(
        grouped, chosen, ["split_group"], spread=["SUP_ID"],
        counts=sizes.withColumnRenamed("size", "n"),
        small_right=seen["rows"] <= BROADCAST_ROWS,
    )


def min_split_distance(split: DataFrame) -> DataFrame:
    """Least distance between sites of different splits, by the split's own measure."""
    near = nearest_site(split.select("SUP_ID", "split", "latitude", "longitude"), split,
                        ["SUP_ID"], apart="split")
    distance = geo.haversine_split_m(
        "latitude", "longitude", "nearest_ANFR_latitude", "nearest_ANFR_longitude"
    )
    return near.agg(F.min(distance).alias("min_distance_m"))


def leaked_ids(train: DataFrame, val: DataFrame, key: str = "SUP_ID") -> DataFrame:
    """Ids that stand in both tables."""
    return train.select(key).distinct().join(val.select(key).distinct(), key, "left_semi")
