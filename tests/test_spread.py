import random

import numpy as np
from pyspark.sql import functions as F

from geosieve.operators import spread


def test_skew_join_splits_hot_keys_and_keeps_every_row(spark):
    left = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        plain = left.join(right, "k", how)
        for small in (True, False):
            got = spread.skew_join(left, right, ["k"], how, spread=["id"], small_right=small, hot_rows=100)
            assert sorted(got.select("id", "k", "v").collect(), key=str) == sorted(
                plain.select("id", "k", "v").collect(), key=str)


def test_skew_join_repeats_only_hot_right_rows(spark):
    counts = spark.createDataFrame([(1, 1000), (2, 5)], "k int, n long")
    hot = spread.hot_keys(counts, ["k"], 100).collect()
    assert [(r.k, r._parts) for r in hot] == [(1, 10)]


def test_rank_rows_in_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 4 else f"g{i % 7}", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(7)
    ranked = spread.rank_rows(df, [F.col("v").desc(), F.col("id").asc()], within=["g"])
    want, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert {r.id: r["rank"] for r in ranked.collect()} == want


def test_rank_rows_over_everything(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("v"))
    got = {r.id: r["rank"] for r in spread.rank_rows(df, [F.col("v").asc(), F.col("id").asc()]).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((i % 10, i) for i in range(1000)), 1)}
    assert got == want


def test_exact_quantiles(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 5) for _ in range(501)] + [1.0] * 200
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = spread.rows_at_ranks(df, "v", "id", [0.5, 0.95, 0.975, 0.99])
    for q, value in got.items():
        assert abs(value - np.percentile(values, q * 100)) < 1e-12
    assert spread.rows_at_ranks(df.limit(0), "v", "id", [0.5]) == {}


def test_materialize_counts_rows(spark):
    df, seen = spread.materialize_with(spark.range(10), "t", top=F.max("id"))
    assert seen == {"rows": 10, "top": 9} and df.count() == 10
