"""Building blocks that keep joins, ranks and iterations even on a cluster.

``materialize`` cuts lineage through a written table in the shared checkpoint
folder, so a lost executor never takes an iteration's state with it.
``skew_join`` spreads keys that hold a large share of the left rows.
``rank_rows`` numbers rows without ever sending a whole group to one task.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# A key with more rows than this is split over several join tasks. The number
# of such keys is at most (all rows / HOT_ROWS), which bounds every table of
# hot keys that is broadcast below.
HOT_ROWS = 2_000_000
# A join side is broadcast only after counting that it has no more rows.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local session may make its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates over the written rows at no extra pass."""
    seen = Observation()
    path = scratch_path(df.sparkSession, name)
    named = [value.alias(key) for key, value in metrics.items()]
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *named)
    watched.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` has few enough rows to broadcast, by a count that every partition shares."""
    return df.count() <= (BROADCAST_ROWS if rows is None else rows)


def hot_keys(counts: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """Keys of ``counts`` (columns ``on`` and ``n``) that need splitting, with a part count."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    return counts.filter(F.col("n") > hot_rows).select(
        *on, F.ceil(F.col("n") / hot_rows).cast("int").alias("_parts")
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    spread: list[str],
    counts: DataFrame | None = None,
    small_right: bool | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join a large left side whose keys may be very uneven.

    A right side that is counted to be small is broadcast. Otherwise keys with
    more than ``hot_rows`` left rows are cut into parts by the hash of
    ``spread`` (a unique key of the left side, so the cut survives retries), and
    the right rows of just those keys are repeated once per part.
    """
    if small_right is None:
        small_right = fits_broadcast(right)
    if small_right:
        return left.join(F.broadcast(right), on, how)
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot, seen = materialize_with(hot_keys(counts, on, hot_rows), "hot")
    if not seen["rows"]:
        return left.join(right, on, how)
    # Hot keys are few by their definition; the count makes sure before they are broadcast.
    few = F.broadcast(hot) if seen["rows"] <= BROADCAST_ROWS else hot
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    cut = left.join(few, on, "left").withColumn("_part", part).drop("_parts")
    copies = (
        right.join(few, on, "left")
        .withColumn("_part", F.explode(parts))
        .drop("_parts")
    )
    return cut.join(copies, [*on, "_part"], how).drop("_part")


def rank_rows(
    df: DataFrame, order_by: list[Column], *, within: list[str] | None = None, name: str = "rank"
) -> DataFrame:
    """Number rows 1..n in ``order_by`` order, restarting in each ``within`` group.

    The order must be total (end it with a unique key): rows are range-partitioned
    on group and order, numbered inside each range and shifted by the rows of
    the same group in earlier ranges. Even one group holding every row is spread
    over all ranges, and the shift table has at most one row per range.
    """
    within = within or []
    ordered = df.repartitionByRange(*[F.col(c).asc() for c in within], *order_by)
    placed = materialize(ordered.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_rows"))
    if within:
        # A group can only continue into a range as that range's first group, so
        # the non-zero shifts number at most one per range.
        earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(
            Window.unboundedPreceding, -1
        )
        before = totals.select("_range", *within, F.sum("_rows").over(earlier).alias("_before"))
        before = before.filter(F.col("_before").isNotNull())
    else:
        # One row per range: a bounded table.
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select("_range", F.sum("_rows").over(earlier).alias("_before"))
        before = before.filter(F.col("_before").isNotNull())
    local = Window.partitionBy("_range", *within).orderBy(*order_by)
    numbered = placed.withColumn(name, F.row_number().over(local).cast("long"))
    return (
        numbered.join(F.broadcast(before), ["_range", *within], "left")
        .withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_range", "_before")
    )


def rows_at_ranks(df: DataFrame, column: str, tie: str, fractions: list[float]) -> dict[float, float]:
    """Exact quantiles with linear interpolation, by position in a distributed order."""
    ranked = rank_rows(df.select(column, tie), [F.col(column).asc(), F.col(tie).asc()])
    ranked = materialize(ranked.select(column, "rank"), "ranked")
    total = ranked.count()
    if total == 0:
        return {}
    spots = {q: q * (total - 1) for q in fractions}
    wanted = sorted({int(s) + k for s in spots.values() for k in (1, 2)})
    # At most two rows per requested fraction come back.
    found = {r["rank"]: r[column] for r in ranked.filter(F.col("rank").isin(wanted)).collect()}
    values = {}
    for q, spot in spots.items():
        low = found[int(spot) + 1]
        high = found.get(int(spot) + 2, low)
        values[q] = low + (high - low) * (spot - int(spot))
    return values
