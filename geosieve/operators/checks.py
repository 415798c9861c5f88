"""Data checks: counts of violations and errors that name them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.functions import boxes, geo, text


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Fail with the sorted names of the missing columns."""
    present = {c.lower() for c in df.columns}
    missing = sorted(c for c in needed if c.lower() not in present)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row (check, violations) per rule; a rule is true for a bad row."""
    sums = [
        F.struct(
            F.lit(name).alias("check"),
            F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"),
        )
        for name, bad in rules.items()
    ]
    return df.agg(F.array(*sums).alias("found")).select(F.inline("found"))


def require_clean(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Run the rules (one pass, one row per rule back) and fail on any violation."""
    bad = [f"{r['check']}: {r['violations']}" for r in count_violations(df, rules).collect()
           if r["violations"]]
    if bad:
        raise ValueError("invalid rows - " + ", ".join(bad))
    return df


def bad_direction() -> dict[str, Column]:
    """Rows whose directions are not N/S and E/W after trimming, in any case."""
    def wrong(name: str, *allowed: str) -> Column:
        return ~F.coalesce(F.upper(F.trim(F.col(name))).isin(*allowed), F.lit(False))

    return {
        "latitude direction": wrong("COR_CD_NS_LAT", "N", "S"),
        "longitude direction": wrong("COR_CD_EW_LON", "E", "W"),
    }


def bad_coordinates(lat: str = "latitude", lon: str = "longitude") -> Column:
    return ~geo.valid_latlon(lat, lon)


def bad_status() -> Column:
    return ~text.clean_status().isin("visible", "non_visible", "ambigu")


def bad_box(size: float = 1024) -> Column:
    """A visible row needs a complete box inside the image."""
    return (text.clean_status() == "visible") & ~boxes.is_inside(size)


def bad_split() -> Column:
    return ~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False))


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (null counts as a key) with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def inconsistent_ids(
    df: DataFrame, key: str, columns: list[str], numbers: list[str] | None = None
) -> DataFrame:
    """Keys whose rows differ in a column, null differing from a value.

    Columns in ``numbers`` are compared as numbers: 8, 08 and 8.0 are equal.

    Least, greatest and null count tell it: no per-key value sets, and one
    partially combined aggregate for all columns.
    """
    columns = [c for c in columns if c in df.columns]
    df = df.withColumns({c: text.to_number(c) for c in columns if c in (numbers or [])})
    rows = F.count(F.lit(1)).alias("_rows")
    parts = []
    for c in columns:
        parts += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}")]
    seen = df.groupBy(key).agg(rows, *parts)
    checks = []
    for c in columns:
        differs = ~F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}"))
        mixed = (F.col(f"n_{c}") > 0) & (F.col(f"n_{c}") < F.col("_rows"))
        checks.append(F.when(differs | mixed, F.lit(c)))
    names = F.array_compact(F.array(*checks))
    return seen.select(key, names.alias("columns")).filter(F.size("columns") > 0)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows, with multiplicity, found on one side only."""
    left = a.select(*[F.col(c) for c in a.columns], F.lit(1).alias("_side"))
    right = b.select(*[F.col(c) for c in a.columns], F.lit(-1).alias("_side"))
    net = left.unionByName(right).groupBy(*a.columns).agg(F.sum("_side").alias("net"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("only_right"),
    )


def check_table(rows: list[DataFrame]) -> DataFrame:
    """Union of one-row frames (check, expected, actual) with a verdict column."""
    whole = reduce(lambda a, b: a.unionByName(b), rows)
    return whole.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def expectation(df: DataFrame, check: str, actual: Column, expected) -> DataFrame:
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    return df.agg(
        F.lit(check).alias("check"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
    )
