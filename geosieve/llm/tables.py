"""Tables between jobs, fixed-size key bitmaps and connected components.

Every intermediate table is written to the shared folder of ``spark.checkpoint.dir``, so a lost
executor costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geosieve.operators.spread import scratch_path

# A table is broadcast only after counting that it has no more rows than this.
BROADCAST_ROWS = 200_000


_shipped: set[str] = set()


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``df.mapInArrow`` on workers that are sent this package once per application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip"))
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, str(file.relative_to(package.parent)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(work, schema)


def map_groups(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Apply ``work`` (RecordBatch to RecordBatch or None) to the rows of each key.

    For groups whose size the caller has bounded: rows are dealt out and sorted by the keys, and a
    task holds one Arrow batch and one group at a time.
    """
    import pyarrow as pa

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [*rest, batch])
            changed = np.zeros(table.num_rows - 1, dtype=bool)
            for key in keys:
                column = table.column(key).to_numpy()
                changed |= column[1:] != column[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            for start, stop in zip(cuts[:-1], cuts[1:]):
                out = work(table.slice(start, stop - start).combine_chunks().to_batches()[0])
                if out is not None:
                    yield out
            rest = table.slice(cuts[-1]).combine_chunks().to_batches()
        if rest is not None:
            out = work(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])
            if out is not None:
                yield out

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
    """As ``written``, with aggregates of the rows taken while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"),
                             *(v.alias(k) for k, v in values.items())), name)
    return out, seen.get


def small(df: DataFrame, rows: int) -> DataFrame:
    """A side whose row count is known: broadcast within the bound, else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


class KeyBits:
    """A bitmap of hashed keys of at most 2**27 bits (16 MB), whatever the number of keys.

    It only spares work: a key that is in the table always passes, and the join that follows
    removes those that pass by chance. With far more keys than bits everything passes.
    """

    def __init__(self, keys: DataFrame, column: str, rows: int, most: int = 27):
        self.log = int(min(most, max(16, np.ceil(np.log2(max(rows, 1) * 16)))))
        slot = self.slot(F.col(column))
        words = keys.filter(F.col(column).isNotNull()).select(slot.alias("s")).groupBy(
            F.shiftright("s", 5).cast("int").alias("w")
        ).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits"))
        bits = np.zeros(1 << (self.log - 5), dtype=np.uint32)
        found = words.toArrow()
        bits[found["w"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def slot(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << self.log))

    @staticmethod
    def hits(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
        slots = slots.astype(np.uint32)
        return (bits[slots >> np.uint32(5)] >> (slots & np.uint32(31))) & np.uint32(1) == 1


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node reachable.

    Large-star and small-star rounds: each hangs neighbours under the least node near them, so
    a chain of n nodes takes about log(n) rounds. Minima are combined before the shuffle and a hub
    only meets its edges in a join that can be split.
    """
    now, seen = written_with(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .filter("u <> v").distinct(), "edges", sign=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    while seen["rows"]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, now_seen = written_with(
            rest.union(least).distinct(), "edges", sign=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        same = now_seen == seen
        now, seen = new, now_seen
        if same:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
