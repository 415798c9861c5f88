"""Neighbour counts and proximity groups on top of the cell search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import geo
from geosieve.operators.cells import (
    CELL, MARGIN_M, Metric, NearPairs, cell_columns, near_pairs, opened,
)
from geosieve.operators.spread import BROADCAST_ROWS, materialize, materialize_with, skew_join


def positions_of(
    points: DataFrame, id_col: str, group: list[str], metric: Metric
) -> tuple[DataFrame, list[str]]:
    """Distinct positions per group with their multiplicity and least id.

    Copies of one position collapse here (combined map-side), however many rows
    they hold.
    """
    if metric.flat:
        spot = ["x", "y"]
        placed = points.select(*group, id_col, *spot)
    else:
        spot = ["latitude", "longitude"]
        placed = points.select(*group, id_col, *[F.col(c).cast("double").alias(c) for c in spot])
        # -0.0 and 0.0 are one position; Spark normalises them in group keys.
    packed = placed.groupBy(*group, *spot).agg(
        F.min(id_col).alias("id"), F.count(F.lit(1)).alias("w")
    )
    if metric.flat:
        packed = packed.withColumn("z", F.lit(0.0))
    else:
        packed = packed.withColumns(geo.sphere_xyz("latitude", "longitude", metric.radius))
    return packed, spot


def _solid_side(metric: Metric) -> float:
    """Cell side for which two points of one cell are always within reach."""
    sides = 2.0 if metric.flat else 3.0
    return (metric.chord - 2.0 * MARGIN_M) / math.sqrt(sides)


def count_within(
    points: DataFrame,
    id_col: str,
    metric: Metric,
    *,
    group: list[str] | None = None,
    name: str = "n_within",
    open_pairs: int | None = None,
) -> DataFrame:
    """How many points of the same group lie within reach, the point itself included.

    Whole cells are counted as one row; points are only compared along the rim of
    the search circle. ``id_col`` is unique in the group.
    """
    group = group or []
    positions, spot = positions_of(points, id_col, group, metric)
    positions = materialize(positions, "positions")
    found = near_pairs(
        positions, group, metric, side=_solid_side(metric), half=False, open_pairs=open_pairs
    )
    sums = []
    for step in found.levels:
        keys = [*group, *CELL]
        whole = step.full.groupBy(*group, *[F.col(f"a_{c}").alias(c) for c in CELL]).agg(
            F.sum("b_w").alias("add")
        )
        whole, size = materialize_with(whole, "whole")
        # One row per cell with its share, handed on to the cell's positions.
        cells = cell_columns(found.side, step.level)
        keyed = positions.select(*group, "id", *cells)
        shared = skew_join(
            keyed, whole, keys, spread=["id"], counts=step.cells,
            small_right=size["rows"] <= BROADCAST_ROWS,
        )
        sums.append(shared.select(*group, "id", "add"))
        if not step.n_open:
            continue
        rim = opened(found, step, positions, metric)
        sums.append(rim.groupBy(*group, F.col("p_id").alias("id")).agg(F.sum("q_w").alias("add")))
    total = sums[0]
    for part in sums[1:]:
        total = total.unionByName(part)
    total = total.groupBy(*group, "id").agg(F.sum("add").alias(name))
    counted = positions.select(*group, *spot, "id", "w").join(total, [*group, "id"])
    counted, size = materialize_with(counted, "counted")
    counts = counted.select(*group, *spot, F.col("w").alias("n"))
    placed = points.withColumns({c: F.col(c).cast("double") for c in spot})
    return skew_join(
        placed, counted.select(*group, *spot, name), [*group, *spot],
        spread=[*group, id_col], counts=counts, small_right=size["rows"] <= BROADCAST_ROWS,
    )


def connected_components(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Component of every vertex that has an edge: columns group..., id, root.

    ``edges``: group..., a, b. Each round every vertex moves two steps towards
    the least vertex of its neighbourhood in that round's hashed order; edges are
    rewritten to the new vertices and loops and repeats vanish, so the graph shrinks by
    more than half each round, chains included. ``root`` is one vertex per component.
    """
    group = group or []
    both = edges.select(*group, "a", "b").unionByName(
        edges.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))
    )
    both = both.filter(F.col("a") != F.col("b")).distinct()
    work, seen = materialize_with(both, "edges")
    moves, sizes = [], []
    while seen["rows"]:
        seed = F.lit(len(moves))
        # There are at most as many vertices as directed edges.
        small = seen["rows"] <= BROADCAST_ROWS
        best = work.groupBy(*group, F.col("a").alias("id")).agg(
            F.min(F.xxhash64(seed, "b")).alias("rank"),
            F.min_by("b", F.xxhash64(seed, "b")).alias("to"),
            F.count(F.lit(1)).alias("n"),
        )
        stay = F.xxhash64(seed, "id") <= F.col("rank")
        best = best.select(*group, "id", "n", F.when(stay, F.col("id")).otherwise(F.col("to")).alias("to"))
        if not small:
            best = materialize(best, "best")
        ahead = best.select(*group, F.col("id").alias("to"), F.col("to").alias("goal"))
        into = best.groupBy(*group, "to").agg(F.count(F.lit(1)).alias("n"))
        move = skew_join(
            best.select(*group, "id", "to"), ahead, [*group, "to"], spread=["id"],
            counts=into, small_right=small,
        ).select(*group, "id", F.col("goal").alias("to"))
        move = materialize(move, "moves")
        moves.append((move, small))
        degree = best.select(*group, F.col("id").alias("a"), "n")
        at_a = move.select(*group, F.col("id").alias("a"), F.col("to").alias("new_a"))
        at_b = move.select(*group, F.col("id").alias("b"), F.col("to").alias("new_b"))
        moved = skew_join(
            work, at_a, [*group, "a"], spread=["b"], counts=degree, small_right=small
        )
        moved = skew_join(
            moved, at_b, [*group, "b"], spread=["a"],
            counts=degree.withColumnRenamed("a", "b"), small_right=small,
        )
        moved = moved.filter(F.col("new_a") != F.col("new_b")).select(
            *group, F.col("new_a").alias("a"), F.col("new_b").alias("b")
        )
        before = seen["rows"]
        work, seen = materialize_with(moved.distinct(), "edges")
        # The vertex that is first in the round's order always absorbs its neighbours.
        if seen["rows"] >= before:
            raise RuntimeError("a round of components merged nothing")
    if not moves:
        return edges.select(*group, F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    # Follow each vertex through the rounds, last round first.
    final, small = moves[-1][0].withColumnRenamed("to", "root"), moves[-1][1]
    for move, next_small in reversed(moves[:-1]):
        later = final.select(*group, F.col("id").alias("to"), "root")
        final = skew_join(
            move, later, [*group, "to"], "left", spread=["id"], small_right=small
        ).select(*group, "id", F.coalesce("root", "to").alias("root"))
        if not small:
            final = materialize(final, "roots")
        small = next_small
    return final


class Groups:
    """Proximity groups: which vertex (solid cell) each point is in and its root.

    Points of one solid cell always belong together, so the graph has one vertex
    per occupied cell and at most a few dozen edges at each.
    """

    def __init__(self, positions: DataFrame, found: NearPairs, roots: DataFrame, group: list[str]):
        self.positions = positions
        self.group = group
        self.side = found.side
        self.cells = found.levels[0].cells
        self.roots = roots

    def vertices(self) -> DataFrame:
        """group..., cell, n (distinct positions) and root of every occupied cell."""
        joined = self.cells.select(*self.group, *CELL, "n", F.col("vertex").alias("id")).join(
            self.roots, [*self.group, "id"], "left"
        )
        return joined.select(
            *self.group, *CELL, "n", F.coalesce("root", "id").alias("root")
        )


def close_groups(
    points: DataFrame,
    id_col: str,
    metric: Metric,
    *,
    group: list[str] | None = None,
    open_pairs: int | None = None,
) -> Groups:
    """Group points that are linked by chains of steps within reach."""
    group = group or []
    positions, _ = positions_of(points, id_col, group, metric)
    positions = materialize(positions, "positions")
    found = near_pairs(
        positions, group, metric, side=_solid_side(metric), half=True, open_pairs=open_pairs
    )
    edges = None
    for step in found.levels:
        ends = [F.col("a_vertex").alias("a"), F.col("b_vertex").alias("b")]
        part = step.full.select(*group, *ends)
        if step.n_open:
            rim = opened(found, step, positions, metric)
            part = part.unionByName(rim.select(*group, *ends))
        edges = part if edges is None else edges.unionByName(part)
    return Groups(positions, found, connected_components(edges, group), group)


def group_cells(points: DataFrame, side: float, radius: float) -> DataFrame:
    """Cell columns for points given by latitude and longitude."""
    placed = points.withColumns(
        {f"_{a}": v for a, v in geo.sphere_xyz("latitude", "longitude", radius).items()}
    )
    cells = {
        f"c{a}": F.floor(F.col(f"_{a}") * (1.0 / side)).cast("long") for a in ("x", "y", "z")
    }
    return placed.withColumns(cells).drop("_x", "_y", "_z")


def label_groups(
    points: DataFrame, id_col: str, groups: Groups, metric: Metric, name: str = "component"
) -> DataFrame:
    """Add the least id of the point's proximity group."""
    group = groups.group
    keys = [*group, *CELL]
    vertices = materialize(groups.vertices(), "vertices")
    celled = group_cells(points, groups.side, metric.radius)
    least = groups.cells.select(*keys, "vertex").join(vertices.select(*keys, "root"), keys)
    least = least.groupBy(*group, "root").agg(F.min("vertex").alias(name))
    named = skew_join(
        vertices.select(*keys, "root"), least, [*group, "root"], spread=CELL
    ).drop("root")
    named, size = materialize_with(named, "named")
    counts = celled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return skew_join(
        celled, named, keys, spread=[*group, id_col], counts=counts,
        small_right=size["rows"] <= BROADCAST_ROWS,
    ).drop(*CELL)

