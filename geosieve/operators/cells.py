"""Range searches on grid cells.

Points become 3-D positions in metres (on the sphere, or planar with z = 0) and
fall into cubic cells. Cells are summarised by the box and number of their
points, and only cell summaries meet in joins: two cells whose boxes are wholly
within reach, or wholly apart, are settled as one row each. Undecided cell pairs
are opened point by point when that is cheap and otherwise halved and tried
again, so a cell holding a third of all points never pairs them with each other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.functions import geo
from geosieve.operators.spread import (
    BROADCAST_ROWS, HOT_ROWS, materialize, materialize_with, skew_join,
)

AXES = ("x", "y", "z")
CELL = ["cx", "cy", "cz"]
# Positions carry rounding errors near 1e-9 m; distances within this margin of a
# limit are always decided by the exact formula.
MARGIN_M = 1e-6
# An undecided cell pair is opened when it has no more point pairs than this.
OPEN_PAIRS = 1024
# Cells are not halved below this side: pairs still undecided there are compared in blocks of points.
FINEST_M = 0.02
BLOCK = 512


def cell_columns(side: float, level: int = 0) -> list[Column]:
    """Cell index per axis; halving ``level`` times shifts exactly one bit each."""
    scale = 2.0**level / side
    return [F.floor(F.col(a) * scale).cast("long").alias(f"c{a}") for a in AXES]


def box_of(points: DataFrame, keys: list, **extra: Column) -> DataFrame:
    """Bounding box and number of the points per key (combined map-side)."""
    sides = []
    for a in AXES:
        sides += [F.min(a).alias(f"{a}_lo"), F.max(a).alias(f"{a}_hi")]
    others = [value.alias(name) for name, value in extra.items()]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sides, *others)


def gap_squared(a: dict, b: dict) -> Column:
    """Square of the least distance between two boxes given as {axis: (lo, hi)}."""
    total = F.lit(0.0)
    for axis in AXES:
        (alo, ahi), (blo, bhi) = a[axis], b[axis]
        total = total + F.pow(F.greatest(F.lit(0.0), alo - bhi, blo - ahi), F.lit(2.0))
    return total


def span_squared(a: dict, b: dict) -> Column:
    """Square of the greatest distance between points of two boxes."""
    total = F.lit(0.0)
    for axis in AXES:
        (alo, ahi), (blo, bhi) = a[axis], b[axis]
        total = total + F.pow(F.greatest(ahi - blo, bhi - alo), F.lit(2.0))
    return total


def box_columns(prefix: str = "") -> dict:
    return {a: (F.col(f"{prefix}{a}_lo"), F.col(f"{prefix}{a}_hi")) for a in AXES}


def point_box(prefix: str = "") -> dict:
    return {a: (F.col(f"{prefix}{a}"), F.col(f"{prefix}{a}")) for a in AXES}


def neighbour_cells(
    df: DataFrame,
    here: dict,
    cell: list[str],
    side: float,
    reach: float,
    *,
    flat: bool,
    half: bool = False,
    radius: float | None = None,
    shift: float = 0.0,
) -> DataFrame:
    """One row per cell within ``reach`` of the row's box; replaces the cell columns.

    Cells the sphere's surface does not cross hold no points and are skipped.
    """
    steps = math.ceil(reach / side)
    span = range(-steps, steps + 1)
    offsets = list(itertools.product(span, span, [0] if flat else span))
    if half:
        offsets = [o for o in offsets if o > (0, 0, 0)]
    rows = ", ".join("named_struct('x', %d, 'y', %d, 'z', %d)" % o for o in offsets)
    choices = F.expr(f"array({rows})")
    there = {}
    new = {}
    for axis, name in zip(AXES, cell):
        new[name] = F.col(name) + F.col(f"_step.{axis}")
        low = new[name].cast("double") * side
        there[axis] = (low, low + side)
    if flat:
        there["z"] = here["z"]
    near = gap_squared(here, there) <= (reach + MARGIN_M) ** 2
    if radius is not None and not flat:
        mid = sum(
            (F.pow(there[a][0] + (side / 2.0 - shift), F.lit(2.0)) for a in AXES),
            F.lit(0.0),
        )
        thick = side * math.sqrt(3.0) / 2.0 + 1.0
        low = max(0.0, radius - thick)
        near = near & mid.between(low * low, (radius + thick) ** 2)
    return df.withColumn("_step", F.explode(choices)).filter(near).withColumns(new).drop("_step")


@dataclass(frozen=True)
class Metric:
    """How distance is measured, with the matching straight-line grid reach."""

    reach_m: float
    strict: bool = False
    radius: float = geo.EARTH_RADIUS_M
    legacy: bool = False
    flat: bool = False

    @property
    def chord(self) -> float:
        return self.reach_m if self.flat else geo.chord_m(self.reach_m, self.radius)

    def within(self, p: Callable[[str], Column], q: Callable[[str], Column]) -> Column:
        """The exact predicate between two points."""
        if self.flat:
            dx, dy = q("x") - p("x"), q("y") - p("y")
            return dx * dx + dy * dy <= self.reach_m**2
        measure = geo.haversine_split_m if self.legacy else geo.haversine_m
        distance = measure(p("latitude"), p("longitude"), q("latitude"), q("longitude"))
        return distance < self.reach_m if self.strict else distance <= self.reach_m


@dataclass
class PairLevel:
    """Settled and still-open cell pairs of one grid level."""

    level: int
    cells: DataFrame
    full: DataFrame
    open: DataFrame
    n_open: int
    last: bool = False


@dataclass
class NearPairs:
    group: list[str]
    side: float
    levels: list[PairLevel] = field(default_factory=list)


def _pair_side(nodes: DataFrame, group: list[str], tag: str, root: bool) -> DataFrame:
    names = [F.col(c).alias(f"{tag}_{c}") for c in CELL]
    boxes = [F.col(f"{a}_{e}").alias(f"{tag}_{a}_{e}") for a in AXES for e in ("lo", "hi")]
    extra = [F.col("vertex").alias(f"{tag}_vertex")] if root else []
    return nodes.select(
        *group, *names, *boxes, F.col("n").alias(f"{tag}_n"), F.col("w").alias(f"{tag}_w"), *extra
    )


def _judge(pairs: DataFrame, metric: Metric, open_pairs: int, last: bool) -> DataFrame:
    a, b = box_columns("a_"), box_columns("b_")
    gap, span = gap_squared(a, b), span_squared(a, b)
    inside = max(0.0, metric.chord - MARGIN_M)
    state = (
        F.when(span <= inside * inside, "full")
        .when(F.lit(last) | (F.col("a_n") * F.col("b_n") <= open_pairs), "open")
        .otherwise("split")
    )
    return pairs.filter(gap <= (metric.chord + MARGIN_M) ** 2).withColumn("state", state)


def near_pairs(
    positions: DataFrame,
    group: list[str],
    metric: Metric,
    *,
    side: float,
    half: bool,
    open_pairs: int | None = None,
) -> NearPairs:
    """Cell pairs that may hold points within reach, settled wherever boxes allow.

    ``positions``: group columns, x, y, z, a weight ``w`` and an ``id``; no two
    rows of a group share a position. With ``half`` each unordered pair of
    different cells comes once and pairs of a cell with itself are left out (use
    a side whose cells lie wholly within reach); the cell's least id, ``vertex``,
    then names it.
    """
    open_pairs = OPEN_PAIRS if open_pairs is None else open_pairs
    result = NearPairs(group, side)

    def summarise(level: int) -> DataFrame:
        keys = [*[F.col(g) for g in group], *cell_columns(side, level)]
        return box_of(positions, keys, w=F.sum("w"), vertex=F.min("id"))

    cells, count = materialize_with(summarise(0), "cells")
    left = _pair_side(cells, group, "a", root=half)
    aim = [f"to_{c}" for c in CELL]
    left = left.withColumns({t: F.col(f"a_{c}") for t, c in zip(aim, CELL)})
    left = neighbour_cells(
        left, box_columns("a_"), aim, side, metric.chord,
        flat=metric.flat, half=half, radius=metric.radius,
    )
    right = _pair_side(cells, group, "b", root=half)
    right = right.withColumns({t: F.col(f"b_{c}") for t, c in zip(aim, CELL)})
    if count["rows"] <= BROADCAST_ROWS:
        right = F.broadcast(right)
    level, last = 0, side <= FINEST_M
    pairs = _judge(left.join(right, [*group, *aim]).drop(*aim), metric, open_pairs, last)
    while True:
        states = {s: F.count(F.when(F.col("state") == s, 1)) for s in ("open", "split")}
        pairs, seen = materialize_with(pairs, "pairs", **states)
        full = pairs.filter(F.col("state") == "full")
        still_open = pairs.filter(F.col("state") == "open")
        result.levels.append(PairLevel(level, cells, full, still_open, seen["open"], last))
        split = pairs.filter(F.col("state") == "split")
        if not seen["split"]:
            return result
        # Halve both cells of every pair still undecided. Only cell summaries
        # are joined: at most eight children per cell.
        level += 1
        last = side / 2.0**level <= FINEST_M
        cells = materialize(summarise(level), "cells")
        up = {f"up_{c}": F.shiftright(F.col(c), 1) for c in CELL}
        roots = ["a_vertex", "b_vertex"] if half else []
        split = split.select(*group, *[f"{t}_{c}" for t in "ab" for c in CELL], *roots)
        if half:
            known = full.select(*group, *roots).distinct()
            split = split.join(known, [*group, *roots], "left_anti")
        for tag in "ab":
            kids = _pair_side(cells.withColumns(up), group, tag, root=False)
            kids = kids.withColumns(
                {f"old_{c}": F.shiftright(F.col(f"{tag}_{c}"), 1) for c in CELL}
            )
            split = split.withColumnsRenamed({f"{tag}_{c}": f"old_{c}" for c in CELL})
            split = split.join(kids, [*group, *[f"old_{c}" for c in CELL]])
            split = split.drop(*[f"old_{c}" for c in CELL])
        pairs = _judge(split, metric, open_pairs, last)


def opened(found: NearPairs, step: PairLevel, positions: DataFrame, metric: Metric) -> DataFrame:
    """Point pairs within reach inside one level's open cell pairs (columns p_*, q_*).

    Only the points of open cells are needed. Few open cells are broadcast to pick
    them. Otherwise cells above HOT_ROWS, which hold too many points to be open,
    are set aside before the points are shuffled; there are at most
    (all points / HOT_ROWS) of those.
    """
    keys = [*found.group, *CELL]
    pairs = step.open
    points = positions.withColumns(dict(zip(CELL, cell_columns(found.side, step.level))))
    salt: list[str] = []
    if step.last:
        # Cells of any number of points: blocks of each meet blocks of the other.
        salt = ["salt"]
        counts = step.cells.select(*keys, F.col("n").alias("_n"))
        points = skew_join(points, counts, keys, spread=["id"])
        points = points.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK))).drop("_n")
        for tag in "ab":
            last_block = F.ceil(F.col(f"{tag}_n") / BLOCK) - 1
            pairs = pairs.withColumn(f"{tag}_salt", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    if 2 * step.n_open <= BROADCAST_ROWS:
        sides = [
            pairs.select(*found.group, *[F.col(f"{t}_{c}").alias(c) for c in CELL]) for t in "ab"
        ]
        used = sides[0].unionByName(sides[1]).distinct()
        points = points.join(F.broadcast(used), keys, "left_semi")
    else:
        hot = step.cells.filter(F.col("n") > HOT_ROWS).select(*keys)
        points = points.join(F.broadcast(hot), keys, "left_anti")

    def side(tag: str, name: str) -> DataFrame:
        renamed = {c: f"{name}_{c}" for c in points.columns if c not in [*keys, *salt]}
        return points.withColumnsRenamed({**renamed, **{c: f"{tag}_{c}" for c in [*CELL, *salt]}})

    near = gap_squared(point_box("p_"), box_columns("b_")) <= (metric.chord + MARGIN_M) ** 2
    first = pairs.join(side("a", "p"), [*found.group, *[f"a_{c}" for c in [*CELL, *salt]]]).filter(near)
    both = first.join(side("b", "q"), [*found.group, *[f"b_{c}" for c in [*CELL, *salt]]])
    exact = metric.within(lambda c: F.col(f"p_{c}"), lambda c: F.col(f"q_{c}"))
    return both.filter(exact)
