"""Nearest known site for every point, exactly, by descending two trees of cells together.

Positions on the sphere fall into cubes; level L halves the cube of level 0 L times. Sites are
summarised at every third level (box, number and, in cells of few sites, the sites themselves). A
point's home is the finest level at which its cell, or a neighbour on a nearer side, holds a site, which bounds
its distance at once. Points of one home are grouped by cells one step finer, and such a group
meets only the site cells within its bound. The bound is then the least of the greatest distances between the boxes, aggregated per group, and
site cells beyond it go. Groups whose remaining cells hold few sites have their list; the others are
divided, and so are their site cells, until the lists are short. Points that crowd a group get shorter lists, those of
finer cells, which are picked from the group's list by the bound of the finer cell.

No step pairs points with sites: only groups and cells meet, at most a few hundred cells a group, and the
number of groups is bounded by that of site cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.functions import geo
from geosieve.operators.cells import (
    AXES, CELL, MARGIN_M, box_of,
)
from geosieve.operators.spread import (
    BROADCAST_ROWS, materialize, materialize_with, skew_join,
)

# All positions are shifted into one cube of side 2**24 m. Cells of level 16 are 256 m wide.
CUBE_M = 2.0**24
SHIFT_M = 2.0**23
STEP = 3
LEVEL = 16
FINEST = 28
LEVELS = (0, *range(1, LEVEL + 1, STEP))
# Sites that a group gathers before they are compared with its bound one by one.
GATHER_MAX = 4096
# A group with more candidate sites left than this is divided further.
LIST_MAX = 1024
# Lists are made for finer cells, so many levels below those of the groups, as long as each serves so many points.
FINER = (2, 4)
SERVED = 4
# Levels that groups and site cells go down when they are divided.
DIVIDE = 4
_FINE = ["fx", "fy", "fz"]
_ENDS = [f"{a}_{e}" for a in AXES for e in ("lo", "hi")]


def _placed(df: DataFrame) -> DataFrame:
    """Positions in metres."""
    xyz = geo.sphere_xyz("latitude", "longitude")
    return df.withColumns({a: xyz[a] + SHIFT_M for a in AXES})


def _celled(placed: DataFrame) -> DataFrame:
    """The cells of the finest level."""
    return placed.withColumns({f: F.floor(F.col(a) * (2.0**FINEST / CUBE_M)).cast("long") for f, a in zip(_FINE, AXES)})


def _cells(level: str, names: list[str] = CELL) -> dict[str, Column]:
    """Cells of a level, given in SQL, that hold the finest ones."""
    return {c: F.expr(f"shiftright({f}, cast({FINEST} - ({level}) as int))") for c, f in zip(names, _FINE)}


def _gap(low: str, high: str) -> str:
    """SQL for the square of the least distance of the box a_* to {low}..{high} (of an axis)."""
    return " + ".join(
        f"pow(greatest(0D, a_{a}_lo - {high.format(a)}, {low.format(a)} - a_{a}_hi), 2D)" for a in AXES)


def _span(low: str, high: str) -> str:
    """SQL for the square of the greatest distance between points of the two boxes."""
    return " + ".join(
        f"pow(greatest(a_{a}_hi - {low.format(a)}, {high.format(a)} - a_{a}_lo), 2D)" for a in AXES)


def _kept(items: str, gap: str, bound: str) -> str:
    """SQL for the items whose gap is at most the bound.

    The bound is a lambda's argument: a column of its own is merged into the filter and worked out for every item.
    """
    return f"transform(array({bound}), b -> filter({items}, {gap} <= b))[0]"


def _boxed(prefix: str) -> list[str]:
    return [f"{prefix}{end}" for end in _ENDS]


def _tree(spots: DataFrame, levels: list[int], labels: list[str], gather_max: int, rows: int) -> DataFrame:
    """Site cells of the levels: number, box (s_*) and, if they are at most ``gather_max``, the sites."""
    keys = [*labels, "level", *CELL]
    spread = spots.withColumn("level", F.explode(F.lit(levels))).withColumns(_cells("level"))
    site = F.struct("site", "lat", "lon", *AXES)
    renamed = {end: f"s_{end}" for end in _ENDS}
    if rows <= BROADCAST_ROWS:
        # A whole catalogue of this size fits one row, so one aggregate does.
        cells = box_of(spread, keys, near=F.collect_list(site))
        return cells.withColumn("near", F.when(F.col("n") <= gather_max, F.col("near"))).withColumnsRenamed(renamed)
    cells = box_of(spread, keys)
    light = cells.filter(F.col("n") <= gather_max).select(keys)
    listed = skew_join(spread, light, keys, spread=["lat", "lon"])
    listed = listed.groupBy(*keys).agg(F.collect_list(site).alias("near"))
    return cells.join(listed, keys, "left").withColumnsRenamed(renamed)


def _homes(points: DataFrame, tree: DataFrame, labels: list[str], small: bool) -> DataFrame:
    """Point cells of level 16: box (a_*), home level, and the box of a site cell in the home."""
    cells = box_of(points.withColumns(_cells(str(LEVEL))), [*labels, *CELL])
    cells = cells.withColumnsRenamed({end: f"a_{end}" for end in _ENDS})
    up = [f"p{c}" for c in CELL]
    asked = cells.withColumnsRenamed(dict(zip(CELL, up))).withColumn("level", F.explode(F.lit([x for x in LEVELS if x])))
    # The cell of each level and its neighbours on the nearer sides, so that no point is cut off by a coarse border.
    side = F.lit(CUBE_M) / F.pow(F.lit(2.0), "level")
    for axis, c, u in zip(AXES, CELL, up):
        own = F.expr(f"shiftright({u}, cast({LEVEL} - level as int))")
        beside = own + F.when(F.floor(F.col(f"a_{axis}_lo") * 2.0 / side) % 2 == 1, 1).otherwise(-1)
        asked = asked.withColumn(c, F.explode(F.array(own, beside)))
    sites = tree.select("level", *CELL, *[F.col(c).alias(f"other_{c}") for c in labels], *_boxed("s_"))
    met = skew_join(asked, sites, ["level", *CELL], "left", spread=up, small_right=small)
    hit = F.col("s_x_lo").isNotNull()
    for label in labels:
        hit = hit & (F.col(label) != F.col(f"other_{label}"))
    less = (-F.expr(_span("s_{}_lo", "s_{}_hi"))).alias("less")
    best = F.max(F.when(hit, F.struct("level", less, *_boxed("s_")))).alias("h")
    found = met.groupBy(*labels, *up).agg(*[F.first(c).alias(c) for c in _boxed("a_")], best)
    # The whole cube holds a site, wherever it is.
    whole = {end: F.lit(0.0 if end.endswith("lo") else CUBE_M) for end in _ENDS}
    return found.select(
        *labels, *[F.col(u).alias(c) for u, c in zip(up, CELL)], *_boxed("a_"),
        F.coalesce("h.level", F.lit(0)).alias("home"),
        *[F.coalesce(f"h.s_{end}", whole[end]).alias(f"s_{end}") for end in _ENDS])


def _reached(groups: DataFrame) -> DataFrame:
    """One row per site cell of level ``home`` within the bound of a group; adds the cell columns."""
    reach = f"sqrt({_span('s_{}_lo', 's_{}_hi')}) + {2 * MARGIN_M!r}D as _reach"
    out = groups.selectExpr("*", reach, f"{CUBE_M!r}D / pow(2D, home) as _side")
    gap = "0D"
    for a, cell in zip(AXES, CELL):
        first = f"cast(greatest(0D, floor((a_{a}_lo - _reach) / _side)) as bigint)"
        last = f"cast(least(pow(2D, home) - 1, floor((a_{a}_hi + _reach) / _side)) as bigint)"
        gap += f" + pow(greatest(0D, {cell} * _side - a_{a}_hi, a_{a}_lo - {cell} * _side - _side), 2D)"
        out = out.selectExpr("*", f"explode(sequence({first}, {last})) as {cell}").filter(f"{gap} <= _reach * _reach")
    return out.drop("_reach", "_side", *_boxed("s_"))


def _lists(pairs: DataFrame, keys: list[str], labels: list[str], gather_max: int, list_max: int) -> DataFrame:
    """Per group: the site cells that may hold a nearest site, and the list of sites if it is short.

    ``reach`` is the square of a distance within which every point of the group has a site.

    ``pairs``: keys and box (a_*) of the group, one site cell (level, cell, other labels, n, s_*, near).
    """
    cell = ", ".join(f"'{c}', {c}" for c in ("level", *CELL, *[f"other_{c}" for c in labels]))
    # Few rows can be much work here: a set number of partitions is not merged by size.
    met = _dealt(pairs, keys).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in _boxed("a_")], F.expr(f"min({_span('s_{}_lo', 's_{}_hi')}) as _span"),
        F.expr(f"collect_list(named_struct('gap', {_gap('s_{}_lo', 's_{}_hi')}, 'n', s_n, 'cell', named_struct({cell}), 'near', near)) as cells"))
    margin = f"{2 * MARGIN_M!r}D"
    met = met.selectExpr("*", f"pow(sqrt(_span) + {margin}, 2D) as _bound").selectExpr(
        *keys, "_span", *_boxed("a_"), _kept("cells", "c -> c.gap", "_bound") + " as cells")
    # The same bound again, site by site.
    site = f"named_struct('gap', {_gap('s.{}', 's.{}')}, 'span', {_span('s.{}', 's.{}')}, 's', s)"
    gathered = f"case when aggregate(cells, 0L, (x, c) -> x + c.n) <= {gather_max} then flatten(transform(cells, c -> c.near)) end"
    met = met.selectExpr(*keys, "_span", "cells", f"transform({gathered}, s -> {site}) as near")
    span = "array_min(transform(near, s -> s.span))"
    bound = f"pow(sqrt({span}) + {margin}, 2D)"
    met = met.selectExpr(
        *keys, f"coalesce({span}, _span) as reach", "cells", f"transform({_kept('near', 's -> s.gap', bound)}, s -> s.s) as near")
    met = met.selectExpr(*keys, "reach", "cells", "near", f"near is null or size(near) > {list_max} as busy")
    return met.selectExpr(
        *keys, "reach", "busy", "case when not busy then near end as near", "case when busy then transform(cells, c -> c.cell) end as cells")


def _beyond(lists: DataFrame, beyond: float | None) -> DataFrame:
    """Lists whose points may all be ``beyond`` metres or more from any site; without ``beyond`` all lists."""
    if beyond is None:
        return lists
    least = max(0.0, geo.chord_m(beyond) - 2 * MARGIN_M)
    return lists.filter(F.col("reach") >= least * least)


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one key in one of a set number of partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _finer(
    points: DataFrame, lists: DataFrame, keys: list[str], unique: list[str], small: bool, beyond: float | None,
) -> DataFrame:
    """Closest sites of points, with lists of finer cells where points are many.

    A site nearest to a point of a finer cell is in the group's list, and no farther from the cell's box than
    the least of the greatest distances to the box.
    """
    group = [f"g{c}" for c in CELL]
    levels = [F.least(F.col("fine") + step, F.lit(FINEST)) for step in FINER]
    cells = [[f"{c}_{step}" for c in CELL] for step in FINER]
    celled = points
    for level, names in zip(levels, cells):
        celled = celled.withColumn("_to", level).withColumns(_cells("_to", names)).drop("_to")
    boxes = box_of(celled, [*keys, *[c for names in cells for c in names]]).withColumnsRenamed({e: f"a_{e}" for e in _ENDS})
    boxes, seen = materialize_with(boxes, "boxes", points=F.sum("n"))
    sides = [F.min(c) if c.endswith("lo") else F.max(c) for c in _boxed("a_")]
    sides = [side.alias(c) for side, c in zip(sides, _boxed("a_"))]
    found, at = lists.select(*keys, "near"), keys
    for names in cells:
        below = [*at, *names]
        if names is cells[-1]:
            shapes, count = boxes, seen["rows"]
        else:
            shapes = materialize(boxes.groupBy(*below).agg(*sides), "shapes")
            count = shapes.count()
        if count * SERVED > (seen["points"] or 0):
            break
        span = f"transform(near, s -> {_span('s.{}', 's.{}')})"
        bound = f"pow(sqrt(array_min({span})) + {2 * MARGIN_M!r}D, 2D)"
        joined = _dealt(shapes, at).join(_dealt(found, at), at)
        joined = joined.selectExpr(
            *below, f"array_min({span}) as reach", _kept("near", f"s -> {_gap('s.{}', 's.{}')}", bound) + " as near")
        found, listed = materialize_with(_beyond(joined, beyond).drop("reach"), "finer", sites=_listed())
        at, small = below, _is_small(listed)
    counts = boxes.groupBy(*at).agg(F.sum("n").alias("n"))
    return _picked(celled, found, at, unique, small, counts)


def _listed() -> Column:
    """The number of sites on all lists."""
    return F.sum(F.when(F.col("near").isNotNull(), F.size("near")))


def _is_small(lists: dict) -> bool:
    """Whether lists can be broadcast: the sites on them count, not the lists."""
    return max(lists["rows"], lists["sites"] or 0) <= BROADCAST_ROWS


def _closest(near: str) -> Column:
    """The least (distance, site, lat, lon) of a list of sites for the row's latitude and longitude.

    The straight-line distance tells the sites that may be the nearest, most often one.
    """
    line = " + ".join(f"({a} - s.{a}) * ({a} - s.{a})" for a in AXES)
    bound = f"pow(sqrt(array_min(transform({near}, s -> {line}))) + {2 * MARGIN_M!r}D, 2D)"
    near = _kept(near, f"s -> {line}", bound)
    chord = ("pow(sin((radians(s.lat) - radians(latitude)) / 2D), 2D)"
             " + cos(radians(latitude)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(longitude)) / 2D), 2D)")
    chords = f"transform({near}, s -> named_struct('a', {chord}, 's', s))"
    arc = f"atan2(sqrt(c.a), sqrt(greatest(0D, 1D - c.a))) * {2 * geo.EARTH_RADIUS_M!r}D"
    return F.expr(f"array_min(transform({chords}, c -> named_struct('d', {arc}, 'site', c.s.site, 'lat', c.s.lat, 'lon', c.s.lon)))")


def _divided(
    points: DataFrame, busy: DataFrame, spots: DataFrame, labels: list[str], unique: list[str],
    gather_max: int, list_max: int, finest: int, beyond: float | None,
) -> list[DataFrame]:
    """Closest sites of the points of busy groups: groups and site cells are divided until lists are short."""
    group = [f"g{c}" for c in CELL]
    keys = [*labels, "home", "fine", *group]
    others = [f"other_{c}" for c in labels]
    at_end = F.col("fine") >= finest
    facts = {"busy": F.count(F.when(F.col("busy"), 1)), "ended": F.count(F.when(F.col("busy") & at_end, 1))}
    parts: list[DataFrame] = []
    levels = list(LEVELS)
    open_, seen = materialize_with(busy.select(*keys, "busy", "cells"), "open", **facts)
    while seen["busy"]:
        if seen["ended"]:
            # Groups too small to divide are compared row by row, with sites all but equally far from them.
            last = open_.filter(at_end & F.col("busy")).select(*keys, F.inline("cells"))
            sites = spots.withColumn("level", F.explode(F.lit(levels))).withColumns(_cells("level"))
            sites = sites.withColumnsRenamed(dict(zip(labels, others))).select("level", *CELL, *others, "site", "lat", "lon")
            pairs = last.join(sites, ["level", *CELL, *others]).select(*keys, "site", "lat", "lon")
            distance = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
            best = points.join(pairs, keys).groupBy(*unique).agg(
                F.min(F.struct(distance.alias("d"), "site", "lat", "lon")).alias("_best"))
            parts.append(points.join(best, unique))
        if seen["busy"] == seen["ended"]:
            break
        open_ = open_.filter(~at_end & F.col("busy"))
        old = [f"o{c}" for c in group]
        inside = skew_join(
            points, open_.select(*keys), keys, spread=unique, small_right=True if seen["busy"] <= BROADCAST_ROWS else None,
        ).withColumnsRenamed(dict(zip(group, old)))
        inside = inside.withColumns({"was": F.col("fine"), "fine": F.least(F.col("fine") + DIVIDE, F.lit(FINEST))})
        inside = materialize(inside.withColumns(_cells("fine", group)), "inside")
        points = inside.drop("was", *old)
        kids = box_of(inside, [*keys, "was", *old]).withColumnsRenamed({end: f"a_{end}" for end in _ENDS}).drop("n")
        wide = [f"w{c}" for c in CELL]
        above = open_.select(*labels, "home", F.col("fine").alias("was"), *[F.col(g).alias(o) for g, o in zip(group, old)], F.inline("cells"))
        above = above.withColumnsRenamed(dict(zip(CELL, wide)))
        down = {x: min(x + DIVIDE, FINEST) for x in levels}
        # Only sites in the cells of busy groups are divided.
        cells, many = materialize_with(above.select(*others, "level", *wide).distinct(), "wide")
        below = spots.withColumn("level", F.explode(F.lit(levels))).withColumns(
            {**_cells("level", wide), **{other: F.col(label) for other, label in zip(others, labels)}})
        below = below.join(
            F.broadcast(cells) if many["rows"] <= BROADCAST_ROWS else cells, [*others, "level", *wide], "left_semi")
        below, left = materialize_with(below.select(*spots.columns).distinct(), "below")
        levels = sorted(set(down.values()))
        tree = _tree(below, levels, labels, gather_max, left["rows"]).withColumnsRenamed({**dict(zip(labels, others)), "n": "s_n", "level": "_level"})
        # The cells above: DIVIDE levels up, or fewer where the finest level was reached.
        steps = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(y).alias("to")) for x, y in down.items()])
        tree = tree.withColumn("_up", F.explode(F.filter(steps, lambda t: t["to"] == F.col("_level"))))
        tree = tree.withColumn("level", F.col("_up.level")).withColumns(
            {w: F.expr(f"shiftright({c}, cast(_level - level as int))") for w, c in zip(wide, CELL)}).drop("_up")
        pairs = kids.join(above, [*labels, "home", "was", *old])
        pairs = pairs.join(tree, ["level", *wide, *others]).withColumn("level", F.col("_level"))
        lists = _beyond(_lists(pairs, keys, labels, gather_max, list_max), beyond)
        open_, seen = materialize_with(lists, "near", **facts, sites=_listed())
        parts.append(_picked(points, open_.filter("not busy"), keys, unique, _is_small(seen)))
    return parts


def _picked(
    points: DataFrame, lists: DataFrame, keys: list[str], unique: list[str], small: bool, counts: DataFrame | None = None,
) -> DataFrame:
    joined = skew_join(points, lists.select(*keys, "near"), keys, spread=unique, small_right=small, counts=counts)
    return joined.withColumn("_best", _closest("near")).drop("near")


def has_position() -> Column:
    """Whether a row's latitude and longitude are numbers."""
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None)).isNotNull() for c in ("latitude", "longitude")]
    return known[0] & known[1]


def nearest_site(
    points: DataFrame,
    sites: DataFrame,
    unique: list[str],
    *,
    site_id: str = "SUP_ID",
    apart: str | None = None,
    list_max: int | None = None,
    finest: int | None = None,
    beyond: float | None = None,
) -> DataFrame:
    """Add the nearest site's id, position and distance to every point.

    Equal distances go to the least site id as text. ``unique`` is a key of the
    points. With ``apart`` only sites that differ from the point in that column
    count; points no site differs from are left out, and so are points whose coordinates are null or NaN.
    With ``beyond`` only points at least so many metres from every site are returned; cells of points
    that all have a nearer site are dropped whole.
    """
    list_max = LIST_MAX if list_max is None else list_max
    gather_max = max(list_max, GATHER_MAX * list_max // LIST_MAX)
    finest = FINEST if finest is None else finest
    labels = [apart] if apart else []
    given = points.columns
    spots = sites.filter(geo.valid_latlon("latitude", "longitude"))
    # One row per position: the least id answers for all sites standing there.
    spots = spots.groupBy(*labels, "latitude", "longitude").agg(
        F.min(F.col(site_id).cast("string")).alias("site")
    )
    spots, count = materialize_with(
        _celled(_placed(spots)).withColumnsRenamed({"latitude": "lat", "longitude": "lon"}), "sites")
    if not count["rows"]:
        raise ValueError("the site catalogue has no valid site")
    tree, cells = materialize_with(_tree(spots, list(LEVELS), labels, gather_max, count["rows"]), "tree")
    few = cells["rows"] <= BROADCAST_ROWS
    # The points are met several times from here; their cells follow from the positions.
    placed = _celled(materialize(_placed(points.filter(has_position())), "placed"))
    homes, seen = materialize_with(_homes(placed, tree, labels, few), "homes")
    group = [f"g{c}" for c in CELL]
    keys = [*labels, "home", "fine", *group]
    fine = F.least(F.col("home") + STEP, F.lit(LEVEL)).alias("fine")
    homes = homes.select("*", fine).withColumns({
        g: F.expr(f"shiftright({c}, cast({LEVEL} - fine as int))") for g, c in zip(group, CELL)})
    sides = []
    for a in AXES:
        sides += [F.min(f"a_{a}_lo").alias(f"a_{a}_lo"), F.max(f"a_{a}_hi").alias(f"a_{a}_hi")]
    groups = homes.groupBy(*keys).agg(*sides, *[F.first(c).alias(c) for c in _boxed("s_")])
    asked = _reached(groups).withColumn("level", F.col("home"))
    theirs = tree.withColumnsRenamed({**{c: f"other_{c}" for c in labels}, "n": "s_n"})
    # The cells are broadcast with their sites, which stand on several levels.
    light = few and len(LEVELS) * count["rows"] <= BROADCAST_ROWS
    pairs = asked.join(F.broadcast(theirs) if light else theirs, ["level", *CELL])
    for label in labels:
        pairs = pairs.filter(F.col(label) != F.col(f"other_{label}"))
    lists, facts = materialize_with(
        _beyond(_lists(pairs, keys, labels, gather_max, list_max), beyond), "lists",
        busy=F.count(F.when(F.col("busy"), 1)), sites=_listed())

    # Points find their group by the cell of level 16, then the list of the group.
    keyed = placed.withColumns(_cells(str(LEVEL)))
    named = homes.select(*labels, *CELL, "home", "fine", *group)
    small = seen["rows"] <= BROADCAST_ROWS
    keyed = skew_join(keyed, named, [*labels, *CELL], spread=unique, small_right=True if small else None)
    keyed = keyed.drop(*CELL)
    if not small:
        keyed = materialize(keyed, "keyed")
    parts = [_finer(keyed, lists.filter("not busy") if facts["busy"] else lists, keys, unique, _is_small(facts), beyond)]
    if facts["busy"]:
        crowd = skew_join(
            keyed, lists.filter("busy").select(*keys), keys, spread=unique, small_right=True if facts["busy"] <= BROADCAST_ROWS else None)
        parts += _divided(
            materialize(crowd, "crowd"), lists.filter("busy"), spots, labels, unique, gather_max, list_max, finest, beyond)
    whole = parts[0].select(*given, "_best")
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*given, "_best"))
    if beyond is not None:
        whole = whole.filter(F.col("_best.d") >= beyond)
    return whole.select(
        *given,
        F.col("_best.site").alias("nearest_SUP_ID"),
        F.col("_best.lat").alias("nearest_ANFR_latitude"),
        F.col("_best.lon").alias("nearest_ANFR_longitude"),
        F.col("_best.d").alias("nearest_ANFR_distance_m"),
    )
