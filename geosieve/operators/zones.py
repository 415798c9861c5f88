"""Site density, contrasting study zones, patch grids and their tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.config import Imagery
from geosieve.functions import geo, text
from geosieve.operators import checks
from geosieve.operators.cells import Metric
from geosieve.operators.proximity import count_within
from geosieve.operators.spread import materialize, materialize_with, skew_join


def with_planar(sites: DataFrame) -> DataFrame:
    """Metres east and north, the east scaled at the table's mean latitude."""
    mean = sites.agg(F.avg(F.radians("latitude")).alias("phi")).select("phi").scalar()
    return sites.withColumns({
        "x_m": F.radians("longitude") * F.cos(mean) * geo.EARTH_RADIUS_M,
        "y_m": F.radians("latitude") * geo.EARTH_RADIUS_M,
    })


def density_counts(sites: DataFrame, radius_m: float = 500.0, name: str = "density") -> DataFrame:
    """Sites within the radius of each site, itself included, by planar distance.

    Sites without a position are refused, with their number.
    """
    if radius_m <= 0:
        raise ValueError("radius_m must be positive")
    checks.require_columns(sites, ["SUP_ID", "latitude", "longitude"])
    sites = sites.withColumns(text.numbers(sites, ["latitude", "longitude"]))
    lost = sites.filter(F.col("latitude").isNull() | F.col("longitude").isNull()).count()
    if lost:
        raise ValueError(f"{lost} sites have no position")
    flat = with_planar(sites).withColumnsRenamed({"x_m": "x", "y_m": "y"})
    flat = materialize(flat, "planar")
    counted = count_within(flat, "SUP_ID", Metric(radius_m, flat=True), name=name)
    return counted.drop("x", "y")


def far_enough(
    sites: DataFrame, centres: list[tuple[float, float]], separation_m: float = 5000.0
) -> DataFrame:
    """Sites at least this far from each of a few given centres (lat, lon)."""
    ok = F.lit(True)
    for lat, lon in centres:
        ok = ok & (geo.haversine_m("latitude", "longitude", lat, lon) >= separation_m)
    return sites.filter(ok)


def _median(counts: DataFrame, column: str) -> float:
    """Exact median from the histogram of a whole-number column."""
    histogram = counts.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return histogram.agg(F.percentile(column, F.lit(0.5), F.col("n"))).first()[0]


def contrasting_zones(
    sites: DataFrame, radius_m: float = 500.0, separation_m: float = 5000.0
) -> DataFrame:
    """Three centres: the densest site, one of median density at least the separation
    away, and of the least dense ones away from both the farthest. Ties go to the
    least id as text."""
    if separation_m <= 0:
        raise ValueError("separation_m must be positive")
    checks.require_columns(sites, ["SUP_ID", "latitude", "longitude"])
    located = sites.withColumns(text.numbers(sites, ["latitude", "longitude"]))
    located = located.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    thin = located.select(F.col("SUP_ID").cast("string").alias("SUP_ID"), "latitude", "longitude")
    counts, seen = materialize_with(density_counts(thin, radius_m), "density")
    if seen["rows"] < 3:
        raise ValueError(f"three zones need at least three located sites, not {seen['rows']}")
    row = F.struct("SUP_ID", "latitude", "longitude", "density")

    def first_by(frame: DataFrame, *order):
        """The row that comes first; one row reaches the driver."""
        keys = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], "SUP_ID")
        return frame.agg(F.min_by(row, keys).alias("r")).first()["r"]

    dense = first_by(counts, -F.col("density"))
    centres = [(dense["latitude"], dense["longitude"])]
    pool = far_enough(counts, centres, separation_m)
    if pool.isEmpty():
        raise ValueError("no site is far enough for an intermediate zone")
    target = _median(pool, "density")
    medium = first_by(pool, F.abs(F.col("density") - F.lit(target)))
    centres.append((medium["latitude"], medium["longitude"]))
    pool = far_enough(counts, centres, separation_m)
    apart = F.least(*[geo.haversine_m("latitude", "longitude", a, b) for a, b in centres])
    sparse = first_by(pool, F.col("density"), -apart)
    if sparse is None:
        raise ValueError("no site is far enough for a sparse zone")
    chosen = zip(("dense", "intermediaire", "peu_dense"), (dense, medium, sparse))
    rows = [(z, r["SUP_ID"], r["latitude"], r["longitude"], r["density"]) for z, r in chosen]
    return sites.sparkSession.createDataFrame(
        rows, "zone_id string, SUP_ID string, latitude double, longitude double, supports_within long"
    )


def grid_patches(zones: DataFrame, cfg: Imagery | None = None) -> DataFrame:
    """The grid of image patches round every zone centre, with corners and extents."""
    cfg = cfg or Imagery()
    world, size = cfg.world_size, cfg.patch_size
    lat, lon = geo.require_latlon("latitude", "longitude")
    half = cfg.grid_size * size / 2.0
    steps = F.sequence(F.lit(0), F.lit(cfg.grid_size - 1))
    corner = zones.select(
        F.col("zone_id").cast("string").alias("zone_id"),
        F.rint(geo.world_x(lon, world) - half).cast("long").alias("_left"),
        F.rint(geo.world_y(lat, world) - half).cast("long").alias("_top"),
    )
    cells = corner.withColumn("row", F.explode(steps)).withColumn("col", F.explode(steps))
    placed = cells.select(
        "zone_id",
        F.format_string("%s_r%02d_c%02d.jpg", "zone_id", "row", "col").alias("image"),
        "row", "col", F.lit(cfg.zoom).alias("zoom"),
        (F.col("_left") + F.col("col") * size).alias("world_left"),
        (F.col("_top") + F.col("row") * size).alias("world_top"),
    )
    left, top = F.col("world_left"), F.col("world_top")
    right, bottom = left + size, top + size
    return placed.withColumns({
        "relative_image_path": F.concat(F.lit("images/"), "image"),
        "world_right": right, "world_bottom": bottom,
        "center_latitude": geo.world_lat(top + size / 2.0, world),
        "center_longitude": geo.world_lon(left + size / 2.0, world),
        "north": geo.world_lat(top.cast("double"), world),
        "south": geo.world_lat(bottom.cast("double"), world),
        "west": geo.world_lon(left.cast("double"), world),
        "east": geo.world_lon(right.cast("double"), world),
    })


def centred_patches(sites: DataFrame, cfg: Imagery | None = None) -> DataFrame:
    """One patch per site with the site at its centre."""
    cfg = cfg or Imagery()
    lat, lon = geo.require_latlon("latitude", "longitude")
    half = cfg.patch_size / 2.0
    return sites.select(
        F.col("SUP_ID").cast("string").alias("SUP_ID"),
        F.concat(F.lit("support_"), F.col("SUP_ID").cast("string"), F.lit(".jpg")).alias("image"),
        "latitude", "longitude", F.lit(cfg.zoom).alias("zoom"),
        F.rint(geo.world_x(lon, cfg.world_size) - half).cast("long").alias("world_left"),
        F.rint(geo.world_y(lat, cfg.world_size) - half).cast("long").alias("world_top"),
    )


def patch_tiles(patches: DataFrame, cfg: Imagery | None = None) -> DataFrame:
    """Tiles each patch is cut from: where a tile is pasted and where the crop starts."""
    cfg = cfg or Imagery()
    tile, size = cfg.tile_size, cfg.patch_size

    def index(c):
        return F.floor(c / F.lit(float(tile))).cast("long")

    left, top = F.col("world_left"), F.col("world_top")
    framed = patches.withColumns({
        "_x0": index(left), "_x1": index(left + (size - 1)),
        "_y0": index(top), "_y1": index(top + (size - 1)),
    })
    return (
        framed.withColumn("tile_x", F.explode(F.sequence("_x0", "_x1")))
        .withColumn("tile_y", F.explode(F.sequence("_y0", "_y1")))
        .withColumns({
            "paste_x": (F.col("tile_x") - F.col("_x0")) * tile,
            "paste_y": (F.col("tile_y") - F.col("_y0")) * tile,
            "crop_left": left - F.col("_x0") * tile,
            "crop_top": top - F.col("_y0") * tile,
        })
        .drop("_x0", "_x1", "_y0", "_y1")
    )


def zone_extents(patches: DataFrame) -> DataFrame:
    return patches.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("patches"),
        F.max("north").alias("north"), F.min("south").alias("south"),
        F.min("west").alias("west"), F.max("east").alias("east"),
    )


def _cover(extents: DataFrame, top: float, levels: int) -> DataFrame:
    """(zone_id, edges, level, ci, cj, inside): cells that cover each extent, the coarsest that fit.

    Level 0 has cells of ``top`` degrees, each level halves them. The cells inside an extent are a block at each
    level; of that block those are listed which the block of the level above leaves over, a frame. Around the last
    block come the cells on the rim, which have to be looked into.
    """
    margin = 1e-9
    sides = (("south", "north", "a", "b"), ("west", "east", "c", "d"))
    shown = ["zone_id", "north", "south", "west", "east"]
    cut = extents.select(*shown).filter("south <= north and west <= east")
    # One row a level, and one for the rim at the last level.
    cut = cut.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cut = cut.withColumns({"level": F.least(F.col("_step"), F.lit(levels - 1)), "inside": F.col("_step") < levels})
    cut = cut.withColumn("_side", F.lit(top) / F.pow(F.lit(2.0), "level"))
    # The block left out: that of the level above in cells of this one, or for the rim the block itself.
    cut = cut.withColumn("_times", F.when(F.col("inside"), 2).otherwise(1).cast("long"))
    outer, inner = {}, {}
    for low, high, first, last in sides:
        for found, side in ((outer, F.col("_side")), (inner, F.col("_side") * F.col("_times"))):
            found[first] = F.ceil((F.col(low) + margin) / side).cast("long")
            found[last] = F.floor((F.col(high) - margin) / side).cast("long") - 1
        outer[first] = F.when(F.col("inside"), outer[first]).otherwise(F.floor(F.col(low) / F.col("_side")).cast("long"))
        outer[last] = F.when(F.col("inside"), outer[last]).otherwise(F.floor(F.col(high) / F.col("_side")).cast("long"))
    cut = cut.withColumns({**outer, **{f"_{k}": v for k, v in inner.items()}}).filter("a <= b and c <= d")
    some = (F.col("_step") > 0) & (F.col("_a") <= F.col("_b")) & (F.col("_c") <= F.col("_d"))
    cut = cut.withColumns({f"i{k}": F.when(some, F.col(f"_{k}") * F.col("_times") + (F.col("_times") - 1 if k in "bd" else 0)) for k in "abcd"})
    cut = cut.withColumn("ci", F.explode(F.sequence("a", "b")))
    # Rows beside the inner block are whole, the others have a piece on either side of it.
    beside = F.col("ia").isNull() | (F.col("ci") < F.col("ia")) | (F.col("ci") > F.col("ib"))
    one = F.array(F.struct(F.col("c").alias("lo"), F.col("d").alias("hi")))
    two = F.array(F.struct(F.col("c").alias("lo"), (F.col("ic") - 1).alias("hi")), F.struct((F.col("id") + 1).alias("lo"), F.col("d").alias("hi")))
    cut = cut.withColumn("_piece", F.explode(F.when(beside, one).otherwise(two))).filter("_piece.lo <= _piece.hi")
    return cut.withColumn("cj", F.explode(F.sequence("_piece.lo", "_piece.hi"))).select(*shown, "level", "ci", "cj", "inside")


def sites_in_extents(
    extents: DataFrame, sites: DataFrame, name: str = "sites_in_extent", top_deg: float = 16.0, levels: int = 14,
) -> DataFrame:
    """Sites inside each zone's extent, edges included.

    Sites are counted per cell of each level first. An extent is covered by coarse cells inside and finer ones
    towards its rim, so its number of cells grows with its rim and not with its area. A cell inside adds its count as
    one row; only the finest cells on the rim (``top_deg`` halved ``levels`` - 1 times) are looked into site by site.
    """
    fine = top_deg / 2 ** (levels - 1)
    lat_cell = F.floor(F.col("latitude") / fine).cast("long").alias("ci")
    lon_cell = F.floor(F.col("longitude") / fine).cast("long").alias("cj")
    # Copies of one position are one row with a weight.
    spots = sites.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("w"))
    spots = materialize(spots.select("*", lat_cell, lon_cell), "spots")
    cells = spots.groupBy("ci", "cj").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"))
    cells = materialize(cells, "cells")
    cover = materialize(_cover(extents, top_deg, levels), "cover")
    # The counts of all levels from those of the finest.
    up = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    counts = up.groupBy(
        "level", F.expr(f"shiftright(ci, {levels - 1} - level)").alias("ci"), F.expr(f"shiftright(cj, {levels - 1} - level)").alias("cj")
    ).agg(F.sum("n").alias("n"))
    whole = cover.filter("inside").join(counts, ["level", "ci", "cj"]).select("zone_id", "n")
    in_box = F.col("latitude").between(F.col("south"), F.col("north")) & F.col(
        "longitude").between(F.col("west"), F.col("east"))
    edge = cover.filter(~F.col("inside")).drop("inside", "level")
    rim = skew_join(
        spots, edge, ["ci", "cj"], spread=["latitude", "longitude"], counts=cells.select("ci", "cj", F.col("rows").alias("n"))
    ).filter(in_box)
    found = whole.unionByName(rim.select("zone_id", F.col("w").alias("n")))
    totals = found.groupBy("zone_id").agg(F.sum("n").alias(name))
    return extents.join(totals, "zone_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
