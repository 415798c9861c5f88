"""Human and weak annotations: coverage, label tables, distance calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.config import Imagery
from geosieve.functions import boxes, geo, text
from geosieve.operators import checks
from geosieve.operators.nearest import nearest_site
from geosieve.operators.spread import materialize, rows_at_ranks

STATUSES = ["visible", "non_visible", "ambigu"]


def clean_annotations(df: DataFrame) -> DataFrame:
    checks.require_columns(df, ["status", "image"])
    return df.withColumn("status", text.clean_status())


def visible(df: DataFrame) -> DataFrame:
    """Rows whose status is exactly visible."""
    return df.filter(F.coalesce(F.col("status") == "visible", F.lit(False)))


def usable(df: DataFrame) -> DataFrame:
    """Rows a data set can use; an empty or missing status is not ambiguous."""
    return df.filter(F.coalesce(F.col("status") != "ambigu", F.lit(True)))


def coverage(df: DataFrame, by: str = "split") -> DataFrame:
    """Reviewed images per source with their statuses."""
    status = F.col("status")
    counts = [F.count(F.when(status == s, 1)).alias(s) for s in STATUSES]
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), *counts,
        F.count(F.when(F.coalesce(status != "ambigu", F.lit(True)), 1)).alias("usable"),
    )


def visible_type_counts(df: DataFrame) -> DataFrame:
    kind = F.coalesce("classe_niveau2", F.lit("non_renseigne")).alias("classe_niveau2")
    return visible(df).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def human_labels(df: DataFrame, size: int = 1024) -> DataFrame:
    """Label text per usable image: one line if visible, empty if not.

    Fails on unknown statuses, repeated ids in a split, ids in two splits and
    visible rows without a valid box.
    """
    rows = clean_annotations(df)
    checks.require_clean(rows, {
        "status": checks.bad_status(), "box": checks.bad_box(size), "split": checks.bad_split(),
    })
    repeated = rows.groupBy("SUP_ID").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("split").alias("first"), F.max("split").alias("last"),
    ).filter(F.col("n") > 1).head()
    if repeated:
        kind = "repeated" if repeated["first"] == repeated["last"] else "in two splits"
        raise ValueError(f"SUP_ID {repeated['SUP_ID']} is {kind}")
    line = F.when(F.col("status") == "visible", boxes.label_line(boxes.normalised(size)))
    return usable(rows).select(
        "SUP_ID", "split", "image",
        F.concat(text.file_stem("image"), F.lit(".txt")).alias("label_file"),
        F.coalesce(line, F.lit("")).alias("label"),
    )


def human_label_counts(df: DataFrame) -> DataFrame:
    """Reviewed, usable and excluded images per split."""
    return coverage(clean_annotations(df)).select(
        "split", F.col("total").alias("total_reviewed"), "usable", "visible", "non_visible",
        F.col("ambigu").alias("ambiguous_excluded"),
    )


def weak_labels(manifest: DataFrame, size: int = 1024, box_px: int = 160) -> DataFrame:
    """The same centred box for every site of a split manifest."""
    if not 0 < box_px <= size:
        raise ValueError("box_px must be between 1 and size")
    checks.require_columns(manifest, ["SUP_ID", "split"])
    checks.require_clean(manifest, {"split": checks.bad_split()})
    share = box_px / size
    return manifest.select(
        F.col("SUP_ID").cast("string").alias("SUP_ID"), "split",
        F.concat(F.lit("support_"), "SUP_ID", F.lit(".jpg")).alias("image"),
        F.concat(F.lit("support_"), "SUP_ID", F.lit(".txt")).alias("label_file"),
        F.lit(0).alias("class_id"),
        F.lit(0.5).alias("x_center_norm"), F.lit(0.5).alias("y_center_norm"),
        F.lit(share).alias("width_norm"), F.lit(share).alias("height_norm"),
        F.lit("weak_centered_from_anfr_coordinate").alias("annotation_type"),
        F.lit(f"0 0.50000000 0.50000000 {share:.8f} {share:.8f}\n").alias("label"),
    )


def missing_files(manifest: DataFrame, files: DataFrame, name: str = "image") -> DataFrame:
    """Manifest rows whose image is not among the listed files (column path)."""
    listed = files.select(F.regexp_extract("path", r"([^/\\]*)$", 1).alias(name)).distinct()
    return manifest.join(listed, name, "left_anti")


def wrong_image_size(files: DataFrame, size: int = 1024) -> DataFrame:
    """Listed images (columns width and height) of another size."""
    return files.filter((F.col("width") != size) | (F.col("height") != size))


def visual_positions(df: DataFrame, cfg: Imagery | None = None) -> DataFrame:
    """Where the annotated box centre lies when the image is centred on the site."""
    cfg = cfg or Imagery()
    world, half = cfg.world_size, cfg.patch_size / 2.0
    cx, cy = boxes.center()
    lat, lon = geo.require_latlon("latitude", "longitude")
    shifted = df.withColumns({
        "bbox_center_x": cx, "bbox_center_y": cy,
        "_px": geo.world_x(lon, world) + cx - half, "_py": geo.world_y(lat, world) + cy - half,
    })
    return shifted.withColumns({
        "visual_latitude": geo.world_lat("_py", world),
        "visual_longitude": geo.world_lon("_px", world),
    }).drop("_px", "_py")


def own_site_distance(df: DataFrame) -> DataFrame:
    """Distance from the visual position to the annotated site itself."""
    return df.withColumn("distance_to_own_anfr_m", geo.haversine_m(
        "latitude", "longitude", "visual_latitude", "visual_longitude"))


def calibrate(annotations: DataFrame, sites: DataFrame, cfg: Imagery | None = None) -> DataFrame:
    """Offset of every visible annotation to its own and to its nearest site."""
    numbers = ["latitude", "longitude", *boxes.CORNERS]
    checks.require_columns(annotations, ["SUP_ID", "status", *numbers])
    seen = visible(annotations).withColumns(text.numbers(annotations, numbers))
    state = seen.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.greatest(*[F.col(c).isNull() for c in numbers]), 1)).alias("bad"),
    ).first()
    if not state["n"]:
        raise ValueError("no visible annotation to calibrate with")
    if state["bad"]:
        raise ValueError("visible annotations lack coordinates or box corners")
    placed = own_site_distance(visual_positions(seen, cfg)).withColumnsRenamed({
        "latitude": "official_latitude", "longitude": "official_longitude",
    })
    placed = placed.withColumns({
        "latitude": F.col("visual_latitude"), "longitude": F.col("visual_longitude"),
    })
    extra = [c for c in ("source", "classe_niveau2") if c in annotations.columns]
    key = ["SUP_ID", *[c for c in extra if c == "source"]]
    near = nearest_site(placed, sites, key)
    return near.select(
        "SUP_ID", *extra, "official_latitude", "official_longitude",
        "bbox_center_x", "bbox_center_y", "visual_latitude", "visual_longitude",
        "distance_to_own_anfr_m", "nearest_SUP_ID",
        F.col("nearest_ANFR_distance_m").alias("distance_to_nearest_anfr_m"),
    )


def calibration_summary(calibration: DataFrame, threshold_m: float = 150.0) -> DataFrame:
    """Count, mean, maximum and exact percentiles of the nearest distances."""
    column = "distance_to_nearest_anfr_m"
    known = calibration.filter(F.col(column).isNotNull() & ~F.isnan(column))
    known = materialize(known.select("SUP_ID", column), "distances")
    marks = rows_at_ranks(known, column, "SUP_ID", [0.5, 0.95, 0.975, 0.99])
    if not marks:
        raise ValueError("the calibration has no usable distance")
    named = zip(("median_m", "p95_m", "p97_5_m", "p99_m"), sorted(marks))
    return known.agg(
        F.count(F.lit(1)).alias("visible_supports_used"), F.avg(column).alias("mean_m"),
        *[F.lit(marks[q]).alias(name) for name, q in named],
        F.max(column).alias("max_m"),
        F.lit(float(threshold_m)).alias("candidate_distance_threshold_m"),
    )


def distance_histogram(
    calibration: DataFrame, column: str = "distance_to_nearest_anfr_m", bins: int = 24
) -> DataFrame:
    """Counts in equal bins between least and greatest value; the last bin is closed."""
    known = calibration.filter(F.col(column).isNotNull() & ~F.isnan(column))
    known = materialize(known.select(column), "distances")
    ends = known.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        raise ValueError("no distance to count")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = calibration.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
