"""Matching image files to known sites and judging detections near them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import boxes, text
from geosieve.operators.spread import skew_join

# The comparison's status texts.
NO_REFERENCE = "Référence ANFR introuvable"
NOT_DETECTED = "🔴 Support ANFR non détecté par l'IA"
NEAR_SITE = "🟢 Détection IA proche du support ANFR"
FAR_FROM_SITE = "🟠 Détection IA éloignée du support ANFR"


def match_images(images: DataFrame, sites: DataFrame, unique: str, name: str = "filename") -> DataFrame:
    """Add the site an image belongs to (null when none).

    The whole stem counts first, then the runs of digits in it from left to right.
    ``sites`` has one row per SUP_ID.
    """
    stem = text.file_stem(name)
    tokens = F.concat(F.array(stem), F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1)))
    spread = images.select(unique, F.posexplode(tokens).alias("_pos", "_token"))
    # A token repeated in one name matters only where it stands first.
    spread = spread.groupBy(unique, "_token").agg(F.min("_pos").alias("_pos"))
    ids = sites.select(F.trim(F.col("SUP_ID").cast("string")).alias("_token")).distinct()
    found = skew_join(spread, ids, ["_token"], spread=[unique])
    first = found.groupBy(unique).agg(F.min_by("_token", "_pos").alias("SUP_ID"))
    return images.join(first, unique, "left")


def local_offsets(
    detections: DataFrame, ground_m: float = 100.0, width: float = 1024.0, height: float = 1024.0
) -> DataFrame:
    """Rounded box table with the distance from the image centre in metres."""
    cx, cy = boxes.center()
    distance = boxes.offset_from_center_m(cx, cy, F.lit(width), F.lit(height), ground_m)
    shown = {
        "confiance": F.bround("confidence", 4),
        **{c: F.bround(F.col(c).cast("double"), 1) for c in boxes.CORNERS},
        "centre_x": F.bround(cx, 1), "centre_y": F.bround(cy, 1),
        "distance_centre_m": F.bround(distance, 2),
    }
    return detections.withColumns(shown)


def compare_detections(
    images: DataFrame, detections: DataFrame, radius_m: float, unique: str = "pred_id"
) -> DataFrame:
    """Status of each detection of each image against the image's site.

    ``images``: image and SUP_ID (null without a known site), one row per image.
    An image with a site but no detection gets one row saying so.
    """
    sites = images.select("image", "SUP_ID", F.lit(True).alias("_listed"))
    joined = skew_join(detections, sites, ["image"], "left", spread=[unique])
    near = F.col("distance_centre_m") <= radius_m
    known = F.col("SUP_ID").isNotNull()
    judged = joined.drop("_listed").withColumns({
        "correspondance": known & F.coalesce(near, F.lit(False)),
        "statut": F.when(~known, NO_REFERENCE).when(near, NEAR_SITE).otherwise(FAR_FROM_SITE),
    })
    seen = detections.select("image").distinct()
    silent = images.filter("SUP_ID is not null").join(seen, "image", "left_anti")
    silent = silent.select("image", "SUP_ID").withColumns({
        "correspondance": F.lit(False), "statut": F.lit(NOT_DETECTED),
    })
    return judged.unionByName(silent, allowMissingColumns=True)


def detection_kpis(detections: DataFrame, radius_m: float) -> DataFrame:
    """Detections, best confidence and how many lie within the radius, per image."""
    near = F.when(F.col("distance_centre_m") <= radius_m, 1)
    return detections.groupBy("image").agg(
        F.count(F.lit(1)).alias("detections"), F.max("confiance").alias("confidence_max"),
        F.count(near).alias("near_site"),
    )
