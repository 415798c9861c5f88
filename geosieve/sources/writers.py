"""Sinks: tables, JSON documents, GeoJSON features and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.operators.spread import rank_rows


def write_csv(df: DataFrame, path: str, *, sep: str = ",", encoding: str = "UTF-8",
              partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep)
    writer = writer.option("encoding", encoding).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The run summary as JSON lines, one per zone, in as many files as its rows come from."""
    summary.write.mode("overwrite").json(path)


def feature(properties: list[str], lat: str = "latitude", lon: str = "longitude") -> Column:
    """GeoJSON point feature, longitude first."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    ))


def to_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row."""
    return df.select("*", feature(properties).alias("feature"))


def write_geojson_lines(df: DataFrame, path: str, properties: list[str]) -> None:
    """Newline-delimited GeoJSON: one feature per line, any number of files."""
    df.select(feature(properties).alias("value")).write.mode("overwrite").text(path)


def detection_documents(
    detections: DataFrame, columns: list[str], order: str,
    image_size_m: float = 100.0, pixels: tuple[int, int] | None = (1024, 1024),
    chunk: int | None = None,
) -> DataFrame:
    """JSON payload of every image's detections, in confidence order.

    One payload per image; with ``chunk`` a payload holds at most so many detections and an image
    with more gets numbered further documents, so that no image is gathered whole in one task.
    """
    numbered = rank_rows(
        detections, [F.col("confidence").desc(), F.col(order).asc()], within=["image"], name="_no"
    )
    part = (F.floor((F.col("_no") - 1) / chunk).cast("int") if chunk else F.lit(0)).alias("part")
    item = F.struct("_no", F.struct(*columns).alias("d"))
    packed = numbered.groupBy("image", part).agg(F.array_sort(F.collect_list(item)).alias("list"))
    size = F.array(*[F.lit(p) for p in pixels]) if pixels else F.lit(None).cast("array<int>")
    return packed.select("image", "part", F.to_json(F.struct(
        F.lit(float(image_size_m)).alias("image_size_meters"), size.alias("image_pixels"),
        F.transform("list", lambda x: x["d"]).alias("detections"),
    )).alias("document"))


def detection_lines(
    detections: DataFrame, columns: list[str], order: str,
    image_size_m: float = 100.0, pixels: tuple[int, int] | None = (1024, 1024),
) -> DataFrame:
    """(image, line_no, line): the lines of one JSON document per image, its detections in confidence order.

    A head, a line a detection and an end; no image is gathered, whatever its number of detections.
    """
    numbered = rank_rows(
        detections, [F.col("confidence").desc(), F.col(order).asc()], within=["image"], name="line_no")
    comma = F.when(F.col("line_no") > 1, ",").otherwise("")
    items = numbered.select("image", "line_no", F.concat(comma, F.to_json(F.struct(*columns))).alias("line"))
    size = F.array(*[F.lit(p) for p in pixels]) if pixels else F.lit(None).cast("array<int>")
    head = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"detections":['))
    images = detections.select("image").distinct().withColumn(
        "_head", F.to_json(F.struct(F.lit(float(image_size_m)).alias("image_size_meters"), size.alias("image_pixels"))))
    ends = F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), head.alias("line")),
        F.struct(F.lit(1 << 62).alias("line_no"), F.lit("]}").alias("line"))))
    return items.unionByName(images.select("image", ends.alias("e")).select("image", "e.line_no", "e.line"))


def write_detection_documents(
    detections: DataFrame, columns: list[str], order: str, path: str,
    image_size_m: float = 100.0, pixels: tuple[int, int] | None = (1024, 1024),
) -> None:
    """One JSON document per image in a folder of its own; its files in name order are the document.

    Lines are range-partitioned by image and place, so a large image is written by several tasks. For very many
    images prefer ``detection_documents``.
    """
    lines = detection_lines(detections, columns, order, image_size_m, pixels)
    placed = lines.repartitionByRange("image", "line_no").sortWithinPartitions("image", "line_no")
    placed.select("image", F.col("line").alias("value")).write.mode("overwrite").partitionBy("image").text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines as a table partitioned by split: SUP_ID, label_file, label text."""
    labels.write.mode("overwrite").partitionBy("split").parquet(path)


def write_label_files(labels: DataFrame, path: str) -> None:
    """Label lines as text, one folder per split and label file; a label without a box
    is an empty line. For very many images prefer ``write_labels``."""
    lines = labels.select("split", "label_file", F.regexp_replace("label", r"\n$", "").alias("value"))
    lines.write.mode("overwrite").partitionBy("split", "label_file").text(path)
