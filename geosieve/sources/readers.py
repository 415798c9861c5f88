"""Readers for the source files, all without schema inference over the data."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosieve.functions.text import to_number
from geosieve.operators.spread import materialize
from geosieve.sources.records import file_lines, probe, records

BOM = "﻿"
# Numeric columns of the source tables; all others stay text.
DOUBLES = {
    "latitude", "longitude", "confidence", "x1", "y1", "x2", "y2", "center_x", "center_y",
    "nearest_ANFR_latitude", "nearest_ANFR_longitude", "nearest_ANFR_distance_m",
    "cluster_max_confidence", "cluster_max_distance_anfr_m", "center_latitude",
    "center_longitude", "north", "south", "west", "east", "best_iou",
    "x_center_norm", "y_center_norm", "width_norm", "height_norm",
}
LONGS = {
    "detection_id", "row", "col", "zoom", "world_left", "world_top", "world_right",
    "world_bottom", "NB_STATIONS_ANFR", "NAT_ID", "detections_in_cluster", "supports_500m",
    "nb_predictions", "TP", "FP", "FN", "class_id",
}


# Words that stand for a missing value.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The header line of a file or of the first file of a folder."""
    lines = file_lines(spark, path).select("line").head(1)
    return bytes(lines[0][0]).decode(encoding).lstrip(BOM) if lines else ""


def with_row_order(df: DataFrame) -> DataFrame:
    """Add ``_row``, which orders rows as they stand in their file."""
    place = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return df.select("*", place.alias("_row"))


def _columns(line: str, sep: str) -> list[str]:
    return [c.strip().strip('"').strip() for c in line.rstrip("\r\n").split(sep)]


def _present(columns: list[str], null_words: tuple[str, ...]) -> dict[str, Column]:
    """The text columns with the words for missing values as nulls."""
    return {c: F.when(~F.col(f"`{c}`").isin(*null_words), F.col(f"`{c}`")) for c in columns} if null_words else {}


def _as_text(
    spark: SparkSession, path: str, sep: str, *, encoding: str | None = "UTF-8", multi_line: bool | None = None,
    null_words: tuple[str, ...] = NULL_WORDS, order: bool = False, tags: dict[str, Column] | None = None,
) -> DataFrame:
    """All columns of the header as text. Without an encoding, UTF-8 if every line is, else Latin-1.

    One scan tells the encoding and whether records span lines; then the file is read once, in
    splits in either case.
    """
    lines = file_lines(spark, path)
    splits = None
    if multi_line is not False or encoding is None:
        splits, utf8, breaks = probe(lines, sep)
        encoding = encoding or ("UTF-8" if utf8 else "ISO-8859-1")
        multi_line = breaks if multi_line is None else multi_line
    columns = _columns(first_line(spark, path, encoding), sep)
    if multi_line:
        found = records(lines, splits, sep).filter("start > 0 or line > 0")
        text = F.regexp_replace(F.decode("record", encoding), "\\r\\z", "")
        schema = ", ".join(f"c{i} string" for i in range(len(columns)))
        options = {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}
        df = found.withColumn("text", text).filter(F.trim("text") != "")
        df = df.select(F.col("path").alias("_path"), F.struct("path", "start", "line").alias("_row"),
                       F.from_csv("text", schema, options).alias("_values"))
        df = df.select("_path", "_row", *[F.col(f"_values.c{i}").alias(c) for i, c in enumerate(columns)])
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = spark.read.schema(schema).option("header", True).option("sep", sep)
        reader = reader.option("encoding", encoding).option("enforceSchema", True)
        df = reader.option("escape", '"').csv(path)
        if order or tags:
            df = with_row_order(df).withColumn("_path", F.col("_row.path"))
    for name, value in (tags or {}).items():
        df = df.withColumn(name, value)
    shown = [*columns, *(tags or {}), *(["_row"] if order else [])]
    return df.select(*[F.col(f"`{c}`") for c in shown]).withColumns(_present(columns, null_words))


def read_csv(
    spark: SparkSession, path: str, *, order: bool = False, multi_line: bool | None = None,
    null_words: tuple[str, ...] = NULL_WORDS,
) -> DataFrame:
    """Comma CSV with a header; ids stay text and known numeric columns are numbers.

    Records may span lines inside quotes; ``multi_line`` says so or not, and without it a scan tells. Cells that
    are one of ``null_words`` are null in every column, text or number.
    """
    df = _as_text(spark, path, ",", multi_line=multi_line, null_words=null_words, order=order)
    columns = [c for c in df.columns if c != "_row"]
    numbers = {c: to_number(c) for c in columns if c in DOUBLES}
    numbers |= {c: to_number(c).cast("long") for c in columns if c in LONGS}
    return df.withColumns(numbers) if numbers else df


def read_semicolon(
    spark: SparkSession, path: str, *, order: bool = True, multi_line: bool | None = None,
    null_words: tuple[str, ...] = NULL_WORDS,
) -> DataFrame:
    """Semicolon export in UTF-8, with or without byte order mark, or in Latin-1."""
    return _as_text(spark, path, ";", encoding=None, multi_line=multi_line, null_words=null_words, order=order)


def read_any_csv(
    spark: SparkSession, path: str, *, multi_line: bool | None = None, null_words: tuple[str, ...] = NULL_WORDS,
) -> DataFrame:
    """All-text CSV whose separator, comma or semicolon, is told from the header."""
    line = first_line(spark, path)
    sep = ";" if line.count(";") > line.count(",") else ","
    return _as_text(spark, path, sep, multi_line=multi_line, null_words=null_words)


def read_tagged(
    spark: SparkSession, paths: list[str], name: str = "source", *, multi_line: bool | None = None,
    null_words: tuple[str, ...] = NULL_WORDS,
) -> DataFrame:
    """Several CSVs as one table, columns matched by name, rows tagged by file stem."""
    if not paths:
        raise ValueError("no file given")
    frames = [read_csv(spark, p, multi_line=multi_line, null_words=null_words).withColumn(name, F.lit(PurePath(p).stem)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Threshold sweep JSON: one row per threshold."""
    schema = (
        "best_threshold double, all_thresholds array<struct<threshold:double, TP:bigint, "
        "FP:bigint, FN:bigint, precision:double, recall:double, f1:double>>"
    )
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("best_threshold", F.inline("all_thresholds"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics JSON document as one row."""
    return spark.read.option("multiLine", True).json(path)


def read_histories(
    spark: SparkSession, folder: str, glob: str = "*/results.csv", run: str = r"([^/]+)/results\.csv$",
    *, multi_line: bool | None = None,
) -> DataFrame:
    """Training histories, by default ``<folder>/<run>/results.csv``, with the run's
    name taken from the path."""
    renamed = {
        "metrics/mAP50(B)": "map50", "metrics/mAP50-95(B)": "map50_95",
        "metrics/precision(B)": "prec", "metrics/recall(B)": "rec",
    }
    path = f"{folder.rstrip('/')}/{glob}"
    name = F.url_decode(F.regexp_extract(F.col("_path"), run, 1))
    df = _as_text(spark, path, ",", multi_line=multi_line, tags={"run": name}).withColumnsRenamed(renamed)
    numbers = [c for c in df.columns if c != "run"]
    return df.withColumns({
        c: F.trim(F.col(c)).try_cast("long" if c == "epoch" else "double") for c in numbers
    })


# Endings of files that the line reader would unpack.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files of any size, digested piece by piece as their bytes pass.

    A file is read by one task in order, since a digest has an order; its bytes come as stretches between
    line feeds, so a task holds one Arrow batch. Two things the reader leaves out are tried both ways, and the length
    tells which holds: a last line feed, and a byte order mark.
    """
    def digest(batches):
        import hashlib

        import pyarrow as pa

        def send(now):
            name, size, lines, plain, marked = now
            rows = []
            for mark, state in ((0, plain), (3, marked)):
                ended = state.copy()
                ended.update(b"\n")
                rows += [(name, size + lines - 1 + mark, state.hexdigest()), (name, size + lines + mark, ended.hexdigest())]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "bytes", "sha256"])

        now = None
        for batch in batches:
            paths, lines = batch.column("path").to_pylist(), batch.column("line").to_pylist()
            at = 0
            while at < len(paths):
                stop = at
                while stop < len(paths) and paths[stop] == paths[at]:
                    stop += 1
                if now is None or now[0] != paths[at]:
                    if now is not None:
                        yield send(now)
                    now = [paths[at], 0, 0, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")]
                part = b"\n".join(lines[at:stop])
                now[1] += len(part) - (stop - at - 1)
                for state in now[3:]:
                    if now[2]:
                        state.update(b"\n")
                    state.update(part)
                now[2] += stop - at
                at = stop
        if now is not None:
            yield send(now)

    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    # Whole files, one a task: the cost of opening one fills a partition.
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(1 << 60))
        return materialize(lines.mapInArrow(digest, "path string, bytes long, sha256 string"), "digests")
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def list_files(spark: SparkSession, path: str, glob: str = "*", *, digest: bool = False) -> DataFrame:
    """Files below a folder with their sizes and, if asked, SHA-256 digests.

    Sizes come from the listing, whatever they are. Packed files (``PACKED``) are digested as one value
    each, which limits those to 2 GB; all others pass piece by piece. Spark's readers leave out empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = files.option("recursiveFileLookup", True).load(path)
    shown = ["path", F.element_at(F.split("path", "/"), -1).alias("file"), "length"]
    listed = files.select(*shown, F.col("_metadata.file_path").alias("_place"))
    if not digest:
        return listed.drop("_place")
    found = file_digests(spark, path, glob).withColumnsRenamed({"path": "_place", "bytes": "length"}).distinct()
    packed = files.filter(F.col("path").rlike(PACKED)).select(F.col("_metadata.file_path").alias("_place"), F.sha2("content", 256).alias("_whole"))
    out = listed.join(found, ["_place", "length"], "left").join(packed, "_place", "left")
    return out.select("path", "file", "length", F.coalesce("_whole", "sha256").alias("sha256"))


def check_inventory(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (file, size_bytes, sha256) against the files found."""
    joined = manifest.join(files, "file", "left")
    return joined.select(
        "file", F.col("path").isNotNull().alias("present"),
        F.coalesce(F.col("length") == F.col("size_bytes"), F.lit(False)).alias("size_ok"),
        F.coalesce(files["sha256"] == manifest["sha256"], F.lit(False)).alias("sha256_ok"),
    )
