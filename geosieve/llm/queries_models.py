"""Queries of language identification and document quality over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.llm.langid import identify
from geosieve.llm.quality import score_quality
from geosieve.llm.tables import read


def remainder(column: str, parts: int):
    return F.crc32(F.col(column).cast("string")) % parts


def op4_language_id(spark, folder):
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    found = identify(read(spark, folder, "documents"), F.col("doc_id").isNotNull() & ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op9_quality(spark, folder):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    found = score_quality(docs, docs.filter(~held), labels.filter(~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


# Learned models have no SQL; they are tested by brute force and held-out accuracy.
QUERIES = {"op4_language_id": op4_language_id, "op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
