"""Query of personal data in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.llm.private import KINDS, as_text, find_private
from geosieve.llm.tables import read


def op8_private_data(spark, folder):
    found = find_private(read(spark, folder, "documents"))
    def count(i, kind):
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{kind}")

    counts = [count(i, k) for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


# The added spans come from a learned model, so there is no SQL; tested against plain patterns and planted spans.
QUERIES = {"op8_private_data": op8_private_data}
ORACLES: dict[str, str] = {}
