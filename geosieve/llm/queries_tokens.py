"""Query of the token counts of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.llm.resync import token_counts
from geosieve.llm.tables import read

LIMIT = 512  # tokens


def op11_token_counts(spark, folder):
    import public_tokenizers

    counts = token_counts(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


# Byte-pair encoding has no SQL; it is tested against the library's encoding of whole texts.
QUERIES = {"op11_token_counts": op11_token_counts}
ORACLES: dict[str, str] = {}
