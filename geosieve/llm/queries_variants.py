"""Query of the spelling variants over all documents."""

from __future__ import annotations

from geosieve.llm.tables import read
from geosieve.llm.variants import spelling_variants


def op13_spelling_variants(spark, folder):
    return spelling_variants(read(spark, folder, "documents"))


# The pairs of all words are too many for SQL; tests compare with brute force on a small fixture.
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES: dict[str, str] = {}
