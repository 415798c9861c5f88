"""Query of the main-text extraction over all pages."""

from __future__ import annotations

from geosieve.llm.html import main_text
from geosieve.llm.tables import read


def op7_main_text(spark, folder):
    return main_text(read(spark, folder, "pages"))


# A tree over markup has no SQL; it is tested against pages with known articles.
QUERIES = {"op7_main_text": op7_main_text}
ORACLES: dict[str, str] = {}
