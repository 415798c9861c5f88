"""Cleaning of text columns as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A number as the source files write it; rejects Java-only forms such as '1d'.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


def to_number(name: str) -> Column:
    """Double, or null where the text is not a number; NaN becomes null."""
    text = F.trim(F.col(name).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def numbers(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """``to_number`` for text columns; numeric ones only lose their NaN values."""
    types = {name.lower(): kind for name, kind in df.dtypes}
    missing = F.lit(None).cast("double")
    return {
        c: to_number(c) if types[c.lower()] == "string" else F.nanvl(F.col(c).cast("double"), missing)
        for c in columns
    }


def to_number_comma(name: str) -> Column:
    """As ``to_number`` but also reads a decimal comma ('7,9' is 7.9)."""
    text = F.trim(F.replace(F.col(name).cast("string"), F.lit(","), F.lit(".")))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clean_id(name: str) -> Column:
    """Identifier as text without the '.0' a float column leaves behind."""
    return F.trim(F.regexp_replace(F.col(name).cast("string"), r"\.0$", ""))


def clean_status(name: str = "status") -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def is_true(name: str) -> Column:
    """1, true, yes and oui in any case are true; all else, null too, is false."""
    text = F.lower(F.trim(F.col(name).cast("string")))
    return F.coalesce(text.isin("1", "true", "yes", "oui"), F.lit(False))


def relabel(name: str, labels: dict[str, str]) -> Column:
    """Replace the values found in ``labels``; keep all others."""
    if not labels:
        return F.col(name)
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[F.col(name)], F.col(name))


def file_stem(name: str | Column) -> Column:
    """File name without folders and without its last extension."""
    path = F.col(name) if isinstance(name, str) else name
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(base, r"(.)\.[^.]*$", "$1"))
