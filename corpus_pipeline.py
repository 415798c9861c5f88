"""The corpus pipeline: five stages over whole documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and gets what the stage before kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosieve.llm.decontaminate import contamination
from geosieve.llm.langid import identify
from geosieve.llm.minhash import near_duplicates
from geosieve.llm.pieces import round_trip
from geosieve.llm.private import mask
from geosieve.llm.tables import read, written


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a text key, so that decisions find their rows again."""
    return docs.withColumn("_key", F.xxhash64("text"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._key") == F.col(f"{b}._key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or too unlike every learned language."""
    train = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = docs.withColumn("_row", F.struct("doc_id", F.xxhash64("text")))
    found = identify(rows, train, "_row").filter("rejected").select(F.col("_row").alias("_bad")).distinct()
    return rows.join(found, F.col("_row").eqNullSafe(F.col("_bad")), "left_anti").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one row of each group of near copies: that of the least id, a null id last.

    Rows are told apart by id and text, so repeated and null ids are judged by their own texts, and of
    rows equal in both one stays. Texts without words are copies of nothing and all stay.
    """
    rows = _numbered(docs).withColumn("_row", F.xxhash64("doc_id", "text"))
    pairs = rows.filter(F.col("text").rlike(r"[^ \t-\r]")).groupBy("_row", "doc_id", "_key").agg(F.count(F.lit(1)).alias("_n"))
    found = near_duplicates(rows, "_row", shingle=5, num=80, den=100).select("_row", "component_id").distinct()
    placed = written(pairs.join(found, "_row"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "_row")
    first = placed.groupBy("component_id").agg(F.min(order).alias("least")).select("least.doc_id", "least._key", F.lit(True).alias("_first"))
    marks = written(
        placed.alias("a").join(first.alias("b"), _same("a", "b"), "left").filter("_first is null or _n > 1")
        .select("a.doc_id", "a._key", F.coalesce("_first", F.lit(False)).alias("_first")), "copies")
    alone = rows.alias("a").join(marks.alias("b"), _same("a", "b"), "left_anti").select(*docs.columns)
    repeated = rows.alias("a").join(marks.filter("_first").alias("b"), _same("a", "b"), "left_semi")
    one = repeated.groupBy("doc_id", "_key").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return alone.union(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a twentieth or more."""
    found = contamination(docs, read(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select("doc_id", F.col("text_key").alias("_key")).distinct()
    return _numbered(docs).alias("a").join(bad.alias("b"), _same("a", "b"), "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; n_chars follows."""
    return mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them."""
    return round_trip(docs)


STAGES = [
    ("language_id", language), ("minhash_dedup", near_copies), ("decontaminate", decontaminate),
    ("private_data", private_data), ("sentencepiece", tokens),
]

# Learned models and Viterbi have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
