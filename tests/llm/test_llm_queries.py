"""Queries against their SQL, and learned ones on held-out rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from check_queries import rows_of
from geosieve.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cursor = db.execute(registry.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_languages_of_held_out_documents(spark, db):
    truth = dict(db.execute("select doc_id, lang from documents").fetchall())
    rows = registry.QUERIES["op4_language_id"](spark, FOLDER).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_held_out_documents(spark, db):
    truth = dict(db.execute("select doc_id, quality from labels").fetchall())
    rows = registry.QUERIES["op9_quality"](spark, FOLDER).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
