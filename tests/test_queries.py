"""The driver's contract, and the quick queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "coerce_numeric", "id_consistency", "layer_class", "schema_harmonise", "src_semicolon_encodings",
    "sink_geojson", "dms_to_decimal", "geolocate_box", "map_link", "bbox_to_normalised", "centred_patch",
    "grid_patches", "patch_join", "nearest_site", "station_count_join", "detection_compare",
    "annotation_coverage", "threshold_sweep", "error_summary", "seeded_sample", "set_equality", "type_filter", "nature_exclusion", "catalogue_kpis", "cluster_members",
    "dedup_incomplete",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def test_every_query_of_the_library_has_sql():
    own = {n for n in set(contract.queries()) - set(contract.oracle_sql()) if n not in contract.MORE}
    assert own == set()


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    cursor = db.execute(contract.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 837 and "candidate_id" in df.columns


def test_latitudes_on_a_tie_are_rounded_as_in_sql(spark, tmp_path):
    # The centres of these boxes of Z72 lie at 48.4075, which exp and atan miss by a last digit.
    db = duckdb.connect()
    for name in ("customer", "orders", "nation"):
        db.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
        db.execute(f"copy (select * from {name}) to '{tmp_path}/{name}.parquet' (format parquet)")
    ids = "(182622), (547122), (404622), (569622), (72), (147)"
    rows = f"select * replace (cast(v.id as bigint) as event_id) from '{FOLDER}/events.parquet' e join (values {ids}) v(id) on e.event_id = v.id % 97"
    db.execute(f"create table events as select * exclude (id) from ({rows})")
    db.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = contract.queries()["dedup_incomplete"](spark, str(tmp_path))
    cursor = db.execute(contract.oracle_sql()["dedup_incomplete"])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
