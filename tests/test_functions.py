import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geosieve.config import Imagery
from geosieve.functions import boxes, geo, text

WORLD = Imagery().world_size


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(43.2951, -0.37), (-33.0, 179.999), (0.0, -180.0)], "lat double, lon double")
    back = df.select("lat", "lon", geo.world_lat(geo.world_y("lat", WORLD), WORLD).alias("lat2"),
                     geo.world_lon(geo.world_x("lon", WORLD), WORLD).alias("lon2"))
    for r in back.collect():
        assert r.lat2 == pytest.approx(r.lat, abs=1e-8) and r.lon2 == pytest.approx(r.lon, abs=1e-8)


def test_mercator_clamps_near_the_pole(spark):
    row = spark.range(1).select(geo.world_y(F.lit(89.0), WORLD).alias("a"),
                                geo.world_y(F.lit(85.05112878), WORLD).alias("b")).first()
    assert row.a == row.b and abs(row.a) < 1.0


def test_haversine(spark):
    row = spark.range(1).select(
        geo.haversine_m(12.25, 71.5, 12.25, 71.5).alias("same"),
        geo.haversine_m(0.0, 0.0, 0.0, 180.0).alias("half"),
        geo.haversine_split_m(0.0, 0.0, 0.0, 180.0).alias("older")).first()
    assert row.same == 0.0
    assert row.half == pytest.approx(math.pi * geo.EARTH_RADIUS_M)
    assert row.older == pytest.approx(math.pi * geo.SPLIT_RADIUS_M)


def test_dms_and_directions(spark):
    df = spark.createDataFrame([(48, 48, 0, "N"), (48, 48, 0, " s "), (2, 8, 0, "W"), (2, 8, 0, "E")],
                               "d int, m int, s int, dir string")
    got = [r[0] for r in df.select(geo.dms_to_decimal("d", "m", "s", "dir")).collect()]
    assert got == pytest.approx([48.8, -48.8, -2.1333333333, 2.1333333333])


def test_map_link_has_longitude_first(spark):
    df = spark.createDataFrame([(-17.533402, 149.566918)], "latitude double, longitude double")
    url = df.select(geo.map_link("https://maps.example/%20/", "latitude", "longitude")).first()[0]
    assert url == "https://maps.example/%20/149.566918/-17.533402"


def test_out_of_range_coordinates_fail(spark):
    df = spark.createDataFrame([(91.0, 2.0)], "latitude double, longitude double")
    assert df.select(geo.valid_latlon("latitude", "longitude")).first()[0] is False
    with pytest.raises(PySparkException):
        df.select(geo.map_link("x", "latitude", "longitude")).collect()


def test_numbers_from_text(spark):
    raw = ["7", " 3.5 ", "1d", "7,9", "abc", "", None, "NaN", "1e3", "-.5", "inf"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, raw string")
    got = [r.v for r in df.select("i", text.to_number("raw").alias("v")).orderBy("i").collect()]
    assert got == [7.0, 3.5, None, None, None, None, None, None, 1000.0, -0.5, math.inf]
    comma = [r.v for r in df.select("i", text.to_number_comma("raw").alias("v")).orderBy("i").collect()]
    assert comma[3] == 7.9 and comma[2] is None
    nan = spark.createDataFrame([(float("nan"),)], "raw double").select(text.to_number("raw")).first()[0]
    assert nan is None


def test_text_cleaning(spark):
    df = spark.createDataFrame([("12.0", " Oui ", "in/ab.c.jpg"), (" 7 ", None, ".hidden"), ("1.05", "0", "x")],
                               "id string, flag string, file string")
    got = df.select(text.clean_id("id"), text.is_true("flag"), text.file_stem("file")).collect()
    assert [tuple(r) for r in got] == [("12", True, "ab.c"), ("7", False, ".hidden"), ("1.05", False, "x")]


def test_label_line_rounds_ties_to_even(spark):
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0)], "x1 double, y1 double, x2 double, y2 double")
    # centre y is 1/1024 = 0.0009765625, width 4/1024, centre x 2/1024 = 0.001953125
    line = df.select(boxes.label_line(boxes.normalised(1024.0))).first()[0]
    assert line == "0 0.00195312 0.00097656 0.00390625 0.00195312\n"


def test_box_checks_and_iou(spark):
    rows = [(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 5.0, 9.0), (None, 0.0, 1.0, 1.0), (0.0, 0.0, 2000.0, 5.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    assert [r[0] for r in df.select(boxes.is_inside(1024)).collect()] == [True, False, False, False]
    a = {c: F.col(c) for c in boxes.CORNERS}
    b = {c: F.lit(v) for c, v in zip(boxes.CORNERS, (5.0, 0.0, 15.0, 10.0))}
    assert df.select(boxes.iou(a, b)).first()[0] == pytest.approx(1 / 3)
