import pytest
from pyspark.sql import functions as F

from geosieve.operators import catalogue as cat
from geosieve.operators import checks
from geosieve.sources import readers

HEADER = ("SUP_ID;STA_NM_ANFR;NAT_ID;COR_NB_DG_LAT;COR_NB_MN_LAT;COR_NB_SC_LAT;COR_CD_NS_LAT;"
          "COR_NB_DG_LON;COR_NB_MN_LON;COR_NB_SC_LON;COR_CD_EW_LON;SUP_NM_HAUT;ADR_LB_LIEU;COM_CD_INSEE")
ROWS = [
    "41;K1;23;44;30;36;N;5;15;0;E;18;;26005",
    "41;K2;23;44;30;36;N;5;15;0;E;18;;26005",
    "41;;023;44;30.0;36;N;5;15;0;E;18;;26005",
    "10;K3;7;44;45;0; n ;0;30;0;w;7,9;rue;26111",
    "63;K4;7;43;6;0;N;4;30;0;E;51;;84007",
]


def write(folder, rows, natures="NAT_ID;NAT_LB_NOM\n23;Tour hertzienne\n7;Mât\n", encoding="utf-8"):
    (folder / "support.txt").write_text("\n".join([HEADER, *rows]) + "\n", encoding=encoding)
    (folder / "nature.txt").write_text(natures, encoding=encoding)
    return str(folder / "support.txt"), str(folder / "nature.txt")


def prepare(spark, tmp_path, rows, code="26", encoding="utf-8", **kw):
    support, nature = write(tmp_path, rows, encoding=encoding, **kw)
    return cat.prepare_reference(
        readers.read_semicolon(spark, support), readers.read_semicolon(spark, nature), code)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_prepare(spark, tmp_path, encoding):
    rows = {r.SUP_ID: r for r in prepare(spark, tmp_path, ROWS, encoding=encoding).collect()}
    assert set(rows) == {"41", "10"}
    first, ten = rows["41"], rows["10"]
    assert (first.NB_STATIONS_ANFR, first.STA_NM_ANFR, first.NAT_LB_NOM) == (2, "K1", "Tour hertzienne")
    assert first.latitude == pytest.approx(44.51) and first.longitude == pytest.approx(5.25)
    assert ten.longitude == pytest.approx(-0.5) and ten.SUP_NM_HAUT == "7,9"


@pytest.mark.parametrize("row, message", [
    ("41;K9;23;44;30;37;N;5;15;0;E;18;;26005", "inconsistent"),
    ("41;K9;23;44;30;36;N;5;15;0;E;;;26005", "inconsistent"),
    ("77;K9;23;44;30;36;X;5;15;0;E;18;;26005", "direction"),
    ("77;K9;23;98;30;36;N;5;15;0;E;18;;26005", "coordinates"),
    ("77;K9;23;abc;30;36;N;5;15;0;E;18;;26005", "coordinates"),
    ("77;K9;99;44;30;36;N;5;15;0;E;18;;26005", "nature"),
])
def test_prepare_rejects(spark, tmp_path, row, message):
    with pytest.raises(ValueError, match=message):
        prepare(spark, tmp_path, [*ROWS, row])


def test_prepare_rejects_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="department"):
        prepare(spark, tmp_path, ROWS, code="13")
    with pytest.raises(ValueError, match="duplicated"):
        prepare(spark, tmp_path, ROWS, natures="NAT_ID;NAT_LB_NOM\n23;a\n23;b\n7;c\n")
    with pytest.raises(ValueError, match=r"\['SUP_ID', 'latitude'\]"):
        checks.require_columns(spark.range(1).withColumn("longitude", F.lit(1.0)),
                               ["longitude", "latitude", "SUP_ID"])


def test_clean_sites_keeps_the_first_valid_row(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text("SUP_ID,latitude,longitude,name\n007,95,2,bad\n007,48,2,first\n007,49,2,second\n"
                    "8,x,2,bad\n9,48.5,-180,edge\n")
    rows = cat.clean_sites(readers.read_csv(spark, str(path), order=True)).collect()
    assert {(r.SUP_ID, r.name) for r in rows} == {("007", "first"), ("9", "edge")}
    with pytest.raises(ValueError):
        cat.clean_sites(readers.read_csv(spark, str(path), order=True).filter("SUP_ID = '8'"))


def test_first_per_key_limits_before_the_shuffle(spark):
    plan = cat.first_per_key(spark.range(10).selectExpr("id", "id % 3 as k"), "k", [F.col("id")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_null_nature_is_not_excluded(spark):
    df = spark.createDataFrame([("Tunnel",), (None,), ("Mât",)], "NAT_LB_NOM string")
    assert {r[0] for r in cat.exclude_natures(df).collect()} == {None, "Mât"}


def test_harmonise_both_shapes(spark):
    plain = spark.createDataFrame([("12.0", "48,5", "2.25", "Mât")], "SUP_ID string, ` latitude ` string, longitude string, NAT_LB_NOM string")
    row = cat.harmonise(plain).first()
    assert (row.SUP_ID, row.latitude, row.longitude, row.TYPE, row.ADR_NM_CP) == ("12", 48.5, 2.25, "Mât", None)
    names = ("COR_NB_DG_LAT COR_NB_MN_LAT COR_NB_SC_LAT COR_CD_NS_LAT "
             "COR_NB_DG_LON COR_NB_MN_LON COR_NB_SC_LON COR_CD_EW_LON").split()
    dms = spark.createDataFrame([("48", "30", "0", "s", "2", "15", "0", None)], ", ".join(f"{n} string" for n in names))
    row = cat.harmonise(dms.withColumn("SUP_ID", F.lit("1"))).first()
    assert (row.latitude, row.longitude, row.TYPE) == (-48.5, 2.25, "Non renseigné")


def test_exploration(spark):
    rows = [("A1", "Mât", 48.0, 2.0), ("a2", "Mât", None, 2.0), ("b3", None, 48.0, 2.0), ("b4", "Tour", 48.0, 2.0)]
    df = spark.createDataFrame(rows, "SUP_ID string, TYPE string, latitude double, longitude double")
    assert cat.search_id(df, "A").count() == 2 and cat.search_id(df, "").count() == 4
    k = cat.kpis(df, ["Mât"], "a").first()
    assert (k.sites, k.types, k.located, k.selected, k.selected_located, k.selected_types) == (4, 2, 3, 2, 1, 1)
    counts = cat.type_counts(df).collect()
    assert [(r.TYPE, r.n) for r in counts] == [("Mât", 2), ("Tour", 1)] and counts[0].share == pytest.approx(2 / 3)


def test_set_difference_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert tuple(checks.same_rows(a, b).first()) == (2, 1)
