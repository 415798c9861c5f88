"""The site catalogue: preparation from raw exports, cleaning, exploration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosieve.functions import geo, text
from geosieve.operators import checks
from geosieve.operators.spread import fits_broadcast, materialize_with

RAW_NEEDED = [
    "SUP_ID", "STA_NM_ANFR", "NAT_ID", "COM_CD_INSEE",
    "COR_NB_DG_LAT", "COR_NB_MN_LAT", "COR_NB_SC_LAT", "COR_CD_NS_LAT",
    "COR_NB_DG_LON", "COR_NB_MN_LON", "COR_NB_SC_LON", "COR_CD_EW_LON",
]
# The columns that describe one physical site.
PHYSICAL = [
    "NAT_ID", "COR_NB_DG_LAT", "COR_NB_MN_LAT", "COR_NB_SC_LAT", "COR_CD_NS_LAT",
    "COR_NB_DG_LON", "COR_NB_MN_LON", "COR_NB_SC_LON", "COR_CD_EW_LON",
    "SUP_NM_HAUT", "COM_CD_INSEE",
]
CATALOGUE = [
    "SUP_ID", "STA_NM_ANFR", "NB_STATIONS_ANFR", "NAT_ID", "NAT_LB_NOM",
    "latitude", "longitude", "SUP_NM_HAUT", "ADR_LB_LIEU", "ADR_LB_ADD1",
    "ADR_NM_CP", "COM_CD_INSEE",
]
# Natures whose sites cannot be seen from the air.
UNDERGROUND = ["Tunnel", "Intérieur sous-terrain", "Intérieur galerie"]
NOT_GIVEN = "Non renseigné"


def project_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that the table has, in list order."""
    present = {c.lower() for c in df.columns}
    return df.select(*[c for c in columns if c.lower() in present])


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key. The rank filter is applied before the shuffle too."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(window)).filter("_first = 1").drop("_first")


def department(df: DataFrame, code: str) -> DataFrame:
    """Sites whose municipality code begins with the department's code."""
    return df.filter(F.col("COM_CD_INSEE").startswith(str(code)))


def station_counts(raw: DataFrame) -> DataFrame:
    """Number of different stations per site; null stations do not count."""
    return raw.groupBy("SUP_ID").agg(F.count_distinct("STA_NM_ANFR").alias("NB_STATIONS_ANFR"))


def exclude_natures(df: DataFrame, natures: list[str] | None = None) -> DataFrame:
    """Drop the natures; a site without a nature stays."""
    natures = UNDERGROUND if natures is None else natures
    return df.filter(F.coalesce(~F.col("NAT_LB_NOM").isin(*natures), F.lit(True)))


def with_natures(sites: DataFrame, natures: DataFrame, *, check: bool = True) -> DataFrame:
    """Add the nature's name. The dimension must have unique ids, and with ``check``
    every site must find its nature."""
    checks.require_columns(natures, ["NAT_ID", "NAT_LB_NOM"])
    names = natures.select(F.col("NAT_ID").cast("int").alias("NAT_ID"), "NAT_LB_NOM")
    if not checks.duplicated_keys(names, "NAT_ID").isEmpty():
        raise ValueError("duplicated NAT_ID in the nature table")
    if fits_broadcast(names):
        names = F.broadcast(names)
    numbers = text.to_number("NAT_ID").cast("int")
    joined = sites.withColumn("NAT_ID", numbers).join(names, "NAT_ID", "left")
    if check:
        checks.require_clean(joined, {"nature not found": F.col("NAT_LB_NOM").isNull()})
    return joined


def with_decimal_position(df: DataFrame) -> DataFrame:
    parts = {c: text.to_number(c) for c in PHYSICAL if c.startswith("COR_NB")}
    return df.withColumns(parts).withColumns({
        "latitude": geo.dms_to_decimal(
            "COR_NB_DG_LAT", "COR_NB_MN_LAT", "COR_NB_SC_LAT", "COR_CD_NS_LAT"),
        "longitude": geo.dms_to_decimal(
            "COR_NB_DG_LON", "COR_NB_MN_LON", "COR_NB_SC_LON", "COR_CD_EW_LON"),
    })


def prepare_reference(
    raw: DataFrame, natures: DataFrame, department_code: str, order: list[Column] | None = None
) -> DataFrame:
    """Raw exports of one department to a catalogue of physical sites.

    ``order`` gives the input order for the row kept per site; readers add
    ``_row`` for it.
    """
    checks.require_columns(raw, RAW_NEEDED)
    order = order or [F.col("_row").asc()]
    # Checked several times below, so the department's rows are parsed once.
    rows, seen = materialize_with(department(raw, department_code), "department")
    if not seen["rows"]:
        raise ValueError(f"no site in department {department_code}")
    wrong = checks.inconsistent_ids(
        rows, "SUP_ID", PHYSICAL, [c for c in PHYSICAL if c == "NAT_ID" or c.startswith("COR_NB")]
    ).head()
    if wrong:
        raise ValueError(f"SUP_ID {wrong['SUP_ID']} is inconsistent in {wrong['columns']}")
    sites = first_per_key(rows, "SUP_ID", order).join(station_counts(rows), "SUP_ID", "left")
    sites = with_decimal_position(sites)
    checks.require_clean(sites, {
        **checks.bad_direction(), "coordinates": checks.bad_coordinates(),
    })
    return project_existing(with_natures(sites, natures), CATALOGUE)


def clean_sites(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Numeric coordinates in range and one row per site; fails when none is left."""
    checks.require_columns(df, ["SUP_ID", "latitude", "longitude"])
    order = order or [F.col("_row").asc()]
    sites = df.withColumns(text.numbers(df, ["latitude", "longitude"]))
    sites = first_per_key(sites.filter(geo.valid_latlon("latitude", "longitude")), "SUP_ID", order)
    if sites.isEmpty():
        raise ValueError("the site catalogue has no valid site")
    return sites


def harmonise(df: DataFrame) -> DataFrame:
    """One shape for decimal and DMS catalogues: numeric position, TYPE, text ids."""
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns})
    columns = set(df.columns)
    if {"latitude", "longitude"} <= columns:
        df = df.withColumns({c: text.to_number_comma(c) for c in ("latitude", "longitude")})
    else:
        checks.require_columns(df, [c for c in RAW_NEEDED if c.startswith("COR")])
        lat = [text.to_number_comma(f"COR_NB_{p}_LAT") for p in ("DG", "MN", "SC")]
        lon = [text.to_number_comma(f"COR_NB_{p}_LON") for p in ("DG", "MN", "SC")]
        df = df.withColumns({
            "latitude": geo.dms_to_decimal(*lat, F.coalesce("COR_CD_NS_LAT", F.lit(""))),
            "longitude": geo.dms_to_decimal(*lon, F.coalesce("COR_CD_EW_LON", F.lit(""))),
        })
    if "TYPE" not in columns:
        kind = F.col("NAT_LB_NOM") if "NAT_LB_NOM" in columns else F.lit(NOT_GIVEN)
        df = df.withColumn("TYPE", kind)
    shown = ["SUP_ID", "STA_NM_ANFR", "SUP_NM_HAUT", "ADR_LB_LIEU", "ADR_NM_CP", "COM_CD_INSEE"]
    missing = {c: F.lit(None).cast("string") for c in shown if c not in columns}
    if missing:
        df = df.withColumns(missing)
    return df.withColumn("SUP_ID", text.clean_id("SUP_ID"))


def of_types(df: DataFrame, types: list[str]) -> DataFrame:
    return df.filter(F.col("TYPE").isin(*types))


def search_id(df: DataFrame, pattern: str) -> DataFrame:
    """Sites whose id contains the pattern (a regular expression), in any case."""
    if not pattern:
        return df
    return df.filter(F.col("SUP_ID").cast("string").rlike("(?i)" + pattern))


def kpis(df: DataFrame, types: list[str] | None = None, pattern: str = "") -> DataFrame:
    """Row, type and valid-position counts of the catalogue and of a selection."""
    chosen = F.lit(True)
    if types is not None:
        chosen = F.coalesce(F.col("TYPE").isin(*types), F.lit(False))
    if pattern:
        match = F.col("SUP_ID").cast("string").rlike("(?i)" + pattern)
        chosen = chosen & F.coalesce(match, F.lit(False))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    # One row per type first: then counting types needs no second distinct pass.
    by_type = df.groupBy("TYPE").agg(
        F.count(F.lit(1)).alias("sites"), F.count(F.when(located, 1)).alias("located"),
        F.count(F.when(chosen, 1)).alias("selected"),
        F.count(F.when(chosen & located, 1)).alias("selected_located"),
    )
    names = ["sites", "located", "selected", "selected_located"]
    return by_type.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.count("TYPE").alias("types"),
        F.count(F.when(F.col("selected") > 0, F.col("TYPE"))).alias("selected_types"),
    )


def type_counts(df: DataFrame, column: str = "TYPE") -> DataFrame:
    """Rows per type, most first, with the share of all typed rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One row per type by now, so the total is over the short list.
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), column)


def top_natures(df: DataFrame, limit: int = 10) -> DataFrame:
    named = F.coalesce("NAT_LB_NOM", F.lit(NOT_GIVEN)).alias("NAT_LB_NOM")
    counts = df.groupBy(named).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "NAT_LB_NOM").limit(limit)
