"""Human review of candidates and the reports drawn from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import text

REVIEWED = ["plausible", "faux_positif", "incertain"]
NOT_REVIEWED = "non_revu"
# Where a map is centred when there is nothing to show.
DEFAULT_CENTRE = (48.8, 2.1)


def join_reviews(candidates: DataFrame, reviews: DataFrame, key: list[str]) -> DataFrame:
    """Candidates with their review; one without a review is not reviewed."""
    joined = candidates.join(reviews, key, "left")
    return joined.withColumn("review_status", F.coalesce("review_status", F.lit(NOT_REVIEWED)))


def layer_class(candidates: DataFrame, final_ids: list[str] | None = None,
                id_column: str = "unique_candidate_id") -> DataFrame:
    """Map layer: final for chosen candidates, else the known status, else not reviewed."""
    status = F.trim(F.coalesce("review_status", F.lit("")))
    known = F.when(status.isin(*REVIEWED), status).otherwise(F.lit(NOT_REVIEWED))
    final = F.lit(False)
    if final_ids:
        final = final | F.coalesce(F.col(id_column).cast("string").isin(*final_ids), F.lit(False))
    if "selection_finale" in candidates.columns:
        final = final | text.is_true("selection_finale")
    return candidates.withColumn("layer", F.when(final, F.lit("final")).otherwise(known))


def status_counts(reviewed: DataFrame) -> DataFrame:
    status = F.coalesce("review_status", F.lit("")).alias("review_status")
    return reviewed.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def plausible_types(reviewed: DataFrame) -> DataFrame:
    plausible = reviewed.filter(F.col("review_status") == "plausible")
    return plausible.groupBy("support_type").agg(F.count(F.lit(1)).alias("n"))


def funnel(detections: DataFrame, far: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Rows left after each step; ``reviewed`` are the unique candidates."""
    def size(df: DataFrame, step: int, stage: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(step).alias("step"), F.lit(stage).alias("stage"), "n")

    plausible = reviewed.filter(F.col("review_status") == "plausible")
    return (
        size(detections, 1, "raw").unionByName(size(far, 2, "far"))
        .unionByName(size(reviewed, 3, "unique")).unionByName(size(plausible, 4, "plausible"))
    )


def zone_summary(
    zones: DataFrame, detections: DataFrame, far: DataFrame, reviewed: DataFrame
) -> DataFrame:
    """Per zone: raw, far and unique counts, statuses and the plausible share in percent."""
    def per_zone(df: DataFrame, **counts) -> DataFrame:
        return df.groupBy("zone_id").agg(*[v.alias(k) for k, v in counts.items()])

    one = F.count(F.lit(1))
    status = {
        s: F.count(F.when(F.col("review_status") == v, 1))
        for s, v in (("plausibles", "plausible"), ("faux_positifs", "faux_positif"),
                     ("incertains", "incertain"))
    }
    whole = (
        zones.join(per_zone(detections, detections_brutes=one), "zone_id", "left")
        .join(per_zone(far, detections_far=one), "zone_id", "left")
        .join(per_zone(reviewed, candidats_uniques=one, **status), "zone_id", "left")
    )
    names = ["detections_brutes", "detections_far", "candidats_uniques", *status]
    whole = whole.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    share = F.when(
        F.col("candidats_uniques") > 0,
        F.lit(100.0) * F.col("plausibles") / F.col("candidats_uniques"),
    )
    return whole.withColumn("taux_plausibles_pct", share)


def map_center(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """Mean position of the candidates, else of the sites, else a fixed one."""
    def means(df: DataFrame, tag: str) -> DataFrame:
        place = text.numbers(df, ["latitude", "longitude"])
        return df.agg(F.avg(place["latitude"]).alias(f"{tag}_lat"),
                      F.avg(place["longitude"]).alias(f"{tag}_lon"))

    first, second = means(candidates, "c"), means(sites, "s")
    one = first.select(
        "c_lat", "c_lon",
        second.select("s_lat").scalar().alias("s_lat"), second.select("s_lon").scalar().alias("s_lon"),
    )
    use_c = F.col("c_lat").isNotNull() & F.col("c_lon").isNotNull()
    use_s = F.col("s_lat").isNotNull() & F.col("s_lon").isNotNull()
    lat = F.when(use_c, F.col("c_lat")).when(use_s, F.col("s_lat")).otherwise(DEFAULT_CENTRE[0])
    lon = F.when(use_c, F.col("c_lon")).when(use_s, F.col("s_lon")).otherwise(DEFAULT_CENTRE[1])
    return one.select(lat.alias("latitude"), lon.alias("longitude"))


def final_selection(reviewed: DataFrame, chosen: dict[str, int], key: str = "unique_candidate_id"
                    ) -> DataFrame:
    """The few chosen candidates with their ranks."""
    if not chosen:
        return reviewed.limit(0).withColumn("rang_final", F.lit(None).cast("int"))
    pairs = [F.lit(v) for item in chosen.items() for v in item]
    rank = F.create_map(*pairs)[F.col(key)]
    return reviewed.filter(F.col(key).isin(*chosen)).withColumn("rang_final", rank)


def best_epochs(history: DataFrame) -> DataFrame:
    """The epoch with the greatest mAP50 of every run, the first one on a tie."""
    order = F.struct("map50", (-F.col("epoch")).alias("e"))
    best = history.groupBy("run").agg(
        F.max_by(F.struct("epoch", "map50", "map50_95", "prec", "rec"), order).alias("b")
    )
    return best.select("run", "b.*")


def training_curve(history: DataFrame, run: str) -> DataFrame:
    return history.filter(F.col("run") == run).select("epoch", "map50", "map50_95").orderBy("epoch")


def compare_experiments(experiments: DataFrame, split: str, labels: dict[str, str]) -> DataFrame:
    chosen = experiments.filter(F.col("evaluation_split") == split)
    return chosen.withColumn("label", text.relabel("experiment", labels)).orderBy("map50")
