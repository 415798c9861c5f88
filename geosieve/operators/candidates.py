"""From located detections to unique, ranked candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import text
from geosieve.operators.cells import CELL, Metric
from geosieve.operators.checks import require_columns
from geosieve.operators.proximity import Groups, close_groups, group_cells
from geosieve.operators.spread import materialize, rank_rows, skew_join

# Ids of a page of a cluster's list.
PAGE = 1000
NEEDED = [
    "detection_id", "zone_id", "confidence", "latitude", "longitude", "nearest_ANFR_distance_m",
]


def _zone_key(zone: str = "zone_id"):
    """The zone as a join key: a missing zone is a zone like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(zone).cast("string")), F.lit(""))


def _zone_name(key: str = "zone_id"):
    return F.when(F.col(key) != "", F.substring(key, 2, 1 << 30))


def far_filter(detections: DataFrame, min_distance_m: float = 150.0) -> DataFrame:
    """Detections at least this far from every known site; no distance means no."""
    require_columns(detections, NEEDED)
    if min_distance_m < 0:
        raise ValueError("min_distance_m must not be negative")
    distance = text.numbers(detections, ["nearest_ANFR_distance_m"])["nearest_ANFR_distance_m"]
    return detections.filter(distance >= min_distance_m)


@dataclass
class Clusters:
    """Detections, their proximity groups and one row per cluster.

    ``zone_id`` of the inner tables is a key without nulls; ``loose`` are the detections
    without a position, which are near nothing.
    """

    points: DataFrame
    loose: DataFrame
    groups: Groups
    vertices: DataFrame
    table: DataFrame

    def keyed_members(self, only: DataFrame | None = None) -> DataFrame:
        """One row per detection with its cluster; with ``only`` of those clusters (zone_id, root)."""
        keys = ["zone_id", *CELL]
        vertices, loose = self.vertices, self.loose.withColumn("root", F.col("detection_id"))
        if only is not None:
            vertices = vertices.join(only, ["zone_id", "root"], "left_semi")
        placed = skew_join(
            self.points, vertices.select(*keys, "root"), keys,
            spread=["zone_id", "detection_id"], counts=self.vertices,
        ).drop(*CELL)
        return placed if only is not None else placed.unionByName(loose)

    def members(self) -> DataFrame:
        """One row per detection with its cluster's root, whatever the cluster's size."""
        return self.keyed_members().withColumn("zone_id", _zone_name())

    def pages(self, page: int | None = None) -> DataFrame:
        """The members of clusters of two or more as pages: zone_id (a key), root, page, ids.

        A page holds at most ``page`` ids in input order, and pages follow each other. Clusters that need one
        page are gathered; in larger ones ids are ranked over range partitions first, so none meets in one task.
        """
        page = PAGE if page is None else page
        name = ["zone_id", "root"]
        sizes = self.table.select(*name, F.col("detections_in_cluster").alias("n"))
        ids = F.array_sort(F.collect_list("detection_id")).alias("ids")
        fit = sizes.filter(F.col("n").between(2, page)).select(*name)
        one = self.keyed_members(fit).groupBy(*name).agg(ids).withColumn("page", F.lit(0).cast("long"))
        one = one.select(*name, "page", "ids")
        large = sizes.filter(F.col("n") > page).select(*name)
        if large.isEmpty():
            return one
        ranked = rank_rows(
            self.keyed_members(large).select(*name, "detection_id"), [F.col("detection_id").asc()], within=name, name="_no")
        number = F.floor((F.col("_no") - 1) / page).cast("long").alias("page")
        return one.unionByName(ranked.groupBy(*name, number).agg(ids))


def id_texts(pages: DataFrame) -> DataFrame:
    """zone_id, root, cluster_detection_ids: the pages of each cluster as one text, for export.

    Only page texts meet, a thousandth of the rows; a cluster whose text passes 2 GB has no such text in any
    file format here, and its pages are the result.
    """
    text_of = F.array_join(F.col("ids").cast("array<string>"), ",").alias("text")
    texts = pages.select("zone_id", "root", "page", text_of)
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return texts.groupBy("zone_id", "root").agg(parts.alias("p")).select(
        "zone_id", "root", F.array_join(F.transform("p", lambda x: x["text"]), ",").alias("cluster_detection_ids"))


def cluster_detections(detections: DataFrame, cluster_distance_m: float = 30.0) -> Clusters:
    """Group detections of one zone linked by steps of at most the given distance.

    (zone_id, detection_id) is the key of the detections, and detection_id gives
    the input order. A detection without a position is a cluster of its own, a null zone is a
    zone like any other, and a confidence that is no number never makes a representative of a
    cluster that has one.
    """
    require_columns(detections, NEEDED)
    if cluster_distance_m <= 0:
        raise ValueError("cluster_distance_m must be positive")
    metric = Metric(cluster_distance_m)
    thin = detections.select(
        _zone_key().alias("zone_id"), "detection_id",
        *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in NEEDED[2:]],
    )
    far = materialize(thin, "far")
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    thin, loose = far.filter(located), far.filter(~located)
    groups = close_groups(thin, "detection_id", metric, group=["zone_id"])
    points = group_cells(thin, groups.side, metric.radius)
    keys = ["zone_id", *CELL]
    best = F.max(F.struct("confidence", (-F.col("detection_id")).alias("order"))).alias("best")
    # First per cell, combined map-side, then per cluster: a crowded cell or
    # cluster never meets in one task as rows.
    per_cell = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), best,
        F.max("nearest_ANFR_distance_m").alias("far"), F.min("detection_id").alias("first"),
    )
    vertices = materialize(
        per_cell.join(groups.vertices().drop("n"), keys), "vertices"
    )
    table = vertices.groupBy("zone_id", "root").agg(
        F.sum("n").alias("detections_in_cluster"),
        F.max("best").alias("best"),
        F.max("far").alias("cluster_max_distance_anfr_m"),
        F.min("first").alias("cluster_first_id"),
    )
    table = table.select(
        "zone_id", "root",
        (-F.col("best.order")).alias("detection_id"),
        "detections_in_cluster",
        F.col("best.confidence").alias("cluster_max_confidence"),
        "cluster_max_distance_anfr_m", "cluster_first_id",
    )
    single = loose.select(
        "zone_id", F.col("detection_id").alias("root"), "detection_id", F.lit(1).cast("long").alias("detections_in_cluster"),
        F.col("confidence").alias("cluster_max_confidence"),
        F.col("nearest_ANFR_distance_m").alias("cluster_max_distance_anfr_m"),
        F.col("detection_id").alias("cluster_first_id"),
    )
    return Clusters(points, loose, groups, vertices, materialize(table.unionByName(single), "clusters"))


def _with_ids(clusters: Clusters, table: DataFrame) -> DataFrame:
    """Cluster rows with the ids of their members as text."""
    texts = id_texts(clusters.pages())
    named = F.coalesce("cluster_detection_ids", F.col("detection_id").cast("string"))
    return table.join(texts, ["zone_id", "root"], "left").withColumn("cluster_detection_ids", named)


def cluster_table(clusters: Clusters) -> DataFrame:
    """One row per cluster with its size, maxima, representative and all member ids.

    The ids are listed in input order, whatever their number; ``Clusters.members`` has them
    as rows and ``Clusters.pages`` as pages.
    """
    return _with_ids(clusters, clusters.table).withColumn("zone_id", _zone_name())


def number_candidates(candidates: DataFrame, *, per_zone: bool = False) -> DataFrame:
    """C001, C002, ... by zone, then falling confidence, then first detection.

    With ``per_zone`` numbers restart in every zone, as in separate area runs.
    """
    order = [
        F.col("zone_id").asc(), F.col("confidence").desc(), F.col("cluster_first_id").asc(),
    ]
    if per_zone:
        ranked = rank_rows(candidates, order[1:], within=["zone_id"], name="candidate_number")
    else:
        ranked = rank_rows(candidates, order, name="candidate_number")
    return ranked.withColumn("candidate_id", F.format_string("C%03d", F.col("candidate_number")))


def merge_candidates(
    detections: DataFrame, cluster_distance_m: float = 30.0, *, per_zone: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The candidates of ``dedup_candidates`` and their members.

    Members: zone_id, root (a name of the cluster in its zone), detection_id of every detection.
    """
    clusters = cluster_detections(detections, cluster_distance_m)
    # Numbers need the thin table only; wide columns join last.
    thin = number_candidates(
        clusters.table.withColumn("confidence", F.col("cluster_max_confidence")), per_zone=per_zone).drop("confidence")
    table = _with_ids(clusters, thin).withColumnRenamed("zone_id", "_zone").drop("root")
    merged = detections.withColumn("zone_id", F.col("zone_id").cast("string")).withColumn(
        "_zone", _zone_key()
    ).join(table, ["_zone", "detection_id"]).drop("_zone")
    return merged, clusters.members().select("zone_id", "root", "detection_id")


def dedup_candidates(
    detections: DataFrame, cluster_distance_m: float = 30.0, *, per_zone: bool = False
) -> DataFrame:
    """Merge close detections of a zone; each cluster keeps its most confident one."""
    return merge_candidates(detections, cluster_distance_m, per_zone=per_zone)[0]


def build_candidates(
    detections: DataFrame,
    min_distance_m: float = 150.0,
    cluster_distance_m: float = 30.0,
    *,
    per_zone: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The far detections and the candidates merged from them."""
    far = far_filter(detections, min_distance_m)
    return far, dedup_candidates(far, cluster_distance_m, per_zone=per_zone)


def number_detections(boxes: DataFrame, order: list[str]) -> DataFrame:
    """detection_id 1..n per zone in patch order, then box order."""
    return rank_rows(
        boxes, [F.col(c).asc() for c in order], within=["zone_id"], name="detection_id"
    )


def zone_candidate_ids(candidates: DataFrame, key: str = "detection_id") -> DataFrame:
    """Review ids: the zone's capital initial and the rank by confidence in the zone."""
    ranked = rank_rows(
        candidates, [F.col("confidence").desc(), F.col(key).asc()],
        within=["zone_id"], name="zone_rank",
    )
    initial = F.upper(F.substring("zone_id", 1, 1))
    return ranked.withColumn(
        "unique_candidate_id", F.concat(initial, F.format_string("%03d", F.col("zone_rank")))
    )
