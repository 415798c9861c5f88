"""Detection quality against annotated boxes, and box suppression.

Each evaluated image has at most one annotated box (its site), so the best
prediction of an image decides its true positive and everything is plain
aggregation: hot images are combined map-side, never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosieve.functions import boxes
from geosieve.operators.annotations import usable
from geosieve.operators.proximity import connected_components
from geosieve.operators.spread import (
    BROADCAST_ROWS, materialize, materialize_with, rank_rows, skew_join,
)

# The confidence thresholds of the published sweep.
THRESHOLDS = [0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3]
AP_IOUS = [(50 + 5 * i) / 100 for i in range(10)]


def match_boxes(predictions: DataFrame, truth: DataFrame, unique: str = "pred_id") -> DataFrame:
    """Every prediction with its image's status and IoU with the annotated box.

    Only images in ``truth`` count; the IoU is null where nothing is annotated.
    """
    gt = truth.select("image", "status", *[F.col(c).alias(f"gt_{c}") for c in boxes.CORNERS])
    joined = skew_join(predictions, gt, ["image"], spread=[unique])
    mine = {c: F.col(c).cast("double") for c in boxes.CORNERS}
    theirs = {c: F.col(f"gt_{c}").cast("double") for c in boxes.CORNERS}
    overlap = F.when(F.col("status") == "visible", boxes.iou(mine, theirs))
    return joined.withColumn("iou", overlap).drop(*[f"gt_{c}" for c in boxes.CORNERS])


def _scores(n: Column, best: Column, seen: Column, match_iou: float) -> dict[str, Column]:
    tp = F.when(seen & (best >= match_iou), 1).otherwise(0).cast("long")
    return {
        "TP": tp, "FP": (n - tp).cast("long"),
        "FN": F.when(seen, 1 - tp).otherwise(0).cast("long"),
    }


def image_eval(
    predictions: DataFrame, truth: DataFrame, confidence: float = 0.05, match_iou: float = 0.5
) -> DataFrame:
    """Predictions, best IoU and TP, FP, FN of every usable image."""
    images = usable(truth)
    strong = predictions.filter(F.col("confidence") >= confidence)
    matched = match_boxes(strong, images).groupBy("image").agg(
        F.count(F.lit(1)).alias("nb_predictions"), F.max("iou").alias("best_iou")
    )
    whole = images.select("SUP_ID", "image", "status").join(matched, "image", "left")
    seen = F.col("status") == "visible"
    whole = whole.withColumns({
        "nb_predictions": F.coalesce("nb_predictions", F.lit(0)),
        "best_iou": F.when(seen, F.coalesce("best_iou", F.lit(0.0))),
    })
    return whole.withColumns(
        _scores(F.col("nb_predictions"), F.col("best_iou"), seen, match_iou)
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_rates(totals: DataFrame) -> DataFrame:
    """Precision, recall and F1, each 0 where undefined."""
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return totals.withColumns({
        "precision": precision, "recall": recall,
        "f1": _ratio(2.0 * precision * recall, precision + recall),
    })


def eval_totals(details: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("TP", "FP", "FN")]
    return with_rates(details.agg(F.count(F.lit(1)).alias("images"), *sums))


def threshold_sweep(
    predictions: DataFrame,
    truth: DataFrame,
    thresholds: list[float] | None = None,
    match_iou: float = 0.5,
) -> DataFrame:
    """Totals per confidence threshold, with the best F1 marked (least on a tie).

    A prediction is filed under the number of thresholds it passes, combined per
    image, and only those few rows per image are spread over the thresholds.
    """
    thresholds = sorted(thresholds or THRESHOLDS)
    images = materialize(usable(truth).select("image", "status", *boxes.CORNERS), "images")
    passed = sum((F.when(F.col("confidence") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    steps = match_boxes(predictions, images).withColumn("_passed", passed).filter("_passed > 0")
    steps = steps.groupBy("image", "_passed").agg(
        F.count(F.lit(1)).alias("n"), F.max("iou").alias("best")
    )
    per_image = steps.withColumn("_k", F.explode(F.sequence(F.lit(1), "_passed"))).groupBy(
        "image", "_k"
    ).agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    seen = F.col("best").isNotNull()
    scored = per_image.withColumns(_scores(F.col("n"), F.col("best"), seen, match_iou))
    sums = scored.groupBy("_k").agg(F.sum("TP").alias("TP"), F.sum("FP").alias("FP"))
    visible = images.agg(F.count(F.when(F.col("status") == "visible", 1)).alias("v"))
    spark = predictions.sparkSession
    rows = spark.createDataFrame(list(enumerate(thresholds, 1)), "_k int, threshold double")
    totals = rows.join(sums, "_k", "left").select(
        "threshold", F.coalesce("TP", F.lit(0)).alias("TP"), F.coalesce("FP", F.lit(0)).alias("FP")
    )
    totals = totals.withColumn("FN", visible.select("v").scalar() - F.col("TP"))
    rated = with_rates(totals)
    # As many rows as thresholds: ranking them in one window is bounded.
    order = Window.orderBy(F.desc("f1"), F.asc("threshold"))
    return rated.withColumn("is_best", F.row_number().over(order) == 1)


def detection_ap(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """AP at IoU .50 and mean over .50:.05:.95, with precision and recall at the best F1.

    Predictions of usable images are ranked by confidence, then id. At each IoU an
    image's first prediction reaching it is its true positive. AP is the mean over
    101 recall levels of the greatest precision at that recall or above.
    """
    images = materialize(usable(truth).select("image", "status", *boxes.CORNERS), "images")
    matched = match_boxes(predictions, images).select("pred_id", "image", "confidence", "iou")
    matched = materialize(matched, "matched")
    order = F.struct((-F.col("confidence")).alias("c"), "pred_id")
    hits = matched.groupBy("image").agg(
        *[F.min(F.when(F.col("iou") >= t, order)).alias(f"t{i}") for i, t in enumerate(AP_IOUS)]
    )
    # One row per (image, IoU level) at most; pred_id is unique, so no skew.
    firsts = hits.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(f"t{i}.pred_id").alias("pred_id"))
        for i in range(len(AP_IOUS))
    ])).alias("h")).select("h.*").filter("pred_id is not null")
    levels = firsts.groupBy("pred_id").agg(F.sum(F.expr("shiftleft(1, level)")).alias("hit"))
    flagged = matched.select("pred_id", "confidence").join(levels, "pred_id", "left")
    flagged = flagged.withColumn("hit", F.coalesce("hit", F.lit(0)))
    ranked = rank_rows(flagged, [F.col("confidence").desc(), F.col("pred_id").asc()])
    # From here only the true positives matter: precision peaks at them.
    found = ranked.filter("hit > 0").select(
        "rank", F.explode(F.array(*[F.lit(i) for i in range(len(AP_IOUS))])).alias("level"), "hit"
    ).filter("(hit & shiftleft(1, level)) != 0")
    numbered = rank_rows(
        found.select("level", "rank"), [F.col("rank").asc()], within=["level"], name="tp"
    )
    positives = images.agg(F.count(F.when(F.col("status") == "visible", 1)).alias("v")).first()["v"]
    curve = numbered.select(
        "level", (F.col("tp") / F.col("rank")).alias("precision"),
        (F.col("tp") / F.lit(float(positives))).alias("recall"),
        # The last recall level r/100 this point reaches: r * positives <= 100 * tp.
        F.floor(F.lit(100) * F.col("tp") / F.lit(float(positives))).cast("int").alias("step"),
    )
    f1 = 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    curve = curve.withColumn("f1", f1)
    best_step = curve.groupBy("level", "step").agg(F.max("precision").alias("precision"))
    # At most 101 steps for each of ten levels from here on.
    reach = Window.partitionBy("level").orderBy(F.desc("step")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    spark = predictions.sparkSession
    grid = spark.range(len(AP_IOUS) * 101).select(
        F.floor(F.col("id") / 101).cast("int").alias("level"), (F.col("id") % 101).cast("int").alias("step")
    )
    filled = grid.join(best_step, ["level", "step"], "left").withColumn(
        "best", F.coalesce(F.max("precision").over(reach), F.lit(0.0))
    )
    ap = filled.groupBy("level").agg(F.avg("best").alias("ap"))
    at_best = curve.filter("level = 0").agg(
        F.max_by(F.struct("precision", "recall"), F.struct("f1", "recall")).alias("p")
    )
    return ap.agg(
        F.max(F.when(F.col("level") == 0, F.col("ap"))).alias("ap50"),
        F.avg("ap").alias("ap50_95"),
    ).select(
        "ap50", "ap50_95",
        F.coalesce(at_best.select("p.precision").scalar(), F.lit(0.0)).alias("precision"),
        F.coalesce(at_best.select("p.recall").scalar(), F.lit(0.0)).alias("recall"),
    )


def hard_negatives(
    predictions: DataFrame, truth: DataFrame, max_iou: float = 0.1, top: int = 5
) -> DataFrame:
    """Per image the most confident predictions that miss the annotated box.

    The rank limit is applied on both sides of the shuffle, so a crowded image
    sends on a handful of rows per task.
    """
    matched = match_boxes(predictions, usable(truth))
    wrong = matched.withColumn("iou", F.coalesce("iou", F.lit(0.0))).filter(F.col("iou") < max_iou)
    order = Window.partitionBy("image").orderBy(F.desc("confidence"), F.asc("pred_id"))
    return wrong.withColumn("rang", F.row_number().over(order)).filter(F.col("rang") <= top)


def error_summary(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per usable image: truth present, predictions, top confidence, best IoU and its confidence."""
    images = usable(truth)
    matched = match_boxes(predictions, images)
    positive = F.when(F.col("iou") > 0, F.struct("iou", "confidence"))
    per_image = matched.groupBy("image").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"), F.max(positive).alias("best")
    )
    return images.select("image", (F.col("status") == "visible").alias("gt_present")).join(
        per_image, "image", "left"
    ).select(
        "image", "gt_present",
        F.coalesce("n", F.lit(0)).alias("nombre_predictions"),
        F.coalesce("top", F.lit(0.0)).alias("confidence_max"),
        F.coalesce("best.iou", F.lit(0.0)).alias("best_iou_avec_gt"),
        F.col("best.confidence").alias("confidence_best_iou"),
    )


# An image, or a component of overlapping boxes, of at most so many is settled in one ordered pass.
WHOLE = 768


def _bins(name: str) -> Column:
    """Size bin: floor of the binary logarithm of a side length."""
    return F.floor(F.log2(F.col(name))).cast("int")


def _strength() -> Column:
    """Ascending by falling confidence; no number is weakest."""
    return F.coalesce(-F.col("confidence").cast("double"), F.lit(float("nan")))


def _in_order(rows: DataFrame, keys: list[str], iou: float, unique: str) -> DataFrame:
    """Rows that greedy suppression keeps in each group of ``keys``, by one fold over the ordered group.

    For groups whose size the caller has bounded.
    """
    corners = list(boxes.CORNERS)
    entry = F.struct(
        _strength().alias("c"), F.col(unique).alias("u"), *[F.col(c).cast("double").alias(c) for c in corners],
        F.struct(*rows.columns).alias("row"))
    sorted_ = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("b"))

    def step(kept: Column, box: Column) -> Column:
        beaten = F.exists(kept, lambda k: boxes.iou({c: k[c] for c in corners}, {c: box[c] for c in corners}) > iou)
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(box)))

    kept = F.aggregate("b", F.slice("b", 1, 0), step)
    return sorted_.select(F.explode(kept).alias("k")).select("k.row.*")


def box_nms(
    boxes_df: DataFrame, iou: float = 0.5, group: str = "image", unique: str = "pred_id", whole: int = WHOLE,
) -> DataFrame:
    """Boxes left by greedy suppression: most confident first, dropping overlaps above ``iou``.

    An image of at most ``whole`` boxes is settled in one ordered pass, as one row. Larger ones are
    contracted: cells of boxes of like size and place are joined where boxes of theirs may
    overlap, and the components of that graph of cells are settled alone. A component that is still too
    large is split by rank: its first ``whole`` boxes are settled in order, and so is the strongest box of each cell
    that no stronger open one overlaps; what they overlap goes, and the rest falls into new
    components. A chain of n boxes takes one round if it is short and n / ``whole`` at most.

    A box without a group, without area or with a missing corner overlaps nothing and stays. A confidence that
    is no number is the weakest.
    """
    if not 0 < iou < 1:
        raise ValueError("iou must be above 0 and below 1")
    if whole < 1:
        raise ValueError("whole must be at least 1")
    has_area = F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    solid = has_area & F.col(group).isNotNull()
    alone = boxes_df.filter(~solid)
    rest = boxes_df.filter(solid)
    sizes = rest.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole)
    large, seen = materialize_with(sizes.select(group), "large")
    if not seen["rows"]:
        return alone.unionByName(_in_order(rest, [group], iou, unique))
    # At most (rows / whole) images.
    few = F.broadcast(large) if seen["rows"] <= BROADCAST_ROWS else large
    small = _in_order(rest.join(few, group, "left_anti"), [group], iou, unique)
    crowded = rest.join(few, group, "left_semi")
    kept = _contracted(crowded, iou, group, unique, whole)
    return alone.unionByName(small).unionByName(crowded.join(kept, unique, "left_semi"))


def _around(df: DataFrame, iou: float) -> DataFrame:
    """One row per cell whose boxes could overlap those described by the row above the limit.

    ``df``: cell, the least and greatest side (w_lo, w_hi, h_lo, h_hi) and double centre (x_lo, ...).
    """
    # Sides of overlapping boxes differ by a factor of at most 1 / iou.
    reach = math.ceil(-math.log2(iou))
    spread = df
    for side, axis, b, c in (("w", "x", "bw", "cx"), ("h", "y", "bh", "cy")):
        spread = spread.withColumn(f"to_{b}", F.explode(F.sequence(F.col(b) - reach, F.col(b) + reach)))
        unit = F.pow(F.lit(2.0), f"to_{b}")
        # Centres differ by at most (1 - iou) times the longer side.
        longest = F.greatest(F.col(f"{side}_hi"), F.least(F.col(f"{side}_hi") / iou, 2.0 * unit))
        slack = 2.0 * (1.0 - iou) * longest + 1e-9
        spread = spread.withColumn(f"to_{c}", F.explode(F.sequence(
            F.floor((F.col(f"{axis}_lo") - slack) / unit).cast("long"),
            F.floor((F.col(f"{axis}_hi") + slack) / unit).cast("long"))))
    return spread


def _contracted(crowded: DataFrame, iou: float, group: str, unique: str, whole: int) -> DataFrame:
    """(unique) of the boxes kept in images too large for one pass."""
    corners = list(boxes.CORNERS)
    # Copies of one box: all but the strongest are certain to go.
    first = F.min(F.struct(_strength().alias("c"), F.col(unique).alias("u"))).alias("k")
    work = crowded.groupBy(group, *[F.col(c).cast("double").alias(c) for c in corners]).agg(first).select(
        group, *corners, "k", F.col("k.u").alias(unique), (-F.col("k.c")).alias("confidence"),
        (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    # Cells are half a bin's least side wide and high.
    work = work.withColumns({"bw": _bins("w"), "bh": _bins("h")}).withColumns({
        "cx": F.floor((F.col("x1") + F.col("x2")) / F.pow(F.lit(2.0), "bw")).cast("long"),
        "cy": F.floor((F.col("y1") + F.col("y2")) / F.pow(F.lit(2.0), "bh")).cast("long"),
    })
    cell = [group, "bw", "bh", "cx", "cy"]
    target = {f"to_{c}": c for c in cell[1:]}
    spans = {"w": F.col("w"), "h": F.col("h"), "x": F.col("x1") + F.col("x2"), "y": F.col("y1") + F.col("y2")}
    alone = {f"{name}_{end}": value for name, value in spans.items() for end in ("lo", "hi")}
    work, seen = materialize_with(work, "open")
    kept: list[DataFrame] = []
    while seen["rows"]:
        comps, facts = materialize_with(_components_of_cells(work, cell, target, spans, iou, group), "components")
        small = facts["rows"] <= BROADCAST_ROWS
        placed = skew_join(work, comps, cell, spread=[unique], small_right=True if small else None)
        placed, crowd = materialize_with(placed, "placed", large=F.count(F.when(F.col("size") > whole, 1)))
        done = _in_order(placed.filter(F.col("size") <= whole), [group, "component"], iou, unique)
        kept.append(materialize(done.select(unique), "kept"))
        if not crowd["large"]:
            break
        large = placed.filter(F.col("size") > whole)
        # Partial limits cut each task's rows before they meet.
        order = Window.partitionBy(group, "component").orderBy("k")
        head = large.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= whole).drop("_place")
        head = materialize(head, "head")
        winners = _in_order(head, [group, "component"], iou, unique)
        # The strongest box of each cell, compared with those of the cells around.
        tops = large.groupBy(*cell, "component").agg(F.min_by(F.struct("k", *corners, "w", "h", unique), "k").alias("b"))
        tops = materialize(tops.select(*cell, "b.*"), "tops")
        rivals = _around(tops.withColumns(alone), iou).select(
            group, F.col(unique).alias("of"), F.col("k").alias("mine"), *target).withColumnsRenamed(target)
        beaten = rivals.join(tops.select(*cell, "k"), cell).filter(F.col("k") < F.col("mine"))
        best = tops.join(beaten.select(F.col("of").alias(unique)).distinct(), unique, "left_anti")
        shown = [*cell, unique, *corners, "w", "h"]
        winners = materialize(winners.select(*shown).unionByName(best.select(*shown)).dropDuplicates([unique]), "winners")
        kept.append(winners.select(unique))
        claims = _around(winners.withColumns(alone), iou).select(
            group, F.col(unique).alias("by"), *[F.col(c).alias(f"k_{c}") for c in corners], *target,
        ).withColumnsRenamed(target)
        counts = large.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
        met = skew_join(large, claims, cell, spread=[unique], counts=counts)
        overlap = boxes.iou({c: F.col(c) for c in corners}, {c: F.col(f"k_{c}") for c in corners})
        gone = met.filter((overlap > iou) | (F.col("by") == F.col(unique))).select(unique)
        gone = gone.unionByName(head.select(unique)).distinct()
        work, seen = materialize_with(large.join(gone, unique, "left_anti").drop("component", "size"), "open")
    out = crowded.select(unique).limit(0)
    for part in kept:
        out = out.unionByName(part)
    return out


def _components_of_cells(
    work: DataFrame, cell: list[str], target: dict[str, str], spans: dict[str, Column], iou: float, group: str,
) -> DataFrame:
    """Cells with their component and the number of boxes in it."""
    sides = []
    for name, value in spans.items():
        sides += [F.min(value).alias(f"{name}_lo"), F.max(value).alias(f"{name}_hi")]
    for low, high in (("x1", "x2"), ("y1", "y2")):
        sides += [F.min(low).alias(f"{low}_lo"), F.max(high).alias(f"{high}_hi")]
    least = F.min(F.col("w") * F.col("h")).alias("area")
    cells = materialize(work.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), least, *sides).withColumn(
        "id", F.xxhash64(*cell)), "cells")
    mine = _around(cells, iou).select(
        group, F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x1_lo", "x2_hi", "y1_lo", "y2_hi", "area")],
        *target).withColumnsRenamed(target)
    met = mine.join(cells.select(*cell, F.col("id").alias("b"), "x1_lo", "x2_hi", "y1_lo", "y2_hi", "area"), cell)
    shared = F.lit(1.0)
    for low, high in (("x1_lo", "x2_hi"), ("y1_lo", "y2_hi")):
        shared = shared * F.greatest(F.lit(0.0), F.least(high, f"a_{high}") - F.greatest(low, f"a_{low}"))
    # IoU > t means shared area > t / (1 + t) * both areas.
    may = shared * (1.0 + 1e-9) >= (iou / (1.0 + iou)) * (F.col("area") + F.col("a_area"))
    edges = met.filter(may & (F.col("a") < F.col("b"))).select(group, "a", "b")
    roots = connected_components(edges, [group]).withColumnRenamed("root", "component")
    named = cells.select(*cell, "id", "n").join(roots, [group, "id"], "left").select(
        *cell, "n", F.coalesce("component", "id").alias("component"))
    named = materialize(named, "named")
    totals = named.groupBy(group, "component").agg(F.sum("n").alias("size"))
    return skew_join(named.drop("n"), totals, [group, "component"], spread=cell)
