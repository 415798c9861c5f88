import random

import pytest
from brute import iou
from pyspark.sql import functions as F

from geosieve.operators import annotations as ann
from geosieve.operators import evaluation as ev

TRUTH = "SUP_ID string, image string, status string, x1 double, y1 double, x2 double, y2 double"
PRED = "pred_id long, image string, confidence double, x1 double, y1 double, x2 double, y2 double"


def data(spark, seed=1, images=8, n=150):
    rng = random.Random(seed)
    truth = []
    for i in range(images):
        status = ["visible", "visible", "non_visible", "ambigu"][i % 4]
        box = (100.0, 100.0, 160.0, 180.0) if status == "visible" else (None,) * 4
        truth.append((f"s{i}", f"i{i}", status, *box))
    preds = []
    for k in range(n):
        x, y = rng.choice([95.0, 100.0, 110.0, 300.0]), rng.choice([98.0, 105.0, 130.0])
        preds.append((k, f"i{rng.randrange(images + 1)}", round(rng.random() * 0.3, 2), x, y, x + 60, y + 80))
    return truth, preds, spark.createDataFrame(truth, TRUTH), spark.createDataFrame(preds, PRED)


def brute_eval(truth, preds, confidence, match=0.5):
    out = {}
    for s, image, status, *box in truth:
        if status == "ambigu":
            continue
        mine = [p for p in preds if p[1] == image and p[2] >= confidence]
        best = max([iou(p[3:], box) for p in mine], default=0.0) if status == "visible" else None
        tp = int(best is not None and best >= match)
        out[image] = (len(mine), best, tp, len(mine) - tp, int(status == "visible") - tp)
    return out


def test_image_eval_totals_and_sweep(spark):
    truth, preds, t, p = data(spark)
    want = brute_eval(truth, preds, 0.05)
    details = ev.image_eval(p, t)
    got = {r.image: (r.nb_predictions, r.best_iou, r.TP, r.FP, r.FN) for r in details.collect()}
    assert got == {k: (v[0], pytest.approx(v[1]) if v[1] is not None else None, *v[2:]) for k, v in want.items()}
    total = ev.eval_totals(details).first()
    assert (total.TP, total.FP, total.FN) == tuple(sum(v[i] for v in want.values()) for i in (2, 3, 4))
    rows = ev.threshold_sweep(p, t, [0.01, 0.1, 0.29, 0.9]).collect()
    for r in rows:
        w = brute_eval(truth, preds, r.threshold)
        assert (r.TP, r.FP, r.FN) == tuple(sum(v[i] for v in w.values()) for i in (2, 3, 4))
    best = [r for r in rows if r.is_best]
    assert len(best) == 1 and best[0].f1 == max(r.f1 for r in rows)


def test_rates_are_zero_where_undefined(spark):
    row = ev.with_rates(spark.createDataFrame([(0, 0, 0)], "TP long, FP long, FN long")).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def brute_ap(truth, preds, level):
    gt = {i: b for _, i, s, *b in truth if s == "visible"}
    usable = {i for _, i, s, *_ in truth if s != "ambigu"}
    ranked = sorted((p for p in preds if p[1] in usable), key=lambda p: (-p[2], p[0]))
    used, tp, points = set(), 0, []
    for n, p in enumerate(ranked, 1):
        if p[1] in gt and p[1] not in used and iou(p[3:], gt[p[1]]) >= level:
            used.add(p[1])
            tp += 1
        points.append((tp / len(gt), tp / n))
    return sum(max([pr for rc, pr in points if rc * len(gt) * 100 >= k * len(gt) - 1e-9], default=0.0)
               for k in range(101)) / 101


def test_average_precision(spark):
    truth, preds, t, p = data(spark, seed=3)
    row = ev.detection_ap(p, t).first()
    levels = [brute_ap(truth, preds, v) for v in ev.AP_IOUS]
    assert row.ap50 == pytest.approx(levels[0]) and row.ap50_95 == pytest.approx(sum(levels) / 10)


def test_hard_negatives_limit_before_the_shuffle(spark):
    truth, preds, t, p = data(spark)
    df = ev.hard_negatives(p, t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for image in {r.image for r in df.collect()}:
        box = next(b for _, i, _, *b in truth if i == image)
        wrong = [q for q in preds if q[1] == image and (box[0] is None or iou(q[3:], box) < 0.1)]
        want = [q[0] for q in sorted(wrong, key=lambda q: (-q[2], q[0]))[:5]]
        assert [r.pred_id for r in df.filter(F.col("image") == image).orderBy("rang").collect()] == want


def brute_nms(preds, limit):
    kept = []
    for p in sorted(preds, key=lambda p: (-p[2], p[0])):
        if all(k[1] != p[1] or iou(k[3:], p[3:]) <= limit for k in kept):
            kept.append(p)
    return {p[0] for p in kept}


@pytest.mark.parametrize("limit", [0.5, 0.3, 0.15])
def test_suppression(spark, limit):
    rng = random.Random(4)
    preds = []
    for k in range(160):
        x, y, w, h = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 45), rng.uniform(5, 45)
        preds.append((k, f"i{k % 2}", round(rng.random(), 2), x, y, x + w, y + h))
    preds += [(200 + k, "i0", 0.5, *preds[0][3:]) for k in range(30)]
    preds += [(300, "i1", 0.1, 5.0, 5.0, 5.0, 9.0)]
    df = spark.createDataFrame(preds + [(400, "i1", 0.9, None, 5.0, 5.0, 9.0)], PRED)
    want = brute_nms(preds, limit) | {400}
    assert {r.pred_id for r in ev.box_nms(df, limit).collect()} == want
    # Images above the bound: components, ranked heads and strongest boxes of cells.
    assert {r.pred_id for r in ev.box_nms(df, limit, whole=7).collect()} == want


def test_suppression_along_a_chain(spark):
    """Each box overlaps the next, in falling confidence: every second one stays."""
    n = 2000
    preds = [(k, "long", 1.0 - k / (2.0 * n), 6.0 * k, 0.0, 6.0 * k + 20.0, 20.0) for k in range(n)]
    preds += [(n + k, f"short{k % 5}", None if k == 3 else 0.5, 0.0, 0.0, 10.0, 10.0) for k in range(20)]
    preds += [(n + 50, None, 0.5, 0.0, 0.0, 10.0, 10.0)]
    got = {r.pred_id for r in ev.box_nms(spark.createDataFrame(preds, PRED), 0.5).collect()}
    assert got == set(range(0, n, 2)) | {n, n + 1, n + 2, n + 4, n + 8, n + 50}


def test_annotation_checks(spark):
    rows = [("81", "p.jpg", " visible ", 256.0, 128.0, 512.0, 640.0), ("82", "q.jpg", "non_visible", *(None,) * 4),
            ("83", "r.jpg", "ambigu", *(None,) * 4)]
    df = spark.createDataFrame(rows, TRUTH).withColumn("split", F.lit("train"))
    labels = {r.SUP_ID: (r.label_file, r.label) for r in ann.human_labels(df).collect()}
    assert labels == {"81": ("p.txt", "0 0.37500000 0.37500000 0.25000000 0.50000000\n"), "82": ("q.txt", "")}
    counts = ann.human_label_counts(df).first()
    assert (counts.total_reviewed, counts.usable, counts.ambiguous_excluded) == (3, 2, 1)
    again = df.union(df.filter("SUP_ID = '82'").withColumn("split", F.lit("val")))
    with pytest.raises(ValueError, match="two splits"):
        ann.human_labels(again)
    with pytest.raises(ValueError, match="repeated"):
        ann.human_labels(df.union(df.filter("SUP_ID = '82'")))
    with pytest.raises(ValueError, match="box"):
        ann.human_labels(df.withColumn("x2", F.lit(5000.0)))
    with pytest.raises(ValueError, match="status"):
        ann.human_labels(df.withColumn("status", F.lit("?")))


def test_weak_labels_and_files(spark):
    df = spark.createDataFrame([("1", "train"), ("2", "val")], "SUP_ID string, split string")
    labels = ann.weak_labels(df).collect()
    assert {r.label for r in labels} == {"0 0.50000000 0.50000000 0.15625000 0.15625000\n"}
    with pytest.raises(ValueError):
        ann.weak_labels(df, box_px=2000)
    files = spark.createDataFrame([("x/support_1.jpg", 1024, 512)], "path string, width int, height int")
    assert [r.SUP_ID for r in ann.missing_files(ann.weak_labels(df), files).collect()] == ["2"]
    assert ann.wrong_image_size(files).count() == 1


def test_calibration_uses_the_nearest_site(spark):
    # The box centre lies 10 px east of the image centre; another site stands right there.
    rows = [("own", "visible", 48.0, 2.0, 512.0, 502.0, 532.0, 522.0), ("x", "ambigu", 48.0, 2.0, *(None,) * 4)]
    df = spark.createDataFrame(rows, "SUP_ID string, status string, latitude double, longitude double, "
                                     "x1 double, y1 double, x2 double, y2 double")
    moved = 2.0 + 10 / (256 * 2**19) * 360
    catalogue = spark.createDataFrame([("own", 48.0, 2.0), ("other", 48.0, moved)],
                                      "SUP_ID string, latitude double, longitude double")
    table = ann.calibrate(df, catalogue)
    row = table.first()
    assert table.count() == 1 and row.nearest_SUP_ID == "other"
    assert row.distance_to_nearest_anfr_m < 1e-3 < 1.9 < row.distance_to_own_anfr_m < 2.1
    summary = ann.calibration_summary(table).first()
    assert summary.visible_supports_used == 1 and summary.candidate_distance_threshold_m == 150.0
    bins = ann.distance_histogram(table, "distance_to_own_anfr_m").collect()
    assert len(bins) == 24 and sum(b.n for b in bins) == 1
    with pytest.raises(ValueError, match="no visible"):
        ann.calibrate(df.filter("status = 'ambigu'"), catalogue)
    with pytest.raises(ValueError, match="lack"):
        ann.calibrate(df.withColumn("status", F.lit("visible")), catalogue)
