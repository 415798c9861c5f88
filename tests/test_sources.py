import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from geosieve.sources import readers, records, writers


def test_separator_is_told_from_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" SUP_ID ;lat\n1;48,5\n")
    (tmp_path / "b.csv").write_text("SUP_ID,note\n1,\"a;b, c\"\n")
    a = readers.read_any_csv(spark, str(tmp_path / "a.csv")).first()
    b = readers.read_any_csv(spark, str(tmp_path / "b.csv")).first()
    assert (a.SUP_ID, a.lat) == ("1", "48,5") and b.note == "a;b, c"


def test_ids_stay_text_and_numbers_are_numbers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("SUP_ID,latitude,detection_id\n0012,48.5,7\nx,1d,\n")
    df = readers.read_csv(spark, str(tmp_path / "d.csv"))
    assert [tuple(r) for r in df.collect()] == [("0012", 48.5, 7), ("x", None, None)]


def test_line_breaks_in_quotes_need_no_flag(spark, tmp_path):
    for name, sep in (("c", ","), ("s", ";")):
        (tmp_path / f"{name}.csv").write_text(sep.join(["SUP_ID", "note"]) + f'\n1{sep}"a\nb ""q"" {sep}\r\nc"\n2{sep}"d"\n')
    want = {c: [("1", f'a\nb "q" {s}\r\nc'), ("2", "d")] for c, s in (("c", ","), ("s", ";"))}
    c, s = str(tmp_path / "c.csv"), str(tmp_path / "s.csv")
    for df, kind in ((readers.read_csv(spark, c), "c"), (readers.read_semicolon(spark, s), "s"), (readers.read_any_csv(spark, c), "c"),
                     (readers.read_any_csv(spark, s), "s"), (readers.read_tagged(spark, [c]), "c")):
        assert sorted((r.SUP_ID, r.note) for r in df.collect()) == want[kind]


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_records_are_cut_from_many_splits(spark, tmp_path, small_splits, monkeypatch):
    rng = random.Random(2)
    bits = ["a", "word", "\n", "\r\n", '""', ",", ";", "é", " ", "x" * 30]
    texts = {}
    for name in ("one", "two"):
        rows = []
        for i in range(60):
            cells = [str(i)]
            for _ in range(2):
                text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
                # A quote inside an unquoted cell is a character.
                cells.append(f'"{text}"' if rng.random() < 0.6 else rng.choice(["plain", '5" wide', 'in "it"', ""]))
            rows.append(",".join(cells))
        rows.insert(30, '90,"' + "long\n" * 60 + '",end')  # over several splits
        texts[name] = "id,a,b\n" + "\n".join(rows) + ("\n" if name == "one" else "")
        (tmp_path / f"{name}.csv").write_bytes(texts[name].encode())
    want = {}
    for name, text in texts.items():
        read = list(csv.reader(io.StringIO(text, newline="")))
        want[name] = [tuple(v or None for v in r) for r in read[1:]]
    df = readers.read_csv(spark, str(tmp_path), order=True, null_words=("",))
    assert records.file_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    for few in (True, False):
        if not few:
            monkeypatch.setattr(records, "BROADCAST_ROWS", 0)
            df = readers.read_csv(spark, str(tmp_path), order=True, null_words=("",))
        got = df.orderBy("_row").select("id", "a", "b", F.element_at(F.split("_row.path", "/"), -1).alias("f")).collect()
        for name in texts:
            assert [tuple(r)[:3] for r in got if r.f == f"{name}.csv"] == want[name]


def test_splits_that_keep_or_turn_their_state(spark):
    facts = [("f", 0, False, True), ("f", 1, True, True), ("f", 2, False, True), ("f", 3, True, False), ("f", 4, True, False),
             ("f", 5, True, False), ("f", 6, False, False), ("f", 7, True, False), ("g", 0, True, False), ("g", 1, False, True)]
    df = spark.createDataFrame(facts, "path string, start long, closed boolean, opened boolean")
    got = {(r.path, r.start): r.inside for r in records.beginnings(df).collect()}
    want, state = {}, False
    for path, start, closed, opened in facts:
        state = False if start == 0 else state
        want[path, start] = state
        state = opened if state else closed
    assert got == want


def test_words_for_missing_values(spark, tmp_path):
    (tmp_path / "n.csv").write_text('SUP_ID,latitude,note\nNA,NaN,null\n"n/a",48.5,"NA "\n7,None,#N/A\n')
    want = [(None, None, None), (None, 48.5, "NA "), ("7", None, None)]
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "n.csv")).collect()] == want
    kept = readers.read_csv(spark, str(tmp_path / "n.csv"), null_words=("#N/A",)).collect()
    assert [(r.SUP_ID, r.note) for r in kept] == [("NA", "null"), ("n/a", "NA "), ("7", None)]


def test_encoding_is_told_by_the_probe(spark, tmp_path):
    for name, encoding in (("l", "latin-1"), ("u", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes('SUP_ID;Pylône\n1;"é\nü"\n2;ß\n'.encode(encoding))
        df = readers.read_semicolon(spark, str(tmp_path / f"{name}.csv"), order=False)
        assert df.columns == ["SUP_ID", "Pylône"]
        assert sorted(tuple(r) for r in df.collect()) == [("1", "é\nü"), ("2", "ß")]


def test_tagged_files_are_matched_by_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text("SUP_ID,status\n1,visible\n")
    (tmp_path / "two.csv").write_text("status,SUP_ID,extra\nambigu,2,e\n")
    df = readers.read_tagged(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    got = {(r.SUP_ID, r.status, r.extra, r.source) for r in df.collect()}
    assert got == {("1", "visible", None, "one"), ("2", "ambigu", "e", "two")}


def test_histories_carry_their_run(spark, tmp_path):
    for run, value in (("base", 0.5), ("fine tune", 0.25)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.csv").write_text(
            f"epoch, metrics/mAP50(B),metrics/mAP50-95(B)\n1,{value},0.1\n2,{value},0.2\n")
    df = readers.read_histories(spark, str(tmp_path))
    assert {(r.run, r.epoch, r.map50) for r in df.collect()} == {
        ("base", 1, 0.5), ("base", 2, 0.5), ("fine tune", 1, 0.25), ("fine tune", 2, 0.25)}


def test_sweep_document(spark, tmp_path):
    doc = {"model": "m", "best_threshold": 0.03, "all_thresholds": [
        {"threshold": 0.03, "TP": 1, "FP": 2, "FN": 3, "precision": 0.1, "recall": 0.2, "f1": 0.3}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=2))
    row = readers.read_sweep(spark, str(tmp_path / "t.json")).first()
    assert (row.best_threshold, row.threshold, row.TP, row.f1) == (0.03, 0.03, 1, 0.3)


def test_inventory(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.bin").write_bytes(b"abc")
    (tmp_path / "files" / "b.bin").write_bytes(b"abcd")
    digest = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame(
        [("a.bin", 3, digest), ("b.bin", 3, digest), ("c.bin", 1, digest)],
        "file string, size_bytes long, sha256 string")
    files = readers.list_files(spark, str(tmp_path / "files"), digest=True)
    got = {r.file: (r.present, r.size_ok, r.sha256_ok) for r in readers.check_inventory(files, manifest).collect()}
    assert got == {"a.bin": (True, True, True), "b.bin": (True, False, False), "c.bin": (False, False, False)}


def test_digests_of_files_of_any_content(spark, tmp_path):
    import gzip

    folder = tmp_path / "any"
    folder.mkdir()
    rng = random.Random(4)
    contents = {"feed": b"\n", "feeds": b"a\n\n", "text": b"x" * 50 + b"\n" + b"y", "mark": b"\xef\xbb\xbfabc\nd\n",
                "binary": bytes(rng.randrange(256) for _ in range(200_000)), "spaced name": b"\r\n\r\n", "two.gz": gzip.compress(b"inside\n")}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    got = {r.file: (r.length, r.sha256) for r in readers.list_files(spark, str(folder), digest=True).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}


def test_documents_are_written_without_gathering(spark, tmp_path):
    rows = [("big", n, n / 1000) for n in range(997)] + [("small", 0, 0.5)]
    df = spark.createDataFrame(rows, "image string, pred_id long, confidence double").repartition(3)
    assert "collect_list" not in writers.detection_lines(df, ["pred_id"], "pred_id")._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_detection_documents(df, ["pred_id"], "pred_id", str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for image, n in (("big", 997), ("small", 1)):
        files = sorted((tmp_path / "d" / f"image={image}").glob("part-*"))
        doc = json.loads("".join(f.read_text() for f in files))
        assert [d["pred_id"] for d in doc["detections"]] == list(range(n))[::-1] and doc["image_pixels"] == [1024, 1024]
    assert len(list((tmp_path / "d" / "image=big").glob("part-*"))) > 1


def test_geojson_lines(spark, tmp_path):
    df = spark.createDataFrame([("C001", 48.5, 2.25, 0.75)], "candidate_id string, latitude double, longitude double, confidence double")
    writers.write_geojson_lines(df, str(tmp_path / "g"), ["candidate_id", "confidence"])
    line = spark.read.text(str(tmp_path / "g")).first()[0]
    assert json.loads(line) == {
        "type": "Feature", "geometry": {"type": "Point", "coordinates": [2.25, 48.5]},
        "properties": {"candidate_id": "C001", "confidence": 0.75}}


def test_detection_documents_come_in_confidence_order_and_parts(spark):
    df = spark.createDataFrame([("i", n, n / 10) for n in range(5)], "image string, pred_id long, confidence double")
    rows = writers.detection_documents(df, ["pred_id"], "pred_id", chunk=3).orderBy("part").collect()
    docs = [json.loads(r.document) for r in rows]
    assert [[d["pred_id"] for d in doc["detections"]] for doc in docs] == [[4, 3, 2], [1, 0]]
    assert docs[0]["image_pixels"] == [1024, 1024] and docs[0]["image_size_meters"] == 100.0


def test_label_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "train", "a.txt", "0 1\n"), ("2", "val", "b.txt", "")],
                               "SUP_ID string, split string, label_file string, label string")
    writers.write_label_files(df, str(tmp_path / "l"))
    back = spark.read.text(str(tmp_path / "l")).select("split", "label_file", F.col("value"))
    assert {tuple(r) for r in back.collect()} == {("train", "a.txt", "0 1"), ("val", "b.txt", "")}
