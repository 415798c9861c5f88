"""Personal data in long lists: positions, overlaps and masks against plain loops."""

import itertools

from pyspark.sql import functions as F

from geosieve.llm import private


def test_running_values_over_blocks(spark):
    rows = [(i, [(7 * j * j + i) % 1000 for j in range(n)]) for i, n in enumerate([0, 1, 255, 256, 257, 1500])] + [(9, None)]
    table = spark.createDataFrame(rows, "i int, v array<bigint>").select("i", *(F.col("v").alias(w) for w in ("sum", "max", "min")))
    got = {r["i"]: r for r in private._scanned(table, {w: w for w in ("sum", "max", "min")}).collect()}
    for i, values in rows:
        for name, op in (("sum", lambda a, b: a + b), ("max", max), ("min", min)):
            assert got[i][name] == list(itertools.accumulate(values or [], op))


def test_cuts_of_a_text_in_chunks(spark):
    text = "".join(chr(97 + i % 26) if i % 5 else "\U0001d4b3\n"[i % 2] for i in range(1000))
    spans = [(0, 0), (0, 1), (0, 256), (255, 257), (256, 512), (3, 999), (1000, 1000), (990, 1000)]
    table = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a long, b long").withColumn("c", private._chunks(F.col("t")))
    assert [r.x for r in table.select(private._cut("c", F.col("a"), F.col("b")).alias("x")).collect()] == [text[a:b] for a, b in spans]


def test_long_lists_are_found_and_masked_whole(spark):
    items = [(f"user{i}@host{i % 7}.com", "[EMAIL]") if i % 3 else (f"+1 (212) 555-{1000 + i % 9000}", "[PHONE]") for i in range(30000)]
    text = " é\U0001d4b3 ".join(a for a, _ in items)
    table = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in private.find_private(table.select("doc_id", "text")).collect()}
    assert [text[s:e] for s, _, e in found[1].base] == [a for a, _ in items] and not found[2].base and not found[3].spans
    masked = {r.doc_id: r.text for r in private.mask(table).collect()}
    assert masked == {1: " é\U0001d4b3 ".join(b for _, b in items), 2: None, 3: ""}
