"""The corpus pipeline, stage by stage, against brute force on a small corpus."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_llm_brute import brute_base, brute_contamination, brute_near

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before each stage and the last result, each written and read again."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(90001, "123 456 ...", "en", "s", 11), (90002, None, None, None, None)], docs.schema)
    out = [docs.union(extra)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(i))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in d.collect()] for d in out]


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_language_drops_what_has_no_letters(steps):
    assert ids(steps[0]) - ids(steps[1]) == {90001, 90002} and len(steps[1]) == len(ids(steps[1]))


def test_near_copies_leave_one_of_each_group(steps):
    want = {root for _, root in brute_near([(r["doc_id"], r["text"]) for r in steps[1]], 5, 80, 100).values()}
    assert ids(steps[2]) == want


def test_contaminated_documents_go(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids(steps[3]) == {r["doc_id"] for r in steps[2] if not brute_contamination(r["text"], items)[3]}


def test_personal_data_is_masked_and_the_rest_stays(steps):
    before = {r["doc_id"]: r for r in steps[3]}
    assert ids(steps[4]) == set(before)
    for r in steps[4]:
        spans = brute_base(before[r["doc_id"]]["text"])
        assert not brute_base(r["text"]) and (spans or r["text"] == before[r["doc_id"]]["text"] or "[" in r["text"])
        assert list(r) == list(before[r["doc_id"]]) and r["n_chars"] == len(r["text"])


def test_tokens_decode_to_the_texts(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[4]}
    assert {r["doc_id"]: r["decoded"] for r in steps[5]} == texts and all(r["same"] for r in steps[5])


def test_near_copies_of_repeated_and_null_ids_leave_one_row_each(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    near = b + " more"
    rows = [(2, a), (1, b), (2, b), (None, b), (3, near), (4, c), (4, c), (4, c), (None, a + " x y z" * 9), (None, a + " x y z" * 9),
            (None, ""), (5, " "), (5, " "), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()), key=str)
    want = [(2, a), (1, b), (4, c), (None, a + " x y z" * 9), (None, ""), (5, " "), (5, " "), (6, None)]
    assert got == sorted(want, key=str)


def test_contaminated_documents_without_id_go(spark):
    item = max((r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()), key=len)
    rows = [(None, item), (1, item), (None, "clean words only"), (1, "clean words only")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontaminate(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "clean words only"), (1, "clean words only")]
