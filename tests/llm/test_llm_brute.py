"""Methods against brute force on small inputs."""

import hashlib
import html
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosieve.llm import html as pages
from geosieve.llm import langid, minhash, pieces, private, quality, registry, suffixes, vectors
from geosieve.llm.arrays import mix
from geosieve.llm.decontaminate import contamination
from geosieve.llm.spark_hash import spark_long
from geosieve.llm.tables import components, map_groups

FOLDER = "/root/testdata/sf0.001"


def test_hash_is_that_of_spark(spark):
    values = [0, 1, -5, 2**62, -(2**63)]
    got = spark_long(np.array(values, dtype=np.int64)).view(np.int64).tolist()
    assert got == [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").selectExpr("xxhash64(v)").collect()]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(50, 51), (51, 52), (52, 50)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)} | {50: 50, 51: 50, 52: 50}
    assert got == want


def test_groups_stay_whole_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        import pyarrow as pa

        def count(group):
            return pa.RecordBatch.from_arrays([group.column("k").slice(0, 1), pa.array([group.num_rows])], names=["k", "n"])

        df = spark.range(100).selectExpr("id % 6 as k", "id")
        got = {r["k"]: r["n"] for r in map_groups(df, ["k"], count, "k long, n long").collect()}
        assert got == {k: len(range(k, 100, 6)) for k in range(6)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---- decontamination -----------------------------------------------------------------


def brute_contamination(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(13, len(x))
        wins = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else []:
            if tuple(w[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["ab", "cd", "Ef", "g1", "é", "zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 5, 12, 13, 14, 30, 40, 0])] + [(9, None), (10, "...")]
    docs = []
    for i in range(60):
        words = rng.choices(["x", "y", "zz", "q", "r", "s"], k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items[3:8])[1].split()
            start = rng.randint(0, max(0, len(source) - 14))
            at = rng.randint(0, len(words))
            words[at:at] = source[start:start + rng.randint(10, 20)]
        docs.append((i, rng.choice([" ", "\n", "; "]).join(words), 1))
    docs += [(100, None, 1), (101, "", 1), (102, "same row", 1), (102, "same row", 1)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string, hits int"),
                        spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {d: brute_contamination(t, items) for d, t, _ in docs}
    assert len(got) == len(want)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == want[r["doc_id"]], r


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in contamination(docs, none).collect()} == {0}
    assert contamination(docs.limit(0), none).count() == 0


# ---- near-duplicate texts ------------------------------------------------------------


def brute_near(docs, k, num, den):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, k, num):
    rng = random.Random(k)
    docs = []
    for _ in range(6):  # families of copies that drift, so that links form chains and near misses
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([4, 40, 120]))]
        for _ in range(15):
            docs.append(" ".join(words))
            if rng.random() < 0.8:
                words = list(words)
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 99)}"
    docs += [None, "", "  \n", "one", "One", "two words"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=k, num=num).collect()}
    assert got == brute_near(docs, k, num, 100)


def test_near_duplicates_of_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (2, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == [(2, 2, True), (2, 2, True), (3, 2, False), (None, None, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_screening_bounds():
    bands, rows = minhash.banding(0.85, 1e-6)
    assert (1 - 0.85**rows) ** bands <= 1e-6 and bands * rows <= 128
    # The least count is the first whose posterior chance reaches the miss probability.
    m = minhash.least_matches(24, 0.85, 1e-6)
    chance = [sum(math.comb(25, j) * 0.85**j * 0.15 ** (25 - j) for j in range(x + 1)) for x in (m - 1, m)]
    assert chance[0] < 1e-6 <= chance[1]


# ---- language and quality ------------------------------------------------------------


def test_kneser_ney_sums_to_one_and_prefers_its_own():
    grams, _ = langid.trigrams(["abab abba", "baab"])
    other, _ = langid.trigrams(["xyz zyx"])
    model = langid.Model({"p": np.unique(grams, return_counts=True), "q": np.unique(other, return_counts=True)})
    for context in (0, int(grams[2]) >> 8, (97 << 8) | 98):
        logs = model.logs((np.uint32(context) << 8) | np.arange(256, dtype=np.uint32))
        assert np.allclose(np.exp2(logs).sum(axis=0), 1, atol=1e-4)
    keys, ends = langid.trigrams(["abba", "zyx", "", None, "12 !"])
    assert model.entropies(keys, ends).argmin(axis=1)[:2].tolist() == [0, 1]
    assert np.diff(ends)[2:].tolist() == [0, 0, 0]


def test_trigrams_do_not_cross_texts():
    whole, ends = langid.trigrams(["Ab, c", "é"])
    for text, start, stop in zip(["Ab, c", "é"], ends[:-1], ends[1:]):
        assert whole[start:stop].tolist() == langid.trigrams([text])[0].tolist()


def test_language_edge_cases(spark):
    rows = [(1, "der die das und", "de", True), (2, "the of and to", "en", True), (3, None, None, False), (4, "123 ...", "en", True),
            (5, "the and", None, False), (5, "the and", None, False), (None, "und der", "xx", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, train boolean")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, langid.identify(df, F.col("train")).select("doc_id", "lang_pred").collect()), key=str)
    assert got == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "en"), (5, "en"), (None, "de")]
    none = langid.identify(df.filter("not train"), F.col("train")).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]


def test_junk_labels_do_not_open_the_limit(spark):
    rng = random.Random(9)

    def prose(syllables):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(40))

    def junk():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200))

    rows = [(i, prose(["ka", "to", "mi", "sen", "ra"]), "a", True) for i in range(200)]
    rows += [(200 + i, prose(["gle", "dor", "wu", "fis", "bal"]), "b", True) for i in range(60)]
    rows += [(300 + i, junk(), "ab"[i % 2], True) for i in range(4)]
    rows += [(400 + i, prose(["ka", "to", "mi", "sen", "ra"]), None, False) for i in range(20)]
    rows += [(500 + i, junk(), None, False) for i in range(20)]
    rows += [(600 + i, prose(["czy", "prz", "szc", "\u0142uj", "\u017cec"]), None, False) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, train boolean")
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(df, F.col("train")).collect()}
    assert not any(got[i] for i in [*range(260), *range(400, 420)]) and all(got[i] for i in range(500, 520)) and all(got[i] for i in range(600, 620))


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 3, 1]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    emit, trans = rng.normal(size=offsets[-1]), rng.normal(size=(2, 2))
    good, pair = quality.marginals(emit, trans, offsets)
    want, pairs = np.zeros(len(emit)), np.zeros((2, 2))
    for a, b in zip(offsets[:-1], offsets[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([math.exp(sum(emit[a + i] * y for i, y in enumerate(p)) + sum(trans[p[i], p[i + 1]] for i in range(len(p) - 1))) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            for i, y in enumerate(p):
                want[a + i] += w * y
            for i in range(len(p) - 1):
                pairs[p[i], p[i + 1]] += w
    assert np.allclose(good, want) and np.allclose(pair, pairs)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([None, "", "\n\n", "good text here.\nmore of it.", "bad&&& bad&&& bad&&&"] * 8)],
                                 "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, None if i % 5 == 0 else int(i % 5 == 3)) for i in range(40) if i % 5 != 1] + [(3, 1), (999, 1)],
                                   "doc_id long, quality int")
    rows = quality.score_quality(docs, docs, labels).collect()
    assert len(rows) == 40 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows if r["doc_id"] % 5 == 3} == {1} and {r["predicted"] for r in rows if r["doc_id"] % 5 == 4} == {0}
    assert {r["score"] for r in quality.score_quality(docs, docs, labels.limit(0)).collect()} == {0.5}


# ---- vectors -------------------------------------------------------------------------


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for base in rng.normal(size=(12, 24)):
        for _ in range(8):
            rows.append((base + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.18])).tolist())
    rows = [(i, v, i % 2) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [1.0, None], 0), (n + 3, [float("nan")] * 24, 0), (n + 4, rows[0][1], None),
             (n + 5, rows[0][1], 0), (n + 6, [2 * x for x in rows[0][1]], 0), (n + 7, [], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
           vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), l) for i, v, l in rows if v and None not in v and l is not None and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}
    for (a, x, l), (b, y, m) in itertools.combinations(good, 2):
        if l == m and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
            links[a] += 1
            links[b] += 1
            p, q = root[a], root[b]
            root = {k: min(p, q) if v in (p, q) else v for k, v in root.items()}
    missed = sum(got[i][0] != links[i] for i in links)
    assert missed <= 0.1 * len(links) and all(got[i][0] <= links[i] for i in links)
    assert missed or got == {i: (links[i], root[i], root[i] == i) for i in links}


# ---- suffixes ------------------------------------------------------------------------


def brute_removed(docs, length):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            first[s] = min(d, first.get(s, d))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choices("abcdé \n", k=n)) for n in (49, 50, 51, 80, 200)] + ["a" * 120, "xyz" * 40]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts += ["".join(rng.choices("pqrst", k=rng.randint(0, 60))), p[cut:] if rng.random() < 0.4 else p]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[5][1]), (101, docs[5][1]), (102, ""), (103, None), (104, "short"), (105, "short")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, key int")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.remove_repeats(df).collect()}
    want = brute_removed(docs, 50)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_loser_tree_gives_order_and_common_prefixes():
    rng = random.Random(2)
    for runs in (1, 2, 3, 7):
        lists = [sorted((bytes(rng.choices(b"ab", k=rng.randint(1, 9))), b"", i, 0, 0) for i in range(rng.randint(0, 30))) for _ in range(runs)]
        got = list(suffixes.merged([suffixes.front_coded(x) for x in lists]))
        want = sorted(e[0] for x in lists for e in x)
        assert [g[0] for g in got] == want
        for (a, _, _), (b, n, _) in zip(got, got[1:]):
            assert n == len(os.path.commonprefix([a, b]))


def test_every_shared_string_holds_an_anchor():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    at, _ = suffixes.anchors(data, np.array([0, 5000]), 50)
    gaps = np.diff(at)
    assert gaps.max() <= 27 and at[0] <= 26


# ---- pages ---------------------------------------------------------------------------


def test_main_text_of_awkward_pages():
    page = ('<html><body><header>top</header><nav>menu</nav><div class="cookie-banner">cookies</div><main><article><h1>T &amp; x</h1>'
            '<p>a<br>b <b>c<p>d &nbsp; e<ul><li>f<li>g</ul><aside>side</aside><form>form</form><script>var a="</p>";</script>'
            '<!-- no --><section class="comments"><article>reply</article></section><p title="x>y">h</article></main><footer>end</footer>')
    assert pages._kept(page, set()) == "T & x\na b c\nd e\nf\ng\nh"
    assert pages._kept("plain &lt;text&gt; <b>only", set()) == "plain <text> only"
    assert pages._kept("<script>never closed", set()) == "" and pages._kept("<p>", set()) == ""


def test_repeated_parts_of_a_host_go(spark):
    rows = [(i, "http://Host.example/x", f"<div>{i} words of page {i}</div><div class=strip>Always the same strip</div>") for i in range(12)]
    rows += [(20, None, "<p>no host"), (21, "u", None), (22, "u", ""), (0, rows[0][1], rows[0][2])]
    got = sorted(map(tuple, pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
                     .select("page_id", "text", "n_chars").collect()))
    want = [(i, f"{i} words of page {i}", len(f"{i} words of page {i}")) for i in range(12)]
    assert got == sorted(want + [want[0], (20, "no host", 7), (21, "", 0), (22, "", 0)])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_articles_of_the_pages_table(spark):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in registry.QUERIES["op7_main_text"](spark, FOLDER).collect():
        article = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1].replace("<br>", " ")
        found = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in found if b)


# ---- personal data -------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-"), "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(6)
    bits = ["a.b@c.d", "x@y", "1.2.3.4", "256.1.1.1", "001.2.3.04.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (938) 555-1226", "+12",
            "a@b.c_x@d.e", "é", "\n", " ", "-", "😀", "+", "@", "12-", "name [at] mail dot", "joe [at] mail [dot] com", "tel 555-123-4567 "]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(300)] + [None, "", "9" * 20000, "a" * 20000 + "@b.c", "1." * 9000, "1 " * 9000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in private.find_private(df).collect():
        assert [(s["s"], s["k"], s["e"]) for s in r["base"]] == brute_base(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_labelers_add_planted_spans_and_mask_them(spark):
    rows = [(i, f"word tel (212) 555-{1000 + i} more") for i in range(40)] + [(100 + i, f"mail joe{i} [at] host [dot] com now") for i in range(40)]
    rows += [(200 + i, f"call +1 212 555 {1000 + i} ok") for i in range(40)] + [(300 + i, f"version {1000 + i} page {i}") for i in range(40)]
    rows += [(400 + i, f"id 411111111111{1110 + i} x") for i in range(40) if not luhn(f"411111111111{1110 + i}")]
    df = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, spans string")
    masked = {r["doc_id"]: r for r in private.mask(df).collect()}
    assert all(r["spans"] == "keep" for r in masked.values())
    assert masked[205]["text"] == "call [PHONE] ok" and masked[305]["text"] == "version 1005 page 5"
    assert masked[5]["text"] == "word tel [NUMBER] more" and masked[105]["text"] == "mail [CONTACT] now"
    assert all("[" not in r["text"] for i, r in masked.items() if i >= 300)
    assert private.mask(df.limit(0)).count() == 0


# ---- pieces --------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isfile(pieces.MODEL), reason="no vocabulary")
def test_segmentation_is_best_and_decodes(spark):
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load()
    known = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    def brute(text):
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max([best[b] + known[text[b:end]] for b in range(end) if text[b:end] in known] + [best[end - 1] + own.least]
                            if text[end - 1:end] not in known else [best[b] + known[text[b:end]] for b in range(end) if text[b:end] in known]))
        return best[-1]

    rng = random.Random(0)
    texts = ["".join(rng.choices("abthe  ñé中\n.x0😀", k=rng.randint(1, 14))) for _ in range(200)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), np.int32).tolist()
        raw = bytes(int(model.id_to_piece(i)[3:5], 16) for i in ids if model.is_byte(i))
        score = sum(model.get_score(i) for i in ids if not model.is_byte(i)) + own.least * len(raw.decode())
        assert own.decode(ids) == text and abs(score - brute(" ".join(["", text]).replace(" ", pieces.MARK))) < 1e-6
    texts += ["a▁b", "￿ x", "  two  ", " ", "", None, "x" * 5000, "a b " * 3000]
    rows = pieces.round_trip(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")).collect()
    assert all(r["same"] and r["decoded"] == texts[r["doc_id"]] for r in rows)
    assert [r["tokens"] for r in rows if texts[r["doc_id"]] is None] == [None]
    again = pieces.decode(pieces.encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["tokens"], r["decoded"]) for r in again} == {r["doc_id"]: (r["tokens"], r["decoded"]) for r in rows}


@pytest.mark.skipif(not os.path.isfile(pieces.MODEL), reason="no vocabulary")
def test_scores_are_learned_from_all_texts(spark):
    texts = ["language model training data", "The government announced", "the model of the data", None, "", "a▁b ￿ 中 x  y"] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pieces.round_trip(docs).collect()}
    assert [rows[i]["n_tokens"] for i in (0, 1, 2)] == [4, 3, 5] and all(r["same"] for r in rows.values())
    own = pieces.estimate(docs)
    assert abs(sum(math.exp(s) for s, ok in zip(own.scores, own.normal) if ok) - 1) < 1e-9
    assert -40 < own.least < 0 and -1e6 < pieces.load().least and pieces.load().ranked() and not own.ranked()


@pytest.mark.skipif(not os.path.isfile(pieces.MODEL), reason="no vocabulary")
def test_expected_pieces_match_all_segmentations():
    own = pieces.load()
    rng = random.Random(4)
    own.score([rng.uniform(-9, -1) for _ in own.scores])
    names = {own.bytes[i].decode(): i for i in range(len(own.scores)) if own.normal[i]}

    def splits(text):
        if not text:
            yield []
        for end in range(1, len(text) + 1):
            if text[:end] in names or end == 1:
                yield from ([names.get(text[:end], -1), *rest] for rest in splits(text[end:]))

    for word in (" the", "  and", "ations", " é😀n"):
        ways = list(splits(word))
        chances = [math.exp(sum(own.scores[i] if i >= 0 else own.least for i in w)) for w in ways]
        want = {}
        for w, c in zip(ways, chances):
            for i in w:
                if i >= 0:
                    want[i] = want.get(i, 0) + c / sum(chances)
        got = own.expected(word)
        assert all(abs(got.get(i, 0) - n) < 1e-6 for i, n in want.items()) and set(got) <= set(want)


def test_double_array_finds_its_words():
    rng = random.Random(5)
    words = {bytes(rng.choices(b"abc\xff", k=rng.randint(1, 6))): i for i, _ in enumerate(range(300))}
    trie = pieces.Trie(words)

    def look(word):
        node = 0
        for byte in word:
            nxt = trie.base[node] + byte
            if trie.check[nxt] != node or nxt == 0:
                return -1
            node = nxt
        return trie.value[node]

    assert all(look(w) == i for w, i in words.items())
    assert all(look(bytes(w)) == words.get(bytes(w), -1) for w in itertools.product(b"abc", repeat=4))


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(1 << 16, dtype=np.uint64)
    assert len(np.unique(mix(x))) == len(x)
