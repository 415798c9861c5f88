"""Token counts, prefix trie and spelling variants against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geosieve.llm import prefixes, resync, variants
from geosieve.llm.tables import read

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_bytes string, key string, plan string, k int"


# ---- token counts ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def codec():
    return resync.Codec(open(MODEL, encoding="utf-8").read())


def whole(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


ODD = ["a", "b", "the", "'s", "'re", "'", "\"", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "1", "23", "!", "<|endoftext|>", "<|", "|>",
       "endoftext", "é", "ß", "梦", "语言", "😀", "é", "٠", "...", "---", "x" * 9, "࢈", "ReallyLongWord", ".com"]


def odd_text(rng, n):
    return "".join(rng.choices(ODD, k=n))


def test_token_counts_of_short_texts(spark, library):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "word", " a  b ", *[odd_text(rng, rng.randint(1, 60)) for _ in range(300)]]
    rows = [(i, t, "x", "y", "z", 1) for i, t in enumerate(texts)] + [(None, "two words", "", "", "", 0), (3, "\n\n", "", "", "", 0)]
    got = resync.token_counts(spark.createDataFrame(rows, DOCS), MODEL).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()), whole(library, r[1])) for r in rows)
    assert collections.Counter(map(tuple, got)) == want


def test_token_counts_of_spliced_texts(spark, library):
    rng = random.Random(6)
    texts = [odd_text(rng, 400) for _ in range(40)]
    texts += ["a" * 3000, "ab" * 1500, " " * 2000, "\n" * 900 + "x", "é" * 1200, "梦" * 1500, "!" * 1000 + "<|endoftext|>" * 50, "࢈" * 700]
    texts += ["".join(rng.choices("abcdefgh", k=2500)), "'" * 800 + "s" * 800, "x" * 300 + " y" * 300 + "7" * 900, "word " * 500]
    rows = [(i // 2, t, "x", "y", "z", 1) for i, t in enumerate(texts)] + [(None, texts[0], "", "", "", 0), (0, texts[0], "", "", "", 0)]
    got = resync.token_counts(spark.createDataFrame(rows, DOCS), MODEL, chunk=100, overlap=20).collect()
    want = collections.Counter((r[0], len(r[1].encode()), whole(library, r[1])) for r in rows)
    assert collections.Counter(map(tuple, got)) == want


def test_seams_are_widened_only_when_alignment_fails(codec):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    assert resync.hard("e", " ") and resync.hard("a", "!") and not resync.hard(" ", "a") and not resync.hard("'", "s")
    assert resync.plan(250, 100, 20) == [(0, 83, 20), (83, 166, 20), (166, 250, 0)]
    assert resync.widen([(0, 83, 20), (83, 166, 20), (166, 250, 0)], {0}) == [(0, 83, 80), (83, 166, 20), (166, 250, 0)]
    assert resync.widen([(0, 83, 83), (83, 166, 20), (166, 250, 0)], {0}) == [(0, 166, 20), (166, 250, 0)]
    assert resync.splice(codec, text, [], []) is None


def test_valid_pairs_decide_the_encoding(codec):
    """Neighbours that hold make the encoding of the whole run."""
    rng = random.Random(7)
    for _ in range(300):
        word = "".join(rng.choices("abcdeinst", k=rng.randint(2, 30)))
        ids = codec.ids(word).tolist()
        assert all(codec.pair_holds(a, b) for a, b in zip(ids, ids[1:]))
        at = rng.randint(1, len(word) - 1)
        left, right = codec.ids(word[:at]).tolist(), codec.ids(word[at:]).tolist()
        assert codec.pair_holds(left[-1], right[0]) == (left + right == ids)


def test_empty_token_table(spark):
    assert resync.token_counts(spark.createDataFrame([], DOCS), MODEL).collect() == []


# ---- prefix trie -----------------------------------------------------------------------


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c in own:
        own[c].sort()
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(t[2:] for t in own.get(c - c % 100, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(seqs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def trie(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as p1", "'x' as top", "3 as pos")
    return sorted((tuple(r) for r in prefixes.prefix_trie(df, **more).collect()), key=lambda r: (r[0], r[1]))


def made_conversations():
    rng = random.Random(8)
    rows = []
    for c in [0, 1, 2, 5, 7, 99, 100, 101, 150, 199, 205, 206, 207, 208, 300, *range(301, 330), 12345678901]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é€", "", None, "long " * 9])))
    rows += [(0, 1, "user", "a")] * 3 + [(None, 0, "user", "a")]
    for c in range(400, 430):  # equal ones
        rows += [(c, t, "user", f"turn {t}") for t in range(7)]
    return rows


def test_trie_matches_brute_force(spark):
    rows = made_conversations()
    want = brute_trie(rows)
    assert trie(spark, rows) == want
    # Light shards below, few messages in memory, and heavy nodes.
    assert trie(spark, rows, limit=20, queue=3) == want


def test_trie_of_long_shared_conversations_in_bands(spark):
    rows = [(c, t, "user", f"t{t}" if t < 60 - c else f"t{t} of {c}") for c in range(6) for t in range(70)]
    assert trie(spark, rows, limit=8, band=3, queue=2) == brute_trie(rows)


def test_trie_of_given_conversations(spark):
    rows = [tuple(r) for r in read(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, []) == []


def test_queue_keeps_order_when_it_spills():
    rng = random.Random(9)
    queue, sent = prefixes.MessageQueue(4), collections.Counter()
    for _ in range(200):
        key = (rng.randint(0, 9), rng.randint(0, 3))
        queue.push(key, (1, 2))
        sent[key] += 1
    for key in sorted(sent):
        got = list(queue.take(key))
        assert (sum(g[0] for g in got), sum(g[1] for g in got)) == (sent[key], 2 * sent[key])
    assert not queue.heap and not queue.runs


# ---- spelling variants -----------------------------------------------------------------


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, least=6, times=5):
    import re

    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least and c >= times}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def made_words():
    rng = random.Random(10)
    base = ["colour", "example", "größere", "àéîõüÿ×", "aaaaaaa", "letters", "abcdefgh", "straße÷x"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, act, x = rng.randrange(len(w)), rng.randint(0, 2), rng.choice("abeéß")
                w[at:at + 1] = [] if act == 0 else [x] if act == 1 else [w[at], x]
            words.append("".join(w).title() if rng.random() < 0.1 else "".join(w))
        rows.append((i, " 中1-".join(words)))
    return rows + [(None, "colour " * 7), (3, None), (4, ""), (5, "Colour" * 9), (5, "colour " * 30), (6, "b" * 400 + " ") , (6, ("b" * 400 + " ") * 6), (7, ("b" * 401 + " ") * 5)]


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants_match_brute_force(spark):
    rows = made_words()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "'y' as form", "2 as size")
    want = brute_variants(rows)
    assert len(want) > 100 and any(r[3] for r in want)
    assert variant_rows(variants.spelling_variants(df)) == want
    # Several boxes, and boxes cut into blocks.
    assert variant_rows(variants.spelling_variants(df, box_rows=3)) == want


def test_variants_with_the_same_letters(spark):
    rng = random.Random(11)
    words = {"".join(rng.sample("aabbcdeé", 8)) for _ in range(150)}
    words |= {w[:3] + "x" + w[4:] for w in words} | {w[:5] + "y" + w[5:] for w in words}
    rows = [(i, f"{w} " * rng.randint(1, 60)) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert variant_rows(variants.spelling_variants(df, box_rows=7)) == brute_variants(rows)


def test_variants_of_given_documents(spark):
    docs = read(spark, FOLDER, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert variant_rows(variants.spelling_variants(docs)) == brute_variants(rows)
    assert variant_rows(variants.spelling_variants(docs.limit(0))) == []


def test_long_chains_of_forms(spark):
    steps = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)] + [("a", "w03")], "word string, form string")
    got = {r["word"]: r["root"] for r in variants.last_forms(steps).collect()}
    assert got == {**{f"w{i:02d}": "w20" for i in range(20)}, "a": "w20"}


def test_words_are_whole_at_slice_borders(monkeypatch):
    monkeypatch.setattr(variants, "_SLICE", 7)
    text = "abcdefghij klmnopq rstuvw " * 3 + "x" * 40
    got = collections.Counter()
    for w, n in variants.text_words(1, text, 1 << 40, 6):
        got[w] += n
    assert got == {b"abcdefghij": 3, b"klmnopq": 3, b"rstuvw": 3, b"x" * 40: 1}


# ---- segmentation lattices ---------------------------------------------------------------


def test_lattices_agree_with_word_by_word_segmentation():
    from geosieve.llm import pieces

    own, rng = pieces.load(), random.Random(12)
    own.score([-(3 + rng.random() * 14) if ok else 0.0 for ok in own.normal])
    words = [" " + "".join(rng.choices("abceinorstуж漢é😀.-", k=rng.randint(0, 9))) for _ in range(800)]
    words += ["   ", " a▁b", " ￿x", " 漢" * 20, "x" * 90]
    own._learn(set(words))
    assert all(own.known[w] == own._marked(w) for w in words)
    total, want = np.zeros(len(own.scores), np.int64), np.zeros(len(own.scores))
    raw = [w.replace(" ", pieces.MARK).encode() for w in words[:300]]
    for rows, data in pieces.by_length(raw, pieces.LONGEST):
        own.lattice.expect(data, np.full(len(rows), 3), pieces.UNIT, total)
    for word, data in zip(words[:300], raw):
        if len(data) <= pieces.LONGEST:
            for piece, share in own.expected(word).items():
                want[piece] += 3 * share
    assert np.allclose(total / pieces.UNIT, want, atol=1e-3)


def test_saved_scores_give_equal_ids_in_any_table(spark, tmp_path):
    from geosieve.llm import pieces

    rows = [(i, f"some words are here {i % 7} and there") for i in range(40)]
    learned = pieces.estimate(spark.createDataFrame(rows, "doc_id long, text string"))
    pieces.scores_table(spark, learned).write.parquet(str(tmp_path / "scores"))
    own = pieces.with_scores(spark.read.parquet(str(tmp_path / "scores")))
    other = spark.createDataFrame(rows[:3] + [(90, "quite another text"), (91, None)], "doc_id long, text string")
    found = {r.doc_id: r.tokens for r in pieces.encode(other, own=own).collect()}
    assert [found[i] for i in range(3)] == [list(np.frombuffer(learned.encode(rows[i][1]), np.int32)) for i in range(3)]
    assert found[91] is None and pieces.round_trip(other, own=own).filter("not same").count() == 0
