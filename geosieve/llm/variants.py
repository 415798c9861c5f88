"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

Method: a word is the vector of its letter counts. A replaced letter lowers one count and raises another by
one (L1 distance two), an inserted letter raises one. For each word length the vectors are split
by a k-d tree (one letter, one threshold a node). A word looks for partners of its own length and of the next
length: it goes down the tree with at most one raised and one lowered count left to spend, so a box
is entered only if it lies within that reach. Of two words of one length only the one whose letter is the
greater looks, so a pair is met once. Inside a box the tree goes on, and in its small boxes the order
of the letters is compared.

Scale: words are counted per Arrow batch before the shuffle. The upper tree is fitted on the driver on at most
``SAMPLE`` words; every word is then placed in one box of it as a member and in all boxes within reach
as a query. A box with more members than ``box_rows`` or more queries than ``QUERIES`` times that is cut into
blocks, each block of members meeting each block of queries, so a task holds a bounded number
of words even if they all have the same letters. Links leave a box as a count and the best partner of each
word. Chains of forms rise fivefold each step, so they are followed by doubling in a few rounds.

Defined results: a null text has no words, an empty one neither; a null id counts as an empty one in the
deletion rule; texts are taken in slices cut outside of words, so their length does not matter; repeated rows
count again; among partners of equal number the least word by code points is the form; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import raw
from geosieve.llm.tables import map_arrow, map_groups, written, written_with

SAMPLE = 1 << 17  # words on which the upper trees are fitted
BOX_ROWS = 1 << 15  # members of a box of the upper tree
BOX_BYTES = 1 << 24
QUERIES = 16
FLUSH = 400_000  # distinct words of a batch that are counted before they are sent
_SLICE = 1 << 20
_LEAF = 24  # members of a box whose words are compared

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
# Latin-1 bytes: A-Z lower-cased, letters kept, all others a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_DIM = np.zeros(256, np.int16)
_DIM[97:123] = np.arange(26)
_DIM[192:] = np.arange(26, 90)
DIMS = 90


def _slices(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        stop = min(at + _SLICE, len(text))
        run = _RUN.match(text, stop) if stop < len(text) else None
        stop = run.end() if run else stop
        yield text[at:stop]
        at = stop


def text_words(doc_id, text: str, every: int, least: int) -> Iterator[tuple[bytes, int]]:
    """Words (Latin-1, at least ``least`` letters) of one text with their numbers, after the deletions."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in _slices(text):
        for run, n in Counter(part.encode("latin-1", "replace").translate(_FOLD).split()).items():
            if len(run) < least:
                continue
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least:
                    continue
            yield run, n


def word_counts(docs: DataFrame, every: int = 199, least: int = 6, times: int = 5) -> DataFrame:
    """(word, n) of the words of at least ``least`` letters with ``times`` occurrences or more."""
    def send(total):
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["word", "n"])

    def run(batches):
        total: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                for word, n in text_words(doc_id.as_py(), text.as_py(), every, least):
                    total[word] = total.get(word, 0) + n
                    if len(total) >= FLUSH:
                        yield send(total)
                        total = {}
        yield send(total)

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    counts = map_arrow(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= times)


def letters(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words given as rows of Latin-1 bytes."""
    m, size = codes.shape
    flat = np.arange(m, dtype=np.int64)[:, None] * DIMS + _DIM[codes]
    return np.bincount(flat.ravel(), minlength=m * DIMS).reshape(m, DIMS).astype(np.uint8 if size < 256 else np.int32)


def best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """The (letter, threshold) that halves the vectors most evenly; None if all are equal."""
    best, found = 0.0, None
    for t in (0, 1, 2):
        share = (counts <= t).mean(axis=0)
        even = np.minimum(share, 1 - share)
        k = int(even.argmax())
        if even[k] > best:
            best, found = even[k], (k, t)
    if found is None:
        wide = np.flatnonzero(counts.min(axis=0) != counts.max(axis=0))
        if len(wide):
            k = int(wide[0])
            found = k, int(max(counts[:, k].min(), min(np.median(counts[:, k]), counts[:, k].max() - 1)))
    return found


def grow(counts: np.ndarray, most: float, leaf: Iterator[int]):
    """A tree of (letter, threshold, left, right) whose leaves (numbers) hold at most ``most`` rows."""
    split = best_split(counts) if len(counts) > max(most, 1) else None
    if split is None:
        return next(leaf)
    left = counts[:, split[0]] <= split[1]
    return (*split, grow(counts[left], most, leaf), grow(counts[~left], most, leaf))


class Reach:
    """Queries on their way down: which count was raised and which was lowered to get here."""

    def __init__(self, counts: np.ndarray, lower: bool, rows=None, up=None, down=None):
        self.counts, self.lower = counts, lower
        n = len(counts)
        self.rows = np.arange(n) if rows is None else rows
        self.up = np.full(n, -1, np.int16) if up is None else up
        self.down = np.full(n, -1, np.int16) if down is None else down

    def __len__(self) -> int:
        return len(self.rows)

    def parts(self, k: int, t: int) -> tuple[Reach, Reach]:
        """Those that can have partners at or below the threshold, and above it."""
        value = self.counts[self.rows, k].astype(np.int64)
        value += (self.up == k).astype(np.int64) - (self.down == k)
        here = value <= t
        free = (self.up != k) & (self.down != k)
        rises = here & (value == t) & free & (self.up < 0)
        # Partners raise a letter before the one they lower.
        rises &= (self.down < 0) | (k < self.down)
        falls = ~here & (value == t + 1) & free & (self.down < 0) & ((self.up < 0) | (self.up < k)) & self.lower
        out = []
        for stay, cross, name in ((here, falls, "down"), (~here, rises, "up")):
            rows = np.concatenate([self.rows[stay], self.rows[cross]])
            up = np.concatenate([self.up[stay], self.up[cross]])
            down = np.concatenate([self.down[stay], self.down[cross]])
            (up if name == "up" else down)[int(stay.sum()):] = k
            out.append(Reach(self.counts, self.lower, rows, up, down))
        return out[0], out[1]


def boxes(tree, reach: Reach) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, queries) of all leaves within reach."""
    if not len(reach):
        return
    if not isinstance(tree, tuple):
        yield tree, reach.rows
        return
    k, t, left, right = tree
    below, above = reach.parts(k, t)
    yield from boxes(left, below)
    yield from boxes(right, above)


def homes(tree, counts: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    out = np.zeros(len(counts), np.int64)

    def place(node, rows):
        if not isinstance(node, tuple):
            out[rows] = node
            return
        k, t, left, right = node
        low = counts[rows, k] <= t
        place(left, rows[low])
        place(right, rows[~low])

    place(tree, np.arange(len(counts)))
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) in which b has one letter more or one lesser letter instead of another."""
    size = a.shape[1]
    step = max(1, (1 << 21) // max(1, len(b) * b.shape[1]))
    found = []
    for at in range(0, len(a), step):
        x = a[at:at + step, None, :]
        if b.shape[1] == size:
            near = ((x != b[None]).sum(axis=2) == 1) & (b.sum(axis=1, dtype=np.int64)[None] < x.sum(axis=2, dtype=np.int64))
        else:
            head, tail = x == b[None, :, :-1], x[:, :, ::-1] == b[None, :, :0:-1]
            same = head.all(axis=2)
            near = same | (head.argmin(axis=2) + np.where(tail.all(axis=2), size, tail.argmin(axis=2)) >= size)
        i, j = np.nonzero(near)
        found.append((i + at, j))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int),) * 2


def search(members: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, member) of one box, by a k-d tree below it."""
    counts = letters(members)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def descend(rows: np.ndarray, reach: Reach) -> None:
        if not len(reach) or not len(rows):
            return
        split = best_split(counts[rows]) if len(rows) > _LEAF else None
        if split is None:
            for at in range(0, len(rows), 4096):
                some = rows[at:at + 4096]
                i, j = one_edit(queries[reach.rows], members[some])
                found.append((reach.rows[i], some[j]))
            return
        low = counts[rows, split[0]] <= split[1]
        below, above = reach.parts(*split)
        descend(rows[low], below)
        descend(rows[~low], above)

    descend(np.arange(len(members)), Reach(letters(queries), members.shape[1] == queries.shape[1]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def room(size: int, box_rows: int) -> int:
    """Members of a box for words of ``size`` letters."""
    return max(1, min(box_rows, BOX_BYTES // size))


def _trees(words: DataFrame, box_rows: int) -> dict[int, object]:
    """A tree for each word length; leaves are numbered through."""
    sizes = {r["size"]: r["n"] for r in words.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = sorted(s for s, n in sizes.items() if n > room(s, box_rows))
    some: dict[int, list[bytes]] = {s: [] for s in wide}
    if wide:
        total = sum(sizes[s] for s in wide)
        share = min(1.0, SAMPLE / total)
        picked = words.filter(F.col("size").isin(wide)).filter(
            F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else words.filter(F.col("size").isin(wide))
        for r in picked.select("word", "size").toLocalIterator():
            some[r["size"]].append(r["word"].encode("latin-1"))
    leaf = iter(range(1 << 62))
    trees: dict[int, object] = {}
    for size in sorted(sizes):
        if some.get(size):
            codes = np.frombuffer(b"".join(some[size]), np.uint8).reshape(-1, size)
            trees[size] = grow(letters(codes), room(size, box_rows) * len(codes) / sizes[size], leaf)
        else:
            trees[size] = next(leaf)
    return trees


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, words as rows of bytes) of each word length of a batch."""
    data, ends = raw(pa.array([w.encode("latin-1") for w in batch.column("word").to_pylist()], pa.binary()))
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, data[ends[rows][:, None] + np.arange(size)]


def _placed(trees, size: int, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(leaf, kind, rows): kind 0 members, 1 queries of the same length, 2 shorter queries."""
    counts = letters(codes)
    own = homes(trees[size], counts)
    order = np.argsort(own, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        yield int(own[rows[0]]), 0, rows
    for kind, tree in ((1, trees[size]), (2, trees.get(size + 1))):
        if tree is not None:
            for leaf, rows in boxes(tree, Reach(counts, kind == 1)):
                yield leaf, kind, rows


def links(words: DataFrame, box_rows: int = BOX_ROWS) -> DataFrame:
    """(word, n_near, form, form_n): number of words one edit away, and the most frequent of them."""
    spark = words.sparkSession
    words = words.withColumn("size", F.length("word"))
    trees = spark.sparkContext.broadcast(_trees(words, box_rows))

    def count(batches):
        for batch in batches:
            for size, _, codes in _groups(batch):
                seen = [(leaf, kind, size + (kind == 2), len(rows)) for leaf, kind, rows in _placed(trees.value, size, codes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s[0] for s in seen], pa.int64()), pa.array([s[1] > 0 for s in seen], pa.bool_()),
                     pa.array([s[2] for s in seen], pa.int32()), pa.array([s[3] for s in seen], pa.int64())],
                    names=["leaf", "asks", "size", "n"])

    sums = map_arrow(words.select("word"), count, "leaf long, asks boolean, size int, n long").groupBy("leaf", "asks", "size").agg(F.sum("n").alias("n"))
    most = F.greatest(F.lit(1), F.least(F.lit(box_rows), F.floor(F.lit(BOX_BYTES) / F.col("size"))))
    most = F.when(F.col("asks"), most * QUERIES).otherwise(most)
    # Boxes above their size: at most (words / box_rows) of them, and as many again for queries.
    cut = {(r["leaf"], r["asks"]): r["n"] for r in sums.select(
        "leaf", "asks", F.ceil(F.col("n") / most).cast("int").alias("n")).filter("n > 1").collect()}
    blocks = spark.sparkContext.broadcast(cut)

    def deal(batches):
        for batch in batches:
            numbers = batch.column("n").to_numpy()
            for size, at, codes in _groups(batch):
                for leaf, kind, rows in _placed(trees.value, size, codes):
                    mine = blocks.value.get((leaf, kind > 0), 1)
                    others = blocks.value.get((leaf, kind == 0), 1)
                    own = np.array([zlib.crc32(c.tobytes()) % mine for c in codes[rows]]) if mine > 1 else np.zeros(len(rows), int)
                    for other in range(others):
                        block = own * others + other if kind == 0 else other * mine + own
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), leaf)), pa.array(block.astype(np.int32)),
                             pa.array(np.full(len(rows), kind, np.int8)), pa.array(list(map(bytes, codes[rows])), pa.binary()),
                             pa.array(numbers[at[rows]])],
                            names=["leaf", "block", "kind", "code", "n"])

    def meet(group):
        kind, n = group.column("kind").to_numpy(), group.column("n").to_numpy()
        data, ends = raw(group.column("code"))
        home = np.flatnonzero(kind == 0)
        a, b = [], []
        if len(home):
            shape = lambda rows: data[ends[rows][:, None] + np.arange(ends[rows[0] + 1] - ends[rows[0]])]
            members = shape(home)
            for k in (1, 2):
                rows = np.flatnonzero(kind == k)
                if len(rows):
                    i, j = search(members, shape(rows))
                    a += [rows[i], home[j]]
                    b += [home[j], rows[i]]
        if not a or not sum(map(len, a)):
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        words = np.array([x.decode("latin-1") for x in group.column("code").to_pylist()], object)
        # The partners of each word, the most frequent and then the least one first.
        who, name = words[a], words[b]
        order = np.lexsort((name, -n[b], who))
        who, name, number = who[order], name[order], n[b][order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(who[first], pa.string()), pa.array(np.diff(np.append(first, len(who))), pa.int64()),
             pa.array(number[first], pa.int64()), pa.array(name[first], pa.string())],
            names=["word", "k", "form_n", "form"])

    dealt = map_arrow(words.select("word", "n"), deal, "leaf long, block int, kind byte, code binary, n long")
    met = map_groups(dealt, ["leaf", "block"], meet, "word string, k long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return met.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def last_forms(steps: DataFrame) -> DataFrame:
    """(word, root): follow (word, form) to the last form, doubling the steps each round."""
    now, seen = written_with(steps.select("word", F.col("form").alias("root")), "roots")
    while seen["rows"]:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved, seen = written_with(
            now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")),
            "roots", went=F.count(F.when(F.col("went"), 1)))
        now = moved.select("word", "root")
        if not seen["went"]:
            break
    return now


def spelling_variants(
    docs: DataFrame, *, every: int = 199, least: int = 6, times: int = 5, ratio: int = 5, box_rows: int = BOX_ROWS,
) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text).

    A form is the most frequent word one edit away if it is ``ratio`` times as frequent.
    """
    words = written(word_counts(docs, every, least, times), "words")
    near = written(links(words, box_rows), "near")
    all_ = words.join(near, "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    all_ = written(all_.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "variants")
    roots = last_forms(all_.filter("form is not null"))
    return all_.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
