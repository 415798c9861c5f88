"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

Method: documents with the same shingle set form a class; a class has a MinHash signature cut into
bands, and classes that share a band are candidates. The number of bands follows from the chosen
miss probability at the threshold. A candidate's signatures are compared batch by batch: with m of
n values equal and a uniform prior, the posterior chance that the similarity reaches the threshold
t is P(Binomial(n + 1, t) <= m); below ``miss`` the pair is dropped. Survivors are confirmed on
their full shingle sets (64-bit hashes), so no link is wrong.

Scale: a bucket of g classes is never expanded into its pairs. Every member is first compared with
the bucket's least class, then with its greatest if they are still apart; after each round linked
classes are joined into components. Only buckets that still hold several components go on: members
outside the largest component are compared with the rest in blocks of bounded size, in numpy:
survivors are confirmed where they are found, so that only links between components leave the task.
There the triangle inequality on exact distances from the bucket's least class spares most pairs
that are near the threshold but below it. Pairs inside one component cannot change it, so no link between
components is lost. Exact copies collapse in a partial aggregate before anything is shuffled. Texts
are scanned twice and never shuffled; the second scan makes the sets of classes in shared buckets,
picked out by a bitmap of bounded size.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle make one shingle of all words; rows that repeat an id are
returned one by one, each with the component of its own text; a null id links with nothing, is not
kept and has a null component; an empty table gives an empty result; other columns are ignored. A
text and its arrays must fit in a task's memory (about 60 bytes a byte of text).
"""

from __future__ import annotations

import hashlib
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import U, grams, mix, pieces, raw, words
from geosieve.llm.tables import KeyBits, components, map_arrow, map_groups, written, written_with
from geosieve.llm.spark_hash import spark_long

WORD = np.ones(256, dtype=bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
# Bounds of a block in the last comparison: rows of either side, bytes of sets.
LEFT, RIGHT, BYTES = 256, 2048, 1 << 25


def banding(threshold: float, miss: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the widest bands that still miss a pair at the threshold with chance ``miss``."""
    best = None
    for rows in range(1, 33):
        bands = ceil(log(miss) / log(1 - threshold**rows))
        if best is None or bands * rows <= most:
            best = (bands, rows)
    return best


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The least number of equal values of n at which the threshold is still credible."""
    chance, m = 0.0, -1
    while chance < miss:
        m += 1
        chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
    return m


def screen(left: np.ndarray, right: np.ndarray, at_least: list[tuple[int, int]]) -> np.ndarray:
    """Rows (pairs of equal index) that survive every batch of signature values."""
    alive, matches, start = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for stop, need in at_least:
        matches = matches + (left[alive, start:stop] == right[alive, start:stop]).sum(axis=1, dtype=np.int32)
        good = matches >= need
        alive, matches, start = alive[good], matches[good], stop
    return alive


def shingle_sets(piece: pa.RecordBatch, column: str, k: int):
    """The sorted distinct shingle hashes of each row of ``piece``."""
    data, ends = raw(piece.column(column))
    _, _, hashes, first = words(data, ends, WORD)
    wide = grams(hashes, k)
    for i in range(piece.num_rows):
        n = first[i + 1] - first[i]
        if n >= k:
            yield np.unique(wide[first[i]:first[i + 1] - k + 1])
        else:
            yield grams(hashes[first[i]:first[i + 1]], int(n)) if n else np.zeros(0, U)


def signature(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    least = np.full(len(seeds), 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(values), 4096):
        block = (values[None, start:start + 4096] * seeds[:, None]) >> U(32)
        np.minimum(least, block.min(axis=1).astype(np.uint32), out=least)
    return least


def signatures(docs: DataFrame, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest, sig, keys) of each row; digest, sig and keys are null without shingles."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    band_no = np.arange(bands, dtype=U)

    def work(batches):
        for piece in pieces(batches, text_col):
            sizes, digests, sigs, keys = [], [], [], []
            for values in shingle_sets(piece, text_col, k):
                sizes.append(len(values))
                if not len(values):
                    digests.append(None), sigs.append(None), keys.append(None)
                    continue
                sig = signature(mix(values), seeds)
                parts = sig.reshape(bands, rows).astype(U)
                key = band_no.copy()
                for j in range(rows):
                    key = mix(key ^ parts[:, j])
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sigs.append(sig.tobytes())
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "sig", "keys"])

    return map_arrow(docs.select("id", text_col), work,
                     "id long, n_shingles long, digest binary, sig binary, keys array<long>")


def _full_sets(docs: DataFrame, text_col: str, k: int, needed: DataFrame, count: int) -> DataFrame:
    """(id, digest, set) of the documents whose id is in ``needed``."""
    bits = KeyBits(needed, "id", count)
    log_, shared = bits.log, bits.bits

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").fill_null(0).to_numpy()
            near = KeyBits.hits(shared.value, spark_long(ids) & U((1 << log_) - 1))
            for piece in pieces([batch.filter(pa.array(near))], text_col):
                sets = list(shingle_sets(piece, text_col, k))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in sets], pa.binary()),
                     pa.array([v.tobytes() for v in sets], pa.binary())], names=["id", "digest", "set"])

    return map_arrow(docs.select("id", text_col).filter("id is not null"), work, "id long, digest binary, set binary")


def _screened(pairs: DataFrame, sigs: DataFrame, at_least) -> DataFrame:
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                width = at_least[-1][0]
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, width) for c in ("sa", "sb"))
                yield batch.take(pa.array(screen(left, right, at_least))).select(["a", "b"])

    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), work, "a long, b long").distinct()


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, total): sizes of the intersection and union of the full sets of each pair."""
    def work(batches):
        for batch in batches:
            both, total = [], []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both.append(int((y[at] == x).sum()))
                total.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(total, pa.int64())],
                names=["a", "b", "both", "total"])

    a = sets.select(F.col("id").alias("a"), F.col("set").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("tb"))
    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb"), work, "a long, b long, both long, total long")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    return _overlap(pairs, sets).filter(F.col("both") * den >= F.col("total") * num).select("a", "b").distinct()


def _links_apart(members: DataFrame, full: DataFrame, at_least, num: int, den: int) -> DataFrame:
    """Links between members (key, id, root, away) of different roots, compared in blocks.

    ``away`` is the exact distance (1 - similarity) from the bucket's least class. Distances obey
    the triangle inequality, so members whose distances differ by more than the limit are no link.
    A block also drops pairs whose roots it has joined already.
    """
    totals = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = totals.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).filter("top.n < n")
    sized = members.join(full.select("id", F.length("set").alias("bytes")), "id")
    room = sized.groupBy("key").agg(F.sum("bytes").alias("bytes"))
    part = sized.join(tops, "key").join(room.withColumnRenamed("bytes", "all"), "key").select(
        "key", "id", "root", "away", F.col("top.root").alias("top"),
        F.ceil(F.greatest((F.col("n") - F.col("top.n")) / LEFT, F.col("all") / BYTES)).cast("int").alias("nl"),
        F.ceil(F.greatest(F.col("n") / RIGHT, F.col("all") / BYTES)).cast("int").alias("nr"))
    spot = F.xxhash64("id")
    left = part.filter("root <> top").select(
        "key", F.pmod(spot, "nl").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"),
        F.lit(0).alias("side"), "id", "root", "top", "away")
    right = part.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"), F.pmod(spot, "nr").cast("int").alias("r"),
        F.lit(1).alias("side"), "id", "root", "top", "away")
    reach = 1 - num / den + 1e-9

    def work(group):
        side = group.column("side").to_numpy()
        ids, roots, away = (group.column(c).to_numpy() for c in ("id", "root", "away"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("set")]
        size = np.array([len(x) for x in sets])
        lefts, rights = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        top, joined, links = group.column("top")[0].as_py(), roots.copy(), []
        for i in lefts:
            other = rights[(roots[rights] != roots[i]) & ((roots[rights] == top) | (ids[rights] > ids[i]))
                           & (np.abs(away[rights] - away[i]) <= reach)
                           & (np.minimum(size[rights], size[i]) * den >= np.maximum(size[rights], size[i]) * num)]
            live = other[screen(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other], at_least)]
            for j in live[np.argsort(-(sig[live] == sig[i]).sum(axis=1), kind="stable")]:
                if joined[i] == joined[j]:
                    continue
                x, y = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if both * den >= (len(x) + len(y) - both) * num:
                    links.append((ids[i], ids[j]))
                    joined[joined == joined[i]] = joined[j]
        if not links:
            return None
        a, b = np.array(links, dtype=np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = left.union(right).join(full, "id").select("key", "l", "r", "side", "id", "root", "top", "away", "sig", "set")
    return map_groups(dealt, ["key", "l", "r"], work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    num: int = 85, den: int = 100, miss: float = 1e-6, batch: int = 24) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row; linked where den * intersection >= num * union."""
    threshold = num / den
    bands, rows = banding(threshold, miss)
    width = bands * rows
    at_least = [(n, least_matches(n, threshold, miss)) for n in (*range(batch, width, batch), width)]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows_ = written(signatures(docs, "text", shingle, bands, rows), "signatures")
    classes = written(
        rows_.filter("id is not null and digest is not null").groupBy("digest")
        .agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys")), "classes")
    banded = classes.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    members = written(banded.join(shared.filter("n > 1 and lo < hi"), "key").select("key", "id", "lo", "hi").distinct(), "members")
    needed, seen = written_with(members.select("id").distinct(), "needed")
    edges = None
    if seen["rows"]:
        sigs = written(classes.join(needed, "id", "left_semi").select("id", "sig", "digest"), "sigs")
        sets = written(_full_sets(docs, "text", shingle, needed, seen["rows"]).join(
            sigs.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "sets")
        pairs = members.filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
        edges = written(_confirmed(_screened(pairs, sigs, at_least), sets, num, den), "links")
        for step in ("greatest", "rest"):
            roots = components(edges, "a", "b")
            placed = members.join(roots, members["id"] == roots["node"], "left").select(
                "key", "id", "lo", "hi", F.coalesce("root", "id").alias("root"))
            apart = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
            # A bucket of two has had its only pair compared.
            placed, open_ = written_with(
                placed.join(apart.filter("r0 < r1 and n > 2"), "key").select("key", "id", "lo", "hi", "root"), "open")
            if not open_["rows"]:
                break
            if step == "greatest":
                ends = placed.filter("id = hi").select("key", F.col("root").alias("end"))
                pairs = placed.join(ends, "key").filter("root <> end").select(F.col("id").alias("a"), F.col("hi").alias("b")).distinct()
                more = _confirmed(_screened(pairs, sigs, at_least), sets, num, den)
            else:
                known = _overlap(placed.filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct(), sets)
                known = known.select(F.col("a").alias("lo"), F.col("b").alias("id"), (1 - F.col("both") / F.col("total")).alias("away"))
                placed = placed.join(known, ["lo", "id"], "left").withColumn("away", F.coalesce("away", F.lit(0.0)))
                full = sigs.select("id", "digest", "sig").join(sets, ["id", "digest"]).select("id", "sig", "set")
                more = _links_apart(placed, full, at_least, num, den)
            more, found = written_with(more, "links")
            if found["rows"]:
                edges = edges.union(more)
    label = classes.select("digest", F.col("id").alias("class_id"))
    if edges is not None:
        roots = components(edges, "a", "b")
        label = label.join(roots, label["class_id"] == roots["node"], "left").select(
            "digest", F.coalesce("root", "class_id").alias("class_id"))
    out = rows_.select("id", "n_shingles", "digest").join(label, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
