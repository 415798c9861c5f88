"""Removal of repeated byte strings by a prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller
id. Method: suffixes are taken where the hash of the next ``GRAM`` bytes is the least of some window of
``length - GRAM + 1`` neighbours, so any shared string of ``length`` bytes holds such an anchor at the same
place on both sides. Anchors whose gram is in one text only are dropped. Each task sorts the rest of
its suffixes and sends them as front-coded runs (shared prefix length and tail). The receiving tasks
combine runs with a loser tree that keeps each head's common prefix with the last winner: heads with
different prefix lengths are ordered without looking at a byte, others are compared from the known
prefix on. The merged order comes with common prefix lengths; suffixes of one gram stand together,
and with the bytes before them give the strings shared with smaller ids.

Scale: texts are never shuffled but for those that lose bytes. Grams travel as sorted arrays (8 + 4
bytes per anchor, about one anchor in 14 bytes), combined per batch, so a passage in a third of all
documents counts once a batch. A bitmap of bounded size (16 MB) brings the repeated grams back to the
second scan; chance hits only lengthen runs, and beyond about 10**8 repeated grams it thins less and
less, which costs shuffle but no result. Copies of a whole text are settled by digest. One gram's
occurrences meet in one task (as sorted entries of about 90 bytes).

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; rows with a null
id lose nothing and count for nobody; rows that repeat an id do not count against each other; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import U, pieces, prefix_sums, raw, span_hash
from geosieve.llm.spark_hash import spark_long
from geosieve.llm.tables import KeyBits, map_arrow, map_groups, written, written_with

GRAM = 24
PART_BYTES = 1 << 24  # of gram arrays that meet in one group
HEAD = struct.Struct("<BBBqqi")  # shared prefix, tail length, left length, id, text key, position


def _slide(values: np.ndarray, run: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``run`` consecutive values."""
    out, have = values, 1
    while have * 2 <= run:
        out, have = pick(out[:-have], out[have:]), have * 2
    rest = run - have
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of all texts of a piece."""
    run = length - GRAM + 1
    n = len(data) - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n)
    hashes = span_hash(prefix_sums(data), at, at + GRAM) | U(1)
    stop = np.repeat(ends[1:], np.diff(ends))[:n]
    least = _slide(hashes, run, np.minimum)
    least[stop[:len(least)] - at[:len(least)] < length] = 0
    pad = np.zeros(run - 1, U)
    kept = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), run, np.maximum)[:n] == hashes)
    return kept, hashes[kept]


def repeated_grams(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(gram): hashes of anchors found in two different texts."""
    def gather(batches):
        for batch in batches:
            grams, keys = [np.zeros(0, U)], [np.zeros(0, np.uint32)]
            for piece in pieces([batch], "text"):
                data, ends = raw(piece.column("text"))
                at, hashes = anchors(data, ends, length)
                own = np.array([xxhash.xxh32_intdigest(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], np.uint32)
                grams.append(hashes)
                keys.append(own[np.searchsorted(ends, at, side="right") - 1])
            grams, keys = _extremes(np.concatenate(grams), np.concatenate(keys))
            part = (grams >> U(40)) % U(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=U))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)),
                 pa.array([grams[order[cuts[p]:cuts[p + 1]]].tobytes() for p in some], pa.binary()),
                 pa.array([keys[order[cuts[p]:cuts[p + 1]]].tobytes() for p in some], pa.binary())],
                names=["part", "grams", "keys"])

    def meet(group):
        grams = np.frombuffer(b"".join(group.column("grams").to_pylist()), U)
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint32)
        grams, _ = _extremes(grams, keys)
        return pa.RecordBatch.from_arrays([pa.array(grams[:-1][grams[1:] == grams[:-1]].view(np.int64))], names=["gram"])

    sent = map_arrow(docs.select("text"), gather, "part int, grams binary, keys binary")
    return map_groups(sent, ["part"], meet, "gram long")


def _extremes(grams: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram its least and its greatest text key (one entry if they are equal)."""
    if not len(grams):
        return grams, keys
    order = np.lexsort((keys, grams))
    grams, keys = grams[order], keys[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    last = np.ones(len(grams), bool)
    last[:-1] = new[1:]
    keep = new | (last & (keys != keys[np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))]))
    return grams[keep], keys[keep]


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that share ``start`` bytes."""
    most = min(len(a), len(b))
    if a[start:most] == b[start:most]:
        return most
    for i in range(start, most):
        if a[i] != b[i]:
            return i
    return most


def front_coded(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, bytes before, id, text key, position) as compressed front-coded bytes."""
    out, last = [], b""
    for suffix, left, doc, key, at in entries:
        shared = common(last, suffix, 0)
        out.append(HEAD.pack(shared, len(suffix) - shared, len(left), doc, key, at))
        out.append(suffix[shared:])
        out.append(left)
        last = suffix
    return zlib.compress(b"".join(out), 1)


def read_run(run: bytes) -> Iterator[tuple[bytes, int, tuple[bytes, int, int, int]]]:
    """(suffix, prefix shared with the one before, (left, id, text key, position)) in order."""
    data, at, last = zlib.decompress(run), 0, b""
    while at < len(data):
        shared, tail, left, doc, key, place = HEAD.unpack_from(data, at)
        at += HEAD.size
        last = last[:shared] + data[at:at + tail]
        at += tail
        yield last, shared, (data[at:at + left], doc, key, place)
        at += left


def merged(runs: list[bytes]) -> Iterator[tuple[bytes, int, tuple[bytes, int, int, int]]]:
    """All runs in order, each suffix with its common prefix with the one before.

    A loser tree: ``shared[r]`` is the prefix that run r's head has in common with the last winner on its
    path, so a longer one is the smaller head, and equal ones are compared from there.
    """
    k = len(runs)
    streams = [read_run(run) for run in runs]
    heads: list = [next(s, None) for s in streams]
    shared = [0] * k
    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; -1 and ended runs lose."""
        if a < 0 or heads[a] is None:
            return b, a
        if b < 0 or heads[b] is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        n = common(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        won, lost = play(build(2 * node), build(2 * node + 1))
        losers[node] = lost
        return won

    won = build(1) if size > 1 else (0 if k else -1)
    while won >= 0 and heads[won] is not None:
        suffix, _, entry = heads[won]
        yield suffix, shared[won], entry
        heads[won] = head = next(streams[won], None)
        shared[won] = head[1] if head is not None else 0
        node = (won + size) // 2
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2


def covered(group: list, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, text key, start, end) covered around the anchors of one gram, from (suffix, shared, entry)."""
    docs = [e[1] for _, _, e in group]
    low = min(docs)
    if low == max(docs):
        return
    if len(group) <= 8:
        for j, (_, _, (left, doc, key, at)) in enumerate(group):
            start, end = at, at
            for i, (_, _, (other, rival, _, _)) in enumerate(group):
                if rival >= doc:
                    continue
                right = min(group[x][1] for x in range(min(i, j) + 1, max(i, j) + 1))
                before = common(left, other, 0)
                if before + right >= length:
                    start, end = min(start, at - before), max(end, at + right)
            if end > start:
                yield doc, key, start, end
        return
    # Many occurrences: the least id of each string, one offset of the anchor at a time.
    distinct: dict[tuple[bytes, bytes], int] = {}
    for suffix, _, (left, doc, _, _) in group:
        distinct[suffix, left] = min(doc, distinct.get((suffix, left), doc))
    spans = {context: [0, 0, None, None] for context in distinct}
    least: list[dict] = []
    for before in range(length - GRAM + 1):
        own: dict[tuple[bytes, bytes], int] = {}
        for (suffix, left), doc in distinct.items():
            if len(left) >= before and len(suffix) >= length - before:
                string = (left[:before], suffix[:length - before])
                own[string] = min(doc, own.get(string, doc))
        least.append(own)
    del spans
    for suffix, _, (left, doc, key, at) in group:
        start, end = None, None
        for before in range(min(len(left), length - GRAM) + 1):
            if len(suffix) >= length - before and least[before][left[:before], suffix[:length - before]] < doc:
                start = at - before
                end = at - before + length if end is None else end
        if end is not None:
            yield doc, key, start, end


def shared_spans(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(id, key, start, end): byte spans of each text shared with smaller ids; ``docs`` has id, key, text."""
    grams, seen = written_with(repeated_grams(docs, length, parts), "grams")
    bits = KeyBits(grams, "gram", seen["rows"])
    log, shared = bits.log, bits.bits

    def runs(batches):
        for batch in batches:
            entries: dict[int, list] = {}
            first: dict[int, int] = {}
            ids, keys = batch.column("id").to_pylist(), batch.column("key").to_pylist()
            for doc, key in zip(ids, keys):
                if doc < first.get(key, doc + 1):
                    first[key] = doc
            row = 0
            for piece in pieces([batch], "text"):
                data, ends = raw(piece.column("text"))
                at, hashes = anchors(data, ends, length)
                near = KeyBits.hits(shared.value, spark_long(hashes) & U((1 << log) - 1))
                at, hashes = at[near], hashes[near]
                text = np.searchsorted(ends, at, side="right") - 1
                part = ((hashes >> U(40)) % U(parts)).tolist()
                whole, left_most = data.tobytes(), length - GRAM
                for a, t, p in zip(at.tolist(), text.tolist(), part):
                    key = keys[row + t]
                    if first[key] != ids[row + t]:
                        continue  # a copy of a text of this batch
                    begin, end = int(ends[t]), int(ends[t + 1])
                    entries.setdefault(p, []).append(
                        (whole[a:min(a + length, end)], whole[max(begin, a - left_most):a][::-1], ids[row + t], key, a - begin))
                row += piece.num_rows
            for own in entries.values():
                own.sort()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(entries), pa.int32()), pa.array([front_coded(e) for e in entries.values()], pa.binary())],
                names=["part", "run"])

    def combine(group):
        found, same = [], []
        for suffix, prefix, entry in merged(group.column("run").to_pylist()):
            if prefix < GRAM and same:
                if len(same) > 1:
                    found += covered(same, length)
                same = []
            same.append((suffix, prefix, entry))
        if len(same) > 1:
            found += covered(same, length)
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["id", "key", "start", "end"])

    sent = map_arrow(docs, runs, "part int, run binary")
    return map_groups(sent, ["part"], combine, "id long, key long, start long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    rows, seen = written_with(
        docs.select("id", "key", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")),
        "texts", bytes=F.coalesce(F.sum("n_bytes"), F.lit(0)))
    parts = max(12, int((seen["bytes"] or 0) // 14 * 12 // PART_BYTES))
    named = docs.filter("id is not null")
    spans = shared_spans(named, length, parts)
    whole, counted = written_with(spans.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts")), "cuts")
    bits = KeyBits(whole, "id", counted["rows"])
    log, shared = bits.log, bits.bits

    def near(batches):
        for batch in batches:
            yield batch.filter(pa.array(KeyBits.hits(shared.value, spark_long(batch.column("id").to_numpy()) & U((1 << log) - 1))))

    def cut(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                data, kept, at, removed, n = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
                end = -1
                for c in cuts:
                    if c["start"] > end:
                        kept.append(data[at:c["start"]])
                        n, end = n + 1, c["start"]
                    removed += max(0, c["end"] - end)
                    end = at = max(end, c["end"])
                kept.append(data[at:])
                out.append((removed, n, hashlib.sha256(b"".join(kept)).hexdigest()))
            removed, n, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                names=["id", "key", "n_removed", "n_spans", "kept"])

    touched = map_arrow(named, near, "id long, text string, key long").join(whole, ["id", "key"])
    cuts = map_arrow(touched.select("id", "key", "text", "cuts"), cut, "id long, key long, n_removed long, n_spans long, kept string").dropDuplicates(["id", "key"])
    first = rows.filter("id is not null").groupBy("sha").agg(F.min("id").alias("first"))
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= length)
    return rows.join(first, "sha", "left").join(cuts, ["id", "key"], "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
