"""Conversation prefix trie: subtree totals by time-forward processing.

Method: every distinct sequence of first turns is a node. Nodes are sorted by reverse level order (the deepest
level first), and each sends its totals forward to its parent, through a priority queue ordered
like the nodes that writes sorted runs to disk when it grows. Two kinds of shards do this: a light
subtree (at most ``limit`` turns below its root, whose parent has more) lies wholly in one shard, and a task
goes through its sorted shards with one queue. The totals of the shard roots are summed by parent and
enter the heavy nodes above, which are sent through the same sweep. Are there more than ``limit`` of
them, then they are cut into bands of ``BAND`` levels, each band below one node being a shard; the shard roots
form a tree ``BAND`` times flatter, which is settled in the same way, and a second sweep brings its totals
into the bands.

Scale: turns are numbered, and prefixes hashed, over range partitions with one carry a range, so a
conversation with a third of all turns is spread. Nodes, member counts and messages between shards are
aggregates combined before the shuffle. Lists of conversation ids are joined to text in range
partitions and hashed piece by piece in order. A task keeps one Arrow batch and a bounded queue.

Prefixes are told apart by their length and two 64-bit hashes. Defined results: rows with a null conv_id are no
conversation; a null turn comes first, rows of one turn follow role, the text's beginning (256 code points) and
a digest of the whole; a null role or text is an empty one; repeated rows are turns of their own; a conversation may be left without turns and is then a member
of the root; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosieve.llm.tables import BROADCAST_ROWS, map_arrow, written, written_with
from geosieve.operators.spread import rank_rows, skew_join

LIMIT = 1 << 17  # nodes of a shard
LEAST = 1 << 8
BAND = 256  # levels of a shard of heavy nodes
QUEUE = 1 << 16  # messages in memory
BEGINNING = 256  # code points of a text that order rows of one turn
PIECE = 1 << 14  # ids joined to one piece of text
KEY = ["depth", "p1", "p2"]
UP = ["q1", "q2"]


class MessageQueue:
    """A priority queue of (address, sums) that keeps ``most`` entries and writes the others as sorted runs."""

    def __init__(self, most: int = QUEUE):
        self.most = most
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (head, number, rest)

    def push(self, address: tuple, sums: tuple) -> None:
        heapq.heappush(self.heap, (*address, *sums))
        if len(self.heap) > self.most:
            self._spill(len(address))

    def _spill(self, width: int) -> None:
        form = struct.Struct(f"<{len(self.heap[0])}q")
        merged: list[list[int]] = []
        for entry in sorted(self.heap):
            if merged and tuple(merged[-1][:width]) == entry[:width]:
                merged[-1][width:] = [a + b for a, b in zip(merged[-1][width:], entry[width:])]
            else:
                merged.append(list(entry))
        file = tempfile.TemporaryFile()  # without a name: gone with the task
        for entry in merged:
            file.write(form.pack(*entry))
        file.seek(0)
        rest = self._entries(file, form)
        heapq.heappush(self.runs, (next(rest), len(self.runs), rest))
        self.heap = []

    @staticmethod
    def _entries(file, form: struct.Struct) -> Iterator[tuple]:
        with file:
            while block := file.read(form.size * 1024):
                yield from form.iter_unpack(block)

    def take(self, address: tuple) -> Iterator[tuple]:
        """The sums sent to the address, which is the least of all that wait or not among them."""
        width = len(address)
        while self.heap and self.heap[0][:width] == address:
            yield heapq.heappop(self.heap)[width:]
        while self.runs and self.runs[0][0][:width] == address:
            head, number, rest = self.runs[0]
            yield head[width:]
            after = next(rest, None)
            if after is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, number, rest))


def sweep(nodes: DataFrame, parts: int, span: int = 1, queue: int = QUEUE) -> DataFrame:
    """Add to each node the totals of the nodes below it in its ``shard``.

    Nodes with ``top`` send nothing; all others have their parent, ``span`` levels above, in the same shard.
    """
    def run(batches):
        waiting = MessageQueue(queue)
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("shard", "level", "p1", "p2", "q1", "q2", "top", "kids", "leaves", "saved")}
            out: dict[str, list[int]] = {"kids": [], "leaves": [], "saved": []}
            for shard, level, p1, p2, q1, q2, top, kids, leaves, saved in zip(*cols.values()):
                for more, tips, gain in waiting.take((shard, level, p1, p2)):
                    kids, leaves, saved = kids + more, leaves + tips, saved + gain
                if not top:
                    waiting.push((shard, level + span, q1, q2), (1, leaves, saved))
                for name, value in zip(out, (kids, leaves, saved)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) if c not in out else pa.array(out[c], pa.int64()) for c in batch.schema.names],
                names=batch.schema.names)

    # The level is counted upwards, so the deepest nodes come first.
    order = ["shard", "level", "p1", "p2"]
    rows = nodes.withColumn("level", -F.col("depth"))
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    dealt = rows.repartition(parts, "shard").sortWithinPartitions(*order)
    return map_arrow(dealt, run, schema).drop("level")


def _running(turns: DataFrame) -> DataFrame:
    """Add p1, p2: the exclusive-or of t1, t2 over a conversation's turns up to each one."""
    ordered = turns.repartitionByRange("conv_id", "depth")
    placed = written(ordered.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_range", "conv_id").agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"))
    # A conversation enters a range only as its first one: one carry a range at most.
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_range", "conv_id", F.bit_xor("c1").over(earlier).alias("c1"), F.bit_xor("c2").over(earlier).alias("c2"))
    carry = carry.filter("c1 is not null")
    inside = Window.partitionBy("_range", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({p: F.bit_xor(t).over(inside) for p, t in (("p1", "t1"), ("p2", "t2"))})
    out = local.join(F.broadcast(carry), ["_range", "conv_id"], "left")
    return out.withColumns({p: F.col(p).bitwiseXOR(F.coalesce(c, F.lit(0))) for p, c in (("p1", "c1"), ("p2", "c2"))}).drop("_range", "c1", "c2")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt lengths, rebuilt turns with prefix hashes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.length(text).cast("long").alias("chars"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, F.lit(1), role).alias("h2"), role.alias("role"), F.substring(text, 1, BEGINNING).alias("begin"))
    order = [F.col("turn").asc_nulls_first(), *map(F.col, ("role", "begin", "h1", "h2"))]
    ranked = rank_rows(rows, order, within=["conv_id"], name="pos")
    ranked = written(ranked.select("conv_id", "pos", "chars", "h1", "h2"), "turns")
    sizes = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = written(sizes.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own"), "convs")
    first = ranked.filter("pos <= 5").withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "h").join(first, "base").filter("pos <= h").select(
        "conv_id", F.col("pos").alias("depth"), "chars", "h1", "h2")
    tails = skew_join(ranked, convs.select("conv_id", "h", "taken"), ["conv_id"], spread=["pos"]).filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "chars", "h1", "h2")
    turns = heads.union(tails).select(
        "conv_id", "depth", "chars", F.xxhash64("depth", "h1", "h2").alias("t1"), F.xxhash64("h2", "depth", "h1").alias("t2"))
    convs = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    return convs, _running(turns)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends): digest of the ascending, comma-joined ids that end at each node."""
    def groups(batches, fields):
        """(key, rows) of runs of equal keys; a run may go on in the next batch."""
        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(c).to_numpy() for c in KEY]
                new = np.zeros(batch.num_rows, bool)
                for c in cols:
                    new[1:] |= c[1:] != c[:-1]
                cuts = [0, *np.flatnonzero(new), batch.num_rows]
                values = batch.column(fields).to_pylist()
                for a, b in zip(cuts[:-1], cuts[1:]):
                    yield tuple(int(c[a]) for c in cols), values[a:b]

    def join(batches):
        for batch in batches:
            out = []
            for key, ids in groups([batch], "conv_id"):
                out += [(*key, part[0], ",".join(map(str, part))) for part in (ids[i:i + PIECE] for i in range(0, len(ids), PIECE))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "first", "piece"])

    def digest(batches):
        now, state = None, None
        for key, texts in groups(batches, "piece"):
            if key != now:
                if now is not None:
                    yield send(now, state)
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(texts).encode())
        if now is not None:
            yield send(now, state)

    def send(key, state):
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([state.hexdigest()])], names=[*KEY, "ends"])

    ordered = ends.select(*[F.col(c).cast("long") for c in KEY], F.col("conv_id").cast("long"))
    ordered = ordered.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = map_arrow(ordered, join, "depth long, p1 long, p2 long, first long, piece string")
    return map_arrow(joined.repartition(*KEY).sortWithinPartitions(*KEY, "first"), digest, "depth long, p1 long, p2 long, ends string")


def _messages(tops: DataFrame) -> DataFrame:
    """Sums of the totals of shard roots for the parents of these."""
    return tops.groupBy((F.col("depth") - F.col("span")).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("m_kids"), F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))


def _receive(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """Add messages to the nodes they are addressed to."""
    got = nodes.join(sums, KEY, "left")
    return got.withColumns({c: F.col(c) + F.coalesce(f"m_{c}", F.lit(0)) for c in ("kids", "leaves", "saved")}).drop("m_kids", "m_leaves", "m_saved")


def settle(nodes: DataFrame, paths: DataFrame, span: int, limit: int, band: int, queue: int) -> DataFrame:
    """Totals of nodes whose depths are multiples of ``span`` and whose parents are among them.

    ``paths``: (conv_id, depth, p1, p2) of the conversations that name the nodes.
    """
    nodes, seen = written_with(nodes, "heavy")
    if seen["rows"] <= limit:
        return sweep(nodes.withColumns({"shard": F.lit(0), "top": F.col("depth") == 0}), 1, span, queue)
    wide = span * band
    start = F.col("depth") - F.col("depth") % wide
    marks = paths.filter(F.col("depth") % wide == 0)
    named = marks.select("conv_id", F.col("depth").alias("start"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    parts = int(seen["rows"] // limit) + 1
    banded = nodes.withColumn("start", start).join(named, ["conv_id", "start"], "left")
    banded = banded.withColumns({  # the root has no turn
        "top": F.col("depth") == F.col("start"), "shard": F.pmod(F.xxhash64("start", F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0))), F.lit(1 << 30))})
    banded = written(banded.drop("start", "s1", "s2"), "bands")
    local = written(sweep(banded, parts, span, queue), "local")
    above = marks.select("conv_id", (F.col("depth") + wide).alias("depth"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    roots = local.filter("top").drop("shard", "top").join(above, ["conv_id", "depth"], "left")
    # A shard root's parent among shard roots is the one of the band above.
    flat = roots.select(*KEY, F.coalesce("a1", F.lit(0)).alias("q1"), F.coalesce("a2", F.lit(0)).alias("q2"),
                        "conv_id", "n_convs", "ends", "kids", "leaves", "saved")
    solved = settle(flat, paths, wide, limit, band, queue).select(*KEY, "leaves", "saved")
    up = local.filter("top and depth > 0").select(*KEY, *UP).join(solved, KEY).withColumn("span", F.lit(span))
    return sweep(_receive(banded, _messages(up)), parts, span, queue)


def prefix_trie(
    conversations: DataFrame, *, limit: int | None = None, band: int = BAND, queue: int = QUEUE,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    ``limit`` is by default an eighth of a task's share of the turns, from ``LEAST`` to ``LIMIT``.
    """
    convs, turns = rebuilt(conversations)
    convs = written(convs, "sizes")
    turns, facts = written_with(skew_join(turns, convs, ["conv_id"], spread=["depth"]).withColumns(
        {"q1": F.col("p1").bitwiseXOR(F.col("t1")), "q2": F.col("p2").bitwiseXOR(F.col("t2"))}).drop("t1", "t2"), "prefixes")
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = limit or LIMIT
    limit = limit or max(LEAST, min(LIMIT, facts["rows"] // (8 * tasks)))
    same = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    nodes = turns.groupBy(*KEY).agg(
        *same, F.max("chars").alias("chars"), F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("weight"), F.sum((F.col("size") == F.col("depth")).cast("long")).alias("stop"))
    none = F.lit(0).cast("long")
    root = convs.agg(*same, F.sum((F.col("size") == 0).cast("long")).alias("stop")).filter("n_convs > 0").select(
        *[none.alias(c) for c in KEY], "conv_id", "n_convs", none.alias("chars"), none.alias("q1"), none.alias("q2"),
        F.lit(1 << 62).alias("weight"), "stop")
    ends = turns.filter("depth = size").select(*KEY, "conv_id").union(
        convs.filter("size = 0").select(*[none.alias(c) for c in KEY], "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    nodes = nodes.unionByName(root).join(end_digests(ends), KEY, "left").select(
        *KEY, *UP, "conv_id", "n_convs", F.coalesce("ends", F.lit(empty)).alias("ends"),
        none.alias("kids"), (F.col("stop") == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("weight") > limit).alias("big"))
    nodes, seen = written_with(nodes, "nodes", big=F.count(F.when(F.col("big"), 1)))
    if not seen["rows"]:
        return _named(nodes)
    heavy = nodes.filter("big").drop("big")
    # The shard root of a conversation's light nodes is the first of its prefixes that is not heavy.
    paths = turns.select("conv_id", *KEY)
    light = skew_join(paths, heavy.select(*KEY), KEY, "left_anti", spread=["conv_id"], small_right=seen["big"] <= BROADCAST_ROWS)
    tops = light.groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("r")).select(
        "conv_id", F.col("r.depth").alias("from"), F.xxhash64("r.p1", "r.p2").alias("shard"))
    below = skew_join(nodes.filter("not big").drop("big"), tops, ["conv_id"], spread=["depth"])
    below = below.withColumn("top", F.col("depth") == F.col("from")).drop("from")
    parts = max(tasks, int((seen["rows"] - seen["big"]) // most) + 1)
    below = written(sweep(below, parts, 1, queue), "light")
    messages = _messages(below.filter("top").withColumn("span", F.lit(1)))
    above = settle(_receive(heavy, messages), paths, 1, most, band, queue)
    return _named(below.drop("shard", "top").unionByName(above.drop("shard", "top")))


def _named(nodes: DataFrame) -> DataFrame:
    """The result columns, with the parents' ids."""
    nodes = written(nodes, "totals")
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    met = skew_join(nodes, names, ["depth", *UP], "left", spread=["conv_id"])
    return met.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
