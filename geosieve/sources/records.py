"""CSV records with line breaks inside quotes, read in splits.

A file is read as lines in the usual splits. Where a split begins inside a quoted field cannot be seen from the
split alone, so each split is summarised as a function: whether its end is inside quotes if its beginning is
not, and if it is. These functions are composed over the splits of a file, which tells every split how
it begins. Each split is then cut into records on its own; only the pieces of records that cross a border
between splits meet, and are put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosieve.operators.spread import BROADCAST_ROWS, materialize, materialize_with

_SPLIT = ["path", "start"]


def _scanner(sep: bytes):
    """A function of a batch of lines and the state before it: the state after each line.

    A quote opens a field only at its beginning, a doubled one is a character, and after
    the closing one all up to the separator belongs to the field.
    """
    import numpy as np
    import pyarrow.compute as pc

    def after(line: bytes, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1:at + 2] == b'"':
                    at += 2
                    continue
                inside = False
                at += 1
            elif line[at:at + 1] == b'"':
                inside = True
                at += 1
                continue
            at = line.find(sep, at)
            if at < 0:
                return False
            at += len(sep)

    def states(lines, inside: bool):
        quoted = np.flatnonzero(pc.greater(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False))
        out = np.zeros(len(lines), bool)
        done = 0
        for i in quoted.tolist():
            out[done:i] = inside
            inside = after(lines[i].as_py(), inside)
            out[i] = inside
            done = i + 1
        out[done:] = inside
        return out

    return states


def _runs(batch) -> Iterator[tuple[str, int, object]]:
    """(path, start, lines) of the splits in a batch, in order."""
    import numpy as np

    paths, starts = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
    codes = paths.indices.to_numpy()
    cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield paths.dictionary[codes[a].item()].as_py(), starts[a].item(), batch.column("line").slice(a, b - a)


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as bytes, carriage returns kept, with the split they stand in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))


def probe(lines: DataFrame, sep: str) -> tuple[DataFrame, bool, bool]:
    """One scan of the lines: (splits with their functions, all UTF-8, some record of several lines)."""
    mark = sep.encode()
    scanner, runs = _scanner, _runs

    def summarise(batches):
        import pyarrow as pa

        states = scanner(mark)
        now = None
        for batch in batches:
            for path, start, lines in runs(batch):
                if now is None or now[:2] != [path, start]:
                    if now is not None:
                        yield send(pa, now)
                    now = [path, start, False, True, True, False]
                a, b = states(lines, now[2]), states(lines, now[3])
                now[2], now[3] = bool(a[-1]), bool(b[-1])
                try:
                    lines.cast(pa.string())
                except pa.ArrowInvalid:
                    now[4] = False
                now[5] = now[5] or bool(a.any())
        if now is not None:
            yield send(pa, now)

    def send(pa, now):
        return pa.RecordBatch.from_pydict(dict(zip(("path", "start", "closed", "opened", "utf8", "breaks"), ([v] for v in now))))

    found, seen = materialize_with(
        lines.mapInArrow(summarise, "path string, start long, closed boolean, opened boolean, utf8 boolean, breaks boolean"),
        "splits", bad=F.count(F.when(~F.col("utf8"), 1)), breaks=F.count(F.when(F.col("breaks"), 1)))
    return found, not seen["bad"], bool(seen["breaks"])


def beginnings(splits: DataFrame) -> DataFrame:
    """(path, start, inside): whether each split begins inside quotes, one row a split."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A split either decides the state at its end, or keeps it, or turns it.
    fixed = F.col("closed") == F.col("opened")
    turns = F.sum((F.col("closed") & ~F.col("opened")).cast("long")).over(before)
    steps = splits.select(*_SPLIT, "closed", fixed.alias("fixed"), F.coalesce(turns, F.lit(0)).alias("turns"),
                          (F.col("closed") & ~F.col("opened")).alias("turn"))
    last = F.last(F.when(F.col("fixed"), F.struct("closed", (F.col("turns") + F.col("turn").cast("long")).alias("turns"))), True).over(before)
    steps = steps.withColumn("last", last)
    odd = (F.col("turns") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    return steps.select(*_SPLIT, (F.coalesce("last.closed", F.lit(False)) != odd).alias("inside"))


def _cut(sep: str, pieces: bool):
    """Records of each split, or the pieces of those that cross its borders.

    Kinds: 0 a whole record, 1 the end of one begun before, 2 the beginning of one, 3 a split inside one.
    """
    mark = sep.encode()
    scanner, runs = _scanner, _runs

    def run(batches):
        import numpy as np
        import pyarrow as pa

        states = scanner(mark)
        key, inside, begun, number, held = None, False, False, 0, []

        def rest():
            # What is left open at the end of a split.
            if held and pieces:
                return table([(*key, number - len(held), 2 if begun else 3, b"\n".join(held))])
            return None

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()),
                 pa.array([r[4] for r in rows], pa.binary())], names=["path", "start", "line", "kind", "record"])

        for batch in batches:
            carried = batch.column("inside")
            at = 0
            for path, start, lines in runs(batch):
                if (path, start) != key:
                    if (left := rest()) is not None:
                        yield left
                    key, number, held = (path, start), 0, []
                    inside = carried[at].as_py()
                    begun = not inside
                at += len(lines)
                ends = states(lines, inside)
                rows, done = [], 0
                # Lines that neither begin nor end inside quotes are records by themselves.
                for i in np.flatnonzero(ends | np.concatenate([[inside], ends[:-1]])).tolist():
                    if not pieces:
                        rows += [(*key, number + j, 0, r) for j, r in enumerate(lines.slice(done, i - done).to_pylist(), done)]
                    held.append(lines[i].as_py())
                    done = i + 1
                    if not ends[i]:
                        if begun != pieces:
                            rows.append((*key, number + i + 1 - len(held), 0 if begun else 1, b"\n".join(held)))
                        held, begun = [], True
                if not pieces:
                    rows += [(*key, number + j, 0, r) for j, r in enumerate(lines.slice(done).to_pylist(), done)]
                number += len(lines)
                inside = bool(ends[-1])
                if rows:
                    yield table(rows)
        if (left := rest()) is not None:
            yield left

    return run


def records(lines: DataFrame, splits: DataFrame, sep: str) -> DataFrame:
    """(path, start, line, record): all records as bytes, in the place where they begin."""
    known, seen = materialize_with(beginnings(splits), "beginnings")
    few = seen["rows"] <= BROADCAST_ROWS

    def of(chosen: DataFrame, how: str) -> DataFrame:
        if few:
            return lines.join(F.broadcast(chosen), _SPLIT, how)
        # Too many splits for every task: the lines are dealt out by split and put in order again.
        dealt = lines.withColumn("_order", F.monotonically_increasing_id()).join(chosen, _SPLIT, how)
        return dealt.repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "_order")

    shape = "path string, start long, line long, kind int, record binary"
    whole = of(known, "inner").mapInArrow(_cut(sep, False), shape)
    # Only splits that begin or end inside quotes have pieces.
    after = Window.partitionBy("path").orderBy("start")
    borders = known.withColumn("on", F.lead("inside").over(after)).filter("inside or on or on is null").drop("on")
    part = of(materialize(borders, "borders"), "inner")
    found = materialize(part.mapInArrow(_cut(sep, True), shape), "pieces")
    along = Window.partitionBy("path").orderBy("start", "line")
    named = found.withColumn("no", F.sum((F.col("kind") == 2).cast("long")).over(along))
    joined = named.groupBy("path", "no").agg(
        F.min(F.struct("start", "line")).alias("place"), F.array_sort(F.collect_list(F.struct("start", "line", "record"))).alias("parts"))
    texts = F.transform("parts", lambda p: F.hex(p["record"]))
    stitched = joined.select("path", "place.start", "place.line", F.unhex(F.array_join(texts, "0A")).alias("record"))
    return whole.select("path", "start", "line", "record").unionByName(stitched)
