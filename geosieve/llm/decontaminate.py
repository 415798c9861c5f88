"""Benchmark decontamination by winnowed fingerprints that are extended to whole shared windows.

Method: both sides are winnowed: of every run of ``window - gram + 1`` consecutive word k-grams the
one with the least hash is kept (all of them on a tie). Any shared span of ``window`` words holds
the same k-grams on both sides, so it holds a common fingerprint: no such span is missed. A hit is
then extended over the windows around it: each fingerprint carries the hashes of the up to
``window - gram + 1`` windows that cover it, and the offsets at which both sides agree are the
windows really shared. Items shorter than a window are one window each; for a length n < window
this is the same scheme with k = n and one gram per run.

Scale: texts are read once, in Arrow batches, and never shuffled. A bitmap of fixed size holds the
benchmark's fingerprints, so what leaves the scan are the few fingerprints that may match. They
meet the benchmark in a join on the fingerprint (broadcast only after counting it); covered words
are summed with window functions over one document's hits. Windows are told apart by 64-bit hashes
of 64-bit word hashes.

Defined results: a null or empty text has no words and is not contaminated; an empty benchmark hits
nothing; items without words match nothing; repeated rows of one id and text give one row, two
texts under one id give two; extra columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosieve.llm.arrays import U, grams, mix, pieces, raw, words
from geosieve.llm.spark_hash import spark_long
from geosieve.llm.tables import KeyBits, map_arrow, small, written_with

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def kept_grams(hashes: np.ndarray, first: np.ndarray, run: int) -> np.ndarray:
    """Mark the minima of every run of ``run`` consecutive grams inside one text."""
    n = len(hashes)
    if run == 1:
        return np.ones(n, dtype=bool)
    kept = np.zeros(n, dtype=bool)
    if n >= run:
        least = np.lib.stride_tricks.sliding_window_view(hashes, run).min(axis=1)
        inside = first[run - 1:] <= np.arange(n - run + 1)  # the run begins in the text it ends in
        for j in range(run):
            kept[j:n - run + 1 + j] |= inside & (hashes[j:n - run + 1 + j] == least)
    return kept


def _text_starts(ends: np.ndarray, n: int) -> np.ndarray:
    """For each word, the number of the first word of its text."""
    counts = np.diff(ends)
    return np.repeat(ends[:-1], counts)[:n]


def fingerprints(hashes: np.ndarray, first_word: np.ndarray, k: int, span: int):
    """Positions and keys of the kept k-grams, and hash and validity of all windows of ``span`` words."""
    text_start = _text_starts(first_word, len(hashes))
    gram = grams(hashes, k)
    inside = text_start[k - 1:] <= np.arange(len(gram)) if len(gram) else np.zeros(0, bool)
    wide = grams(hashes, span)
    valid = text_start[span - 1:] <= np.arange(len(wide)) if len(wide) else np.zeros(0, bool)
    # Grams that cross into the next text only lie in runs that cross too.
    kept = kept_grams(gram, text_start[k - 1:], span - k + 1) & inside
    at = np.flatnonzero(kept)
    return at, gram[at] ^ mix(np.array([k * 64 + span], dtype=U)), wide, valid


def _hits(at, wide, valid, run):
    """For each kept gram and offset, the window that starts ``offset`` words before it."""
    start = at[:, None] - np.arange(run)[None, :]
    ok = (start >= 0) & (start < len(valid))
    ok[ok] = valid[start[ok]]
    hashes = np.zeros(start.shape, dtype=U)
    hashes[ok] = wide[start[ok]]
    return ok, hashes


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(fingerprint, offset, window_hash, span, item) of all windows of all items."""
    def work(batches):
        for piece in pieces(batches, text_col):
            data, ends = raw(piece.column(text_col))
            _, _, hashes, first = words(data, ends, WORD)
            counts = np.diff(first)
            rows = _item_rows(hashes, first, np.flatnonzero(counts >= window), gram, window)
            for n in range(1, window):
                rows += _item_rows(hashes, first, np.flatnonzero(counts == n), n, n)
            key, offset, wide, span, item = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(offset.astype(np.int32)), pa.array(wide), pa.array(span.astype(np.int32)),
                 piece.column(item_col).take(pa.array(item))],
                names=["fingerprint", "offset", "window_hash", "span", "item"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    return map_arrow(
        benchmark.select(F.col(item_col), F.col(text_col)), work,
        f"fingerprint long, offset int, window_hash long, span int, item {kind}")


def _item_rows(hashes, first, items, k, span):
    out = []
    for i in items:
        own = hashes[first[i]:first[i + 1]]
        at, key, wide, valid = fingerprints(own, np.array([0, len(own)]), k, span)
        ok, found = _hits(at, wide, valid, span - k + 1)
        row, offset = np.nonzero(ok)
        out.append((key[row].view(np.int64), offset, found[row, offset].view(np.int64),
                    np.full(len(row), span), np.full(len(row), i)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 13, gram: int = 5,
                  share: int = 20) -> DataFrame:
    """Per document: id, text_key, n_words, n_hit, n_items, items (array), contaminated.

    Contaminated: at least one word hit and ``share`` * n_hit >= n_words.
    """
    items, seen = written_with(
        item_windows(benchmark, item_col, item_text_col, window, gram).distinct(), "windows",
        spans=F.collect_set(F.col("span")))
    spans = sorted(seen["spans"] or [])
    bits = KeyBits(items, "fingerprint", seen["rows"])
    log, shared = bits.log, bits.bits

    def work(batches):
        for piece in pieces(batches, text_col):
            data, ends = raw(piece.column(text_col))
            _, _, hashes, first = words(data, ends, WORD)
            found = []
            for span in spans:
                k = gram if span == window else span
                at, key, wide, valid = fingerprints(hashes, first, k, span)
                near = KeyBits.hits(shared.value, spark_long(key) & U((1 << log) - 1))
                at, key = at[near], key[near]
                ok, have = _hits(at, wide, valid, span - k + 1)
                row, offset = np.nonzero(ok)
                found.append((np.searchsorted(first, at[row], side="right") - 1, key[row].view(np.int64),
                              offset, have[row, offset].view(np.int64), at[row] - offset, np.full(len(row), span)))
            text, key, offset, have, start, span = (
                np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 6
            order = np.argsort(text, kind="stable")
            text = text[order]
            bounds = np.searchsorted(text, np.arange(piece.num_rows + 1)).astype(np.int32)
            hits = pa.StructArray.from_arrays(
                [pa.array(key[order]), pa.array(offset[order].astype(np.int32)), pa.array(have[order]),
                 pa.array(start[order] - first[text]), pa.array(span[order].astype(np.int32))],
                names=["fingerprint", "offset", "window_hash", "start", "span"])
            yield pa.RecordBatch.from_arrays(
                [piece.column(id_col), piece.column("text_key"), pa.array(np.diff(first).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(bounds), hits)],
                names=["id", "text_key", "n_words", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = map_arrow(
        docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("text_key")), work,
        f"id {kind}, text_key long, n_words long, hits array<struct<fingerprint:long,offset:int,"
              "window_hash:long,start:long,span:int>>")
    wide = scanned.select("id", "text_key", "n_words", F.explode_outer("hits").alias("h")).select(
        "id", "text_key", "n_words", "h.*")
    met = wide.join(small(items, seen["rows"]), ["fingerprint", "offset", "window_hash", "span"], "left").select(
        "id", "text_key", "n_words", "item", F.when(F.col("item").isNotNull(), F.col("start")).alias("start"),
        F.when(F.col("item").isNotNull(), F.col("span")).alias("span"))
    # A span only counts words no earlier start has covered.
    met = written_with(met.distinct(), "hits")[0]
    key = ["id", "text_key", "n_words"]
    starts = met.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("span")).alias("stop"))
    before = F.max("stop").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = starts.withColumn("fresh", F.coalesce(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0)))), F.lit(0)))
    words_hit = covered.groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = met.groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item"))).alias("items"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return words_hit.alias("a").join(named.alias("b"), same).select(
        F.col("a.id").alias(id_col), "a.text_key", "a.n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        "items", ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("a.n_words"))).alias("contaminated"))
