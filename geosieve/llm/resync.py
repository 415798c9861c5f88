"""Token counts of byte-level BPE: huge texts in overlapping chunks that are spliced where it is proven.

Method: a text of more than ``CHUNK`` code points is cut into equal chunks, and each chunk is encoded
with an overlap into the next one. In the overlap both encodings have token boundaries, placed by
summing the byte lengths of the tokens. They are spliced at a common boundary that is proven:

* hard: the character before it is no white space and the one after it is of another class (letter,
  digit, other, white space), an apostrophe before a letter excepted. The splitting pattern ends a match
  there whatever stands around, so both sides are encoded as if alone;
* valid pair: the whole overlap is one run of one class, and the token before the boundary and the
  token after it encode to themselves when encoded together. A sequence of BPE tokens is the
  encoding of its text if and only if that holds for all neighbours.

If an overlap has no such boundary it is widened fourfold, and when it would pass the next chunk both become
one. Chunks are rows of their own, so the chunks of one text are encoded by many tasks.

Shorter texts are cut at hard boundaries before white space, and a task remembers the count of up to
``REMEMBERED`` segments; that saves time and changes nothing.

Defined results: a null text has no tokens and no bytes; an empty one likewise. Every row gives
one row, also repeated ones and those with a null id. Special strings are single tokens, as by
default in the library. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import pieces
from geosieve.llm.tables import map_arrow, map_groups, small, written, written_with

CHUNK = 1 << 16  # code points; a longer text is cut
OVERLAP = 512  # code points, at first
REMEMBERED = 300_000
_LONG = 64  # longer segments are not remembered

_SPACE = " \t\n\r"
# White space besides those: a cut right after one of them is not hard.
_ODD = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:(?<=[{_ODD}])[{_SPACE}]+[^{_SPACE}]*)*|[{_SPACE}]+")


class Codec:
    """The library's tokenizer, built once a task, with the byte length of every token."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)  # one letter of the byte alphabet a byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.lengths[i] = len(token.content.encode())
        self.counts: dict[str, int] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def pair_holds(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when encoded together."""
        both = self.tokenizer.id_to_token(a) + self.tokenizer.id_to_token(b)
        return [t.id for t in self.tokenizer.model.tokenize(both)] == [a, b]

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of texts, each segment between hard boundaries encoded once."""
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        cut = [_SEGMENT.findall(t) for t in texts]
        new = list({s for row in cut for s in row if s not in self.counts})
        fresh = {s: len(e.ids) for s, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
        known = self.counts
        known.update((s, n) for s, n in fresh.items() if len(s) <= _LONG)
        if all(s in known for s in fresh):
            return [sum(map(known.__getitem__, row)) for row in cut]
        return [sum(known[s] if s in known else fresh[s] for s in row) for row in cut]


def check_model(model: str) -> None:
    """Refuse files for which the proofs above do not hold."""
    made = json.loads(model)
    first, core = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = (first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
             and core.get("type") == "BPE" and not core.get("ignore_merges") and not core.get("dropout")
             and not made.get("normalizer"))
    if not plain:
        raise ValueError("only byte-level BPE without normaliser and prefix space can be spliced")


def _kind(char: str) -> str:
    """Class of a character in the splitting pattern; '' if other versions of Unicode may differ."""
    if char in _SPACE or re.match(f"[{_ODD}]", char):
        return "space" if not "\x1c" <= char <= "\x1f" else ""
    name = unicodedata.ucd_3_2_0.category(char)
    return "" if name == "Cn" else {"L": "letter", "N": "digit"}.get(name[0], "other")


def hard(before: str, after: str) -> bool:
    """Whether a match of the splitting pattern always ends between the two characters."""
    a, b = _kind(before), _kind(after)
    return bool(a and b) and a != "space" and a != b and not (before == "'" and b == "letter")


def splice(codec: Codec, over: str, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int | None:
    """A proven common boundary of two encodings, in bytes from the start of the overlap ``over``.

    ``left`` and ``right``: (start, id) of their tokens near the overlap.
    """
    to_char = {0: 0}
    size = 0
    for i, char in enumerate(over):
        size += len(char.encode())
        to_char[size] = i + 1
    starts = {p: t for p, t in right}
    shared = []
    for (_, token), (at, _) in zip(left, left[1:]):
        if at in starts and 0 < at < size and at in to_char:
            shared.append((at, token, starts[at]))
    # From the middle outwards: far from both ends of the overlap.
    shared.sort(key=lambda s: (abs(2 * s[0] - size), s[0]))
    for at, _, _ in shared:
        char = to_char[at]
        if hard(over[char - 1], over[char]):
            return at
    kinds = {_kind(c) for c in over}
    if len(kinds) == 1 and "" not in kinds:
        for at, a, b in shared:
            if at > 8 and codec.pair_holds(a, b):
                return at
    return None


def plan(n: int, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap to the right) of equal chunks of a text."""
    parts = max(1, -(-n // chunk))
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, b, min(overlap, n - b)) for a, b in zip(cuts[:-1], cuts[1:])]


def widen(chunks: list[tuple[int, int, int]], failed: set[int]) -> list[tuple[int, int, int]]:
    """Chunks after the seams ``failed`` (chunk numbers left of them) got a wider overlap or closed."""
    out: list[tuple[int, int, int]] = []
    closed = False
    for i, (start, end, over) in enumerate(chunks):
        if closed:
            start = out.pop()[0]
        closed = False
        if i in failed:
            room = chunks[i + 1][1] - chunks[i + 1][0]
            closed, over = over >= room, min(4 * over, room)
        out.append((start, end, over))
    return out


_FACTS = [("key", pa.string()), ("k", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("over", pa.int32()),
          ("before", pa.int32()), ("last", pa.bool_())]
_CUT = pa.schema([*_FACTS, ("piece", pa.string())])
_LIST = pa.list_(pa.struct([("at", pa.int32()), ("id", pa.int32())]))
_ENCODED = pa.schema([*_FACTS, ("n", pa.int64()), ("head", _LIST), ("tail", _LIST), ("text", pa.string())])
_SPLICED = pa.schema([
    ("key", pa.string()), ("n_tokens", pa.int64()),
    ("plan", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("over", pa.int32())])))])
_CHUNK = "key string, k int, start int, stop int, over int, before int, last boolean"
_TOKENS = "array<struct<at:int,id:int>>"


def _cut(chunk: int, overlap: int):
    """Rows of chunks from rows of texts (with a plan, or null for the first one)."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                key, text = batch.column("key")[row].as_py(), batch.column("text")[row].as_py()
                given = batch.column("plan")[row].as_py()
                chunks = [(c["start"], c["stop"], c["over"]) for c in given] if given else plan(len(text), chunk, overlap)
                for k, (start, stop, over) in enumerate(chunks):
                    before = chunks[k - 1][2] if k else 0
                    yield pa.RecordBatch.from_pylist([dict(
                        key=key, k=k, start=start, stop=stop, over=over, before=before, last=k + 1 == len(chunks),
                        piece=text[start:stop + over])], schema=_CUT)
    return run


def _encode(model):
    """Encode chunks: token count, and the tokens near both ends."""
    def run(batches):
        codec = None
        for batch in pieces(batches, "piece"):
            codec = codec or Codec(model.value)
            rows = batch.to_pylist()
            for row in rows:
                piece = row.pop("piece")
                ids = codec.ids(piece)
                at = np.concatenate([[0], np.cumsum(codec.lengths[ids])])
                core = row["stop"] - row["start"]
                seam = len(piece[:core].encode())
                stop = int(np.searchsorted(at, len(piece[:row["before"]].encode()), side="right"))
                first = max(0, int(np.searchsorted(at, seam)) - 1)
                pairs = lambda a, b, shift: [dict(at=int(at[i]) - shift, id=int(ids[i])) for i in range(a, min(b, len(ids)))]
                row |= dict(n=len(ids), head=pairs(0, stop, 0), tail=pairs(first, len(ids), seam),
                            text=piece[core:] if not row["last"] else "")
            yield pa.RecordBatch.from_pylist(rows, schema=_ENCODED)
    return run


def _splice(model):
    """All seams of one text: its token count, or the plan of the next round."""
    codec: list[Codec] = []

    def run(group):
        if not codec:
            codec.append(Codec(model.value))
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        total, failed = sum(r["n"] for r in rows), set()
        for a, b in zip(rows, rows[1:]):
            left = [(t["at"], t["id"]) for t in a["tail"]]
            right = [(t["at"], t["id"]) for t in b["head"]]
            at = splice(codec[0], a["text"], left, right)
            if at is None:
                failed.add(a["k"])
            else:
                total -= sum(p >= at for p, _ in left) + sum(p < at for p, _ in right)
        chunks = widen([(r["start"], r["stop"], r["over"]) for r in rows], failed) if failed else None
        return pa.RecordBatch.from_pylist([dict(
            key=rows[0]["key"], n_tokens=None if failed else total,
            plan=chunks and [dict(start=a, stop=b, over=o) for a, b, o in chunks])], schema=_SPLICED)
    return run


def _long_counts(texts: DataFrame, model, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of texts (key, text) of more than ``chunk`` code points."""
    chunks = "array<struct<start:int,stop:int,over:int>>"
    done: list[DataFrame] = []
    open_ = texts.withColumn("plan", F.lit(None).cast(chunks))
    while True:
        cut = map_arrow(open_, _cut(chunk, overlap), f"{_CHUNK}, piece string")
        coded = map_arrow(cut.repartition("key", "k"), _encode(model), f"{_CHUNK}, n long, head {_TOKENS}, tail {_TOKENS}, text string")
        one = coded.dropDuplicates(["key", "k"])  # copies of one text
        met = map_groups(one, ["key"], _splice(model), f"key string, n_tokens long, plan {chunks}")
        met, seen = written_with(met, "seams", open=F.count(F.when(F.col("n_tokens").isNull(), 1)))
        done.append(met.filter("n_tokens is not null").select("key", "n_tokens"))
        if not seen["open"]:
            break
        open_ = texts.join(met.filter("n_tokens is null").select("key", "plan"), "key")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return small(out, out.count())


def token_counts(docs: DataFrame, path: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs`` (doc_id, text)."""
    if overlap < 16 or chunk < 4 * overlap:
        raise ValueError("an overlap has at least 16 code points, a chunk four overlaps")
    with open(path, encoding="utf-8") as file:
        model = file.read()
    check_model(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec(shared.value)
            for piece in pieces([batch], "text"):
                texts = piece.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("n_bytes"), pa.array(codec.count_all(texts), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    # The byte length decides for most texts without counting code points.
    huge = (F.col("n_bytes") > chunk) & (F.length("text") > chunk)
    short = map_arrow(rows.filter(~huge), count, f"doc_id {kind}, n_bytes long, n_tokens long")
    long = rows.filter(huge).withColumn("key", F.sha2("text", 256))
    counts = _long_counts(long.select("key", "text"), shared, chunk, overlap)
    ids = written(long.select("doc_id", "n_bytes", "key"), "long")
    return short.union(ids.join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))
