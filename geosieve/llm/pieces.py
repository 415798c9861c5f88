"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Method: a space is written as the marker U+2581 and one marker is put before the text. The best
segmentation is the one with the greatest sum of piece scores, found by Viterbi over the pieces that
a double-array trie (base and check arrays over UTF-8 bytes) finds at each position. A character that no
piece covers costs the least score minus 10 and is written as its bytes. Decoding joins pieces and
bytes, turns markers into spaces and drops the first one. Encoding never normalises, so decoding
gives the text back: a literal U+2581 in a text is always written as bytes.

The vocabulary is any SentencePiece model file (a parameter). Scores that are log-probabilities are used as
they stand. A file of merge ranks (whole numbers, as of byte-pair encoding) has none, so ``estimate``
learns them over all texts: distinct words are counted, and ``ROUNDS`` rounds of expectation-maximisation
count how often each piece is expected over all segmentations of all words. A piece keeps its number;
``PRIOR`` expected uses are added to each. Words of one length are segmented together by array operations
(``lattice``). If no piece holds a marker after another character, words are segmented one by one and a task
remembers up to ``REMEMBERED`` of them; else a text is one segment.

Scale: encoding is one scan without shuffle; the trie (bounded by the vocabulary) is broadcast. To learn
scores, one more scan counts words in each task before it shuffles the distinct ones, and each round
reads them once; the driver holds one count a piece. Counts are whole numbers, so that the order of adding
does not matter. Memory is bounded by one text, its tokens and ``REMEMBERED`` words.

Defined results: a null text has null tokens and decodes to null; an empty text has no tokens; rows
are encoded one by one, repeated or not; ids outside the vocabulary fail; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosieve.llm.arrays import pieces as cut
from geosieve.llm.lattice import LONGEST, WORDS, Lattice, by_length
from geosieve.llm.tables import map_arrow, written

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 250_000
TEXTS = 1 << 22  # bytes of texts that are encoded at once
NONE = -1e300
UNKNOWN_COST = 10.0  # as in the public library
LAST = -1e8  # scores below this only say that a piece is merged last
ROUNDS, PRIOR = 4, 0.1
UNIT = 1 << 20  # expected counts are added in units of 1 / UNIT


class Trie:
    """Double-array trie: the child of node s on byte b is base[s] + b if check says so."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, number in words.items():
            node = 0
            for byte in word:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = len(children)
                    children[node][byte] = nxt
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = number
        size = 2 * len(children) + 512
        base, check, out = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        # The search for a node of n children goes on where that for the last such node ended.
        last, queue = [1] * 257, [(0, 0)]
        for node, place in queue:
            if value[node] >= 0:
                out[place] = value[node]
            own = sorted(children[node])
            if not own:
                continue
            at = max(last[len(own)], 1)
            while True:
                if at + 512 > len(used):
                    base += [0] * size
                    check += [-1] * size
                    out += [-1] * size
                    used += bytearray(size)
                if not any([used[at + b] for b in own]):
                    break
                at += 1
            last[len(own)] = at
            base[place] = at
            for byte in own:
                used[at + byte] = 1
                check[at + byte] = place
                queue.append((children[node][byte], at + byte))
        self.base, self.check, self.value = base + [0] * 256, check + [-1] * 256, out + [-1] * 256

    def __getstate__(self):
        return tuple(np.array(x, dtype=np.int32) for x in (self.base, self.check, self.value))

    def __setstate__(self, state):
        self.base, self.check, self.value = (x.tolist() for x in state)


class Pieces:
    """Pieces, their scores and the two directions."""

    def __init__(self, names: list[str], scores: list[float], normal: list[bool], byte: dict[int, int]):
        self.normal, self.byte = normal, byte
        own = {name.encode(): i for i, name in enumerate(names) if normal[i]}
        self.trie = Trie(own)
        self.single = {word for word in own if len(word.decode()) == 1}
        self.size = [len(name.encode()) for name in names]
        self.score(scores)
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", n) for n, ok in zip(names, normal) if ok)
        self.bytes = [name.replace(MARK, " ").encode() if ok else b"" for name, ok in zip(names, normal)]
        for value, i in byte.items():
            self.bytes[i] = bytes([value])

    def score(self, scores: list[float]) -> Pieces:
        """Take ``scores`` for those of the pieces."""
        self.scores, self.known, self.past, self._lattice = scores, {}, {}, None
        self.least = min((s for s, n in zip(scores, self.normal) if n and s > LAST), default=0.0) - UNKNOWN_COST
        self.gain = [scores[i] if i >= 0 else 2 * NONE for i in self.trie.value]
        return self

    @property
    def lattice(self) -> Lattice:
        if self._lattice is None:
            self._lattice = Lattice(self.trie.base, self.trie.check, self.trie.value, self.gain, self.least, self.byte)
        return self._lattice

    def ranked(self) -> bool:
        """Whether the scores are merge ranks, not log-probabilities."""
        return all(float(s).is_integer() for s, n in zip(self.scores, self.normal) if n)

    def words(self, text: str) -> list[str]:
        """The parts of a text that are segmented on their own."""
        if not self.by_word:
            return [" " + text]
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return re.findall(" *[^ ]+| +", " " + text)
        # Single spaces between words: cut at them.
        return [" " + word for word in text.split(" ")]

    def expected(self, word: str) -> dict[int, float]:
        """How often each piece is expected over all segmentations of ``word``."""
        out: dict[int, float] = {}
        for part in word.split("\uffff"):
            if part:
                self._expect(part.replace(MARK, "\uffff").replace(" ", MARK).encode("utf-8", "surrogatepass"), out)
        return out

    def _expect(self, data: bytes, out: dict[int, float]) -> None:
        base, check, gain, value, single = self.trie.base, self.trie.check, self.gain, self.trie.value, self.single
        n = len(data)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        edges: list[tuple[int, list[tuple[int, int, float]]]] = []
        into[0].append(0.0)
        ahead = [NONE] * (n + 1)
        for start in range(n):
            if not into[start]:
                continue
            top = max(into[start])
            here = ahead[start] = top + math.log(sum([math.exp(x - top) for x in into[start]]))
            own, node, at = [], 0, start
            for byte in data[start:]:
                nxt = base[node] + byte
                if check[nxt] != node:
                    break
                node, at = nxt, at + 1
                piece = value[node]
                if piece >= 0:
                    own.append((piece, at, gain[node]))
                    into[at].append(here + gain[node])
            first = data[start]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            if data[start:start + width] not in single:
                own.append((-1, start + width, self.least))
                into[start + width].append(here + self.least)
            edges.append((start, own))
        top = max(into[n])
        whole = top + math.log(sum([math.exp(x - top) for x in into[n]]))
        behind = [NONE] * (n + 1)
        behind[n] = 0.0
        for start, own in reversed(edges):
            sums = [g + behind[at] for _, at, g in own]
            top = max(sums)
            behind[start] = top + math.log(sum([math.exp(x - top) for x in sums]))
            for (piece, _, _), x in zip(own, sums):
                if piece >= 0 and (share := ahead[start] + x - whole) > -30:
                    out[piece] = out.get(piece, 0.0) + math.exp(share)

    def segment(self, text: str) -> list[int]:
        """Best pieces of ``text`` with markers for spaces; a literal marker arrives as U+FFFF."""
        data = text.encode("utf-8", "surrogatepass")
        base, check, gain, single = self.trie.base, self.trie.check, self.gain, self.single
        n = len(data)
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if here == NONE:
                continue
            node, at = 0, start
            for byte in data[start:]:
                nxt = base[node] + byte
                if check[nxt] != node:
                    break
                node, at = nxt, at + 1
                got = here + gain[node]
                if got > best[at]:
                    best[at], back[at] = got, node
            first = data[start]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            if here + self.least > best[start + width] and data[start:start + width] not in single:
                best[start + width], back[start + width] = here + self.least, -1
        out, at = [], n
        value, size = self.trie.value, self.size
        while at:
            node = back[at]
            if node >= 0:
                piece = value[node]
                out.append(piece)
                at -= size[piece]
            else:
                start = at - 1
                while data[start] & 0xC0 == 0x80:
                    start -= 1
                raw = data[start:at]
                raw = MARK.encode() if raw == b"\xef\xbf\xbf" else raw
                out += [self.byte[b] for b in reversed(raw)]
                at = start
        return out[::-1]

    def _marked(self, word: str) -> bytes:
        # U+FFFF stands for a literal marker; a literal U+FFFF is spelled in bytes by hand.
        ids: list[int] = []
        for i, part in enumerate(word.split("￿")):
            if i:
                ids += [self.byte[b] for b in b"\xef\xbf\xbf"]
            if part:
                ids += self.segment(part.replace(MARK, "￿").replace(" ", MARK))
        return np.array(ids, dtype=np.int32).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Segment words and remember them: those of one length together, odd and long ones one by one."""
        plain: list[str] = []
        for word in words:
            if len(word) > LONGEST or MARK in word or "\uffff" in word:
                self.known[word] = self._marked(word)
            else:
                plain.append(word)
        raw = [w.replace(" ", MARK).encode("utf-8", "surrogatepass") for w in plain]
        for rows, data in by_length(raw, max(map(len, raw), default=0)):
            for i, ids in zip(rows.tolist(), self.lattice.best(data)):
                self.known[plain[i]] = self._marked(plain[i]) if ids is None else ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of texts, each as the bytes of 32-bit integers."""
        if not self.by_word:
            return [self._marked(" " + t) if t else b"" for t in texts]
        rows = [self.words(t) if t else [] for t in texts]
        new = set().union(*rows).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            # The words of these texts stay; of the others those that come again are taken over.
            own = set().union(*rows)
            self.past = self.known
            self.known = {w: self.past[w] for w in own if w in self.past}
        if self.past:
            found = [w for w in new if w in self.past]
            self.known.update((w, self.past[w]) for w in found)
            new.difference_update(found)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, row)) for row in rows]
        for word in new:
            if len(word) > 64:
                del self.known[word]
        return out

    def encode(self, text: str) -> bytes:
        """Token ids of a text, as the bytes of 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        out = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "past": {}, "_lattice": None}


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    names = [model.id_to_piece(i) for i in range(n)]
    byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
    if len(byte) != 256:
        raise ValueError("the model has no byte pieces")
    return Pieces(names, [model.get_score(i) for i in range(n)], [not s for s in special], byte)


def word_counts(docs: DataFrame, text_col: str, own: Pieces) -> DataFrame:
    """(word, n) of the distinct words of all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.encode("utf-8", "surrogatepass") for w in found], pa.binary()),
             pa.array(np.fromiter(found.values(), np.int64, len(found)))], names=["word", "n"])

    def work(batches):
        words, found = shared.value.words, Counter()
        for piece in cut(batches, text_col):
            for text in piece.column(text_col).to_pylist():
                if text:
                    found.update(words(text))
                if len(found) >= REMEMBERED:
                    yield batch(found)
                    found = Counter()
        yield batch(found)

    # So many parts that every core has some, however few words there are.
    parts = 4 * docs.sparkSession.sparkContext.defaultParallelism
    counted = map_arrow(docs.select(text_col), work, "word binary, n long")
    return written(counted.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n")), "words")


def estimate(docs: DataFrame, text_col: str = "text", model: str = MODEL, rounds: int = ROUNDS) -> Pieces:
    """The pieces of ``model``; if it has merge ranks, with log-probabilities learned over all texts of ``docs``."""
    own = load(model)
    if not own.ranked():
        return own
    spark, normal = docs.sparkSession, np.array(own.normal)
    counts = word_counts(docs, text_col, own)
    # Merge ranks are ordered by use: the first guess gives rank r the weight 1 / r.
    order = np.argsort([-s for s in own.scores], kind="stable")
    weight = np.zeros(len(order))
    weight[order] = 1 / np.arange(1, len(order) + 1)
    for step in range(rounds + 1):
        if step:
            found = _expected(counts, spark.sparkContext.broadcast(own)).toArrow()
            weight = np.zeros(len(order))
            weight[found["piece"].to_numpy()] = found["n"].to_numpy().astype(np.float64) / UNIT
            weight += PRIOR
        weight[~normal] = 0
        own.score(np.log(np.where(normal, weight, 1) / weight.sum()).tolist())
    return own


def _expected(counts: DataFrame, shared) -> DataFrame:
    def add(own: Pieces, words: list[bytes], times: np.ndarray, total: np.ndarray) -> None:
        mark, odd = MARK.encode(), "\uffff".encode()
        plain = [b"" if mark in w or odd in w else w.replace(b" ", mark) for w in words]
        for rows, data in by_length(plain, LONGEST):
            own.lattice.expect(data, times[rows], UNIT, total)
        for i, word in enumerate(plain):
            if not word or len(word) > LONGEST:
                for piece, share in own.expected(words[i].decode("utf-8", "surrogatepass")).items():
                    total[piece] += int(times[i]) * round(share * UNIT)

    def work(batches):
        own = shared.value
        total = np.zeros(len(own.scores), np.int64)
        words: list[bytes] = []
        times: list[np.ndarray] = []
        for batch in batches:
            words += batch.column("word").to_pylist()
            times.append(batch.column("n").to_numpy())
            if len(words) >= WORDS:
                add(own, words, np.concatenate(times), total)
                words, times = [], []
        if words:
            add(own, words, np.concatenate(times), total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([str(n) for n in total[some].tolist()], pa.string())], names=["piece", "n"])

    return map_arrow(counts, work, "piece int, n string").groupBy("piece").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n"))


def scores_table(spark: SparkSession, own: Pieces) -> DataFrame:
    """(piece, score): the scores of a vocabulary as a table, to be written and used again."""
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(own.scores)], "piece int, score double")


def with_scores(table: DataFrame, model: str = MODEL) -> Pieces:
    """The pieces of ``model`` with the scores of such a table (one row a piece)."""
    own = load(model)
    rows = {r["piece"]: r["score"] for r in table.collect()}
    if sorted(rows) != list(range(len(own.scores))):
        raise ValueError("the table has other pieces than the model")
    return own.score([rows[i] for i in range(len(rows))])


def _share(df: DataFrame, path: str, text_col: str | None = None, own: Pieces | None = None):
    """The broadcast pieces: those given, or scored over the texts of ``df`` if the file has no log-probabilities."""
    own = own or (load(path) if text_col is None else estimate(df, text_col, path))
    return df.sparkSession.sparkContext.broadcast(own)


def _token_lists(own: Pieces, texts: list[str | None]) -> pa.ListArray:
    ids = own.encode_all([t or "" for t in texts])
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    mask = pa.array([t is None for t in texts])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=mask)


def _texts(own: Pieces, tokens: pa.ListArray) -> list[str | None]:
    ends, ids = tokens.offsets.to_numpy(), tokens.values.to_numpy()
    return [own.decode(ids[a:b].tolist()) if ok else None
            for a, b, ok in zip(ends[:-1], ends[1:], tokens.is_valid().to_pylist())]


def encode(
    df: DataFrame, text_col: str = "text", out_col: str = "tokens", model: str = MODEL, own: Pieces | None = None,
) -> DataFrame:
    """``df`` with the token ids of ``text_col`` in ``out_col``.

    With ``own``, the pieces of ``estimate`` or ``with_scores``, any table is encoded alike; without it the
    scores are learned from this one if the model file has none.
    """
    shared = _share(df, model, text_col, own)

    def work(batches):
        own = shared.value
        for piece in cut(batches, text_col, TEXTS):
            tokens = _token_lists(own, piece.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*piece.columns, tokens], names=[*piece.schema.names, out_col])

    schema = T.StructType([*(f for f in df.schema if f.name != out_col), T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return map_arrow(df.drop(out_col), work, schema)


def decode(df: DataFrame, tokens_col: str = "tokens", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of ``tokens_col`` in ``out_col``."""
    shared = _share(df, model)

    def work(batches):
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = _texts(own, part.column(tokens_col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    schema = T.StructType([*(f for f in df.schema if f.name != out_col), T.StructField(out_col, T.StringType())])
    return map_arrow(df.drop(out_col), work, schema)


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, own: Pieces | None = None,
) -> DataFrame:
    """(id, n_tokens, tokens, decoded, same) of each row; ``same``: decoding gave the text back."""
    shared = _share(docs, model, text_col, own)

    def work(batches):
        own = shared.value
        for piece in cut(batches, text_col, TEXTS):
            texts = piece.column(text_col).to_pylist()
            tokens = _token_lists(own, texts)
            decoded = _texts(own, tokens)
            sizes = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column(id_col), pa.array(sizes), tokens, pa.array(decoded, pa.string()),
                 pa.array([a == b for a, b in zip(texts, decoded)])],
                names=["id", "n_tokens", "tokens", "decoded", "same"])

    # One pass does both, so that a task needs one Python worker and one copy of the trie.
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), work,
                     f"id {kind}, n_tokens long, tokens array<int>, decoded string, same boolean").withColumnRenamed("id", id_col)
