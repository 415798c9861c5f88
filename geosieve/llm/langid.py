"""Language identification by interpolated Kneser-Ney character models and calibrated rejection.

Method: letters are lower-cased and folded to 255 symbols, any run of other characters is one
boundary symbol. All trigrams of all training texts are counted per language. Trigrams are
discounted and interpolated with bigram continuation counts, those with unigram continuation counts,
those with the uniform distribution. The trigrams of all languages stand in one array sorted by their
hash, next to their log-probabilities in every language; a text's language is the one with the
lowest cross-entropy per symbol. A text is rejected if it has no letter, or if its cross-entropy is
beyond the limit of its language and length, plus a margin. The limit is the 0.99999 quantile of the
training texts of that language and about that length, carried on from their median and 0.95 quantile by
an exponential tail, so that wrongly labelled texts (up to a twentieth) do not move it; it is drawn towards
that of the language's texts of all lengths as ``PRIOR`` texts would do.

Scale: counting is map-side combined and has at most 2**24 keys a language, which bounds the model
that is sent to the tasks (one float per key and language), whatever the size of the corpus. Texts are
scanned once to count and once to score, never shuffled or shortened.

Defined results: ``und`` with score 0 for null, empty and letterless texts, and for all texts if
nothing was learned; a tie goes to the language that sorts first; repeated rows are judged one by
one; the language column is read for training rows only; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import U, mix, pieces
from geosieve.llm.tables import map_arrow, written

GAP = "\n\n"
SHARPNESS = 8.0  # of the score: languages weigh 2 ** (-SHARPNESS * bits per symbol)
TAIL = float(np.log(0.5 / 1e-5) / np.log(0.5 / 0.05))  # from the median to the limit, in steps to the 0.95 quantile
PRIOR = 20  # training texts for which a language's quantile over all lengths counts
_tables: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    """Symbol 1 to 255 of each letter of the basic plane, 0 for other characters."""
    if "symbols" not in _tables:
        out = np.zeros(1 << 16, dtype=np.uint8)
        for code in range(1 << 16):
            if chr(code).isalpha():
                out[code] = 1 + ord(chr(code).lower()[0]) % 255
        _tables["symbols"] = out
    return _tables["symbols"]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigram of each symbol of each text, and the n + 1 offsets of the texts."""
    texts = [t or "" for t in texts]
    code = np.frombuffer((GAP.join(texts) + GAP).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _symbols()
    sym = table[np.minimum(code, 0xFFFF)]
    for far in np.unique(code[code > 0xFFFF]):
        sym[code == far] = 1 + int(far) % 255 if chr(far).isalpha() else 0
    ends = np.cumsum([len(t) + 2 for t in texts])
    letter = sym > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[ends - 1] = True  # every text ends with two boundary symbols, the second is no event
    event = keep.copy()
    event[ends - 1] = False
    at = np.flatnonzero(keep)
    s = np.concatenate([[0, 0], sym[at]]).astype(np.uint32)
    keys = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
    keys = keys[event[at]]
    counts = np.concatenate([[0], np.cumsum(event)])
    return keys, counts[np.concatenate([[0], ends])]


def count_trigrams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over whole texts."""
    def work(batches):
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for piece in pieces([batch], text_col):
                keys, ends = trigrams(piece.column(text_col).to_pylist())
                langs = np.array(piece.column(lang_col).to_pylist(), dtype=object)
                owner = np.repeat(np.arange(len(langs)), np.diff(ends))
                for lang in set(langs):
                    found.setdefault(lang, []).append(keys[(langs == lang)[owner]])
            for lang, parts in found.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"])

    return map_arrow(docs.select(text_col, lang_col), work, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


class Model:
    """Log2 probabilities of trigrams by language, in arrays sorted by hash."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        grams = np.unique(np.concatenate([g for g, _ in counts.values()])) if counts else np.zeros(0, np.uint32)
        hashes = mix(grams)
        order = np.argsort(hashes)
        self.hashes, grams = hashes[order], grams[order]
        self.known = np.zeros((len(grams), len(self.langs)), np.float32)
        self.lower = np.zeros((1 << 16, len(self.langs)), np.float32)
        self.left = np.zeros((1 << 16, len(self.langs)), np.float32)
        for i, lang in enumerate(self.langs):
            own, n = counts[lang]
            pairs, pair_n = np.unique(own & 0xFFFF, return_counts=True)
            ones, one_n = np.unique(pairs & 0xFF, return_counts=True)
            first = np.zeros(256)
            d = _discount(one_n)
            first[ones] = np.maximum(one_n - d, 0)
            first = (first + d * len(ones) / 256) / one_n.sum()
            d = _discount(pair_n)
            total, kinds = np.zeros(256), np.zeros(256)
            np.add.at(total, pairs >> 8, pair_n)
            np.add.at(kinds, pairs >> 8, 1)
            seen = np.zeros(1 << 16)
            seen[pairs] = np.maximum(pair_n - d, 0)
            safe = np.maximum(total, 1)
            rest = np.where(total > 0, d * kinds / safe, 1.0)
            second = (seen.reshape(256, 256) / safe[:, None] + rest[:, None] * first[None, :]).ravel()
            d = _discount(n)
            total, kinds = np.zeros(1 << 16), np.zeros(1 << 16)
            np.add.at(total, own >> 8, n)
            np.add.at(kinds, own >> 8, 1)
            safe = np.maximum(total, 1)
            left = np.where(total > 0, d * kinds / safe, 1.0)
            have = np.zeros(len(grams))
            at = np.searchsorted(self.hashes, mix(own))
            have[at] = np.maximum(n - d, 0) / total[own >> 8]
            self.known[:, i] = np.log2(have + left[grams >> 8] * second[grams & 0xFFFF])
            self.lower[:, i], self.left[:, i] = np.log2(second), np.log2(left)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros((len(keys), 0), np.float32)
        distinct, back = np.unique(keys, return_inverse=True)
        hashes = mix(distinct)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = self.known[at]
        new = self.hashes[at] != hashes
        out[new] = self.left[distinct[new] >> 8] + self.lower[distinct[new] & 0xFFFF]
        return out[back]

    def entropies(self, keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits per symbol of each text in each language; 0 without symbols."""
        sums = np.zeros((len(keys) + 1, len(self.langs)))
        np.cumsum(self.logs(keys), axis=0, out=sums[1:])
        return -(sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(np.diff(ends), 1)[:, None]


def learn(docs: DataFrame, text_col: str, lang_col: str) -> Model:
    counts = count_trigrams(docs.filter(F.col(lang_col).isNotNull()), text_col, lang_col).toArrow()
    langs = np.array(counts["lang"].to_pylist(), dtype=object)
    grams, n = counts["gram"].to_numpy().astype(np.uint32), counts["n"].to_numpy()
    order = np.argsort(grams)
    langs, grams, n = langs[order], grams[order], n[order]
    return Model({lang: (grams[langs == lang], n[langs == lang]) for lang in set(langs)})


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", margin: float = 0.5) -> DataFrame:
    """(id, train, lang_pred, score, bits, rejected) of each row; ``train`` marks the rows to learn from."""
    train = F.coalesce(train, F.lit(False))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), train.alias("train"))
    model = learn(docs.filter("train"), "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for piece in pieces(batches, "text"):
            keys, ends = trigrams(piece.column("text").to_pylist())
            size = np.diff(ends)
            bits = model.entropies(keys, ends)
            none = (size == 0) | (not model.langs)
            if model.langs:
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(best)), best]
                score = 1 / np.exp2(-SHARPNESS * (bits - low[:, None])).sum(axis=1)
                names = np.where(none, "und", np.array(model.langs, dtype=object)[best])
            else:
                low, score, names = np.zeros(len(size)), np.zeros(len(size)), np.full(len(size), "und", dtype=object)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("lang"), piece.column("train"), pa.array(list(names), pa.string()),
                 pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, 0.0, low)), pa.array(size.astype(np.int64))],
                names=["id", "lang", "train", "lang_pred", "score", "bits", "size"])

    kind = docs.schema["id"].dataType.simpleString()
    scored = written(map_arrow(docs, work, f"id {kind}, lang string, train boolean, lang_pred string, score double, bits double, size long"), "languages")
    length = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    scored = scored.withColumn("length", length)
    right = scored.filter("train and lang = lang_pred")
    # At most 64 length classes for each learned language.
    near = right.select("lang_pred", F.explode(F.array(*(F.col("length") + i for i in (-1, 0, 1)))).alias("length"), "bits")
    ends = F.percentile_approx("bits", [0.5, 0.95], 10_000)
    high = ends[0] + TAIL * (ends[1] - ends[0])
    limits = F.broadcast(near.groupBy("lang_pred", "length").agg(F.count(F.lit(1)).alias("n"), high.alias("own")))
    whole = F.broadcast(right.groupBy("lang_pred").agg(high.alias("all")))
    n = F.coalesce("n", F.lit(0))
    limit = (n * F.coalesce("own", F.lit(0.0)) + PRIOR * F.col("all")) / (n + PRIOR)
    return scored.join(limits, ["lang_pred", "length"], "left").join(whole, "lang_pred", "left").select(
        F.col("id").alias(id_col), "train", "lang_pred", "score", "bits",
        ((F.col("lang_pred") == "und") | F.coalesce(F.col("bits") > (1 + margin) * limit, F.lit(False))).alias("rejected"))
