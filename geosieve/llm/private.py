"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Method (native, DataFrame and SQL functions only): four base patterns give certain spans. Wider
patterns give candidates (digit groups of any shape, spelled-out addresses). Six labelers vote
yes, no or nothing on each candidate: base pattern, digit-count regex, checksum, context gazetteer,
prefix gazetteer and grouping shape. Expectation-maximisation estimates each labeler's reliability
from the vote patterns; its posteriors train the final classifier, a logistic model over the span's own
features, which adds the candidates it is sure of. Base spans always stay.

Scale: one scan finds spans and votes with JVM expressions; only documents' spans are written, not
their texts. Positions, overlaps and masks come from running sums and extremes over blocks and
from texts in chunks, so time is linear in a text and its matches. EM and the classifier see one row per distinct pattern of votes and features: their number
is bounded by the labelers (3**6 x features), so the driver holds a bounded table. Patterns never
backtrack into a group (possessive loops), so long runs of digits or letters neither overflow the stack nor
take quadratic time.

Defined results: a null text is empty and has no spans; rows are returned one by one, repeated or not;
with no candidates the classifier adds nothing; other columns are ignored, or kept by ``mask``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.llm.tables import written

KINDS = ["email", "ip", "card", "phone", "contact", "number"]
# A match that starts inside a run of its first class can only follow another match (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z])\+?+\(?+[0-9](?:[ ().-]{0,2}+[0-9])++(?![A-Za-z])",
}
# What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+", "contact": "at"}
# Gazetteers of words near personal numbers and near other numbers.
NEAR_WORDS = "phone|tel|call|mobile|fax|card|visa|mastercard|account|ssn|contact|mail|telefon|telefono|teléfono|téléphone|karte|tarjeta|carte"
OTHER_WORDS = "isbn|issn|doi|version|page|order|build|price|article|figure|table|chapter|year"
CERTAIN = 0.95
BLOCK = 256


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    digits = _digits(t)
    n = F.length(digits)

    def add(total, i):
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _good(kind: str, t: Column) -> Column:
    n = F.length(_digits(t))
    if kind == "ip":
        def part(p):
            short = F.regexp_replace(p, "^0+", "")
            return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

        return F.forall(F.split(t, r"\."), part)
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), _luhn(t)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda x: _good(kind, x["t"])


def _named(number: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"))


def _scanned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace arrays of longs by their running 'sum', 'max' or 'min'.

    Blocks of ``BLOCK`` values are folded one by one from their offsets, so no long array is copied per value.
    """
    ways = {"sum": ("{} + {}", "0L"), "max": ("greatest({}, {})", "0L"), "min": ("least({}, {})", "9223372036854775807L")}
    none = "cast(array() as array<bigint>)"
    df = df.withColumns({f"{c}_b": F.expr(f"""
        case when size({c}) > 0 then transform(sequence(0, (size({c}) - 1) div {BLOCK}), i -> slice({c}, cast(i * {BLOCK} + 1 as int), {BLOCK}))
        else cast(array() as array<array<bigint>>) end""") for c in columns})
    offsets, running = {}, {}
    for c, way in columns.items():
        op, zero = ways[way]
        offsets[f"{c}_o"] = F.expr(f"""
            aggregate({c}_b, named_struct('at', {zero}, 'out', {none}), (a, v) -> named_struct(
              'at', {op.format("a.at", f"aggregate(v, {zero}, (x, y) -> {op.format('x', 'y')})")}, 'out', concat(a.out, array(a.at))), a -> a.out)""")
        value = op.format("a.at", "y")
        running[c] = F.expr(f"""
            flatten(zip_with({c}_b, {c}_o, (v, o) -> aggregate(v, named_struct('at', o, 'out', {none}),
              (a, y) -> named_struct('at', {value}, 'out', concat(a.out, array({value}))), a -> a.out)))""")
    return df.withColumns(offsets).withColumns(running).drop(*(f"{c}_{x}" for c in columns for x in "bo"))


def _chunks(text: Column) -> Column:
    """``text`` in pieces of ``BLOCK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(chunks: str, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in chunks, in time of its own length."""
    first = F.floor(start / BLOCK)
    some = F.array_join(F.slice(chunks, (first + 1).cast("int"), (F.floor((end - 1) / BLOCK) - first + 1).cast("int")), "")
    return F.when(end > start, F.substr(some, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with one array of (s, e, t) per kind, bad base matches dropped."""
    text = F.col("_text")
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    tried = {k: F.contains(text, F.lit(NEEDS[k])) if k in NEEDS else F.lit(True) for k in KINDS}
    out = out.withColumns({f"_m_{k}": F.when(tried[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)))
                           .otherwise(F.array().cast("array<string>")) for k in KINDS})
    out = out.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})
    # What lies between matches is what a split leaves, so running lengths place them.
    out = out.withColumns({f"_e_{k}": F.expr(
        f"zip_with(slice(_p_{k}, 1, size(_m_{k})), _m_{k}, (p, t) -> cast(length(p) + length(t) as bigint))") for k in KINDS})
    out = _scanned(out, {f"_e_{k}": "sum" for k in KINDS})
    out = out.withColumns({f"_s_{k}": F.filter(F.expr(
        f"zip_with(_m_{k}, _e_{k}, (t, e) -> named_struct('s', e - length(t), 'e', e, 't', t))"), _valid(k)) for k in KINDS})
    return out.drop(*(f"_{a}_{k}" for a in "mpe" for k in KINDS))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _judged(spans: DataFrame) -> DataFrame:
    """Adds ``base`` (s, e, kind number) and ``more`` (s, e, kind number, votes, features)."""
    base = F.array_sort(F.concat(*(F.transform(f"_s_{k}", _named(i)) for i, k in enumerate(KINDS[:4]))))
    out = spans.withColumn("base", base)
    # Base spans and candidates in order of start: a candidate is held if a base span before it ends behind
    # its start or the next one starts before its end.
    out = out.withColumn("_all", F.array_sort(F.concat(
        F.expr("transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 't', cast(null as string)))"),
        *(F.expr(f"transform(_s_{k}, x -> named_struct('s', x.s, 'k', {KINDS.index(k)}, 'e', x.e, 't', x.t))") for k in KINDS[4:]))))
    out = out.withColumns({
        "_ends": F.expr("transform(_all, x -> if(x.k < 4, x.e, 0L))"),
        "_starts": F.expr("reverse(transform(_all, x -> if(x.k < 4, x.s, 9223372036854775807L)))")})
    out = _scanned(out, {"_ends": "max", "_starts": "min"}).withColumn("_starts", F.reverse("_starts"))
    out = out.withColumn("_more", F.expr("filter(arrays_zip(_all, _ends, _starts), x -> x._all.k >= 4)"))
    out = out.withColumn("_chunks", F.when(F.size("_more") > 0, _chunks(F.col("_text"))))

    def candidate(kind):
        def make(z):
            x = z["_all"]
            t, n = x["t"], F.length(_digits(x["t"]))
            before = F.lower(_cut("_chunks", F.greatest(x["s"] - 30, F.lit(0)), x["s"]))
            near, other = F.rlike(before, F.lit(rf"\b(?:{NEAR_WORDS})\b")), F.rlike(before, F.lit(rf"\b(?:{OTHER_WORDS})\b"))
            held = (z["_ends"] > x["s"]) | (z["_starts"] < x["e"])
            groups = F.size(F.split(F.regexp_replace(F.trim(t), "[^0-9]+", " "), " "))
            long_ = n.between(13, 19)
            checked = F.when(long_, _luhn(t)).otherwise(False)
            if kind == "contact":
                votes = [_vote(held, F.lit(False)), _vote(F.lit(True), F.lit(False)), F.lit("0"), _vote(near, other),
                         _vote(F.rlike(F.lower(t), F.lit(r"(?:com|org|net|edu|de|fr|es|info)$")), F.lit(False)), _vote(F.rlike(t, F.lit("dot")), F.lit(False))]
            else:
                votes = [_vote(held, F.lit(False)), _vote(n.between(10, 15) & (groups > 1), n < 9), _vote(checked, long_ & ~checked),
                         _vote(near, other), _vote(F.rlike(t, F.lit(r"^(?:\+|00|\(0?\d{2,4}\))")), F.lit(False)),
                         _vote(F.rlike(t, F.lit(r"^\+?[0-9 ]*\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$|^\d{3}-\d{2}-\d{4}$|^\d{4}([ -])\d{4}\1\d{4}\1\d{4}$")), groups == 1)]
            features = F.concat_ws("|", F.when(n < 9, "a").when(n < 10, "b").when(n <= 12, "c").when(n <= 15, "d").when(n <= 19, "e").otherwise("f"),
                                   F.least(groups, F.lit(5)).cast("string"), F.when(checked, "y").when(long_, "n").otherwise("-"),
                                   F.when(near, "y").when(other, "n").otherwise("-"), F.when(F.rlike(t, F.lit(r"^[+(]")), "y").otherwise("n"), F.lit(kind))
            return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), held.alias("held"),
                            F.concat(*votes).alias("votes"), features.alias("features"))
        return make

    return out.withColumn("more", F.concat(*(F.transform(
        F.expr(f"filter(_more, x -> x._all.k = {KINDS.index(k)})"), candidate(k)) for k in KINDS[4:])))


def reliabilities(votes: list[str], n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each vote pattern by EM over independent labelers; it starts from the sum of votes."""
    value = np.array([["-0+".index(c) for c in v] for v in votes])
    y = 1 / (1 + np.exp(-2.0 * (value - 1).sum(axis=1)))
    for _ in range(rounds):
        prior = np.clip((n * y).sum() / n.sum(), 1e-6, 1 - 1e-6)
        logit = np.full(len(y), np.log(prior / (1 - prior)))
        for j in range(value.shape[1]):
            for v in range(3):
                at = value[:, j] == v
                yes, no = ((n * w)[at].sum() + 1 for w in (y, 1 - y))
                yes, no = yes / ((n * y).sum() + 3), no / ((n * (1 - y)).sum() + 3)
                # A labeler's yes never counts against a span, nor its no for one.
                gain = np.log(yes / no)
                gain = max(gain, 0.0) if v == 2 else min(gain, 0.0) if v == 0 else gain
                logit[at] += gain
        y = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return y


def classifier(features: list[str], n: np.ndarray, y: np.ndarray, rounds: int = 30) -> dict[str, float]:
    """Log-odds of every feature pattern under a ridge-regularised logistic model of its parts."""
    parts = [[f"{i}={p}" for i, p in enumerate(f.split("|"))] for f in features]
    names = sorted({p for row in parts for p in row})
    x = np.zeros((len(parts), len(names) + 1))
    x[:, -1] = 1
    for i, row in enumerate(parts):
        x[i, [names.index(p) for p in row]] = 1
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (n * (y - p)) - w)
    return dict(zip(features, (x @ w).tolist()))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, base, spans, *keep): arrays of (s, k, e), ordered by start and kind; ``k`` indexes KINDS.

    ``keep`` names no column called base, more or spans.
    """
    found = written(_judged(_spans(docs.select(*dict.fromkeys([id_col, text_col, *keep])), text_col)).select(
        *dict.fromkeys([id_col, *keep]), "base", "more"), "spans")
    table = found.select(F.explode("more").alias("m")).groupBy("m.votes", "m.features").agg(F.count(F.lit(1)).alias("n")).collect()
    sure: list[str] = []
    if table:
        n = np.array([r["n"] for r in table], dtype=float)
        y = reliabilities([r["votes"] for r in table], n)
        sums: dict[str, np.ndarray] = {}
        for r, c, p in zip(table, n, y):
            sums[r["features"]] = sums.get(r["features"], np.zeros(2)) + [c, c * p]
        names = sorted(sums)
        total = np.array([sums[f][0] for f in names])
        odds = classifier(names, total, np.array([sums[f][1] for f in names]) / total)
        sure = [f for f in names if odds[f] >= np.log(CERTAIN / (1 - CERTAIN))]
    # Feature patterns are bounded by their definition, so this list is too.
    added = F.filter("more", lambda m: ~m["held"] & m["features"].isin(sure)) if sure else F.filter("more", lambda m: F.lit(False))
    spans = F.array_sort(F.concat("base", F.transform(added, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))))
    return found.withColumn("spans", spans).drop("more")


def as_text(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(df: DataFrame, column: str, spans: str) -> DataFrame:
    """``df`` with each span of the text replaced by its kind in brackets; overlapping spans make one."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    out = df.withColumns({"_ends": F.transform(spans, lambda x: x["e"]),
                          "_chunks": F.when(F.size(spans) > 0, _chunks(F.col(column)))})
    out = _scanned(out, {"_ends": "max"}).withColumn(
        "_until", F.when(F.size("_ends") > 0, F.concat(F.array(F.lit(0).cast("long")), F.slice("_ends", 1, F.size("_ends") - 1))))

    def piece(x, at):
        return F.when(x["s"] >= at, F.concat(_cut("_chunks", at, x["s"]), F.get(names, x["k"]))).otherwise("")

    last = F.element_at("_ends", -1)
    whole = F.concat(F.array_join(F.zip_with(spans, "_until", piece), ""), _cut("_chunks", last, F.length(column).cast("long")))
    return out.withColumn(column, F.when(F.size(spans) > 0, whole).otherwise(F.col(column)))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; all columns stay, in order."""
    # Numbered names cannot clash with those used on the way.
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    found = find_private(docs.toDF(*names), own, text, tuple(names))
    return masked(found, text, "spans").select(*names).toDF(*docs.columns)
