"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Method: valid vectors are normalised; in each of several tables, a few Gaussian projections are
shifted, divided by a width and rounded down, and vectors with equal codes (and equal label and
dimension) share a bucket. Vectors at the cosine limit lie sqrt(2 - 2 * limit) apart, which gives the
chance to share a bucket of one table; the number of tables follows from the chosen miss
probability. All vectors of a bucket are compared by exact cosine in double precision.

Scale: equal vectors collapse to one class with a count before anything else. Buckets are cut into
blocks of bounded size and each pair of blocks is one small matrix product in a task; a pair found in
several tables counts in the first only, so no pair is emitted: blocks return counts per vector
and a spanning set of links. Links of g mutual near-copies cost g**2 / 2 comparisons, spread over
tasks, because their number is asked for.

Defined results: a null id gives a row that links with nothing, is not kept and has a null
component; null, zero and non-finite vectors, those with null components and null labels link with
nothing; rows that repeat an id are counted as vectors of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import U, mix
from geosieve.llm.tables import components, map_arrow, map_groups, written

BLOCK = 512
WIDTH, ROWS = 1.0, 8


def tables_for(limit: float, miss: float) -> int:
    """Tables needed so that a pair at the limit shares no bucket with chance ``miss`` at most."""
    r = WIDTH / sqrt(2 - 2 * limit)
    one = erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))
    return ceil(log(miss) / log(1 - one**ROWS))


def bucket_codes(unit: np.ndarray, label: np.ndarray, tables: int) -> np.ndarray:
    """One 64-bit code per row and table."""
    rng = np.random.default_rng(unit.shape[1])
    project, shift = rng.standard_normal((unit.shape[1], tables * ROWS)), rng.uniform(0, WIDTH, tables * ROWS)
    cell = np.floor((unit @ project + shift) / WIDTH).astype(np.int64).view(U).reshape(len(unit), tables, ROWS)
    code = mix(np.arange(tables, dtype=U))[None, :] ^ mix(label.astype(np.int64).view(U))[:, None] ^ U(unit.shape[1])
    for j in range(ROWS):
        code = mix(code ^ cell[:, :, j])
    return code.view(np.int64)


def _hashed(vectors: DataFrame, tables: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            n = batch.num_rows
            digest, raw, codes = [None] * n, [None] * n, [None] * n
            lists, labels = batch.column("vector").to_pylist(), batch.column("label").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, (v, label) in enumerate(zip(lists, labels)):
                if v and label is not None and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                x = np.array([lists[i] for i in rows], dtype=float)
                norm = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
                x, norm, rows = x[good], norm[good], np.array(rows)[good]
                if len(rows):
                    found = bucket_codes(x / norm[:, None], np.array([labels[i] for i in rows]), tables)
                    for i, v, c in zip(rows, x, found):
                        digest[i] = hashlib.blake2b(v.tobytes() + str(labels[i]).encode(), digest_size=16).digest()
                        raw[i], codes[i] = v.tobytes(), c
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
                names=["id", "digest", "raw", "codes"])

    return map_arrow(vectors, work, "id long, digest binary, raw binary, codes array<long>")


def _matrix(group: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    picked = group.column("raw").take(pa.array(rows)).to_pylist()
    return np.frombuffer(b"".join(picked)).reshape(len(rows), -1)


def compare_blocks(limit: float):
    def work(group):
        side, ids, times = (group.column(c).to_numpy() for c in ("side", "id", "times"))
        table = group.column("table")[0].as_py()
        codes = np.array(group.column("codes").to_pylist(), dtype=np.int64)
        same = group.column("l")[0].as_py() == group.column("r")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        x, y = _matrix(group, left), _matrix(group, right)
        cosine = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :])
        p, q = np.nonzero(np.triu(cosine >= limit, 1) if same else cosine >= limit)
        p, q = left[p], right[q]
        fresh = np.ones(len(p), bool)
        for start in range(0, len(p), 1 << 15):
            part = slice(start, start + (1 << 15))
            fresh[part] = ~(codes[p[part], :table] == codes[q[part], :table]).any(axis=1)
        p, q = p[fresh], q[fresh]
        if not len(p):
            return None
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, p, times[q])
        np.add.at(links, q, times[p])
        root = ids.copy()
        while True:
            before = root.copy()
            np.minimum.at(root, p, root[q])
            np.minimum.at(root, q, root[p])
            if (before == root).all():
                break
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(root[at])], names=["id", "links", "root"])

    return work


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 limit: float = 0.98, miss: float = 1e-4) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    tables = tables_for(limit, miss)
    rows = written(_hashed(vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("long").alias("label")), tables), "vectors")
    classes = written(rows.filter("id is not null and digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.any_value("raw").alias("raw"), F.any_value("codes").alias("codes")), "classes")
    spread = classes.select("id", F.posexplode("codes").alias("table", "key"))
    shared = spread.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    part = spread.join(shared, ["table", "key"]).withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "b", F.pmod(F.xxhash64("id"), "nb").cast("int"))
    left = part.select("table", "key", F.col("b").alias("l"), F.explode(F.sequence("b", F.col("nb") - 1)).alias("r"), F.lit(0).alias("side"), "id")
    right = part.filter("b > 0").select("table", "key", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("l"), F.col("b").alias("r"), F.lit(1).alias("side"), "id")
    dealt = left.union(right).join(classes, "id").select("table", "key", "l", "r", "side", "id", "times", "raw", "codes")
    found = written(map_groups(dealt, ["table", "key", "l", "r"], compare_blocks(limit), "id long, links long, root long"), "vector_links")
    roots = components(found.select("id", "root"), "id", "root")
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = classes.select("digest", "id", "times").join(totals, "id", "left").join(roots, F.col("id") == roots["node"], "left").select(
        "digest", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return rows.select("id", "digest").join(label, "digest", "left").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
