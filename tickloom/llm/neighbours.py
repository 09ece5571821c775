"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors by three rounds of random signs and a fast Hadamard transform, and assigns them to
the nearest signed axis. A query probes the axes nearest to it in every table; candidates are ranked by their exact
Euclidean distance on the original vectors. Large cells are dealt over parts of PART vectors, each of which all of
the cell's queries visit, so nothing is capped. Queries that find fewer than k candidates are compared with all
vectors, block by block.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Rows that
share a query's id are its own row; other rows that repeat an id count once, at their smallest distance. Ties go to
the smaller id. Vectors of different lengths never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored

TABLES, PROBES, PART = 8, 14, 4096


def _size(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """Pseudo-rotation ``t`` of the unit vectors of the rows, as scores of the 2 * size signed axes."""
    size = _size(x.shape[1])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.default_rng([t, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def cells(x: np.ndarray, probes: int, tables: int = TABLES) -> np.ndarray:
    """(rows, tables * probes) cell numbers: the signed axes nearest to each vector, in every table."""
    out = []
    for t in range(tables):
        r = rotated(x, t)
        k = min(probes, r.shape[1])
        near = np.argpartition(-r, k - 1, axis=1)[:, :k] if k < r.shape[1] else np.tile(np.arange(k), (len(r), 1))
        out.append(near + t * r.shape[1])
    return np.concatenate(out, axis=1)


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda v: v != 0)


def _hashed(vectors: DataFrame, probes: int) -> DataFrame:
    """id, dim, cell, vec: one row for each cell of each vector."""
    def run(batches):
        for b in batches:
            lists = b.column(1).to_pylist()
            dims = np.array([len(v) for v in lists])
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                got = cells(np.array([lists[i] for i in own], dtype=np.float64), probes)
                rows = pa.array(np.repeat(own, got.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(np.full(got.size, d), pa.int32()), pa.array(got.ravel(), pa.int64()), b.column(1).take(rows)], names=["id", "dim", "cell", "vec"])

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "vec").mapInArrow(run, f"id {kinds['id']}, dim int, cell long, vec {kinds['vec']}")


def _ranked(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each (dim, cell, part), the k ids of ``index`` nearest to each of its queries.

    Rows of one id are merged, at their smallest distance, before the nearest are taken. Both have dim, cell, part, id,
    vec. Rows of a part stream past in order, index first, so a task holds one part of the index and one batch of queries.
    """
    both = index.withColumn("asks", F.lit(0)).unionByName(queries.withColumn("asks", F.lit(1)))
    rows = both.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "asks").select("dim", "cell", "part", "asks", "id", "vec")

    def run(batches):
        key, ids, blocks, held = None, [], [], None
        for b in batches:
            out = []
            head = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            values = b.column(5)
            for i, (d, c, p, asks) in enumerate(head):
                if (d, c, p) != key:
                    key, ids, blocks, held = (d, c, p), [], [], None
                v = np.asarray(values[i].values, dtype=np.float64)
                if not asks:
                    ids.append(b.column(4)[i].as_py())
                    blocks.append(v)
                elif ids:
                    if held is None:
                        rows_of = np.argsort(every := np.array(ids), kind="stable")
                        names, starts = np.unique(every[rows_of], return_index=True)
                        held = (names, np.stack(blocks)[rows_of], starts)
                    q = b.column(4)[i].as_py()
                    far = np.minimum.reduceat(np.sqrt(((held[1] - v) ** 2).sum(axis=1)), held[2])
                    far[held[0] == q] = np.inf
                    near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
                    near = near[np.lexsort((held[0][near], far[near]))][: k]
                    out += [(q, n, s) for n, s in zip(held[0][near].tolist(), far[near].tolist()) if s != np.inf]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((b.column(4).type, b.column(4).type, pa.float64()))], names=["query_id", "vec_id", "score"])

    kind = dict(index.dtypes)["id"]
    return rows.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, probes: int = PROBES) -> DataFrame:
    """The k nearest rows of each query: query_id, rank, vec_id, score. ``vectors`` has vec_id and embedding."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) \
        .select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(rows, "vectors")
    indexed, asked = _hashed(rows, 1), _hashed(rows.where("asks"), probes)
    # at most TABLES * 2 * size cells a vector length: a bounded broadcast
    per = F.broadcast(indexed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    index = indexed.join(per, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int").alias("part"), "id", "vec")
    queries = asked.join(per, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "vec")
    found = stored(_ranked(index, queries, k), "found")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    few = rows.where("asks").join(counts, F.col("id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "vec").distinct()
    few = stored(few, "few")
    if few.isEmpty():
        return _best(found, k)
    # the exact way for the rest: blocks of all vectors, each of which those queries visit
    blocks = max(1, -(-rows.count() // PART))
    dim = F.size("vec").alias("dim")
    every = rows.select(dim, F.lit(-1).cast("long").alias("cell"), F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int").alias("part"), "id", "vec")
    asking = few.select(dim, F.lit(-1).cast("long").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "id", "vec")
    more = _ranked(every, asking, k)
    return _best(found.unionByName(more).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k)
