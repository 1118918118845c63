"""Exact top-k search by distributed histogram selection.

Every candidate is scored against a block of queries. Rather than sorting
scores, each task counts them in a few bins a query; the summed counts tell the
bin that holds the k-th best, which the next round cuts into bins again, until
it is one score wide. A last pass keeps what lies above it and, of the scores
equal to it, those with the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.llm.storage import materialize

BINS = 256
#: Queries scored together; their vectors and thresholds are what the driver and each task hold.
QUERY_BLOCK = 2048
#: Candidates scored at a time.
ROWS = 4096
#: Sums of products below this are exact in double precision.
_EXACT = 2**53
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v) with v = floor(scale * x) as longs, without vectors that are null or hold null or non-finite components."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), wide)


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, [rows, queries], exact: by BLAS in doubles while they hold all sums, else in long or whole Python integers held within a long."""
    if not rows.size or not queries.size:
        return np.zeros((len(rows), len(queries)), dtype=np.int64)
    most = int(np.abs(rows.astype(object)).max() if rows.min() == np.iinfo(np.int64).min else np.abs(rows).max()) * int(np.abs(queries).max()) * rows.shape[1]
    if most < _EXACT:
        return (rows.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)
    if most <= _LONG:
        return rows @ queries.T
    whole = rows.astype(object) @ queries.astype(object).T
    return np.clip(whole, -_LONG, _LONG).astype(np.int64)


def _blocks(batches, wide, query_ids, queries):
    """(ids, scores with the query's own row left out as a mask) of each block of candidate rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            yield ids, _scores(_matrix(part.column("v"), wide), queries), ids[:, None] != query_ids[None, :]


def _count(rows: DataFrame, wide: int, held, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(q, bin, n): candidates by bin; bin BINS holds what lies above the range, what lies below is not counted."""

    def run(batches):
        query_ids, queries = held.value
        counts = np.zeros((len(query_ids), BINS + 1), dtype=np.int64)
        for _, scores, other in _blocks(batches, wide, query_ids, queries):
            # Offsets are taken unsigned, so a range as wide as all longs does not overflow.
            inside = other & (scores >= low[None, :])
            over = (scores.astype(np.uint64) - low.astype(np.uint64)[None, :]) // width[None, :]
            bins = np.minimum(over, np.uint64(BINS)).astype(np.int64)
            where = np.nonzero(inside)
            counts += np.bincount(where[1] * (BINS + 1) + bins[where], minlength=counts.size).reshape(counts.shape)
        q, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return rows.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _thresholds(rows: DataFrame, wide: int, held, bound: np.ndarray, k: int) -> np.ndarray:
    """For each query its k-th best score, or the least score there can be if it has fewer candidates."""
    n = len(bound)
    low, least = -bound.astype(np.int64), -bound.astype(np.int64)
    span = bound.astype(np.uint64) * np.uint64(2) + np.uint64(1)
    width = np.maximum((span + np.uint64(BINS - 1)) // np.uint64(BINS), 1)
    above = W.partitionBy("q").orderBy(F.desc("bin"))
    while True:
        counted = _count(rows, wide, held, low, width)
        reached = counted.withColumn("sum", F.sum("n").over(above)).where(F.col("sum") >= k).groupBy("q").agg(F.max("bin").alias("bin")).collect()
        at = np.full(n, -1, dtype=np.int64)
        for r in reached:
            at[r["q"]] = r["bin"]
        few = at < 0
        low = np.where(few, least, (low.astype(np.uint64) + at.astype(np.uint64) * width).astype(np.int64))
        if (width[~few] == 1).all():
            return low
        width = np.where(few, width, np.maximum((width + np.uint64(BINS - 1)) // np.uint64(BINS), np.uint64(1)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of each query with the largest integer inner product.

    ``queries`` and ``vectors`` have the same columns; a candidate with the
    query's own id is passed over. Equal scores go to the smaller id; a query
    with fewer candidates gets all. Vectors that are null or hold null or
    non-finite components and rows without an id take no part; a query's
    candidates are the vectors with as many components as it has, since no other
    has an inner product with it. Repeated rows are candidates each, repeated
    queries are one query. Sums beyond a long are held at its ends. Empty tables
    give no rows.
    """
    spark = vectors.sparkSession
    sound = materialize(quantised(vectors, id_col, vector_col, scale), "topk-vectors")
    asked = materialize(quantised(queries, id_col, vector_col, scale).dropDuplicates(["id"]), "topk-queries")
    found = []
    # A handful at most in a table of embeddings; each is a search of its own.
    for r in asked.select(F.size("v").alias("wide")).distinct().orderBy("wide").toLocalIterator():
        found += _searched(sound.where(F.size("v") == r["wide"]), asked.where(F.size("v") == r["wide"]), r["wide"], k)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _searched(rows: DataFrame, asked: DataFrame, wide: int, k: int) -> list[DataFrame]:
    """The results of the queries ``asked`` among ``rows``, all of ``wide`` components, a block of queries each."""
    spark = rows.sparkSession
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).alias("m")).first()["m"]
    found, last = [], None
    while norm is not None:
        block = asked.where(F.lit(True) if last is None else F.col("id") > last).orderBy("id").limit(QUERY_BLOCK).toPandas()
        if not len(block):
            break
        ids = block["id"].to_numpy(dtype=np.int64)
        last = int(ids[-1])
        matrix = np.array(block["v"].tolist(), dtype=np.int64).reshape(len(ids), wide)
        # Cauchy and Schwarz bound every score; a little is added for rounding.
        bound = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1)) * np.sqrt(norm) * (1 + 1e-9) + 2
        bound = np.where(bound < 2.0**62, np.minimum(bound, 2.0**62), 0).astype(np.int64) + np.where(bound < 2.0**62, 0, _LONG)
        held = spark.sparkContext.broadcast((ids, matrix))
        kth = _thresholds(rows, wide, held, bound, k)
        found.append(materialize(_best(rows, wide, held, kth, k), "topk-found"))
        held.unpersist()
    return found


def _best(rows: DataFrame, wide: int, held, kth: np.ndarray, k: int) -> DataFrame:
    def run(batches):
        query_ids, queries = held.value
        above = [[], [], []]
        ties_q, ties_id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for ids, scores, other in _blocks(batches, wide, query_ids, queries):
            i, q = np.nonzero(other & (scores > kth[None, :]))
            for kept, more in zip(above, (q, ids[i], scores[i, q]), strict=True):
                kept.append(more)
            i, q = np.nonzero(other & (scores == kth[None, :]))
            ties_q, ties_id = np.append(ties_q, q), np.append(ties_id, ids[i])
            order = np.lexsort((ties_id, ties_q))
            ties_q, ties_id = ties_q[order], ties_id[order]
            rank = np.arange(len(ties_q)) - np.searchsorted(ties_q, ties_q)
            ties_q, ties_id = ties_q[rank < k], ties_id[rank < k]
        q, c, s = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in above)
        q, c, s = np.append(q, ties_q), np.append(c, ties_id), np.append(s, kth[ties_q])
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(c), pa.array(s)], names=["query_id", "vec_id", "score"])

    near = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
