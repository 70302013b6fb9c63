"""Exact nearest neighbours by blocks: int8 product tiles with error bounds, survivors recomputed in double.

Candidates and queries are dealt to blocks by hash; every tile is one block of candidates and one of queries.  In a
tile all vectors are rounded to 8-bit integers with a scale of their own.  The integer products (exact, as their
sums stay below what the float type holds) give approximate distances, and by the triangle inequality the true
distance differs by at most the two rounding residuals.  A candidate whose lower bound exceeds the k-th smallest
upper bound cannot be among the k nearest; the few others are recomputed from the original vectors in double
precision.  Tiles return k rows per query, merged by a heap.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null id; a query is compared with vectors of its own length; rows with the query's id are not its
neighbours; of several query rows with one id the smallest vector asks; repeated candidate rows count each; ties go
to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scale and norm of what rounding leaves, for each row."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    whole = np.rint(vectors / scale[:, None]).astype(np.int8)
    return whole, scale, np.sqrt(((vectors - whole * scale[:, None]) ** 2).sum(axis=1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, components added in order; squares beyond the doubles are infinite."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for i in range(x.shape[1]):
            total += (x[:, i] - y[:, i]) ** 2
    return np.sqrt(total)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
         at_once: int = 256) -> pd.DataFrame:
    """The k nearest candidates of each query within one tile."""
    # bounds are taken at a scale at which no square overflows; what squares lose to underflow is in the margin
    unit = 2.0 ** -np.frexp(max(np.abs(vectors).max(), np.abs(queries).max()))[1]
    whole, scale, rest = rounded(vectors * unit)
    q_whole, q_scale, q_rest = rounded(queries * unit)
    kind = np.float32 if vectors.shape[1] * 127 ** 2 < 2 ** 24 else np.float64
    y, norm = whole.astype(kind), np.sqrt((whole.astype(np.int64) ** 2).sum(axis=1)) * scale
    q_norm = np.sqrt((q_whole.astype(np.int64) ** 2).sum(axis=1)) * q_scale
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(queries), at_once):
        own = slice(at, at + at_once)
        product = (q_whole[own].astype(kind) @ y.T).astype(np.float64) * q_scale[own, None] * scale
        near = np.sqrt(np.maximum(q_norm[own, None] ** 2 + norm ** 2 - 2 * product, 0))
        margin = q_rest[own, None] + rest + 1e-7 * (q_norm[own, None] + norm) + 1e-150
        other = query_ids[own, None] != ids
        upper = np.where(other, near + margin, np.inf)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1:k] if upper.shape[1] > k else np.inf
        qi, ci = np.nonzero(other & (near - margin <= limit))
        score = np.empty(len(qi))
        for a in range(0, len(qi), 50_000):
            score[a:a + 50_000] = distances(queries[own][qi[a:a + 50_000]], vectors[ci[a:a + 50_000]])
        order = np.lexsort((ids[ci], score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        starts = np.searchsorted(qi, qi, side="left")
        best = np.arange(len(qi)) - starts < k
        out_q.append(query_ids[own][qi[best]])
        out_c.append(ids[ci[best]])
        out_s.append(score[best])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_c), "score": np.concatenate(out_s)})


def nearest(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
            block: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest rows of every row for which ``asks`` holds.

    ``asks`` may name ``id`` and ``vec``.
    """
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & usable(F.col("vec"))))
    queries = rows.filter(asks).groupBy("id").agg(F.min("vec").alias("vec"))
    n_blocks = max(1, -(-rows.count() // block))
    n_query_blocks = max(1, -(-queries.count() // query_block))
    hashed = F.xxhash64("id", "vec")
    candidates = rows.select(F.col("id").alias("c_id"), F.col("vec").alias("c_vec"), F.size("vec").alias("dim"), F.pmod(hashed, F.lit(n_blocks)).alias("g"),
                             F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_query_blocks - 1).cast("bigint"))).alias("h"))
    asked = queries.select("id", "vec", F.size("vec").alias("dim"), F.pmod(hashed, F.lit(n_query_blocks)).alias("h"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("g"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return tile(left["id"].to_numpy(), np.stack(left["vec"].to_numpy()), right["c_id"].to_numpy(),
                    np.stack(right["c_vec"].to_numpy()), k)

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(found["score"], found["vec_id"]))
        return pd.DataFrame({"query_id": [found["query_id"].iloc[0]] * len(best), "rank": range(1, len(best) + 1),
                             "vec_id": [v for _, v in best], "score": [s for s, _ in best]})

    tiles = asked.groupBy("dim", "g", "h").cogroup(candidates.groupBy("dim", "g", "h")).applyInPandas(
        meet, "query_id bigint, vec_id bigint, score double")
    return tiles.groupBy("query_id").applyInPandas(merge, "query_id bigint, rank int, vec_id bigint, score double")
