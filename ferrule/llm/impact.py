"""Exact top-k by inner product: an impact-ordered index, processed score at a time.

Vectors are quantised to whole numbers. A block of candidates is indexed by impact: its
postings (dimension, value) lie in segments by the size of the value, one for each power
of two, the largest first. For a group of queries the segments are added to the scores in that order.
After each, what the segments still to come can add to or take from a score is bounded, by the
sum of the query's components times the largest value left, and by the lengths of the query and of
the candidate's remainder. Candidates whose upper bound is below the k-th lower bound can't be
members. Processing stops when that proof leaves few candidates, and these are rescored exactly.

Queries and candidates meet in a grid of blocks of bounded size; each unit of the grid returns k
rows a query, and a window over those picks the k best. Nothing grows with a label, a cluster or
the number of equal vectors.

Cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; empty
vectors likewise; vectors of different length don't meet; ties go to the smaller id; a query never finds rows
of its own id; rows that repeat are candidates each, and one query. Scores beyond 64 bits are
clipped. Other columns are ignored, whatever their names. No vectors: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE, CANDIDATES, QUERIES, CHUNK, FEW = 64, 8192, 2048, 128, 4


def segments(x: np.ndarray, most: int = 5) -> list[tuple[np.ndarray, float]]:
    """(postings as a matrix, the largest absolute value in the segments after it), by descending impact."""
    size = np.abs(x)
    top = int(size.max(initial=0)).bit_length()
    out, cuts = [], [2 ** max(0, top - k) for k in range(1, most)]
    upper = np.inf
    for cut in [*dict.fromkeys(c for c in cuts if c > 1), 0]:
        out.append((np.where((size >= cut) & (size < upper), x, 0), cut - 1 if cut else 0))
        upper = cut
    return out


def _dtype(x: np.ndarray, q: np.ndarray):
    """The cheapest type in which every sum is exact."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def top_k(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query row: (query, candidate, score) of its k best of ``x``, ties to the smaller id, never its own id."""
    kind = _dtype(x, q)
    x, q = x.astype(kind), q.astype(kind)
    order = segments(x) if kind is not object else [(x, 0)]
    left = [np.sqrt((np.where(np.abs(x) <= rest, x, 0).astype(np.float64) ** 2).sum(axis=1)) if rest else None for _, rest in order]
    found = []
    for at in range(0, len(q), CHUNK):
        part = q[at:at + CHUNK]
        same = own[at:at + CHUNK, None] == ids[None, :]
        score = np.zeros((len(part), len(x)), dtype=kind)
        total, length = np.abs(part).sum(axis=1), np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))
        maybe = ~same
        for (segment, rest), remainder in zip(order, left, strict=True):
            score += part @ segment.T
            if not rest:
                break
            slack = np.minimum(np.asarray(total * rest, dtype=np.float64)[:, None], length[:, None] * remainder[None, :]) + 1e-3
            low = np.where(same, -np.inf, score - slack)
            kth = np.partition(low, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)] if len(x) > k else np.full(len(part), -np.inf)
            maybe = ~same & (score + slack >= kth[:, None])
            if maybe.sum() <= FEW * k * len(part):  # proof enough: rescore these
                break
        rows, cols = np.nonzero(maybe)
        if rest:
            exact = (part[rows] * x[cols]).sum(axis=1)
        else:
            exact = score[rows, cols]
            if len(x) > 4 * k and kind is not object:  # exact scores: below the k-th there are no members
                s = np.where(maybe, score, -np.inf)
                kth = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
                keep = exact >= kth[rows]
                rows, cols, exact = rows[keep], cols[keep], exact[keep]
        if kind is object:
            exact = np.array([min(max(int(e), -2**63), 2**63 - 1) for e in exact], dtype=np.int64)
        exact = exact.astype(np.int64)
        by = np.lexsort((ids[cols], -exact if kind is not object else -exact.astype(np.float64), rows))
        rows, cols, exact = rows[by], cols[by], exact[by]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        found.append((rows[rank < k] + at, cols[rank < k], exact[rank < k]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    x = np.floor(flat.astype(np.float64) * SCALE)
    return (x if np.abs(x).max(initial=0) < 2**53 else np.array([int(v) for v in x], dtype=object)).reshape(n, -1)


def _unit(k: int):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        c, q = (table.filter(pa.array(side == s)) for s in (0, 1))
        ids, own = np.asarray(c.column("id")), np.asarray(q.column("id"))
        if not len(c) or not len(q):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "qh", "vec_id", "score")})
        rows, cols, score = top_k(_matrix(c.column("vec"), len(c)), ids, _matrix(q.column("vec"), len(q)), own, k)
        return pa.table({"query_id": own[rows], "qh": np.asarray(q.column("h"))[rows], "vec_id": ids[cols], "score": score})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row where ``is_query``."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    v = F.col(f"`{vec}`")
    rows = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("vec"), F.col("__query").alias("query"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number))
    rows = materialize(rows.withColumn("h", F.xxhash64("vec")).withColumn("dim", F.size("vec")), "impact-rows")
    queries = rows.where("query").select("id", "vec", "h", "dim").distinct()
    n_c, n_q = (max(1, -(-n // size)) for n, size in ((rows.count(), CANDIDATES), (rows.where("query").count(), QUERIES)))
    # equal vectors spread over the blocks, as the id decides
    c = rows.select("id", "vec", "h", "dim", F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int").alias("c"),
                    F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"))
    q = queries.select("id", "vec", "h", "dim", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"),
                       F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("q"))
    best = c.unionByName(q).groupBy("dim", "c", "q").applyInArrow(_unit(k), "query_id long, qh long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
