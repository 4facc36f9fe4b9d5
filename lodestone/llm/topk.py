"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are sparse rows of integer weights.  Candidates of a batch become
postings per dimension; each query row scatters its weighted postings into a
dense score array, partition selection keeps the batch's best k, and the bests
of all batches are merged.

Defined results: vectors that are null or hold a null or non-finite component
take no part; vectors of unequal length are compared over the dimensions both
have; of repeated query rows the smallest vector is the query; repeated
candidate rows each count; an empty table gives no rows; a score beyond a
long's range is the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, materialise

#: Candidates per dense score array.
CANDIDATES = 8192


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component as long; null where any component is null or not finite."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", weights_col: str = "weights") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` selects, against all other rows.

    Queries travel to the candidates in blocks of at most BROADCAST_LIMIT bytes; each block is one
    scan of the candidates, which never move.  A task emits k rows a query.  Where there are several
    blocks, each one's rows are written before the next is fetched, so the driver holds one block.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[weights_col].alias("w"), is_query.alias("is_query")).where(F.col("w").isNotNull() & F.col("vec_id").isNotNull())
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("w").alias("w"))
    size = queries.agg(F.coalesce(F.sum(F.size("w") + 2), F.lit(0))).first()[0] * 8
    blocks = max(1, -(-size // BROADCAST_LIMIT))
    if blocks > 1:
        queries = materialise(queries, "queries")
    candidates, found = rows.select("vec_id", "w"), None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().sort_by("vec_id")
        best = candidates.mapInArrow(_scorer(part["vec_id"].to_numpy(), _matrix(part["w"]), k), "query_id long, vec_id long, score long")
        if blocks > 1:
            best = materialise(best, "best")
        found = best if found is None else found.unionAll(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unequal length as one int64 matrix, zero beyond a row's end."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    lengths = np.diff(np.asarray(flat.offsets)) if n else np.zeros(0, np.int64)
    out = np.zeros((n, int(lengths.max()) if n else 0), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def select_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, in order, ties to the smaller place: by partition selection of the k-th score."""
    if k >= len(scores):
        return np.lexsort((np.arange(len(scores)), -np.maximum(scores, _LEAST + 1)))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    chosen = np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))
    return chosen[np.lexsort((chosen, -np.maximum(scores[chosen], _LEAST + 1)))]


def _scorer(query_ids: np.ndarray, queries: np.ndarray, k: int):
    nonzero = [np.flatnonzero(row) for row in queries]
    largest = [int(max(abs(int(row.max())), abs(int(row.min())))) if len(row) else 0 for row in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros((len(query_ids), 0), np.int64), np.zeros((len(query_ids), 0), np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows if len(query_ids) else 0, CANDIDATES):
                held = merge(held, batch_best(batch.slice(at, CANDIDATES)))
        ids, scores = held
        which = np.nonzero(scores > _LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[which[0]]), pa.array(ids[which]), pa.array(scores[which])], names=["query_id", "vec_id", "score"])

    def accumulate(row: np.ndarray, terms: np.ndarray, postings: list, scores: np.ndarray) -> None:
        scores[:] = 0
        for d in terms:
            if d < len(postings):
                at, w = postings[d]
                scores[at] += row[d] * w

    def batch_best(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = piece.column("vec_id").to_numpy()
        weights = _matrix(piece.column("w"))
        order = np.argsort(ids, kind="stable")
        ids, weights = ids[order], weights[order]
        postings = []
        for d in range(weights.shape[1]):
            at = np.flatnonzero(weights[:, d])
            postings.append((slice(None) if len(at) == len(ids) else at, weights[at, d]))
        keep = min(k, len(ids))
        own = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
        out_ids, out_scores = np.empty((len(query_ids), keep), np.int64), np.empty((len(query_ids), keep), np.int64)
        scores = np.empty(len(ids), np.int64)
        widest = max(abs(int(weights.max())), abs(int(weights.min()))) * weights.shape[1] if weights.size else 0
        for q, row in enumerate(queries):
            if largest[q] * widest < _MOST:
                accumulate(row, nonzero[q], postings, scores)
            else:  # a sum may leave 64 bits: Python's integers, cut to a long's range
                wide = np.empty(len(ids), object)
                accumulate(row.astype(object), nonzero[q], [(at, w.astype(object)) for at, w in postings], wide)
                scores[:] = [min(max(x, _LEAST + 1), _MOST) for x in wide]
            scores[own[0][q] : own[1][q]] = _LEAST  # the query's own row
            top = select_best(scores, keep)
            out_ids[q], out_scores[q] = ids[top], scores[top]
        return out_ids, out_scores

    def merge(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.concatenate((a[0], b[0]), 1), np.concatenate((a[1], b[1]), 1)
        order = np.lexsort((ids, -np.maximum(scores, _LEAST + 1)), axis=1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    return run
