"""Nearest neighbours by a block matrix join with int8 tiles.

Queries come in blocks of bounded size; each block meets every row of the table, a tile
of rows (one Arrow batch) at a time. Both sides are quantised to int8, with one scale per
tile and per block, and one matrix product gives all quantised distances of the tile. A
vector's quantisation error is known, and by the triangle inequality the true distance
lies within the sum of both errors. Pairs whose least distance exceeds the k-th smallest
greatest distance cannot be among the k nearest; all others are computed again from the
original vectors in double precision. Each task keeps one heap per query, and the heaps
of all tasks are merged by query. The result is exact: recall is 1.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows with a null id. Only vectors of the query's length are its
candidates. Rows that repeat an id are one candidate, at the smallest distance any of them
has, and one query, with the vector that is smallest by component. A query is not its own
candidate. Ties go to the smaller id. With fewer than k candidates all are given; a query
without candidates gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest stretch of components whose int8 products float32 sums exactly.
_EXACT = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, embedding as array<double>."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")


class Quantised:
    """int8 codes of the rows of a matrix under one scale, their norms and errors."""

    def __init__(self, x: np.ndarray) -> None:
        self.scale = float(np.abs(x).max()) / 127 or 1.0
        codes = np.rint(x / self.scale)
        self.codes = codes.astype(np.int8)
        self.norms = np.einsum("ij,ij->i", codes, codes) * self.scale**2
        left = x - codes * self.scale
        self.errors = np.sqrt(np.einsum("ij,ij->i", left, left))


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of two int8 matrices, through float32 where that holds them exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _EXACT):
        part = a[:, at : at + _EXACT].astype(np.float32)
        out += part @ b[:, at : at + _EXACT].astype(np.float32).T
    return out


def bounds(q: Quantised, x: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each query to each row of a tile."""
    squares = q.norms[:, None] + x.norms[None, :]
    squares -= 2 * q.scale * x.scale * tile_products(q.codes, x.codes)
    near = np.sqrt(np.maximum(squares, 0))
    # The last term covers what double precision loses where near vectors cancel out.
    slack = (q.errors[:, None] + x.errors[None, :]) * (1 + 1e-9)
    slack += 1e-6 * near + 1e-7 * (np.sqrt(q.norms)[:, None] + np.sqrt(x.norms)[None, :])
    return near - slack, near + slack


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, components added in their order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        apart = a[:, i] - b[:, i]
        total += apart * apart
    return np.sqrt(total)


def _merged(held: list, more: list, k: int) -> list:
    """The k nearest of both, each id once."""
    best: dict[int, float] = {}
    for score, vec_id in [*held, *more]:
        if vec_id not in best or score < best[vec_id]:
            best[vec_id] = score
    return nsmallest(k, ((s, i) for i, s in best.items()))


def _answer(heaps: dict[int, list]) -> pa.RecordBatch:
    rows = [(q, i, s) for q, heap in heaps.items() for s, i in heap]
    return pa.record_batch(
        {
            "query_id": pa.array([r[0] for r in rows], pa.int64()),
            "vec_id": pa.array([r[1] for r in rows], pa.int64()),
            "score": pa.array([r[2] for r in rows], pa.float64()),
        }
    )


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _block_scan(rows: DataFrame, block: list, k: int) -> DataFrame:
    """Per task the k nearest of each query of one block."""
    by_length: dict[int, tuple] = {}
    for length in {len(r["embedding"]) for r in block}:
        mine = sorted((r for r in block if len(r["embedding"]) == length), key=lambda r: r["vec_id"])
        by_length[length] = (
            np.array([r["vec_id"] for r in mine], np.int64),
            np.array([r["embedding"] for r in mine], np.float64),
        )
    shared = rows.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {n: (*q, Quantised(q[1])) for n, q in shared.value.items()}
        heaps: dict[int, list] = {}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for length in np.unique(lengths).tolist():
                if length not in blocks:
                    continue
                at = np.flatnonzero(lengths == length)
                tile = batch.take(pa.array(at)) if len(at) < len(lengths) else batch
                ids = tile.column(0).to_numpy()
                search(*blocks[length], ids, _matrix(tile.column(1), length), heaps)
        yield _answer(heaps)

    def search(q_ids, q, quantised, ids, x, heaps, at_once=2048) -> None:
        for start in range(0, len(ids), at_once):
            some, tile = ids[start : start + at_once], x[start : start + at_once]
            least, most = bounds(quantised, Quantised(tile))
            own = q_ids[:, None] == some[None, :]
            least[own] = most[own] = np.inf
            limit = np.full(len(q_ids), np.inf)
            # One id may come several times, so the k-th greatest distance counts ids.
            if len(np.unique(some)) == len(some) and len(some) >= k:
                limit = np.partition(most, k - 1, axis=1)[:, k - 1]
            held = np.array(
                [heap[-1][0] if len(heap := heaps.get(i, ())) == k else np.inf for i in q_ids.tolist()]
            )
            q_at, x_at = np.nonzero(
                (least <= np.minimum(limit, held)[:, None]) & np.isfinite(least)
            )
            scores = distances(q[q_at], tile[x_at])
            ends = np.searchsorted(q_at, np.arange(len(q_ids) + 1))
            scores, found = scores.tolist(), some[x_at].tolist()
            for number, query_id in enumerate(q_ids.tolist()):
                a, b = ends[number], ends[number + 1]
                if a < b:
                    heaps[query_id] = _merged(
                        heaps.get(query_id, []), list(zip(scores[a:b], found[a:b])), k
                    )

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 16_384
) -> DataFrame:
    """``queries(vec_id, embedding)`` against ``vectors``: query_id, rank, vec_id, score.

    Blocks of about ``block_rows`` queries are gathered one by one and broadcast; the
    table is scanned once per block, and nothing but heaps is shuffled.
    """
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_blocks = max(1, -(-asked.count() // block_rows))
    found = None
    for number in range(n_blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number).collect()
        part = _block_scan(rows, mine, k)
        found = part if found is None else found.union(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            fresh: dict[int, list] = {}
            for query_id, vec_id, score in zip(*(c.to_pylist() for c in batch.columns)):
                fresh.setdefault(query_id, []).append((score, vec_id))
            for query_id, more in fresh.items():
                heaps[query_id] = _merged(heaps.get(query_id, []), more, k)
        rows = [(q, n, i, s) for q, h in heaps.items() for n, (s, i) in enumerate(h, 1)]
        yield pa.record_batch(
            {
                "query_id": pa.array([r[0] for r in rows], pa.int64()),
                "rank": pa.array([r[1] for r in rows], pa.int32()),
                "vec_id": pa.array([r[2] for r in rows], pa.int64()),
                "score": pa.array([r[3] for r in rows], pa.float64()),
            }
        )

    return found.repartition("query_id").mapInArrow(
        merge, "query_id bigint, rank int, vec_id bigint, score double"
    )
