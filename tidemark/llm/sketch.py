"""A count sketch of 64-bit hashes over a whole table: a few MB, however large the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a row. Two rows of 32-bit counts: 16 MB where they are broadcast.
CELLS = 1 << 21

#: Rows; a hash is estimated by the least of its cells.
ROWS = 2

#: Cells of one segment: sketches travel and are merged segment by segment.
SEGMENT_CELLS = 1 << 17

SEGMENTS = "segment int, counts binary"

_MOST = np.iinfo(np.uint32).max


def cells(hashes: np.ndarray) -> list[np.ndarray]:
    """The cell of each hash in each row."""
    mask = np.uint64(CELLS - 1)
    bits = hashes.view(np.uint64)
    return [(bits >> np.uint64(20 * i + 3)) & mask for i in range(ROWS)]


def _packed(counts: np.ndarray) -> bytes:
    """The counts by bytes of equal weight, which are mostly zero, compressed."""
    return pa.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data, 4 * SEGMENT_CELLS, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


class Counts:
    """The sketch of one task."""

    def __init__(self) -> None:
        self.rows = np.zeros((ROWS, CELLS), np.uint32)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        for row, at in zip(self.rows, cells(hashes)):
            np.add.at(row, at, counts.astype(np.uint32))

    def segments(self) -> Iterator[tuple[int, bytes]]:
        for i, part in enumerate(self.rows.reshape(-1, SEGMENT_CELLS)):
            if part.any():
                yield i, _packed(part)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment after another, so that a task holds one at a time."""
    held, total = None, None

    def out() -> pa.RecordBatch:
        counts = _packed(np.minimum(total, _MOST).astype(np.uint32))
        return pa.record_batch(
            {"segment": pa.array([held], pa.int32()), "counts": pa.array([counts], pa.binary())}
        )

    for batch in batches:
        for segment, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != held:
                if held is not None:
                    yield out()
                held, total = segment, np.zeros(SEGMENT_CELLS, np.uint64)
            total += _unpacked(counts)
    if held is not None:
        yield out()


def merged(segments: DataFrame) -> np.ndarray:
    """The sum of the sketches of all tasks. Counts beyond 32 bits stay at the largest."""
    parts = (
        segments.repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merge, SEGMENTS)
        .toLocalIterator()
    )
    rows = np.zeros((ROWS * CELLS // SEGMENT_CELLS, SEGMENT_CELLS), np.uint32)
    for part in parts:
        rows[part["segment"]] = _unpacked(part["counts"])
    return rows.reshape(ROWS, CELLS)


def estimates(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """At least the count of each hash."""
    first, second = (row[at] for row, at in zip(rows, cells(hashes)))
    return np.minimum(first, second)
