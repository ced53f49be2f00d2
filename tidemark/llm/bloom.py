"""A pair of Bloom filters, for what was seen once and what was seen twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of one segment: filters travel and are merged segment by segment.
SEGMENT_BITS = 1 << 19


def filter_bits(expected: int, per_key: int = 10, most: int = 1 << 28) -> int:
    """A power of two of at least ``per_key`` bits for each key, ``most`` at most.

    ``most`` bounds what is broadcast (32 MB). A fuller filter only lets more unique keys
    through to the exact stage; results do not depend on it.
    """
    bits = SEGMENT_BITS
    while bits < per_key * expected and bits < most:
        bits *= 2
    return bits


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bit positions of each 64-bit hash."""
    mask = np.uint64(bits - 1)
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & mask for i in range(3)]


def test_bits(words: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(at[0]), bool)
    for p in at:
        found &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def set_bits(words: np.ndarray, at: list[np.ndarray]) -> None:
    for p in at:
        np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))


class SeenTwice:
    """Both filters of one task."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once = np.zeros(bits // 64, np.uint64)
        self.twice = np.zeros(bits // 64, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of distinct (key, document) pairs; a key that comes again is seen twice."""
        if not len(hashes):
            return
        keys, counts = np.unique(hashes, return_counts=True)
        at = positions(keys, self.bits)
        again = test_bits(self.once, at) | (counts > 1)
        set_bits(self.twice, [p[again] for p in at])
        set_bits(self.once, at)

    def segments(self) -> Iterator[pa.RecordBatch]:
        words = SEGMENT_BITS // 64
        for i in range(self.bits // SEGMENT_BITS):
            once = self.once[i * words : (i + 1) * words]
            twice = self.twice[i * words : (i + 1) * words]
            if once.any() or twice.any():
                yield pa.record_batch(
                    {
                        "segment": pa.array([i], pa.int32()),
                        "once": pa.array([once.tobytes()], pa.binary()),
                        "twice": pa.array([twice.tobytes()], pa.binary()),
                    }
                )


SEGMENTS = "segment int, once binary, twice binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seen twice in all: seen twice in one task, or once in each of two."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            once, twice = np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64)
            if segment in held:
                had_once, had_twice = held[segment]
                held[segment] = [had_once | once, had_twice | twice | (had_once & once)]
            else:
                held[segment] = [once, twice]
    for segment, (_, twice) in held.items():
        yield pa.record_batch(
            {
                "segment": pa.array([segment], pa.int32()),
                "twice": pa.array([twice.tobytes()], pa.binary()),
            }
        )


def merged_twice(segments: DataFrame, bits: int) -> np.ndarray:
    """The filter of what was seen twice anywhere: ``bits`` / 8 bytes, whatever the input."""
    rows = (
        segments.repartition("segment").mapInArrow(_merge, "segment int, twice binary").collect()
    )
    words = np.zeros(bits // 64, np.uint64)
    for row in rows:
        start = row["segment"] * (SEGMENT_BITS // 64)
        words[start : start + SEGMENT_BITS // 64] = np.frombuffer(row["twice"], np.uint64)
    return words


def filter_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """One filter of a column of 64-bit hashes: ``bits`` / 8 bytes, whatever the input."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SeenTwice(bits)
        for batch in batches:
            set_bits(held.twice, positions(batch.column(0).to_numpy().view(np.uint64), bits))
        yield from held.segments()

    return merged_twice(hashes.mapInArrow(enter, SEGMENTS), bits)
