"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes proposes cuts; a proposal holds if none lies in
the ``least`` bytes before it, and stretches without cuts are cut every ``most`` bytes.
Cuts depend on nearby content only, so after an insertion the same chunks come again.

Repeats are found in two steps. First 64-bit hashes of chunks, with the smallest and
largest doc_id of each, are summed up; those of two documents or more fill one Bloom
filter of bounded size. A second pass lets through only runs of chunks that the filter
suspects, of ``min_run`` bytes or more. Each chunk of such a run may be known from another
document by chance; a passage counts only if one other document holds it together. So
windows of consecutive chunks that just reach ``min_run`` bytes are grouped by the
128-bit digest of their bytes over all documents, which settles whether and where a window
came first. A chunk of a shared passage always lies in such a window: the shortest that
ends with it, or else the shortest from the passage's start. What is reported is the union
of the windows that two documents hold.

Defined results. Null and empty texts have no chunks, nor have rows with a null doc_id.
The document of smallest doc_id keeps a window, and a byte goes if it lies in any window
that an earlier document keeps; repeats within one document, or in rows that repeat its
doc_id, do not count. Texts of any length are read whole. Offsets are bytes
of UTF-8; what ``drop_repeats`` cuts out is narrowed to whole characters. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .bloom import filter_bits, filter_of, positions, test_bits

#: One random 32-bit number per byte value. Zero bytes count as nothing: they separate texts.
GEAR = np.random.default_rng(20240229).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
GEAR[0] = 0

_WINDOW = 32
_AT_ONCE = 2 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of it and the 31 before: sum of gear[byte] << distance."""
    h = GEAR[data]
    width = 1
    while width < _WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    return h


def cuts(data: np.ndarray, bits: int = 4, least: int = 8) -> np.ndarray:
    """Ends of chunks: where the hash's top bits are 0 and no proposal came shortly before."""
    proposed = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1
    if len(proposed) < 2:
        return proposed
    return proposed[np.concatenate(([True], np.diff(proposed) >= least))]


def chunk_bounds(text: bytes, ends: np.ndarray, most: int = 256) -> list[int]:
    """0, all cuts of one text, its length; stretches of more than ``most`` bytes are cut."""
    bounds = [0]
    for end in [*ends.tolist(), len(text)]:
        while end - bounds[-1] > most:
            bounds.append(bounds[-1] + most)
        if end > bounds[-1]:
            bounds.append(end)
    return bounds


def chunked(texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(number, bounds) of each text; many texts share one pass of the hash."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _AT_ONCE):
            size += len(texts[stop]) + _WINDOW
            stop += 1
        gap = b"\x00" * _WINDOW
        data = np.frombuffer(gap + gap.join(texts[start:stop]), np.uint8)
        ends, at = cuts(data), _WINDOW
        for number in range(start, stop):
            a, b = np.searchsorted(ends, (at + 1, at + len(texts[number])))
            yield number, chunk_bounds(texts[number], ends[a:b] - at)
            at += len(texts[number]) + _WINDOW
        start = stop


def _hashes(text: bytes, bounds: list[int]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    pieces = [text[a:b] for a, b in zip(bounds, bounds[1:])]
    return np.fromiter(map(digest, pieces), np.uint64, len(pieces))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk hash with the smallest and largest doc_id that holds it, per batch."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        hashes, owners = [], []
        for number, bounds in chunked(texts):
            found = _hashes(texts[number], bounds)
            hashes.append(found)
            owners.append(np.full(len(found), ids[number], np.int64))
        if not hashes:
            continue
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        if not len(hashes):
            continue
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        last = np.concatenate((first[1:], [len(hashes)])) - 1
        yield pa.record_batch(
            {
                "hash": pa.array(hashes[first].view(np.int64)),
                "low": pa.array(owners[first]),
                "high": pa.array(owners[last]),
            }
        )


def runs(sizes: list[int], marked: list[bool], min_run: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of marked chunks that come to ``min_run`` bytes."""
    found, start, held = [], None, 0
    for i, (size, mark) in enumerate(zip([*sizes, 0], [*marked, False])):
        if mark:
            start = i if start is None else start
            held += size
        elif start is not None:
            if held >= min_run:
                found.append((start, i))
            start, held = None, 0
    return found


def windows(bounds: np.ndarray, min_run: int) -> np.ndarray:
    """(start, stop) of the shortest windows of whole chunks, by their start and by their end.

    ``bounds`` are those of a run of chunks; both kinds together cover each part of it
    that comes to ``min_run`` bytes.
    """
    after = np.searchsorted(bounds, bounds + min_run)
    before = np.searchsorted(bounds, bounds - min_run, "right") - 1
    has_after, has_before = after < len(bounds), before >= 0
    pairs = np.concatenate(
        (
            np.stack((bounds[has_after], bounds[after[has_after]]), 1),
            np.stack((bounds[before[has_before]], bounds[has_before]), 1),
        )
    )
    return np.unique(pairs, axis=0)


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans (start, stop, first_doc) in order of start; those that touch become one."""
    out: list[list[int]] = []
    for start, stop, first in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
            out[-1][2] = min(out[-1][2], first)
        else:
            out.append([start, stop, first])
    return out


def without(spans: list[list[int]], others: list[list[int]]) -> list[list[int]]:
    """What ``others`` leave of ``spans``; both in order and free of overlaps."""
    out, k = [], 0
    for start, stop, first in spans:
        while k < len(others) and others[k][1] <= start:
            k += 1
        j = k
        while j < len(others) and others[j][0] < stop:
            if others[j][0] > start:
                out.append([start, others[j][0], first])
            start = max(start, others[j][1])
            j += 1
        if start < stop:
            out.append([start, stop, first])
    return out


_SPANS = "doc_id bigint, start int, stop int, first_doc bigint"


def repeated_spans(docs: DataFrame, min_run: int = 120) -> DataFrame:
    """(doc_id, start, stop, first_doc): spans of ``docs(doc_id, text)`` known from others.

    Spans next to each other are told apart by whether this document is the one that keeps
    them (``first_doc`` is its own id) or not (the smallest id among those that do).
    Together they come to ``min_run`` bytes at least.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    repeated = written(
        rows.mapInArrow(_summed, "hash bigint, low bigint, high bigint")
        .groupBy("hash")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("low < high")
        .select("hash"),
        "chunk-hashes",
    )
    bits = filter_bits(repeated.count())
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(repeated, bits))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            digests, owners, starts, stops = [], [], [], []
            for number, bounds in chunked(texts):
                text = texts[number]
                maybe = test_bits(words, positions(_hashes(text, bounds), bits))
                if not maybe.any():
                    continue
                bounds = np.array(bounds)
                for a, b in runs(np.diff(bounds).tolist(), maybe.tolist(), min_run):
                    for start, stop in windows(bounds[a : b + 1], min_run).tolist():
                        digests.append(xxhash.xxh3_128_digest(text[start:stop]))
                        owners.append(ids[number])
                        starts.append(start)
                        stops.append(stop)
            yield pa.record_batch(
                {
                    "digest": pa.array(digests, pa.binary()),
                    "doc_id": pa.array(owners, pa.int64()),
                    "start": pa.array(starts, pa.int32()),
                    "stop": pa.array(stops, pa.int32()),
                }
            )

    held_windows = written(
        rows.mapInArrow(suspect, "digest binary, doc_id bigint, start int, stop int"), "windows"
    )
    firsts = (
        held_windows.groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .filter("first_doc < last_doc")
        .select("digest", "first_doc")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by document and start; a stretch ends where no window goes on."""
        doc, end, held = None, 0, []
        for batch in batches:
            out = []
            for doc_id, start, stop, first in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (doc_id != doc or start > end):
                    out += spans(doc, held)
                    held = []
                end = max(end, stop) if held else stop
                doc = doc_id
                held.append([start, stop, first])
            yield batch_of(out)
        if held:
            yield batch_of(spans(doc, held))

    def spans(doc: int, held: list[list[int]]) -> list[tuple]:
        lost = merged([s for s in held if s[2] < doc])
        own = without(merged([s for s in held if s[2] == doc]), lost)
        return [(doc, *s) for s in sorted(lost + own)]

    def batch_of(out: list) -> pa.RecordBatch:
        names = ("doc_id", "start", "stop", "first_doc")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.record_batch(
            {n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))}
        )

    return (
        held_windows.join(firsts, "digest")
        .select("doc_id", "start", "stop", "first_doc")
        .repartition("doc_id")
        .sortWithinPartitions("doc_id", "start", "stop")
        .mapInArrow(joined, _SPANS)
    )


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans, each narrowed to whole characters."""
    kept, at = [], 0
    for start, stop in sorted(spans):
        while start < stop and text[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop -= 1
        kept.append(text[at:start])
        at = max(at, stop)
    return b"".join([*kept, text[at:]])


def drop_repeats(docs: DataFrame, min_run: int = 120) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id and the text without what others keep."""
    lost = (
        repeated_spans(docs, min_run)
        .filter("first_doc <> doc_id")
        .groupBy(F.col("doc_id").alias("lost_by"))
        .agg(F.collect_list(F.struct("start", "stop")).alias("lost"))
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut_out(text, [(s["start"], s["stop"]) for s in gone or ()])
                for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "text": pa.array(texts, pa.binary()).cast(pa.string()),
                }
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return (
        rows.join(lost, F.col("doc_id") == F.col("lost_by"), "left")
        .select("doc_id", "text", "lost")
        .mapInArrow(rewrite, "doc_id bigint, text string")
    )
