"""Line deduplication with two Bloom filters.

A first pass enters each document's distinct line keys into a pair of filters per task:
seen once, seen twice. The pairs are merged segment by segment into one filter of keys
seen twice anywhere, which is broadcast; its size is bounded. A second pass lets through
only lines that this filter suspects of repeating. They alone are shuffled, grouped by
the whole key (which confirms exactly), and the occurrence that stays is chosen.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines
but those of the largest doc_id holding them.

Defined results. A null or empty text is one empty line. Each row is one document; rows
that repeat a doc_id share its fate. Null doc_ids are smaller than all others; a key that
only they hold stays. A document that loses all lines has an empty text. Lines of any
length are compared whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .bloom import SEGMENTS, SeenTwice, filter_bits, merged_twice, positions, test_bits

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """At least ``min_chars`` code points of UTF-8."""
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode()) >= min_chars


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    return {
        key for line in text.split(b"\n") if long_enough(key := line_key(line), min_chars)
    }


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )


def suspects(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(key, digest, doc_id) of the lines that may repeat, once per document and key."""
    rows = _input(docs)
    lines = docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")))).first()[0]
    bits = filter_bits(lines or 0)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice(bits)
        for batch in batches:
            keys = []
            for text in batch.column(0).to_pylist():
                keys += keys_of(text, min_chars)
            seen.add(hashes_of(keys))
        yield from seen.segments()

    twice = merged_twice(rows.select("text").mapInArrow(enter, SEGMENTS), bits)
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            keys, owners = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                mine = keys_of(text, min_chars)
                keys += mine
                owners += [doc_id] * len(mine)
            if not keys:
                continue
            maybe = np.flatnonzero(test_bits(words, positions(hashes_of(keys), bits))).tolist()
            yield pa.record_batch(
                {
                    "key": pa.array([keys[i] for i in maybe], pa.binary()),
                    "digest": pa.array(
                        [xxhash.xxh3_128_digest(keys[i]) for i in maybe], pa.binary()
                    ),
                    "doc_id": pa.array([owners[i] for i in maybe], pa.int64()),
                }
            )

    return rows.mapInArrow(suspect, "key binary, digest binary, doc_id bigint")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_lines, n_dropped and the kept text."""
    rows = written(suspects(docs, min_chars), "suspects")
    repeated = (
        rows.groupBy("key")
        .agg(
            F.count("*").alias("holders"),
            F.max("doc_id").alias("keep"),
            F.first("digest").alias("digest"),
        )
        .filter(F.col("holders") >= min_docs)
        .select("digest", "keep")
    )
    lost = (
        rows.select("digest", "doc_id")
        .join(repeated, "digest")
        .filter(F.col("doc_id").isNull() & F.col("keep").isNotNull() | (F.col("doc_id") < F.col("keep")))
        .groupBy(F.col("doc_id").alias("lost_by"))
        .agg(F.collect_set("digest").alias("lost"))
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [
                        line
                        for line in lines
                        if not (
                            long_enough(key := line_key(line), min_chars)
                            and xxhash.xxh3_128_digest(key) in gone
                        )
                    ]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(text)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_lines": pa.array(n_lines, pa.int64()),
                    "n_dropped": pa.array(n_dropped, pa.int64()),
                    "text": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    return (
        _input(docs)
        .join(lost, F.col("doc_id").eqNullSafe(F.col("lost_by")), "left")
        .select("doc_id", "text", "lost")
        .mapInArrow(rewrite, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")
    )
