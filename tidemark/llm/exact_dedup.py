"""Exact deduplication by Grace hashing.

Every text is normalised (white space deleted) and folded, in the task that reads it,
into an open-addressing table that compares whole contents: a hot group leaves each
task as one row. What remains is dealt into buckets by the leading bits of a hash. A
bucket whose distinct contents exceed ``bucket_bytes`` is written to a spill table in
the shared folder and partitioned again by four more bits, until every bucket fits one
table or holds one hash value only. Spill tables lie in the folder of
``spark.checkpoint.dir``, so a lost executor costs a repeated task and no more.

Defined results. Null texts count as empty; all empty texts are one group. Of equal
texts the row with most code points stays, ties going to the smallest doc_id; null
doc_ids come last. Rows that repeat doc_id and text are one document given more than
once: each counts in ``group_size``, all carry the same mark, and ``drop_copies`` keeps
one of them. Other columns are carried by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from .names import fresh

#: The characters that do not count: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"

_NO_ID = -(2**63)

_FOLDED = (
    "doc_id bigint, digest binary, hash bigint, content binary, n_bytes bigint, "
    "copies bigint, chars bigint"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("digest", pa.binary()),
        ("hash", pa.int64()),
        ("content", pa.binary()),
        ("n_bytes", pa.int64()),
        ("copies", pa.int64()),
        ("chars", pa.int64()),
    ]
)


def normalise(text: bytes) -> bytes:
    return text.translate(None, BLANKS)


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self) -> None:
        self._slots = array("q", [-1]) * 256
        self.entries: list[list] = []
        self.held = 0

    def _slot(self, hashed: int, content: bytes) -> int:
        mask = len(self._slots) - 1
        at = hashed & mask
        while (entry := self._slots[at]) >= 0:
            found = self.entries[entry]
            if found[0] == hashed and found[1] == content:
                return at
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self._slots = array("q", [-1]) * (4 * len(self._slots))
        mask = len(self._slots) - 1
        for number, entry in enumerate(self.entries):
            at = entry[0] & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = number

    def add(self, hashed: int, content: bytes, copies: int, chars: int, doc_id) -> None:
        at = self._slot(hashed, content)
        if self._slots[at] < 0:
            self._slots[at] = len(self.entries)
            self.entries.append([hashed, content, copies, chars, doc_id])
            self.held += len(content) + 200
            if 2 * len(self.entries) > len(self._slots):
                self._grow()
            return
        entry = self.entries[self._slots[at]]
        entry[2] += copies
        if _better(chars, doc_id, entry[3], entry[4]):
            entry[3], entry[4] = chars, doc_id


def _better(chars: int, doc_id, than_chars: int, than_id) -> bool:
    if chars != than_chars:
        return chars > than_chars
    return doc_id is not None and (than_id is None or doc_id < than_id)


def _contents(table: ContentTable, at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for entry in table.entries:
        part.append(entry)
        size += len(entry[1])
        if size > at_once:
            yield _content_batch(part)
            part, size = [], 0
    if part:
        yield _content_batch(part)


def _content_batch(part: list[list]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([e[4] for e in part], pa.int64()),
            pa.nulls(len(part), pa.binary()),
            pa.array([e[0] for e in part], pa.int64()),
            pa.array([e[1] for e in part], pa.binary()),
            pa.array([len(e[1]) for e in part], pa.int64()),
            pa.array([e[2] for e in part], pa.int64()),
            pa.array([e[3] for e in part], pa.int64()),
        ],
        schema=_ARROW,
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fold(docs: DataFrame, table_bytes: int = 24 << 20) -> DataFrame:
    """Per document a row (doc_id, digest); per content of a task a row with its copies.

    A task's table is given out and begun anew when it exceeds ``table_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            ids, texts, chars = (c.to_pylist() for c in batch.columns)
            digests = []
            for doc_id, text, n in zip(ids, texts, chars):
                content = normalise(text)
                digests.append(hashlib.sha256(content).digest())
                table.add(_signed(xxhash.xxh3_64_intdigest(content)), content, 1, n, doc_id)
                if table.held > table_bytes:
                    yield from _contents(table)
                    table = ContentTable()
            blank = pa.nulls(len(ids), pa.int64())
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(digests, pa.binary()),
                    blank,
                    pa.nulls(len(ids), pa.binary()),
                    blank,
                    blank,
                    blank,
                ],
                schema=_ARROW,
            )
        yield from _contents(table)

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint"), text.cast("binary"), F.length(text).cast("bigint")
    ).mapInArrow(run, _FOLDED)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, one after the other, each through one table."""
    table, current = ContentTable(), None
    for batch in batches:
        for bucket, hashed, content, copies, chars, doc_id in zip(
            *(c.to_pylist() for c in batch.columns)
        ):
            if bucket != current:
                yield from _groups(table)
                table, current = ContentTable(), bucket
            table.add(hashed, content, copies, chars, doc_id)
    yield from _groups(table)


def _groups(table: ContentTable) -> Iterator[pa.RecordBatch]:
    if table.entries:
        yield pa.record_batch(
            {
                "digest": pa.array(
                    [hashlib.sha256(e[1]).digest() for e in table.entries], pa.binary()
                ),
                "keep_id": pa.array([e[4] for e in table.entries], pa.int64()),
                "group_size": pa.array([e[2] for e in table.entries], pa.int64()),
            }
        )


def grace_groups(contents: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row per distinct content: digest, keep_id, group_size."""
    rows, settled = contents, []
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = max(0, ceil(log2(max(1, 2 * total / bucket_bytes))))
    while True:
        bits = min(bits, 63)
        bucket = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("bigint")
        dealt = rows.withColumn("bucket", bucket)
        over = (
            dealt.groupBy("bucket", "hash")
            .agg(F.max("n_bytes").alias("n_bytes"))
            .groupBy("bucket")
            .agg(F.sum("n_bytes").alias("held"), F.count("*").alias("hashes"))
            .filter((F.col("held") > bucket_bytes) & (F.col("hashes") > 1))
            .select("bucket")
        )
        full = bits < 63 and not over.isEmpty()
        fitting = dealt.join(over, "bucket", "left_anti") if full else dealt
        settled.append(
            fitting.select("bucket", "hash", "content", "copies", "chars", "doc_id")
            .repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(_settle, "digest binary, keep_id bigint, group_size bigint")
        )
        if not full:
            break
        rows = written(dealt.join(over, "bucket", "left_semi").drop("bucket"), "grace-spill")
        bits += 4
    groups = settled[0]
    for more in settled[1:]:
        groups = groups.union(more)
    return groups


def exact_groups(
    docs: DataFrame, table_bytes: int = 24 << 20, bucket_bytes: int = 8 << 20
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, digest, keep_id, group_size, kept."""
    folded = written(fold(docs, table_bytes), "grace-fold")
    groups = grace_groups(folded.filter(F.col("content").isNotNull()), bucket_bytes)
    rows = folded.filter(F.col("content").isNull()).select("doc_id", "digest")
    return rows.join(groups, "digest").select(
        "doc_id",
        "digest",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def digest_of(text: str) -> Column:
    """What ``exact_groups`` calls the digest of a text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.unhex(F.sha2(bare.cast("binary"), 256))


def drop_copies(
    docs: DataFrame, table_bytes: int = 24 << 20, bucket_bytes: int = 8 << 20
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Of rows that repeat doc_id and text the first by the other columns stays.
    """
    no_id = F.lit(_NO_ID)
    own_id, own_digest, own_again = fresh(docs, "__id", "__digest", "__again")
    copies = (
        exact_groups(docs, table_bytes, bucket_bytes)
        .filter(~F.col("kept"))
        .select(F.coalesce("doc_id", no_id).alias(own_id), F.col("digest").alias(own_digest))
        .distinct()
    )
    keyed = docs.withColumns(
        {
            own_id: F.coalesce(F.col("doc_id").cast("bigint"), no_id),
            own_digest: digest_of("text"),
        }
    )
    stay = keyed.join(copies, [own_id, own_digest], "left_anti")
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != "text" and "map<" not in kind and kind != "variant"]
    again = Window.partitionBy(own_id, own_digest).orderBy(own_id, *others)
    return (
        stay.withColumn(own_again, F.row_number().over(again))
        .filter(F.col(own_again) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
