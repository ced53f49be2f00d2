"""Counts of words and of pairs of neighbouring words over all texts, told to the texts that hold them.

Texts are cut into chunks. A chunk asks once for each distinct word and pair of words it
holds: bucket by bucket of their hashes, as compressed bytes. The task of a bucket adds up
what all chunks ask for and answers with numbers alone, in the order of the questions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from ..plans.scratch import written

#: Tokens of a chunk, and words and pairs that the task of a bucket holds, about.
CHUNK_TOKENS = 1 << 20
BUCKET_ITEMS = 1 << 21

_REQUEST = "bucket int, chunk bigint, lengths binary, letters binary, counts binary"
_ANSWER = "bucket int, chunk bigint, totals binary, words bigint"


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _pack(values: np.ndarray) -> bytes:
    """Integers from 0 on: the lowest bytes of all, then the next ones, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    places = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + _squeeze(places.T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    places = np.frombuffer(_expand(data[1:]), np.uint8).reshape(data[0], -1)
    values = np.zeros((places.shape[1], 8), np.uint8)
    values[:, : data[0]] = places.T
    return values.view("<i8").reshape(-1)


def _bounds(words: pa.Array) -> np.ndarray:
    return np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]


def _letters(words: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of binary values, compressed."""
    if not len(words):
        return _pack(np.zeros(0, np.int64)), _squeeze(b"")
    at = _bounds(words)
    data = words.buffers()[2]
    return _pack(np.diff(at)), _squeeze(data[at[0] : at[-1]].to_pybytes() if data else b"")


def _words(lengths: np.ndarray, letters: bytes) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(letters)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (key, tokens); a long text goes on in the next chunk."""
    from pyspark import TaskContext

    first, number = TaskContext.get().partitionId() << 32, 0
    held: list[tuple[pa.Array, np.ndarray, pa.Array]] = []
    size = 0

    def joined() -> tuple[pa.Array, np.ndarray, pa.Array]:
        keys, sizes, tokens = zip(*held)
        return pa.concat_arrays(keys), np.concatenate(sizes), pa.concat_arrays(tokens)

    def chunk(keys: pa.Array, sizes: np.ndarray, tokens: pa.Array, partner: bool) -> pa.RecordBatch:
        coded = tokens.dictionary_encode()
        words = coded.dictionary.cast(pa.binary())
        order = pc.array_sort_indices(words).to_numpy()
        rank = np.empty(len(words) + 1, np.int64)
        rank[order], rank[-1] = np.arange(1, len(words) + 1), 0
        codes = rank[pc.fill_null(coded.indices.cast(pa.int64()), len(words)).to_numpy()]
        lengths, letters = _letters(words.take(pa.array(order)))
        row = {
            "chunk": pa.array([first + number], pa.int64()),
            "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            "tokens": pa.array([len(codes)], pa.int64()),
            "partner": pa.array([partner]),
        }
        packed = {"sizes": _pack(sizes), "codes": _pack(codes), "lengths": lengths, "letters": letters}
        return pa.RecordBatch.from_pydict(row | {k: pa.array([v], pa.binary()) for k, v in packed.items()})

    for batch in batches:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        held.append((batch.column(0), sizes, lists.flatten()))
        size += len(held[-1][2])
        if size < CHUNK_TOKENS:
            continue
        keys, sizes, tokens = joined()
        ends, a, i = np.cumsum(sizes), 0, 0
        while len(tokens) - a >= CHUNK_TOKENS:
            b = a + CHUNK_TOKENS
            j = int(np.searchsorted(ends, b))  # the text that holds token b - 1
            partner = bool(ends[j] > b)
            part = sizes[i : j + 1].copy()
            part[-1] -= ends[j] - b
            sizes[j] = ends[j] - b
            part[-1] += partner
            yield chunk(keys[i : j + 1], part, tokens[a : b + partner], partner)
            number, a, i = number + 1, b, j
        held, size = [(keys[i:], sizes[i:], tokens[a:])], len(tokens) - a
    if size:
        yield chunk(*joined(), False)


class _Chunk:
    """The words of a chunk, its pairs of neighbours and the order in which it asks for them."""

    def __init__(self, row: dict, buckets: int) -> None:
        self.letters = _words(_unpack(row["lengths"]), _expand(row["letters"]))
        sizes, codes = _unpack(row["sizes"]), _unpack(row["codes"]) - 1
        self.n = n = len(self.letters)
        own = codes[: len(codes) - row["partner"]]
        self.counts = np.bincount(own[own >= 0], minlength=n)
        text = np.repeat(np.arange(len(sizes)), sizes)
        near = (text[1:] == text[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0)
        self.text, self.texts = text[:-1][near], len(sizes)
        self.places = codes[:-1][near] * n + codes[1:][near]
        self.buckets = buckets

    def ask(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of words and then pairs by bucket, and where each bucket begins."""
        hashed = np.array([zlib.crc32(w) for w in self.letters.to_pylist()], np.uint64)
        both = hashed[pairs // self.n] * np.uint64(0x9E3779B97F4A7C15) + hashed[pairs % self.n] if self.n else hashed
        mixed = np.concatenate([hashed, both]) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)
        return np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=self.buckets).cumsum()


def _escaped(words: pa.Array) -> pa.Array:
    """No word holds a zero byte, which parts the words of a pair."""
    return pc.replace_substring(pc.replace_substring(words, b"\x01", b"\x01\x01"), b"\x00", b"\x01\x02")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _requests(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row, buckets)
            pairs, counts = np.unique(chunk.places, return_counts=True)
            order, ends = chunk.ask(pairs)
            words = _escaped(chunk.letters)
            first, second = (words.take(pa.array(p)) for p in (pairs // max(chunk.n, 1), pairs % max(chunk.n, 1)))
            asked = pa.concat_arrays([words, pc.binary_join_element_wise(first, second, b"\x00")]).take(pa.array(order))
            counts = np.concatenate([chunk.counts, counts])[order]
            made = {name: [] for name in ("bucket", "chunk", "lengths", "letters", "counts")}
            for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                if b > a:
                    values = (k, row["chunk"], *_letters(asked[a:b]), _pack(counts[a:b]))
                    for name, value in zip(made, values):
                        made[name].append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), kinds)], list(made))

    return ask


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each bucket of this task and answers its rows, one by one."""
    held: dict[int, list[tuple[int, bytes, bytes, bytes]]] = {}
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(bucket, []).append(tuple(row))
    for bucket in sorted(held):
        rows = held.pop(bucket)
        lengths = [_unpack(row[1]) for row in rows]
        counts = np.concatenate([_unpack(row[3]) for row in rows])
        asked = _words(np.concatenate(lengths), b"".join(_expand(row[2]) for row in rows)).dictionary_encode()
        at = asked.indices.to_numpy()
        totals = np.bincount(at, weights=counts).astype(np.int64)[at]
        words = pc.sum(pc.equal(pc.find_substring(asked.dictionary, b"\x00"), -1)).as_py()
        ends = np.cumsum([len(x) for x in lengths])
        packed = [_pack(totals[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([bucket] * len(rows), pa.int32()),
                pa.array([row[0] for row in rows], pa.int64()),
                pa.array(packed, pa.binary()),
                pa.array([words] + [0] * (len(rows) - 1), pa.int64()),
            ],
            ["bucket", "chunk", "totals", "words"],
        )


def bigram_logp(tokens: DataFrame, key: str, column: str) -> DataFrame:
    """(key, scored, logp): pairs of neighbours and their log probability, for parts of texts.

    Of the add-one model over all texts: ln((count of the pair + 1) / (count of its first
    word + number of distinct words)). Null tokens are no words and part their neighbours.
    """
    spark = tokens.sparkSession
    kind = tokens.schema[key].dataType
    blobs = [StructField(name, BinaryType()) for name in ("sizes", "codes", "lengths", "letters")]
    plain = [StructField("tokens", LongType()), StructField("partner", BooleanType())]
    schema = StructType([StructField("chunk", LongType()), StructField("keys", ArrayType(kind)), *plain, *blobs])
    chunks = written(tokens.select(key, F.col(column).cast("array<string>")).mapInArrow(_cut, schema), "chunks")
    size = chunks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_ITEMS))
    asked = chunks.drop("keys", "tokens").mapInArrow(_requests(buckets), _REQUEST)
    answers = written(asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_answers, _ANSWER), "totals")
    distinct = answers.agg(F.sum("words")).first()[0] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["keys"]).to_pylist()[0]
        chunk = _Chunk(row, buckets)
        pairs, at = np.unique(chunk.places, return_inverse=True)
        order, _ = chunk.ask(pairs)
        totals = np.empty(len(order), np.int64)
        told = right.sort_by("bucket").column("totals").to_pylist()
        totals[order] = np.concatenate([np.zeros(0, np.int64), *(_unpack(x) for x in told)])
        first = totals[: chunk.n][pairs // max(chunk.n, 1)]
        logp = np.log((totals[chunk.n :] + 1) / (first + distinct))
        scored = np.bincount(chunk.text, minlength=chunk.texts)
        sums = np.bincount(chunk.text, weights=logp[at], minlength=chunk.texts)
        some = np.flatnonzero(scored)
        keys = pa.concat_arrays([c.flatten() for c in left.column("keys").chunks]).take(pa.array(some))
        return pa.table({key: keys, "scored": pa.array(scored[some], pa.int64()), "logp": pa.array(sums[some], pa.float64())})

    told = StructType([StructField(key, kind), StructField("scored", LongType()), StructField("logp", DoubleType())])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, told)
