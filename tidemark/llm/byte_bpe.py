"""Byte-level BPE: encoding and decoding with a two-tier lookup.

Text is cut into pre-tokens by the vocabulary's pattern. First tier: a minimal perfect
hash over the vocabulary, asked for all new pre-tokens of a batch at once, resolves
those that are a token as a whole. Second tier: a miss is merged over its linked bytes,
a heap giving the pair of lowest rank, leftmost first. Results of both are remembered
in a table of bounded size, as the same pre-tokens come again and again.

Defined results. A null text counts as empty and has no ids. Any text can be encoded,
as each single byte is a token; decoding gives the same bytes back. A text of more than
``PIECES_AT_ONCE`` pre-tokens is encoded group after group, so a very long one costs its ids and
one group. Ids outside the vocabulary make ``decode`` fail. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the table of remembered pre-tokens in one Python worker.
REMEMBERED = 250_000

#: Pre-tokens of a text that are Python objects at one time.
PIECES_AT_ONCE = 32_768

_LOW64 = (1 << 64) - 1
_SHIFT = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ascii_pattern(pattern: str) -> str:
    """The pattern as it acts on ASCII text, in terms of the faster standard ``re``."""
    sets = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}
    out, inside = "", False
    for part in re.findall(r"\\p\{.\}|\\.|.", pattern, re.DOTALL):
        if part in sets:
            out += sets[part] if inside else f"[{sets[part]}]"
        elif part == r"\S":
            out += r"[^\t-\r ]"
        else:
            inside = part == "[" or (inside and part != "]")
            out += part
    return out


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, each key in its own slot.

    A key's 64-bit hash names a bucket; hash and displacement of the bucket together name
    the slot. Large buckets choose their displacement first; buckets of one key take what
    slots are left, stored as the slot itself (negative). The slot keeps the key's full
    hash, and the caller compares the key itself.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = max(1, len(keys))
        self.n_buckets = max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < len(keys):
            raise ValueError("two keys share a hash")
        members: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, h in enumerate(hashes):
            members[(h >> 32) % self.n_buckets].append(i)
        self.displaced = np.zeros(self.n_buckets, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        taken = bytearray(n)
        free = 0
        for b in sorted(range(self.n_buckets), key=lambda b: -len(members[b])):
            mine = members[b]
            if not mine:
                break
            if len(mine) == 1:
                while taken[free]:
                    free += 1
                slots, self.displaced[b] = [free], -free - 1
            else:
                shift = 0
                while True:
                    slots = [self._slot(hashes[i], shift) for i in mine]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    shift += 1
                self.displaced[b] = shift
            for i, s in zip(mine, slots):
                taken[s] = 1
                self.key_at[s] = i
        self.hash_at = np.zeros(n, np.uint64)
        used = self.key_at >= 0
        self.hash_at[used] = np.array(hashes, np.uint64)[self.key_at[used]]

    def _slot(self, hashed: int, shift: int) -> int:
        mixed = (hashed ^ (shift * _SHIFT & _LOW64)) * _MIX & _LOW64
        return (mixed >> 33) % self.n

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key, or -1 where its hash is not in the table."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        shift = self.displaced[(hashes >> np.uint64(32)) % np.uint64(self.n_buckets)]
        mixed = (hashes ^ (shift.astype(np.uint64) * np.uint64(_SHIFT))) * np.uint64(_MIX)
        slot = (mixed >> np.uint64(33)) % np.uint64(self.n)
        slot = np.where(shift < 0, -shift - 1, slot.astype(np.int64))
        return np.where(self.hash_at[slot] == hashes, self.key_at[slot], -1)


def merge_bytes(piece: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost among equals, until none merges.

    ``end`` links each token's first byte to the token after it (0: merged away), and
    ``before`` to the token before it. A heap entry packs rank, start and end of a pair;
    it still holds if its two tokens are the ones now linked there.
    """
    n, get = len(piece), ranks.get
    bits = n.bit_length() + 1
    low = (1 << bits) - 1
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [
        (((rank << bits) | i) << bits) | (i + 2)
        for i in range(n - 1)
        if (rank := get(piece[i : i + 2])) is not None
    ]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        stop, left = entry & low, (entry >> bits) & low
        middle = end[left]
        if not middle or middle >= stop or end[middle] != stop:
            continue
        end[left], end[middle] = stop, 0
        if stop < n:
            before[stop] = left
            rank = get(piece[left : end[stop]])
            if rank is not None:
                heappush(heap, (((rank << bits) | left) << bits) | end[stop])
        start = before[left]
        if start >= 0:
            rank = get(piece[start:stop])
            if rank is not None:
                heappush(heap, (((rank << bits) | start) << bits) | stop)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Codec:
    """Vocabulary, perfect hash and remembered pre-tokens of one Python worker."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str) -> None:
        self.ranks = dict(ranks)
        self.tokens = list(self.ranks)
        self.packed = [self.ranks[t].to_bytes(4, "little") for t in self.tokens]
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.hash = PerfectHash(self.tokens)
        self.pattern = pattern
        self._pattern = self._ascii_pattern = None
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def __getstate__(self):
        return {**self.__dict__, "_pattern": None, "_ascii_pattern": None, "_known": {}, "_older": {}}

    def _pattern_for(self, text: str):
        if self._pattern is None:
            self._pattern = regex.compile(self.pattern)
            self._ascii_pattern = re.compile(ascii_pattern(self.pattern))
        return self._ascii_pattern if text.isascii() else self._pattern

    def split(self, text: str) -> list[str]:
        return self._pattern_for(text).findall(text)

    def resolve(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pre-tokens: perfect hash first, merges for the rest."""
        raw = [p.encode() for p in pieces]
        packed = {}
        for piece, key, number in zip(pieces, raw, self.hash.find(raw).tolist()):
            if number >= 0 and self.tokens[number] == key:
                packed[piece] = self.packed[number]
            else:
                ids = merge_bytes(key, self.ranks)
                packed[piece] = pack(f"<{len(ids)}I", *ids)
        return packed

    def _learn(self, pieces: list[str]) -> None:
        """Makes every pre-token of a text known; the oldest go when there are too many."""
        new = set(pieces).difference(self._known)
        if len(self._known) + len(new) > REMEMBERED:
            self._older, self._known = self._known, {}
            new = set(pieces)
        older = self._older
        again = {piece: older[piece] for piece in new if piece in older}
        self._known.update(again)
        self._known.update(self.resolve([piece for piece in new if piece not in again]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        return [
            self._encode(self.split(text))
            if len(text) <= PIECES_AT_ONCE
            else b"".join(map(self._encode, self._groups(text)))
            for text in texts
        ]

    def _groups(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a long text, at most ``PIECES_AT_ONCE`` at a time."""
        pieces = (m[0] for m in self._pattern_for(text).finditer(text))
        while group := list(islice(pieces, PIECES_AT_ONCE)):
            yield group

    def _encode(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self._known.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            return b"".join(map(self._known.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODED = "doc_id bigint, ids binary"

#: Rows of a batch that are Python objects at one time.
ROWS_AT_ONCE = 512


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _shared_codec(spark, path: str, pattern: str):
    """One codec per Python worker: the vocabulary is fixed and small (about 2 MB)."""
    return spark.sparkContext.broadcast(Codec(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id and ids (packed little-endian, 4 bytes each)."""
    shared = _shared_codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in _in_parts(batches):
            ids = codec.encode_batch(batch.column(1).to_pylist())
            yield pa.record_batch(
                {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}
            )

    return _input(docs).mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded(doc_id, ids)`` as doc_id and the bytes the ids stand for."""
    shared = _shared_codec(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in _in_parts(batches):
            texts = [codec.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.record_batch(
                {"doc_id": batch.column(0), "decoded": pa.array(texts, pa.binary())}
            )

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(
        run, "doc_id bigint, decoded binary"
    )


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids, digests of ids and bytes."""
    shared = _shared_codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in _in_parts(batches):
            ids = codec.encode_batch(batch.column(1).to_pylist())
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array(
                        [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids]
                    ),
                }
            )

    return _input(docs).mapInArrow(
        run,
        "doc_id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string",
    )


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))
