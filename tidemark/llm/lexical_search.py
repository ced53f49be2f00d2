"""Ranked lexical search, term at a time with limited accumulators.

Items are answered in blocks of bounded size. For each block, a first pass writes postings,
the counts of the block's terms in each document, as a table in the shared folder; Spark
counts the documents of each term there. A second pass scores whole documents in groups. For
each item it takes the terms rarest first and keeps one accumulator per document. What the
terms that are left can add at most, each its weight times its largest impact in the group,
bounds the score of documents that have no accumulator yet. Once that bound is below the
k-th best partial score (of the group, or of what the task has finished before), no new
accumulators are made; those that exist are updated to the end, so scores are exact. Each
task gives at most k rows an item, and Spark ranks them.

Terms are the maximal runs of ASCII digits and letters and of all other characters beyond
ASCII, A-Z lower-cased. With N documents that hold a term, L terms in all, n in a document,
df documents that hold a term and tf its occurrences in one: weight w = floor(1000 *
ln((2N + 2) / (2df + 1))), m = 75 + (25 n N) div L, and a document's score is the sum of
w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

Defined results. Null and empty texts have no terms; such documents do not count in N and
are never found. Each row is a document of its own, repeated ids included. Rows that repeat
an item_id are one item with all their terms; items without terms have no rows. Equal scores
rank by ascending doc_id, null last. Terms of more than 64 bytes are compared by SHA-256.
A block holds about ``block`` (item, term) pairs, but never less than one item. Empty tables
give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_SLICE = 1 << 20
_LONGEST = 64

#: Documents, and counts of terms, that are scored together.
GROUP_DOCS, GROUP_COUNTS = 1 << 16, 1 << 21


def term_counts(text: bytes) -> Counter:
    """Terms of a UTF-8 text, a slice at a time, so that a long text costs its distinct terms."""
    counts: Counter = Counter()
    text, at = text.lower(), 0
    while at < len(text):
        stop = min(len(text), at + _SLICE)
        if stop < len(text) and (cut := _TERM.match(text, stop)):
            stop = cut.end()  # a term is never cut
        counts.update(_TERM.findall(text, at, stop))
        at = stop
    return counts


def _key(term: bytes) -> bytes:
    return term if len(term) <= _LONGEST else b"\0" + hashlib.sha256(term).digest()


def _bytes(df: DataFrame, name: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return df.select(F.col(name).cast("bigint").alias(name), text)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats): the terms of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = term_counts(text)
                yield pa.record_batch(
                    {
                        "item_id": pa.array([item] * len(counts), pa.int64()),
                        "term": pa.array([_key(t) for t in counts], pa.binary()),
                        "repeats": pa.array(counts.values(), pa.int64()),
                    }
                )

    rows = _bytes(items, "item_id").mapInArrow(cut, "item_id bigint, term binary, repeats bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


POSTINGS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Per document: its id, its number of terms, and the counts of the numbered terms."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, offsets, terms, counts = [], [0], [], []
            for text in batch.column(1):
                found = term_counts(text.as_buffer().to_pybytes())
                sizes.append(found.total())
                for term, tf in found.items():
                    number = known.get(term if len(term) <= _LONGEST else _key(term))
                    if number is not None:
                        terms.append(number)
                        counts.append(tf)
                offsets.append(len(terms))
            ends = pa.array(offsets, pa.int32())
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n": pa.array(sizes, pa.int64()),
                    "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    "counts": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                }
            )

    return _bytes(docs, "doc_id").mapInArrow(count, POSTINGS)


class Best:
    """The k best documents of each item so far: scores, ids and whether the id is null."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def least(self, item: int) -> int:
        """What a new document must reach; 0 while there are fewer than k."""
        held = self.of.get(item)
        return int(held[0][-1]) if held is not None and len(held[0]) == self.k else 0

    def enter(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if item in self.of:
            scores, ids, null = (np.concatenate(x) for x in zip(self.of[item], (scores, ids, null)))
        first = np.lexsort((ids, null, -scores))[: self.k]
        self.of[item] = scores[first], ids[first], null[first]


class Group:
    """The postings of some documents, by term."""

    def __init__(self, batches: list[pa.RecordBatch], documents: int, length: int) -> None:
        ids = [b.column("doc_id") for b in batches]
        self.null = np.concatenate([c.is_null().to_numpy(zero_copy_only=False) for c in ids])
        self.ids = np.concatenate([c.fill_null(0).to_numpy() for c in ids])
        n = np.concatenate([b.column("n").to_numpy() for b in batches])
        terms = np.concatenate([b.column("terms").flatten().to_numpy() for b in batches])
        tf = np.concatenate([b.column("counts").flatten().to_numpy() for b in batches])
        held = np.concatenate([b.column("terms").value_lengths().to_numpy() for b in batches])
        owner = np.repeat(np.arange(len(n)), held)
        m = 75 + (25 * n * documents) // max(length, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        order = np.argsort(terms, kind="stable")
        self.owner, self.impact = owner[order], impact[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(order) else self.impact

    def answer(self, item: int, terms: np.ndarray, gains: np.ndarray, best: Best) -> None:
        """Scores one item; ``terms`` rarest first, ``gains`` their weight times repeats."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        at, gains = at[there], gains[there]
        left = np.cumsum((gains * self.most[at])[::-1])[::-1].tolist()
        score = np.zeros(len(self.ids), np.int64)
        live = np.zeros(len(self.ids), bool)
        limit, highest, opened = best.least(item), 0, True
        for bound, place, gain in zip(left, at.tolist(), gains.tolist()):
            span = slice(self.starts[place], self.stops[place])
            docs, adds = self.owner[span], gain * self.impact[span]
            if opened and highest > bound:  # else the k-th cannot be above it either
                partial = score[live]
                if len(partial) >= best.k:
                    limit = max(limit, int(np.partition(partial, -best.k)[-best.k]))
            if bound < limit:
                opened = False
            if not opened:
                old = live[docs]
                docs, adds = docs[old], adds[old]
            if len(docs):
                score[docs] += adds
                live[docs] = True
                highest = max(highest, int(score[docs].max()))
        found = np.flatnonzero(live & (score > 0) & (score >= best.least(item)))
        if len(found) > best.k:
            kth = np.partition(score[found], -best.k)[-best.k]
            found = found[score[found] >= kth]
        if len(found):
            best.enter(item, score[found], self.ids[found], self.null[found])


def _answered(
    held: DataFrame, block: list[tuple], weights: dict[int, int], rarity: dict[int, int],
    documents: int, length: int, k: int,
) -> DataFrame:
    """(item_id, doc_id, score): at most ``k`` rows an item from each task."""
    queries: dict[int | None, list[tuple[int, int, int]]] = {}
    for item, number, repeats in block:
        if weights.get(number):
            queries.setdefault(item, []).append((rarity[number], number, repeats * weights[number]))
    ids = list(queries)
    plans = []
    for item in ids:
        rows = sorted(queries[item])
        plans.append((np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)))
    shared = held.sparkSession.sparkContext.broadcast((ids, plans))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, plans = shared.value
        best, waiting, size, counts = Best(k), [], 0, 0

        def flush() -> None:
            group = Group(waiting, documents, length)
            for i, (terms, gains) in enumerate(plans):
                group.answer(i, terms, gains, best)

        for batch in batches:
            for part in _parts(batch):
                waiting.append(part)
                size += part.num_rows
                counts += len(part.column("terms").flatten())
                if size >= GROUP_DOCS or counts >= GROUP_COUNTS:
                    flush()
                    waiting, size, counts = [], 0, 0
        if waiting:
            flush()
        for i, (scores, docs, null) in best.of.items():
            yield pa.record_batch(
                {
                    "item_id": pa.array([ids[i]] * len(scores), pa.int64()),
                    "doc_id": pa.array(docs, pa.int64(), mask=null),
                    "score": pa.array(scores, pa.int64()),
                }
            )

    return held.mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few more than ``GROUP_COUNTS`` counts each."""
    ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_COUNTS, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = 1 << 18) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs(doc_id, text)`` for each of
    ``items(item_id, text)``."""
    asked = written(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        terms = sorted({bytes(r["term"]) for r in rows})
        numbers = {term: i for i, term in enumerate(terms)}
        held = written(postings(docs, numbers), "postings")
        totals = held.agg(
            F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")
        ).first()
        documents, length = totals["documents"], totals["length"] or 0
        counted = held.select(F.explode_outer("terms").alias("term")).groupBy("term").count()
        rarity = {r["term"]: r["count"] for r in counted.collect() if r["term"] is not None}
        weights = {
            t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
            for t, df in rarity.items()
        }
        pairs = [(r["item_id"], numbers[bytes(r["term"])], r["repeats"]) for r in rows]
        parts.append(_answered(held, pairs, weights, rarity, documents, length, k))
    found = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("item_id").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    )
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
