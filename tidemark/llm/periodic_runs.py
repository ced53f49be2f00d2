"""Periodic runs of words: frequency splitting first, lags only where it leaves something.

A run is a stretch of consecutive words with smallest period q, at least ``least_words`` and
``repeats`` * q words long, that no neighbouring word extends keeping the period. Each word
of a run occurs at least ``repeats`` times in it. So a word that occurs more rarely within a
segment belongs to no run there and splits it; the parts are split again by their own counts
until nothing changes. Of the parts of a split, the largest inherits the counts less what was
cut off, so that a text of n words takes n log n steps, however deep it goes.

Surviving segments are scanned by lag. A run of period q holds at least four multiples of q
in a row, which must be equal words; all lags of a segment are sampled at their multiples
together, n log n comparisons. Places that pass are compared word by word and extended to
both sides. A stretch that a shorter period explains lies inside that period's run.

Defined results. Null and empty texts have no words and no runs. A row's result depends on
its own text, so rows that repeat a doc_id each have their own. Words are kept as numbers of
4 bytes, and texts are cut into words a slice at a time: a text of any length costs a small
multiple of itself. Of runs of equal length / period, the one that starts first, then that of
the smaller period, is the strongest. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
_SLICE = 1 << 20

SCHEMA = (
    "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
    "strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string"
)

Run = tuple[int, int, int]


def numbered_words(text: str) -> tuple[np.ndarray, list[str]]:
    """The words as numbers, and the word of each number."""
    numbers: dict[str, int] = {}
    parts, at = [], 0
    while at < len(text):
        stop = min(len(text), at + _SLICE)
        while stop < len(text) and text[stop] not in " \t\n\x0b\x0c\r":
            stop += 1  # a word is never cut
        words = _WORDS.findall(text, at, stop)
        parts.append(
            np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
        )
        at = stop
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return ids, list(numbers)


def segments(ids: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """Parts in which each word occurs ``least`` times or more, none below ``shortest`` words."""
    stable = []
    work = [(0, ids)]
    while work:
        offset, part = work.pop()
        if len(part) < shortest:
            continue
        _, own = np.unique(part, return_inverse=True)
        counts = np.bincount(own)
        by_word = np.argsort(own, kind="stable")
        ends = np.cumsum(counts)
        begins = ends - counts
        low, high = 0, len(own)
        cuts = np.flatnonzero(counts[own] < least)
        while len(cuts):
            starts = np.concatenate(([low], cuts + 1))
            stops = np.concatenate((cuts, [high]))
            sizes = stops - starts
            most = int(np.argmax(sizes))
            for i in np.flatnonzero(sizes >= shortest).tolist():
                if i != most:
                    work.append((offset + starts[i], part[starts[i] : stops[i]]))
            kept_low, kept_high = int(starts[most]), int(stops[most])
            if kept_high - kept_low < shortest:
                high = low
                break
            gone = np.concatenate((own[low:kept_low], own[kept_high:high]))
            words, lost = np.unique(gone, return_counts=True)
            counts[words] -= lost
            low, high = kept_low, kept_high
            rare = words[(counts[words] < least) & (counts[words] > 0)]
            places = [by_word[begins[w] : ends[w]] for w in rare.tolist()]
            places = [p[np.searchsorted(p, low) : np.searchsorted(p, high)] for p in places]
            cuts = np.sort(np.concatenate(places)) if places else rare
        if high > low:
            stable.append((offset + low, offset + high))
    return sorted((int(a), int(b)) for a, b in stable)


def _same_until(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading elements are equal; looks at no more than some twice that."""
    size, step, at = min(len(left), len(right)), 32, 0
    while at < size:
        stop = min(size, at + step)
        differ = left[at:stop] != right[at:stop]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = stop, 2 * step
    return size


def _sampled(ids: np.ndarray, first: int, last: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(lags, places): multiples of each lag at which the samples of a run may begin."""
    n = len(ids)
    lags = np.arange(first, last, dtype=np.int64)
    at = lags[:, None] * np.arange(-(-n // first), dtype=np.int64)[None, :]
    words = np.where(at < n, ids[np.minimum(at, n - 1)], -1)
    same = (words[:, 1:] == words[:, :-1]) & (words[:, 1:] >= 0)
    links = repeats - 1
    if same.shape[1] < links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = same.shape[1] - links + 1
    ok = np.logical_and.reduce([same[:, i : i + wide] for i in range(links)])
    row, k = np.nonzero(ok)
    q, p = lags[row], k * lags[row]
    for step in range(1, min(48, last - 1)):  # other words of the period, nearest first
        if len(q) <= 32:  # as quick to look at one by one
            break
        inside = np.minimum(step, q - 1)
        keep = ids[p + inside] == ids[p + inside + q]
        for j in range(1, links - 1):
            keep &= ids[p + inside + j * q] == ids[p + inside + (j + 1) * q]
        q, p = q[keep], p[keep]
    return q, p


def scan(ids: np.ndarray, repeats: int, least_words: int) -> list[Run]:
    """All runs within one segment, by growing lag."""
    n, found = len(ids), []
    #: for each place, the last run over it of each period: few, as runs repeat often
    over: dict[int, list[tuple[int, int]]] = {}
    first = 1
    while first <= n // repeats:
        last = min(2 * first, n // repeats + 1)
        lags, places = _sampled(ids, first, last, repeats)
        lag, reached = 0, 0
        for q, p in zip(lags.tolist(), places.tolist()):
            if q != lag:
                lag, reached = q, 0
                shorter = [spans for d, spans in over.items() if d < q and q % d == 0]
            if p + (repeats - 1) * q < reached:
                continue
            stop = next((b for spans in shorter for a, b in _around(spans, p) if b >= p + q), 0)
            if stop:
                reached = stop
                continue
            size = q + _same_until(ids[p:], ids[p + q :])
            if size < (repeats - 1) * q + 1:
                continue
            back = _same_until(ids[:p][::-1], ids[q : p + q][::-1])
            length = size + back
            if length >= max(least_words, repeats * q):
                found.append((p - back, length, q))
                over.setdefault(q, []).append((p - back, p + size))
            reached = p + size
        first = last
    return found


def _around(spans: list[tuple[int, int]], place: int) -> list[tuple[int, int]]:
    """The spans, sorted and of one period, that hold ``place``; at most two."""
    low, high = 0, len(spans)
    while low < high:
        middle = (low + high) // 2
        if spans[middle][0] <= place:
            low = middle + 1
        else:
            high = middle
    return [s for s in spans[max(0, low - 2) : low] if s[1] > place]


def runs_of(ids: np.ndarray, repeats: int = 4, least_words: int = 6) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    found = []
    for low, high in segments(ids, repeats, least_words):
        found += [(low + s, n, q) for s, n, q in scan(ids[low:high], repeats, least_words)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared exactly."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(ids: np.ndarray, words: list[str], runs: list[Run]) -> str:
    """The text with each run cut to its first period, words joined by one space."""
    edges = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = ids[np.cumsum(edges[:-1]) == 0]
    return " ".join([words[i] for i in kept.tolist()])


def periodic_runs(docs: DataFrame, repeats: int = 4, least_words: int = 6) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, runs, the strongest run and the
    collapsed text."""
    if repeats < 3:
        raise ValueError("runs of fewer than three periods are not told apart")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids, words = numbered_words(text or "")
                runs = runs_of(ids, repeats, least_words)
                rows.append((doc_id, len(ids), runs, strongest(runs), collapsed(ids, words, runs)))
            span = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
            schema = schema or [pa.int64(), pa.int64(), pa.list_(span), span, pa.string()]
            named = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
            columns = [
                [r[0] for r in rows],
                [r[1] for r in rows],
                [[named(x) for x in r[2]] for r in rows],
                [named(r[3]) for r in rows],
                [r[4] for r in rows],
            ]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, schema)],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(find, SCHEMA)
