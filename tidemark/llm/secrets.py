"""Secret scans: fixed patterns, and formats inferred from the credentials they find.

Three patterns give the base spans; their kind labels each value found. From a bounded
sample of labelled values per kind (``sample_rows``, smallest hash first) a prefix tree is
built and its statistically compatible states are merged, which yields one probabilistic
automaton per kind. A model of character pairs, counted over the words of all documents,
stands for ordinary text: each task sums one table of 128 x 128 counts. Every candidate of every text, a run of at least
``min_chars`` credential characters outside the base spans, is scored by how much likelier
per character its format is under the best automaton than as ordinary text; above
``margin`` it is a span of kind ``inferred``.

Texts are read once: base spans and candidates go to a table in the shared folder, which
is all that training and scoring read.

Defined results. A null text counts as empty and has no spans. Positions are code points,
ends exclusive. Whole texts are read, however long. Without labelled values nothing is
inferred. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import inf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Kinds of base spans in their order, and the patterns of the contract.
BASE = ("assign", "access", "hex")
INFERRED = "inferred"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = (b"passw", b"secret", b"token", b"api")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Words counted at once.
_AT_ONCE = 100_000
_FOUND = (
    "doc_id bigint, spans array<struct<kind:string,start:int,end:int,value:string>>, "
    "candidates array<struct<start:int,end:int,value:string>>, "
    "pairs array<struct<pair:int,n:bigint>>"
)
_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]
)
_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
_PAIR = pa.struct([("pair", pa.int32()), ("n", pa.int64())])
_RESULT = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), each kind leftmost and not overlapping."""
    spans = []
    lower = text.encode().lower()
    if any(name in lower for name in _NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                spans.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                spans.append(("access", m.start(), m.end(), m[0]))
    spans += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], BASE.index(s[0])))


def candidates(
    text: str, spans: list[tuple], run: re.Pattern, min_chars: int = 20
) -> list[tuple[int, int, str]]:
    """Runs of credential characters, without what base spans take of them.

    What is left before, between and after base spans is a candidate of its own if it still
    has ``min_chars``. ``spans`` come in order of start; runs and spans are walked once.
    """
    found, following, covered = [], 0, 0
    for m in run.finditer(text):
        start = max(m.start(), covered)
        while following < len(spans) and spans[following][1] < m.end():
            _, first, last, _ = spans[following]
            if first - start >= min_chars:
                found.append((start, first, text[start:first]))
            covered = max(covered, last)
            start = max(start, covered)
            following += 1
        if m.end() - start >= min_chars:
            found.append((start, m.end(), text[start : m.end()]))
    return found


def ordinary_words(text: str) -> list[str]:
    """ASCII words of 6 to 19 characters: too short to be candidates."""
    return [w for w in text.split() if 6 <= len(w) < 20 and w.isascii()]


def pair_counts(words: list[str]) -> np.ndarray:
    """How often each pair of characters comes up; 0 starts a word and 1 ends it."""
    if not words:
        return np.zeros(128 * 128, np.int64)
    joined = "\x00" + "\x01\x00".join(words) + "\x01"
    codes = np.frombuffer(joined.encode("ascii"), np.uint8).astype(np.int32)
    counts = np.bincount(codes[:-1] << 7 | codes[1:], minlength=128 * 128)
    counts[1 << 7] -= len(words) - 1  # from one word to the next
    return counts


class Automaton:
    """A probabilistic automaton, from a prefix tree whose compatible states are merged."""

    def __init__(self, values: list[str], alpha: float = 0.05, least: int = 30) -> None:
        self.seen, self.stops = [0], [0]
        self.next: list[dict[str, list[int]]] = [{}]
        self.alpha, self.least = alpha, least
        for value in values:
            self._insert(value)
        self._merge_states()
        self._as_tables()

    def _insert(self, value: str) -> None:
        state = 0
        self.seen[0] += 1
        for c in value:
            step = self.next[state].get(c)
            if step is None:
                self.seen.append(0)
                self.stops.append(0)
                self.next.append({})
                step = self.next[state][c] = [len(self.seen) - 1, 0]
            step[1] += 1
            state = step[0]
            self.seen[state] += 1
        self.stops[state] += 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        """Hoeffding's bound: two shares differ by more than chance."""
        return abs(f / n - g / m) > sqrt(0.5 * log(2 / self.alpha)) * (1 / sqrt(n) + 1 / sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.seen[a], self.seen[b]
            if n < self.least or m < self.least:
                continue
            if self._differ(self.stops[a], n, self.stops[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    pairs.append((x[0], y[0]))
        return True

    def _fold(self, into: int, state: int) -> None:
        pairs = [(into, state)]
        while pairs:
            a, b = pairs.pop()
            self.seen[a] += self.seen[b]
            self.stops[a] += self.stops[b]
            for c, (target, count) in self.next[b].items():
                step = self.next[a].get(c)
                if step is None:
                    self.next[a][c] = [target, count]
                else:
                    step[1] += count
                    pairs.append((step[0], target))

    def _merge_states(self) -> None:
        settled, fringe = [0], [(0, c) for c in sorted(self.next[0])]
        while fringe:
            parent, c = fringe.pop(0)
            state = self.next[parent][c][0]
            if state in settled:
                continue
            home = next((s for s in settled if self._compatible(s, state)), None)
            if home is None:
                settled.append(state)
                fringe += [(state, d) for d in sorted(self.next[state])]
            else:
                known = {s: set(self.next[s]) for s in settled}
                self.next[parent][c][0] = home
                self._fold(home, state)
                fringe += [
                    (s, d) for s in settled for d in sorted(set(self.next[s]) - known[s])
                ]
        self.settled = settled

    def _as_tables(self) -> None:
        """Log probabilities of the steps of the states that are left."""
        number = {s: i for i, s in enumerate(self.settled)}
        self.steps: list[dict[str, tuple[int, float]]] = []
        self.unseen, self.stop = [], []
        for s in self.settled:
            n = self.seen[s] + 1.0
            self.steps.append(
                {c: (number[t], log(k / n)) for c, (t, k) in self.next[s].items()}
            )
            self.unseen.append(log(1 / (70 * n)))
            self.stop.append(log((self.stops[s] + 0.5) / n))
        del self.seen, self.stops, self.next

    def log_likelihood(self, value: str) -> float:
        state, total = 0, 0.0
        for c in value:
            step = self.steps[state].get(c)
            if step is None:
                total += self.unseen[state]
            else:
                state = step[0]
                total += step[1]
        return total + self.stop[state]


class Ordinary:
    """Character pairs of ordinary tokens, smoothed."""

    def __init__(self, pairs: np.ndarray) -> None:
        counts = pairs.reshape(128, 128) + 0.05
        self.log = np.log(counts / counts.sum(1, keepdims=True))

    def log_likelihood(self, value: str) -> float:
        codes = np.frombuffer(f"\x00{value}\x01".encode("ascii"), np.uint8)
        return float(self.log[codes[:-1], codes[1:]].sum())


class Formats:
    def __init__(self, labelled: dict[str, list[str]], ordinary: np.ndarray) -> None:
        self.automata = [Automaton(values) for values in labelled.values() if values]
        self.ordinary = Ordinary(ordinary)

    def score(self, value: str) -> float:
        """Per character, how much likelier the best format is than ordinary text."""
        best = max((a.log_likelihood(value) for a in self.automata), default=-inf)
        return (best - self.ordinary.log_likelihood(value)) / len(value)


def find(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Base spans and candidates of each document; last in a task its ``pairs``, null elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_run = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % min_chars)
        pairs = np.zeros(128 * 128, np.int64)
        for batch in batches:
            spans, others, words = [], [], []
            for text in batch.column(1).to_pylist():
                spans.append(base_spans(text))
                others.append(candidates(text, spans[-1], long_run, min_chars))
                words += ordinary_words(text)
                if len(words) > _AT_ONCE:
                    pairs += pair_counts(words)
                    words = []
            pairs += pair_counts(words)
            yield rows(batch.column(0), spans, others, [None] * len(batch))
        if pairs.any():
            seen = [{"pair": p, "n": pairs[p]} for p in np.flatnonzero(pairs).tolist()]
            yield rows(pa.array([None], pa.int64()), [[]], [[]], [seen])

    def rows(ids: pa.Array, spans: list, others: list, pairs: list) -> pa.RecordBatch:
        return pa.record_batch(
            {
                "doc_id": ids,
                "spans": pa.array(
                    [[dict(zip(("kind", "start", "end", "value"), s)) for s in x] for x in spans],
                    pa.list_(_SPAN),
                ),
                "candidates": pa.array(
                    [[dict(zip(("start", "end", "value"), s)) for s in x] for x in others],
                    pa.list_(_CANDIDATE),
                ),
                "pairs": pa.array(pairs, pa.list_(_PAIR)),
            }
        )

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, _FOUND)


def _sample(values: DataFrame, rows: int) -> list[str]:
    """At most ``rows`` distinct values, those of smallest hash."""
    chosen = values.distinct().orderBy(F.xxhash64("value"), "value").limit(rows).collect()
    return sorted(r["value"] for r in chosen)


def learn(found: DataFrame, sample_rows: int = 1000) -> Formats:
    """Automata of the labelled values and the model of ordinary tokens."""
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
    labelled = {
        kind: _sample(spans.filter(F.col("kind") == kind).select("value"), sample_rows)
        for kind in BASE
    }
    return Formats(labelled, ordinary_pairs(found))


def ordinary_pairs(found: DataFrame) -> np.ndarray:
    """The sum of the tasks' tables: 16,384 rows come to the driver at most."""
    seen = found.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n"))
    total = np.zeros(128 * 128, np.int64)
    for row in seen.collect():
        total[row["pair"]] = row["n"]
    return total


def scan(
    docs: DataFrame, min_chars: int = 20, sample_rows: int = 1000, margin: float = 0.5
) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id and spans (kind, start, end), in order of start."""
    found = written(find(docs, min_chars), "spans")
    formats = learn(found, sample_rows)
    order = {kind: i for i, kind in enumerate((*BASE, INFERRED))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mine = [(s["kind"], s["start"], s["end"]) for s in spans]
                mine += [
                    (INFERRED, c["start"], c["end"])
                    for c in others
                    if formats.score(c["value"]) > margin
                ]
                mine.sort(key=lambda s: (s[1], order[s[0]], s[2]))
                out.append([dict(zip(("kind", "start", "end"), s)) for s in mine])
            yield pa.record_batch(
                {"doc_id": batch.column(0), "spans": pa.array(out, pa.list_(_RESULT))}
            )

    return found.filter("pairs IS NULL").drop("pairs").mapInArrow(
        run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"
    )
