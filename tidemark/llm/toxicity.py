"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Training uses the labelled documents whose crc32(doc_id as text) mod 3 is not 1, at most
``sample_rows`` of them (those of smallest hash: a documented bound on what one model is
fitted to). From the sample come, in this order, a lexicon of word beginnings that mark
toxic documents, the dense features of each document, the trees, and from a fifth of the
sample that the trees have not seen, the calibration. Scoring covers all documents and
reads nothing but their text.

Features: lexicon hits, their density and weight, hits near a second-person word, hits
that show only once disguises (digits for letters, repeated letters, dots between
letters) are undone, second-person words, capitals, punctuation, disguised words, length.

Defined results. Null and empty texts are scored as a text without words. Labels that are
null, or belong to no document, are not used; repeated ones count as often as they come.
Without labels of both kinds every score is the share of toxic ones (0.0 without labels).
A null doc_id is not held out. Very long texts are scored whole. An empty table gives an
empty result. ``keep_clean`` carries other columns, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .names import fresh

#: Words that address the reader, in the four languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
)

#: Digits and signs that stand for letters.
DISGUISES = str.maketrans(
    {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
)

_EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-*_~"
_INNER = re.compile(r"[.\-_*~'’]+")
_RUNS = re.compile(r"(.)\1{2,}")
_STEMS = (4, 5, 6, 7)
_CAPITALS = bytes(range(65, 91))

HIT, SECOND, CAPS, DISGUISED, UNMASKED, LONG_RUN = 1, 2, 4, 8, 16, 32


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def beginnings(word: str) -> list[str]:
    """The word as a whole (marked) and its beginnings."""
    return [f"{word}$", *[word[:n] for n in _STEMS if len(word) >= n]]


def unmasked(word: str) -> str:
    """The word with disguises undone."""
    plain = _INNER.sub("", word.lower().translate(DISGUISES))
    return _RUNS.sub(r"\1", plain).strip(_EDGES)


class Words(dict):
    """Codes of words: flags in the low byte, weight of the lexicon entry above."""

    def __init__(self, lexicon: dict[str, int], most: int = 200_000) -> None:
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def weight(self, word: str) -> int:
        get = self.lexicon.get
        return max((get(b, 0) for b in beginnings(word)), default=0)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        plain = bare(word)
        weight = self.weight(plain)
        flags = HIT if weight else 0
        if plain in SECOND_PERSON:
            flags |= SECOND
        if len(plain) > 1 and word.isupper():
            flags |= CAPS
        if not plain.isalpha() and any(c.isalpha() for c in plain):
            flags |= DISGUISED
        if _RUNS.search(plain):
            flags |= LONG_RUN
        if not weight and flags & (DISGUISED | LONG_RUN):
            weight = self.weight(unmasked(word))
            flags |= UNMASKED if weight else 0
        code = weight << 8 | flags
        self[word] = code
        return code


N_FEATURES = 16


def features(texts: list[str], words: Words, near: int = 6) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts):
        parts = text.split()
        n = len(parts)
        if not n:
            continue
        codes = np.fromiter(map(words.__getitem__, parts), np.int64, n)
        hit = np.flatnonzero(codes & (HIT | UNMASKED))
        you = np.flatnonzero(codes & SECOND)
        close = 0
        if len(hit) and len(you):
            after = np.searchsorted(you, hit)
            gap = np.minimum(
                np.abs(you[np.minimum(after, len(you) - 1)] - hit),
                np.abs(hit - you[np.maximum(after - 1, 0)]),
            )
            close = int((gap <= near).sum())
        weights = codes[hit] >> 8
        raw = text.encode()
        row[:] = (
            np.log1p(n),
            len(hit),
            len(hit) / n,
            weights.max(initial=0),
            weights.sum() / n,
            len(np.unique(weights)),
            close,
            np.count_nonzero(codes & UNMASKED),
            len(you) / n,
            np.count_nonzero(codes & CAPS) / n,
            (len(raw) - len(raw.translate(None, _CAPITALS))) / n,
            text.count("!") / n,
            text.count("?") / n,
            np.count_nonzero(codes & DISGUISED) / n,
            np.count_nonzero(codes & LONG_RUN) / n,
            text.count("*") / n,
        )
    return out


def count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a word beginning, summed per task."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            words = {bare(w) for w in text.split()}
            counts[label].update({b for w in words if w for b in beginnings(w)})
    keys = list(counts[0].keys() | counts[1].keys())
    for start in range(0, len(keys), 50_000):
        part = keys[start : start + 50_000]
        yield pa.record_batch(
            {
                "entry": pa.array(part, pa.string()),
                "toxic": pa.array([counts[1][k] for k in part], pa.int64()),
                "clean": pa.array([counts[0][k] for k in part], pa.int64()),
            }
        )


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, entries: int) -> dict[str, int]:
    """Word beginnings found in toxic documents far more often than chance allows.

    An entry's evidence is the log-likelihood ratio of its share of toxic documents
    against the sample's; it must outweigh the number of beginnings looked at. Its weight
    (1 to 63) is that evidence on a log scale. ``entries`` bounds the lexicon.
    """
    base = n_toxic / (n_toxic + n_clean)
    counted = (
        sample.select("text", "label")
        .mapInArrow(count_beginnings, "entry string, toxic bigint, clean bigint")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    against = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base)))
    evidence = F.col("toxic") * F.log(share / base) + F.coalesce(against, F.lit(0.0))
    tried = written(
        counted.filter(F.col("toxic") >= 3).select(
            "entry", evidence.alias("evidence"), share.alias("share")
        ),
        "beginnings",
    )
    found = (
        tried.filter((F.col("evidence") > log(tried.count() + 1) + 1) & (F.col("share") > 0.5))
        .orderBy(F.col("evidence").desc(), "entry")
        .limit(entries)
        .collect()
    )
    return {r["entry"]: max(1, min(63, round(8 * log(r["evidence"])))) for r in found}


@dataclass
class Trees:
    """Boosted regression trees of one depth, stored level by level."""

    edges: list[np.ndarray]
    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1
        )

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (binned[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    n_bins: int = 32,
    smooth: float = 2.0,
) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    edges = [
        np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1]))
        for j in range(x.shape[1])
    ]
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(
        edges,
        float(np.log(prior / (1 - prior))),
        np.zeros((0, (1 << depth) - 1), np.int64),
        np.zeros((0, (1 << depth) - 1), np.int64),
        np.zeros((0, 1 << depth)),
    )
    binned = model.bins(x)
    raw = np.full(len(x), model.start)
    n_features = x.shape[1]
    rows = np.arange(len(x))
    built = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature = np.zeros((1 << depth) - 1, np.int64)
        cut = np.full((1 << depth) - 1, n_bins, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-9)
            for j in range(n_features):
                key = node * (n_bins + 1) + binned[:, j]
                size = width * (n_bins + 1)
                g = np.bincount(key, grad, size).reshape(width, -1).cumsum(1)
                h = np.bincount(key, hess, size).reshape(width, -1).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = (
                    g**2 / (h + smooth) + (gt - g) ** 2 / (ht - h + smooth)
                ) - gt**2 / (ht + smooth)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best = np.where(better, top, best)
                where = width - 1 + np.flatnonzero(better)
                feature[where], cut[where] = j, at[better]
            at = width - 1 + node
            node = 2 * node + (binned[rows, feature[at]] > cut[at])
        g = np.bincount(node, grad, 1 << depth)
        h = np.bincount(node, hess, 1 << depth)
        value = rate * g / (h + smooth)
        raw += value[node]
        built.append((feature, cut, value))
    model.feature, model.cut, model.value = (np.array(v) for v in zip(*built))
    return model


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean raw score and smoothed toxic share of each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for score, label in zip(raw[order], y[order]):
        pools.append([float(label), 1.0, float(score)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            label_sum, size, score_sum = pools.pop()
            pools[-1] = [
                pools[-1][0] + label_sum,
                pools[-1][1] + size,
                pools[-1][2] + score_sum,
            ]
    at = np.array([s / n for _, n, s in pools])
    share = np.array([(t + 0.05) / (n + 0.1) for t, n, _ in pools])
    return at, np.maximum.accumulate(share)


@dataclass
class Model:
    """What scoring needs: a few kilobytes, whatever the corpus."""

    lexicon: dict[str, int]
    prior: float
    trees: Trees | None = None
    at: np.ndarray | None = None
    share: np.ndarray | None = None

    def score(self, texts: list[str], words: Words) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(features(texts, words))
        # A trace of the raw score keeps documents of one pool in their order.
        return 0.999 * np.interp(raw, self.at, self.share) + 0.001 / (1 + np.exp(-raw))


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the doc_id as text leaves 1 when divided by 3."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rest = F.crc32(col.cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, entries: int = 2_000
) -> Model:
    """Fits a model to labelled documents outside the held-out third."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out("doc_id"))
        .select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample_rows)
    )
    # At most sample_rows pairs of numbers: bounded, so the documents need no shuffle.
    sample = written(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
            F.broadcast(chosen), "doc_id"
        ),
        "labelled",
    )
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    prior = n_toxic / max(1, n_toxic + n_clean)
    if not n_toxic or not n_clean:
        return Model({}, prior)
    lexicon = learn_lexicon(sample, n_toxic, n_clean, entries)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            rows = features(batch.column(2).to_pylist(), words).tolist()
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "label": batch.column(1),
                    "x": pa.array(rows, pa.list_(pa.float64())),
                }
            )

    rows = (
        sample.select(F.col("doc_id").cast("string"), "label", "text")
        .mapInArrow(dense, "doc_id string, label int, x array<double>")
        .orderBy("doc_id", "label", "x")
        .collect()
    )
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    apart = np.array([crc_part(r["doc_id"]) for r in rows])
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    trees = fit_trees(x[~apart], y[~apart])
    fresh = apart if apart.any() else ~apart
    at, share = fit_isotonic(trees.raw(x[fresh]), y[fresh])
    return Model(lexicon, prior, trees, at, share)


def crc_part(doc_id: str) -> bool:
    """A fifth of the sample, set aside for the calibration."""
    return zlib.crc32(f"calibrate:{doc_id}".encode()) % 5 == 0


def score_column(model: Model, text: str = "text") -> Column:
    """The calibrated score of each text, in Arrow batches."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(model.lexicon)
        for part in parts:
            yield pd.Series(model.score(part.tolist(), words))

    return scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, held_out and score."""
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), score_column(model).alias("score"))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they are."""
    (own,) = fresh(docs, "__toxicity")
    return docs.withColumn(own, score_column(model)).filter(F.col(own) < limit).drop(own)
