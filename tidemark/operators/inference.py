"""Batch model inference: the model is a factory, loaded once per Python worker."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .scoring import TASK_DEFAULTS, generation_config

# What a run without a model answers, by task.
STUB_TEXTS = {
    "mcq": "A",
    "mt": "This is a stub translation.",
    "ssg": "This is a stub story generation.",
}
STUB_OTHER = "Stub response"


class Generator(Protocol):
    def generate(
        self, prompts: list[str], temperatures: list[float], max_new_tokens: list[int]
    ) -> list[str]: ...


#: Models that one Python worker keeps.
MODELS_KEPT = 2


def _model_key(factory: Callable[[], Any]) -> str:
    """The same factory gets the same key in every plan, so a reused worker loads it once."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _load(key: str, factory: Callable[[], Any]) -> Any:
    """One model per worker process and factory; the one used longest ago goes first.

    The models hang on a module of the worker process: this function itself is
    unpickled anew for every task.
    """
    store = sys.modules.setdefault("tidemark_models", types.ModuleType("tidemark_models"))
    models = store.__dict__.setdefault("models", {})
    models[key] = models.pop(key) if key in models else factory()
    while len(models) > MODELS_KEPT:
        del models[next(iter(models))]
    return models[key]


def embed_column(
    df: DataFrame,
    text: str = "text",
    out: str = "embedding",
    dim: int = 384,
    model_factory: Callable[[], Callable] | None = None,
    batch_size: int = 64,
    tokenizer: tx.Tokenizer = tx.tokenize,
) -> DataFrame:
    """Adds a vector per text.

    ``model_factory`` returns a function from an array of texts to a matrix. Without
    one, tokens are counted by hash (the first 8 hex digits of their MD5, modulo ``dim``)
    and scaled to length one: deterministic, and a token is hashed once for each batch.
    """
    if model_factory is not None:
        embed = predict_batch_udf(
            model_factory, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )
        return df.withColumn(out, embed(F.col(text)))
    tokens = F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>"))
    return df.withColumn(out, _hashed_counts(dim)(tokens))


#: Rows whose counts a task holds at once.
_ROWS_AT_ONCE = 1024


def _hashed_counts(dim: int) -> Callable[[Column], Column]:
    """From arrays of tokens to their counts by hash, each scaled to length one; null tokens count nowhere.

    Told as not deterministic, so that a plan which explodes the vectors does not work them out
    a second time to see that they are not empty.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def counted(arrays: pa.Array) -> pa.Array:
        starts = arrays.offsets.to_numpy().astype(np.int64)
        coded = arrays.values.dictionary_encode()
        hashed = [
            None if t is None else int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
            for t in coded.dictionary.to_pylist()
        ]
        known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        places = np.zeros(len(coded), dtype=np.int64)
        places[known] = np.array(hashed, dtype=np.int64)[coded.indices.drop_null().to_numpy()]
        parts = []
        for k in range(0, len(arrays), _ROWS_AT_ONCE):
            ends = starts[k : k + _ROWS_AT_ONCE + 1]
            rows = len(ends) - 1
            own = slice(ends[0], ends[-1])
            row = np.repeat(np.arange(rows), np.diff(ends))[known[own]]
            counts = np.bincount(row * dim + places[own][known[own]], minlength=rows * dim).reshape(rows, dim)
            length = np.sqrt((counts * counts).sum(axis=1, dtype=np.float64))
            unit = counts / np.where(length > 0, length, 1.0)[:, None]
            flat = pa.array(unit.astype(np.float32).ravel())
            parts.append(pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * dim, flat))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return counted.asNondeterministic()


def _stub(task: Column) -> Column:
    chain = F
    for name, answer in STUB_TEXTS.items():
        chain = chain.when(task == name, answer)
    return chain.otherwise(STUB_OTHER)


def batch_generate(
    df: DataFrame,
    prompt: str = "prompt",
    task: str = "task_type",
    model_factory: Callable[[], Generator] | None = None,
    temperature: Column | None = None,
    max_new_tokens: Column | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """Adds generation (stripped), status and error per row.

    With a model, ``batch_size`` prompts go to it at once. An unknown task or a failing
    prompt gives a failed row: a batch that fails, or comes back with another number of
    texts, is halved until the rows to blame stand alone. Without a model the fixed stub
    texts are returned.
    """
    if model_factory is None:
        return (
            df.withColumn("generation", _stub(F.col(task)))
            .withColumn("status", F.lit("completed"))
            .withColumn("error", F.lit(None).cast("string"))
        )
    configured = generation_config(df, task, temperature, max_new_tokens)
    columns = df.columns
    added = [T.StructField(c, T.StringType()) for c in ("generation", "status", "error")]
    model_key = _model_key(model_factory)
    known = list(TASK_DEFAULTS)

    def attempt(model: Generator, part: pd.DataFrame) -> list[tuple]:
        args = [part[c].tolist() for c in (prompt, "temperature", "max_new_tokens")]
        try:
            texts = [g.strip() for g in model.generate(*args)]
            if len(texts) != len(part):
                raise ValueError(f"{len(texts)} texts for {len(part)} prompts")
            return [(g, "completed", None) for g in texts]
        except Exception as e:
            if len(part) == 1:
                return [(None, "failed", f"{type(e).__name__}: {e}")]
            half = len(part) // 2
            return attempt(model, part.iloc[:half]) + attempt(model, part.iloc[half:])

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(model_key, model_factory)
        for batch in batches:
            found = pd.DataFrame(
                {"generation": None, "status": "failed", "error": "invalid task type"},
                index=batch.index,
                dtype=object,
            )
            valid = batch[batch[task].isin(known)]
            for start in range(0, len(valid), batch_size):
                part = valid.iloc[start : start + batch_size]
                found.loc[part.index] = attempt(model, part)
            yield pd.concat([batch[columns], found], axis=1)

    return configured.mapInPandas(generate, T.StructType([*df.schema.fields, *added]))


def next_token_scores(
    df: DataFrame,
    model_factory: Callable[[], Callable],
    prompt: str = "prompt",
    out: str = "scores",
    batch_size: int = 64,
) -> DataFrame:
    """Adds the next-token scores of each prompt, as array<float> indexed by token id.

    ``model_factory`` returns a function from an array of prompts to a matrix.
    """
    score = predict_batch_udf(
        model_factory, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.withColumn(out, score(F.col(prompt)))


def token_logprobs(
    df: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], list[list[float]]]],
    key: str = "seq_id",
    text: str = "text",
) -> DataFrame:
    """(key, pos, logprob) of tokens 2..m of each text, the input of ``perplexity``."""
    model_key = _model_key(model_factory)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(model_key, model_factory)
        for texts in batches:
            yield pd.Series(model(texts.tolist()))

    return df.select(key, F.posexplode(score(F.col(text))).alias("pos", "logprob"))
