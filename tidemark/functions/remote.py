"""User functions over tables: run a Python function where the data is.

``run`` takes the function's frames from the partitions of a table; ``by`` gives it
the frames of one key. A keyed function whose results can be merged should pass
``merge``: it then runs on the slices of each key where they lie, and only merged
results travel, so a key with a third of the rows is worked on by all tasks.
"""

from __future__ import annotations

import functools
import json
import pickle
import threading
import traceback as tb
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import group_bounds

# Partial results a task holds per key, and keys it holds, before it merges or lets go.
_MERGE_AT = 32
_KEYS_HELD = 10_000
# Bound arguments above this many bytes are broadcast once; above the limit they are refused.
_BROADCAST_FROM = 1 << 20
_BROADCAST_LIMIT = 1 << 28

Frame = pd.DataFrame


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _in_task(func: Callable[[Frame], Frame], merge: Callable[[Frame], Frame], by: list[str]):
    """Runs ``func`` per key slice of each batch and merges per key within the task."""

    def combine(batches: Iterator[Frame]) -> Iterator[Frame]:
        held: dict[Any, list[Frame]] = {}
        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                parts = held.setdefault(key, [])
                parts.append(func(part.reset_index(drop=True)))
                if len(parts) >= _MERGE_AT:
                    held[key] = [merge(pd.concat(parts, ignore_index=True))]
            if len(held) > _KEYS_HELD:
                yield pd.concat([p for ps in held.values() for p in ps], ignore_index=True)
                held = {}
        for parts in held.values():
            if len(parts) > 1:
                yield merge(pd.concat(parts, ignore_index=True))
            else:
                yield parts[0]

    return combine


def run(
    df: DataFrame,
    func: Callable,
    schema: str | T.StructType,
    by: str | Sequence[str] | None = None,
    merge: Callable[[Frame], Frame] | None = None,
    arrow: bool = False,
) -> DataFrame:
    """Applies ``func`` to a table and returns what it returns.

    * no ``by``: ``func(frame)`` per batch (a ``pyarrow.RecordBatch`` with ``arrow``);
    * ``by`` and ``merge``: ``func(frame)`` per slice of a key gives a partial result of
      the same schema (key columns included), ``merge(partials)`` joins partial results;
    * ``by`` alone: ``func(key, frames)`` gets a key's rows as an iterator of frames and
      yields frames. The key is one task's work, but never in memory as a whole.
    """
    schema = _schema(schema)
    if by is None:
        if arrow:
            return df.mapInArrow(lambda batches: (func(b) for b in batches), schema)
        return df.mapInPandas(lambda batches: (func(b) for b in batches), schema)
    by = [by] if isinstance(by, str) else list(by)
    if merge is not None:
        partial = df.mapInPandas(_in_task(func, merge, by), schema)

        def finish(parts: Frame) -> Frame:
            return merge(parts)

        return partial.groupBy(*by).applyInPandas(finish, schema)

    def stream(key: tuple[Any, ...], frames: Iterator[Frame]) -> Iterator[Frame]:
        yield from func(key, frames)

    return df.groupBy(*by).applyInPandas(stream, schema)


class TableFunction:
    """A function with its schema, keys and arguments bound: ``df -> df``."""

    def __init__(
        self,
        func: Callable,
        schema: str | T.StructType,
        by: str | Sequence[str] | None = None,
        merge: Callable[[Frame], Frame] | None = None,
        **bound: Any,
    ):
        self.func, self.schema, self.by, self.merge, self.bound = func, schema, by, merge, bound
        functools.update_wrapper(self, func)

    def bind(self, **bound: Any) -> "TableFunction":
        """The same function with more arguments bound."""
        return TableFunction(self.func, self.schema, self.by, self.merge, **{**self.bound, **bound})

    def local(self, *args: Any, **kwargs: Any) -> Any:
        """Calls the plain function here, with the bound arguments."""
        return self.func(*args, **{**self.bound, **kwargs})

    def __call__(self, df: DataFrame, **extra: Any) -> DataFrame:
        bound = {**self.bound, **extra}
        size = len(pickle.dumps(bound)) if bound else 0
        if size > _BROADCAST_LIMIT:
            raise ValueError(f"{size} bytes of bound arguments: pass them as a table and join")
        func = self.func
        if size > _BROADCAST_FROM:
            shared = df.sparkSession.sparkContext.broadcast(bound)

            def call(*args):
                return func(*args, **shared.value)
        elif bound:

            def call(*args):
                return func(*args, **bound)
        else:
            call = func
        return run(df, call, self.schema, self.by, self.merge)


def on_table(
    schema: str | T.StructType,
    by: str | Sequence[str] | None = None,
    merge: Callable[[Frame], Frame] | None = None,
    **bound: Any,
) -> Callable[[Callable], TableFunction]:
    """Decorator: turns a function of frames into a function of tables."""

    def wrap(func: Callable) -> TableFunction:
        return TableFunction(func, schema, by, merge, **bound)

    return wrap


remote = on_table
gpu = on_table


def create_remote_function(func: Callable, schema: str | T.StructType, **options: Any) -> TableFunction:
    """``on_table`` without the decorator form."""
    return TableFunction(func, schema, **options)


_OUTCOME = [
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("traceback", T.StringType()),
    T.StructField("result", T.StringType()),
]


def capture_outcomes(
    df: DataFrame,
    func: Callable[[Any], Any],
    by: str | Sequence[str],
    merge: Callable[[list], Any] | None = None,
) -> DataFrame:
    """One outcome row per key: status, error, traceback, result (JSON).

    An exception fails its own key and no other. With ``merge``, ``func`` gets a frame that
    is a slice of a key, and ``merge`` the list of results; rows are dealt out in the order of
    their keys, so that a key which fits a batch is mostly one call. Without it ``func`` gets an
    iterator over the frames of its key, of which one at a time is in memory, and the
    outcome is told once it returns; frames it leaves are passed over.
    """
    by = [by] if isinstance(by, str) else list(by)
    key_fields = [df.schema[c] for c in by]
    schema = T.StructType([*key_fields, *_OUTCOME])

    def attempt(key: Sequence[Any], work: Callable[[], Any]) -> tuple:
        try:
            found = ("completed", None, None, json.dumps(work(), default=str))
        except Exception as e:  # the outcome row carries it
            found = ("failed", f"{type(e).__name__}: {e}", tb.format_exc(), None)
        return (*[None if pd.isna(v) else v for v in key], *found)

    def frame_of(rows: list[tuple]) -> Frame:
        return pd.DataFrame(rows, columns=schema.names, dtype=object)

    def key_of(frame: Frame) -> list[Any]:
        return [frame[c].iloc[0] for c in by]

    def stream(key: tuple[Any, ...], frames: Iterator[Frame]) -> Iterator[Frame]:
        yield frame_of([attempt(key, lambda: func(frames))])
        for _ in frames:
            pass

    if merge is None:
        return df.groupBy(*by).applyInPandas(stream, schema)

    def slices(batches: Iterator[Frame]) -> Iterator[Frame]:
        """Rows come sorted by key, so a key's slice is cut out by its bounds."""
        for batch in batches:
            if not len(batch):
                continue
            keys, rows = [batch[c].array for c in by], []
            for start, end in group_bounds(batch, by):
                part = batch.iloc[start:end].reset_index(drop=True)
                rows.append(attempt([k[start] for k in keys], lambda: func(part)))
            yield frame_of(rows)

    def join(parts: Frame) -> Frame:
        failed = parts[parts["status"] == "failed"]
        if len(failed):
            return failed.sort_values("error").head(1)
        work = lambda: merge([json.loads(r) for r in parts["result"]])
        return frame_of([attempt(key_of(parts), work)])

    def joined(parts: Frame) -> Iterator[Frame]:
        """Keys of one slice as they are, the others one by one."""
        keys = parts.groupby(by, sort=False, dropna=False)
        single = keys["status"].transform("size") == 1
        if single.any():
            yield parts[single]
        for _, several in parts[~single].groupby(by, sort=False, dropna=False):
            yield join(several)

    def merged(batches: Iterator[Frame]) -> Iterator[Frame]:
        """The last key of a batch may go on in the next one, so it waits for it."""
        held = []
        for batch in batches:
            if not len(batch):
                continue
            number = batch.groupby(by, sort=False, dropna=False).ngroup()
            if held and number.iloc[-1] == number.iloc[0] and same_key(held[0], batch):
                held.append(batch)
                continue
            held.append(batch[number != number.iloc[-1]])
            yield from joined(pd.concat(held, ignore_index=True))
            held = [batch[number == number.iloc[-1]]]
        if held:
            yield from joined(pd.concat(held, ignore_index=True))

    def same_key(a: Frame, b: Frame) -> bool:
        return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(key_of(a), key_of(b)))

    # Rows are dealt by ranges of (key, row): a small key is one slice, a busy key has many tasks.
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(number, *by, F.monotonically_increasing_id())
    found = dealt.sortWithinPartitions(*by).mapInPandas(slices, schema)
    return found.repartition(number, *by).sortWithinPartitions(*by).mapInPandas(merged, schema)


class AsyncRun:
    """An action running in a thread of its own, with status, result and cancel."""

    def __init__(self, spark: SparkSession, action: Callable[[], Any]):
        self.spark = spark
        self.tag = f"run-{uuid.uuid4().hex}"
        self._status = "pending"
        self._value: Any = None
        self._error: BaseException | None = None
        self._lock = threading.Lock()
        self._thread = InheritableThread(target=self._work, args=(action,), daemon=True)
        self._thread.start()

    def _move(self, before: Sequence[str], after: str) -> bool:
        with self._lock:
            if self._status not in before:
                return False
            self._status = after
            return True

    def _work(self, action: Callable[[], Any]) -> None:
        if not self._move(["pending"], "running"):
            return
        self.spark.addTag(self.tag)
        try:
            self._value = action()
            self._move(["running"], "completed")
        except BaseException as e:
            self._error = e
            self._move(["running"], "failed")
        finally:
            self.spark.removeTag(self.tag)

    def status(self) -> str:
        return self._status

    def result(self, timeout: float | None = None) -> Any:
        """The action's value; raises TimeoutError, or RuntimeError when it did not complete."""
        self._thread.join(timeout)
        if self._thread.is_alive() and self._status in ("pending", "running"):
            raise TimeoutError(f"not done after {timeout} s")
        if self._status != "completed":
            raise RuntimeError(f"run {self._status}: {self._error}") from self._error
        return self._value

    def cancel(self) -> bool:
        """Stops the action's jobs; False when it was already over."""
        stopped = self._move(["pending", "running"], "cancelled")
        if stopped:
            self.spark.interruptTag(self.tag)
        return stopped


def run_async(spark: SparkSession, action: Callable[[], Any]) -> AsyncRun:
    """Starts an action (``lambda: df.count()``) and returns its handle."""
    return AsyncRun(spark, action)
