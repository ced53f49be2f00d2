"""Token counts: batches through a sentencepiece model that return lengths only.

Within an Arrow batch the texts are ordered by bytes and dealt into calls of about
``call_bytes`` of UTF-8 each, so no call holds many long texts. Texts of more than
``piece_chars`` are cut at safe boundaries: a single space after an ASCII letter, digit, comma
or full stop and before an ASCII letter or digit, where the model's own word mark begins and
no entry of its vocabulary reaches across. Cut there, the parts' counts add up to the whole's,
as the model puts the word mark before each part again. A vocabulary with an entry that
reaches across, or a model that puts no mark before a text, is not cut at all.

Defined results. A null text counts as empty and has 0 bytes and 0 tokens. A very long
text without a safe boundary is encoded as it is. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = "▁"

#: A single space with ASCII letters, digits or a comma or full stop beside it: characters
#: that the normaliser leaves as they are and that no combining mark follows.
_SAFE = regex.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


def crosses_words(pieces: list[str]) -> bool:
    """Whether an entry has the word mark after another character."""
    return any(_MARK in p.lstrip(_MARK) for p in pieces)


def safe_parts(text: str, piece_chars: int) -> list[str]:
    """The text cut at safe boundaries into parts of at least ``piece_chars``."""
    parts, start = [], 0
    while len(text) - start > piece_chars:
        found = _SAFE.search(text, start + piece_chars)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.end()
    parts.append(text[start:])
    return parts


def calls_of(sizes: list[int], call_bytes: int) -> Iterator[list[int]]:
    """Numbers of texts, longest first, in calls of about equal bytes."""
    call, held = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        call.append(i)
        held += sizes[i]
        if held >= call_bytes:
            yield call
            call, held = [], 0
    if call:
        yield call


def token_counts(
    docs: DataFrame, path: str, piece_chars: int = 4000, call_bytes: int = 1 << 20
) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, n_bytes and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crosses = crosses_words([model.id_to_piece(i) for i in range(model.get_piece_size())])
        whole = crosses or not model.encode("a", out_type=str)[0].startswith(_MARK)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts, owner = [], []
            for i, text in enumerate(texts):
                mine = [text] if whole else safe_parts(text, piece_chars)
                parts += mine
                owner += [i] * len(mine)
            counts = [0] * len(texts)
            for call in calls_of([len(p.encode()) for p in parts], call_bytes):
                encoded = model.encode([parts[i] for i in call], num_threads=1)
                for i, ids in zip(call, encoded):
                    counts[owner[i]] += len(ids)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_bytes": batch.column(2),
                    "n_tokens": pa.array(counts, pa.int64()),
                }
            )

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint"), text, F.octet_length(text).cast("bigint")
    ).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
