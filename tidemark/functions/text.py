"""Column expressions on text: tokens, n-grams, sentences, multiple-choice letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

# Words and numbers, or one symbol; classes both Java and RE2 know.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
SENTENCE_END = "[.!?]"
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
MCQ_LETTER = r"(?<![\p{L}\p{N}_])([A-Da-d])(?![\p{L}\p{N}_])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Text to array of tokens. Any other ``Column -> Column`` may take its place."""
    return F.regexp_extract_all(_col(text), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(tokens: Column | str, n: int) -> Column:
    """All runs of n tokens, as arrays; empty when n <= 0 or there are fewer tokens."""
    tokens, empty = _col(tokens), F.array().cast("array<array<string>>")
    if n <= 0:
        return empty
    # sequence(1, 0) counts down, hence the guard on size.
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    runs = F.transform(starts, lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, runs).when(tokens.isNotNull(), empty)


def gram_keys(tokens: Column | str, n: int, escape: bool = False) -> Column:
    """The n-grams as strings, one string per distinct n-gram.

    Strings group and de-duplicate by hash, arrays of arrays do not. The default
    tokenizer never yields a blank, so a blank separates without ambiguity; pass
    ``escape=True`` for a tokenizer that may. ``tokens`` should be a plain column:
    it is looked up once per token.
    """
    tokens, empty = _col(tokens), F.array().cast("array<string>")
    if n <= 0:
        return empty
    if escape:

        def part(t: Column) -> Column:
            slashes = F.replace(t, F.lit("\\"), F.lit("\\\\"))
            return F.replace(slashes, F.lit(" "), F.lit("\\_"))
    else:
        part = lambda t: t

    def gram(i: Column) -> Column:
        pieces = [part(F.get(tokens, i))]
        for k in range(1, n):
            pieces += [F.lit(" "), part(F.get(tokens, i + k))]
        return F.concat(*pieces)

    if n == 1 and not escape:
        return tokens
    runs = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), gram)
    return F.when(F.size(tokens) >= n, runs).when(tokens.isNotNull(), empty)


def split_sentences(text: Column | str) -> Column:
    """Pieces between ``. ! ?``, stripped, without empties; null stays null."""
    pieces = F.transform(
        F.split(_col(text), SENTENCE_END), lambda s: F.regexp_replace(s, EDGE_SPACE, "")
    )
    return F.filter(pieces, lambda s: s != "")


def mcq_letter(generation: Column | str) -> Column:
    """First stand-alone letter A-D in any case, upper-cased; null when there is none."""
    return F.nullif(F.upper(F.regexp_extract(_col(generation), MCQ_LETTER, 1)), F.lit(""))


def distinct_ratio(grams: Column | str) -> Column:
    """Distinct over total items of an array; 0.0 when there are none."""
    grams = _col(grams)
    return F.when(
        F.size(grams) > 0, F.size(F.array_distinct(grams)) / F.size(grams).cast("double")
    ).otherwise(F.lit(0.0))
