"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions alone.

An item's windows are its runs of ``window`` consecutive words; an item of fewer words is
one window. A window counts as the set of its shingles (``width`` consecutive words, or the
whole window if that is shorter), and a document holds the window only if it holds all of
them, in place. So one shingle of each window is a sufficient prefix: the rarest.

1. Each task cuts its documents into words, hashes the shingle at each word and keeps those
   that any item has: ``found(document, at, shingle)``, a table in the shared folder. The
   hashes of the items' shingles are broadcast in blocks of at most ``block`` numbers of
   8 bytes; more items mean more passes, never a larger broadcast or a shuffle of the words.
2. Shingles are ordered by how often the whole corpus holds them, then by the number of
   windows that have them. A window with a shingle that occurs nowhere is out.
3. The prefix join: places of a window's rarest shingle, and no others, become candidates.
   Positional bound: the window must not begin before the document. Length bound: it must
   end within it.
4. Candidates are verified exactly: the shingles that cover the window must all be found at
   their places, compared as words. Overlapping windows become spans.

Words are the maximal runs of ``WORD``, A-Z lower-cased. A shingle or window of more than
256 bytes is compared by its SHA-256.

Defined results. Null and empty texts have no words. A row's result depends on its own text,
so rows that repeat a doc_id, null ones included, each have their own. Items that are null or
have no words have no windows. Rows that repeat an item_id are one item; an item without an
id marks words, but is not listed. An empty table of documents gives an empty result; an
empty benchmark marks nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import join_carried
from ..plans.scratch import written

#: What parts words: every ASCII character but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_LONGEST = 256


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, GAP), "")


def _key(words: Column) -> Column:
    """Words as one string; they hold no blanks, so it tells them apart."""
    joined = F.array_join(words, " ")
    return F.when(F.octet_length(joined) > _LONGEST, F.sha2(joined, 256)).otherwise(joined)


def _hash(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words): each window of each item, once per item."""
    cut = items.select("item_id", words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    return cut.select("item_id", "all", F.explode(starts).alias("start")).select(
        "item_id", F.slice("all", F.col("start"), window).alias("words")
    ).distinct()


def window_shingles(windows: DataFrame, width: int) -> DataFrame:
    """(window, length, width, offset, shingle, hash): the shingles of each distinct window."""
    distinct = windows.groupBy(_key(F.col("words")).alias("window")).agg(
        F.any_value("words").alias("words")
    )
    sized = distinct.select(
        "*",
        F.size("words").alias("length"),
        F.least(F.size("words"), F.lit(width)).alias("width"),
    )
    placed = sized.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("width"))).alias("offset")
    )
    hashes = [
        F.when(F.col("width") == w, _hash(F.col("words"), F.col("offset"), w))
        for w in range(1, width + 1)
    ]
    return placed.select(
        "window",
        "length",
        "width",
        "offset",
        _key(F.slice("words", F.col("offset") + 1, F.col("width"))).alias("shingle"),
        F.coalesce(*hashes).alias("hash"),
    )


def found_shingles(docs: DataFrame, shingles: DataFrame, block: int = 1 << 19) -> DataFrame:
    """(doc_id, tag, n_words, at, shingle): where documents hold shingles of the items.

    ``tag`` is the digest of the text; with doc_id it names a row by what it says. Each row of
    ``docs`` also has one entry with ``at`` -1, from the same pass over the texts.
    """
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    hashes = written(shingles.select("hash").distinct(), "item-hashes")
    blocks = max(1, -(-hashes.count() // block))
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id", F.unhex(F.md5(text)).alias("tag"), words_of(F.col("text")).alias("words")
    )

    def hashed(width: int) -> Column:
        return F.transform("words", lambda _, i: _hash(F.col("words"), i, width))

    at_each = [hashed(w) for w in widths]

    def one_pass(number: int) -> DataFrame:
        first = [F.lit(0).cast("bigint")] if number == 0 else []
        hashed = cut.select(
            "*", F.concat(F.array(*first).cast("array<bigint>"), *at_each).alias("hashes")
        )
        # not a plain explode, which adds a filter that computes all hashes again
        placed = hashed.select(
            "doc_id", "tag", "words", F.posexplode_outer("hashes").alias("place", "hash")
        )
        mine = hashes.filter(F.pmod("hash", F.lit(blocks)) == number)
        if first:
            mine = mine.unionByName(hashes.sparkSession.range(1).select(F.col("id").alias("hash")))
        place = F.col("place") - len(first)
        n_words = F.size("words")
        at = F.when(place < 0, place).otherwise(place % n_words)
        width = F.get(
            F.array(*[F.lit(w) for w in widths]).cast("array<int>"),
            F.floor(place / n_words).cast("int"),
        )
        return placed.join(F.broadcast(mine.distinct()), "hash").select(
            "doc_id",
            "tag",
            n_words.cast("bigint").alias("n_words"),
            at.cast("int").alias("at"),
            F.when(place >= 0, _key(F.slice("words", at + 1, width))).alias("shingle"),
        )

    parts = [written(one_pass(number), "found") for number in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def rarest_shingles(shingles: DataFrame, found: DataFrame) -> DataFrame:
    """(window, length, offset, shingle): the prefix of each window that can occur at all."""
    held = found.groupBy("shingle").agg(F.count("*").alias("places"))
    among = shingles.groupBy("shingle").agg(F.count("*").alias("windows"))
    ranked = shingles.join(held, "shingle", "left").join(among, "shingle")
    rarity = F.struct(F.coalesce("places", F.lit(0)), "windows", "offset")
    return (
        ranked.groupBy("window")
        .agg(
            F.any_value("length").alias("length"),
            F.min(F.coalesce("places", F.lit(0))).alias("places"),
            F.min_by(F.struct("offset", "shingle"), rarity).alias("prefix"),
        )
        .filter(F.col("places") > 0)
        .select("window", "length", "prefix.offset", "prefix.shingle")
    )


def occurrences(found: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, tag, start, stop, window): each place where a document holds a window whole."""
    places = found.filter(F.col("at") >= 0)
    prefix = written(rarest_shingles(shingles, places), "prefixes")
    start = F.col("at") - F.col("offset")
    candidates = (
        places.join(prefix, "shingle")
        .filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
        .select("doc_id", "tag", start.alias("start"), "window")
        .distinct()
    )
    cover = shingles.filter(
        (F.col("offset") % F.col("width") == 0)
        | (F.col("offset") == F.col("length") - F.col("width"))
    )
    pieces = cover.groupBy("window").agg(F.count("*").alias("pieces"))
    needed = candidates.join(cover.join(pieces, "window"), "window").select(
        "doc_id", "tag", "start", "window", "length", "pieces",
        (F.col("start") + F.col("offset")).alias("at"), "shingle",
    )
    there = places.select(
        F.col("doc_id").alias("in_doc"),
        F.col("tag").alias("in_tag"),
        F.col("at").alias("in_at"),
        F.col("shingle").alias("in_shingle"),
    ).distinct()
    same = (
        needed["doc_id"].eqNullSafe(there["in_doc"])
        & (needed["tag"] == there["in_tag"])
        & (needed["at"] == there["in_at"])
        & (needed["shingle"] == there["in_shingle"])
    )
    return (
        needed.join(there, same, "left_semi")
        .groupBy("doc_id", "tag", "start", "window", "length", "pieces")
        .agg(F.count("*").alias("seen"))
        .filter(F.col("seen") == F.col("pieces"))
        .select(
            "doc_id", "tag", "start", (F.col("start") + F.col("length")).alias("stop"), "window"
        )
    )


def hit_spans(held: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): the words inside any occurrence, as spans that do not touch."""
    by_place = Window.partitionBy("doc_id", "tag").orderBy("start", "stop")
    reached = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opened = held.select("doc_id", "tag", "start", "stop").distinct().select(
        "*", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int").alias("opens")
    )
    numbered = opened.withColumn("island", F.sum("opens").over(by_place))
    islands = numbered.groupBy("doc_id", "tag", "island").agg(
        F.struct(
            F.min("start").cast("bigint").alias("start"),
            F.max("stop").cast("bigint").alias("stop"),
        ).alias("span")
    )
    return islands.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def item_lists(held: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, tag, items): ids of the items with a window in the document, as sorted strings."""
    owners = windows.filter(F.col("item_id").isNotNull()).select(
        _key(F.col("words")).alias("window"), F.col("item_id").cast("string").alias("item")
    ).distinct()
    return (
        held.select("doc_id", "tag", "window")
        .distinct()
        .join(owners, "window")
        .groupBy("doc_id", "tag")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, width: int = 5, block: int = 1 << 19
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, spans of words that occurrences of
    windows of ``items(item_id, text)`` cover, and the ids of those items."""
    windows = written(item_windows(items, window), "windows")
    shingles = written(window_shingles(windows, width), "shingles")
    found = found_shingles(docs, shingles, block)
    held = written(occurrences(found, shingles), "occurrences")
    rows = found.filter(F.col("at") < 0).select("doc_id", "tag", "n_words")
    marked = join_carried(rows, hit_spans(held), ["doc_id", "tag"])
    listed = join_carried(marked, item_lists(held, windows), ["doc_id", "tag"])
    none = F.array()
    return listed.select(
        "doc_id",
        "n_words",
        F.coalesce("spans", none.cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
        F.coalesce("items", none.cast("array<string>")).alias("items"),
    )
