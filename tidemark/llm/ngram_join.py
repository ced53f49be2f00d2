"""Similarity join of documents on word n-grams, by a size-aware heavy-light scheme.

A document is the set of its distinct word n-grams; two link when the Jaccard
similarity of their sets is at least ``num / den``.

* Documents of equal sets are one node.
* Small (light) sets enumerate all their subsets of the fixed size that a link with a
  partner of a given size must share; sets that share such a subset are candidates.
* Large (heavy) sets are found through inverted lists: a set's n-grams are put in one
  global order, rare ones first by a sketch that counts all n-grams of all documents, and
  only those up to where a link is still possible are listed. Positions in that order
  bound the overlap.
* The boundary between the two is the size at which the estimated cost, subsets
  enumerated against lists scanned, is smallest. Near it, small sets are listed as well,
  so that pairs across the boundary are found.
* Parity bits of a set, about one for each n-gram, give a lower bound of the difference of
  two sets; pairs that cannot link go before their sets are compared. All others are
  compared exactly.

Groups of near copies are not expanded into pairs. A first round compares each set with
one leader per list, the set whose shared n-grams come first in its order. After that
only pairs whose members are not yet connected are candidates, in lists that hold more
than one component. No link that joins two components is lost.

Sizes, orders and estimates only steer the work; the result is exact up to equal 64-bit
hashes of different n-grams within a pair of documents.

Defined results. With fewer than ``n`` words the whole sequence is the one n-gram. Null
texts and texts without words have an empty set and link with nothing. Rows that repeat a
doc_id are one document to the links. Rows with a null doc_id take no part: their
component is null and ``drop_near_copies`` keeps them. Very long texts are compared
whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .bloom import filter_bits, filter_of, positions, test_bits
from .components import components, near_labels
from .names import fresh
from .sketch import Counts, estimates, merged

#: Bytes of the documents to compare (id, signature, partners) that may be broadcast.
BROADCAST_BYTES = 32 << 20

#: Members compared with one leader by one task.
PER_TASK = 100

_LOW64 = (1 << 64) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    parts = text.lower().split()
    k = len(parts)
    if not k:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, k)
    width = min(n, k)
    out = _mix(hashes[: k - width + 1] * _A + np.uint64(width))
    for i in range(1, width):
        out = _mix(out * _C + hashes[i : k - width + 1 + i])
    out = out.view(np.int64)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) > 1 else out


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def needed(size: int, num: int, den: int) -> int:
    """The least overlap of a set with any partner it links with: ceil(size * num / den)."""
    return -(-size * num // den)


def subset_sizes(size: int, most: int, num: int, den: int) -> list[tuple[int, int]]:
    """(size of the larger set, size of the subset shared) for partners up to ``most``."""
    return [(m, needed(m, num, den)) for m in range(size, min(most, size * den // num) + 1)]


def boundary(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """The largest size that enumerates subsets: where the estimated cost is least."""
    top = max(sizes, default=0)
    best, at = float("inf"), 0
    for most in range(top + 1):
        cost = 0.0
        for size, count in sizes.items():
            if size <= most:
                cost += count * sum(comb(size, c) for _, c in subset_sizes(size, most, num, den))
            if size > most or size * den // num > most:
                cost += count * (size - needed(size, num, den) + 1) * list_length
        if cost < best:
            best, at = cost, most
    return at


def subset_keys(members: list[int], most: int, num: int, den: int) -> list[int]:
    """Keys of the subsets a small set enumerates: sums of its members' hashes."""
    keys = []
    total = sum(members)
    for larger, c in subset_sizes(len(members), most, num, den):
        for left_out in combinations(members, len(members) - c):
            key = ((total - sum(left_out)) * 0x9E3779B97F4A7C15 + larger) & _LOW64
            key = ((key ^ key >> 31) * 0xBF58476D1CE4E5B9) & _LOW64
            keys.append(key - (1 << 64) if key >> 63 else key)
    return keys


#: Parity bits that are columns, 64 each, so that a join's condition can read them.
_BITS = tuple(f"b{i}" for i in range(16))


def parity_bits(members: np.ndarray) -> tuple[bytes, list[int]]:
    """Which bits an odd number of members fall on: in all, and folded to those of columns."""
    bits = 64 * len(_BITS)
    while bits < 1.2 * len(members) and bits < 1 << 15:
        bits *= 2
    odd = (np.bincount((members >> 20) & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    folded = np.bitwise_xor.reduce(odd.reshape(-1, 64 * len(_BITS)), axis=0)
    return np.packbits(odd).tobytes(), np.packbits(folded).view(np.int64).tolist()


def least_difference(a: bytes, b: bytes) -> int:
    """How many members two sets differ in at least; the longer bits are folded."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(np.frombuffer(a, np.uint8).reshape(-1, len(b)), axis=0).tobytes()
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


#: Sizes whose numbers of sets are counted one by one, for the boundary.
_SMALL = 40

_STATISTICS = "kind int, key bigint, count bigint, counts binary"


def _statistics(docs: DataFrame, n: int, at_once: int = 1 << 21):
    """A sketch of all n-grams' counts, numbers of small sets, and the mean list length.

    Each task counts its n-grams, about two million at a time, into a sketch of a fixed
    size; the sum of all sketches orders the lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHashes(), [], 0
        sizes = np.zeros(_SMALL + 1, np.int64)
        whole = np.zeros(2, np.int64)
        sketch = Counts()

        def enter() -> None:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            sketch.add(keys, counts)
            whole[:] += counts.sum(), len(counts)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                members = shingles(text, n, words)
                if len(members) <= _SMALL:
                    sizes[len(members)] += 1
                held.append(members)
                size += len(members)
                if size >= at_once:
                    enter()
                    held, size = [], 0
        if held:
            enter()
        yield rows(1, range(1, _SMALL + 1), sizes[1:].tolist())
        yield rows(2, range(2), whole.tolist())
        for segment, counts in sketch.segments():
            yield rows(0, [segment], [0], counts)

    def rows(kind: int, keys, counts: list[int], packed: bytes | None = None) -> pa.RecordBatch:
        return pa.record_batch(
            {
                "kind": pa.array([kind] * len(counts), pa.int32()),
                "key": pa.array(keys, pa.int64()),
                "count": pa.array(counts, pa.int64()),
                "counts": pa.array([packed] * len(counts), pa.binary()),
            }
        )

    counted = written(docs.select("text").mapInArrow(run, _STATISTICS), "ngram-counts")
    of_cells = merged(
        counted.filter("kind = 0").select(F.col("key").cast("int").alias("segment"), "counts")
    )
    sums = counted.filter("kind > 0").groupBy("kind", "key").agg(F.sum("count").alias("count"))
    rest = {(r["kind"], r["key"]): r["count"] for r in sums.collect()}
    sizes = {k: c for (kind, k), c in rest.items() if kind == 1 and c}
    list_length = rest.get((2, 0), 1) / max(1, rest.get((2, 1), 1))
    return of_cells, sizes, list_length


_PREPARED = (
    "doc_id bigint, size int, sig binary, first boolean, scan array<bigint>, "
    "subsets array<bigint>, parity binary, " + ", ".join(f"{bits} bigint" for bits in _BITS)
)


def _prepare(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per document its size and signature; per signature of a task its lists and bits."""
    of_cells, sizes, list_length = _statistics(docs, n)
    most = boundary(sizes, list_length, num, den)
    shared = docs.sparkSession.sparkContext.broadcast(of_cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        words, seen = WordHashes(), set()
        for batch in batches:
            columns: list[list] = [[] for _ in range(7 + len(_BITS))]
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                members = shingles(text, n, words)
                size = len(members)
                sig = xxhash.xxh3_128_digest(members.tobytes()) if size else None
                row = [doc_id, size, sig, False, *[None] * (3 + len(_BITS))]
                if sig is not None and doc_id is not None and sig not in seen:
                    seen.add(sig)
                    scan, subsets = [], []
                    if size > most or size * den // num > most:
                        scan = rare_first(members, counts)[
                            : size - needed(size, num, den) + 1
                        ].tolist()
                    if size <= most:
                        subsets = subset_keys(members.tolist(), most, num, den)
                    parity, folded = parity_bits(members)
                    row = [doc_id, size, sig, True, scan, subsets, parity, *folded]
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
            kinds += [pa.list_(pa.int64())] * 2 + [pa.binary()] + [pa.int64()] * len(_BITS)
            names = [c.split()[0] for c in _PREPARED.split(", ")]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

    return written(docs.mapInArrow(run, _PREPARED), "ngram-sets")


def rare_first(members: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The global order: by the sketch's count, then by hash."""
    return members[np.lexsort((members, estimates(counts, members)))]


def _bounded(wanted: DataFrame) -> DataFrame:
    """To be broadcast if it is small, partners included; else Spark joins by shuffling."""
    row = F.lit(64) + 32 * F.size("where")
    total = wanted.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(wanted) if total <= BROADCAST_BYTES else wanted


def _close_enough(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the parity bits leave, each with the number of its leader's pairs."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            columns = (c.to_pylist() for c in batch.columns[2:])
            for of_a, size_a, of_b, size_b in zip(*columns):
                most = (size_a + size_b) * (den - num)
                kept.append(least_difference(of_a, of_b) * (num + den) <= most)
            ids = pa.record_batch(batch.columns[:2], names=["a", "b"])
            yield ids.filter(pa.array(kept, pa.bool_()))

    def of(side: str) -> DataFrame:
        return nodes.select(
            F.col("node").alias(side), F.col("parity").alias(f"of_{side}"), F.col("size").alias(f"size_{side}")
        )

    close = (
        pairs.join(of("b"), "b")
        .join(of("a"), "a")
        .select("a", "b", "of_a", "size_a", "of_b", "size_b")
        .mapInArrow(look, "a bigint, b bigint")
    )
    close = written(close, "pairs")
    return close.join(close.groupBy("a").agg(F.count("*").alias("pairs")), "a")


def _verified(
    pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int
) -> DataFrame:
    """The pairs (a, b) of nodes whose sets do link.

    Sets are made again from the texts, of these nodes only, and go straight to where the
    leader ``a`` of the pair is; a leader of many pairs is given to several tasks.
    """
    counted = _close_enough(pairs, nodes, num, den)
    shares = F.ceil(F.col("pairs") / PER_TASK).cast("int")
    members = counted.select("a", F.pmod(F.xxhash64("b"), shares).cast("int").alias("share"), "b")
    leaders = (
        counted.select("a", shares.alias("shares"))
        .distinct()
        .select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    )
    where = F.struct("a", "share", "b")
    wanted = (
        members.select(F.col("b").alias("node"), where.alias("where"))
        .unionByName(
            leaders.withColumn("b", F.lit(None).cast("bigint")).select(
                F.col("a").alias("node"), where.alias("where")
            )
        )
        .groupBy("node")
        .agg(F.collect_list("where").alias("where"))
        .join(nodes.select("node", "pick", "sig"), "node")
        .select(F.col("pick").alias("doc_id"), "sig", "where")
    )
    wanted = written(wanted, "wanted")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            places, sets = [], []
            for sig, where, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text, n, words).tobytes()
                if xxhash.xxh3_128_digest(found) == sig:
                    places += [(w["a"], w["share"], w["b"]) for w in where]
                    sets += [found] * len(where)
            kinds = (("a", pa.int64()), ("share", pa.int32()), ("b", pa.int64()))
            columns = {
                name: pa.array([p[i] for p in places], kind)
                for i, (name, kind) in enumerate(kinds)
            }
            yield pa.record_batch({**columns, "members": pa.array(sets, pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A leader comes before its members; rows that repeat its doc_id are leaders too."""
        place, leaders = None, []
        for batch in batches:
            kept: tuple[list, list] = ([], [])
            for a, share, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.frombuffer(raw, np.int64)
                if place != (a, share):
                    place, leaders = (a, share), []
                if b is None:
                    leaders.append(found)
                elif any(linked(leader, found, num, den) for leader in leaders):
                    kept[0].append(a)
                    kept[1].append(b)
            yield pa.record_batch(
                {"a": pa.array(kept[0], pa.int64()), "b": pa.array(kept[1], pa.int64())}
            )

    sets = (
        docs.join(_bounded(wanted), "doc_id")
        .select("sig", "where", "text")
        .mapInArrow(make, "a bigint, share int, b bigint, members binary")
    )
    return written(
        sets.repartition("a", "share")
        .sortWithinPartitions("a", "share", F.asc_nulls_first("b"))
        .mapInArrow(compare, "a bigint, b bigint"),
        "verified",
    )


def _shared_lists(nodes: DataFrame) -> DataFrame:
    """(token, node, size, pos) of the lists that more than one node may be in.

    One count per token is shuffled, no list. Tokens of several nodes fill a Bloom filter,
    and what passes it is listed; a token that passes by chance has a list of one.
    """
    tokens = nodes.select(F.explode(F.concat("scan", "subsets")).alias("token"))
    several = written(
        tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), "tokens"
    )
    bits = filter_bits(several.count())
    shared = nodes.sparkSession.sparkContext.broadcast(filter_of(several, bits))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            ids, sizes = (batch.column(i).to_numpy() for i in (0, 1))
            for column, placed in ((batch.column(2), True), (batch.column(3), False)):
                tokens = column.flatten().to_numpy()
                ends = np.cumsum(column.value_lengths().to_numpy())
                at = np.flatnonzero(
                    test_bits(words, positions(tokens.view(np.uint64), bits))
                    if len(tokens)
                    else np.zeros(0, bool)
                )
                row = np.searchsorted(ends, at, "right")
                starts = np.concatenate(([0], ends))[row]
                yield pa.record_batch(
                    {
                        "token": pa.array(tokens[at]),
                        "node": pa.array(ids[row]),
                        "size": pa.array(sizes[row]),
                        "pos": pa.array((at - starts if placed else 0 * at).astype(np.int32)),
                    }
                )

    return nodes.select("node", "size", "scan", "subsets").mapInArrow(
        listed, "token bigint, node bigint, size int, pos int"
    )


def _overlap_possible(left: str, right: str, num: int, den: int) -> Column:
    """Whether sizes and positions leave room for a link."""
    size = F.col(f"{left}size") + F.col(f"{right}size")
    room = F.least(
        F.col(f"{left}size") - F.col(f"{left}pos"), F.col(f"{right}size") - F.col(f"{right}pos")
    )
    return room * (num + den) >= size * num


def _difference_possible(left: str, right: str, num: int, den: int) -> Column:
    """Whether the parity bits leave room for a link."""
    size = F.col(f"{left}size") + F.col(f"{right}size")
    apart = sum(
        (F.bit_count(F.col(f"{left}{b}").bitwiseXOR(F.col(f"{right}{b}"))) for b in _BITS),
        F.lit(0),
    )
    return apart * (num + den) <= size * (den - num)


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(side + c) for c in df.columns])


def near_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles and component_id."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    prepared = _prepare(rows, n, num, den)
    light = prepared.select("doc_id", "size", "sig")
    reps = written(
        prepared.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("sig")
        .agg(
            F.min("doc_id").alias("node"),
            F.min(F.when(F.col("first"), F.col("doc_id"))).alias("pick"),
        ),
        "nodes",
    )
    nodes = written(
        prepared.filter("first")
        .join(reps, (prepared["sig"] == reps["sig"]) & (F.col("doc_id") == F.col("pick")))
        .select("node", "pick", reps["sig"], "size", "scan", "subsets", "parity", *_BITS),
        "ngram-nodes",
    )
    lists = written(_shared_lists(nodes), "lists")
    bits = nodes.select("node", "size", *_BITS)

    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num)))
    banded = lists.withColumn("band", band)
    leaders = banded.groupBy("token", "band").agg(
        F.min(F.struct("pos", "node", "size")).alias("lead"), F.count("*").alias("length")
    )
    led = banded.join(leaders.filter("length > 1"), ["token", "band"]).select(
        *[F.col(c).alias(f"x_{c}") for c in ("node", "pos", "size")],
        *[F.col(f"lead.{c}").alias(f"y_{c}") for c in ("node", "pos", "size")],
    )
    stars = (
        led.filter("x_node <> y_node")
        .filter(_overlap_possible("x_", "y_", num, den))
        .select("x_node", "y_node")
        .distinct()
        .join(_side(bits, "x_"), "x_node")
        .join(_side(bits, "y_"), "y_node")
        .filter(_difference_possible("x_", "y_", num, den))
        .select(F.col("y_node").alias("a"), F.col("x_node").alias("b"))
    )
    links = _verified(stars, nodes, rows, n, num, den)
    known = near_labels(links)

    mixed = lists.join(known, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    mixed = written(mixed, "mixed-lists")
    open_tokens = (
        mixed.groupBy("token")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count("*").alias("n"),
            *[F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)],
        )
        .filter("low < high")
        .select("token", F.xxhash64("n", "h1", "h2").alias("list"))
    )
    # Lists of the same nodes, as the n-grams of one shared passage have, are scanned as one: a
    # pair comes up once for all of them, at each node's first place in any.
    open_lists = (
        mixed.join(open_tokens, "token")
        .groupBy("list", "node")
        .agg(
            F.min("pos").alias("pos"),
            F.any_value("size").alias("size"),
            F.any_value("component").alias("component"),
        )
        .join(bits.drop("size"), "node")
    )
    open_lists = written(open_lists, "open-lists")
    across = (
        _side(open_lists, "x_")
        .join(
            _side(open_lists, "y_"),
            (F.col("x_list") == F.col("y_list"))
            & (F.col("x_node") < F.col("y_node"))
            & (F.col("x_component") != F.col("y_component"))
            & _overlap_possible("x_", "y_", num, den)
            & _difference_possible("x_", "y_", num, den),
        )
        .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
        .distinct()
    )
    links = links.union(_verified(across, nodes, rows, n, num, den))
    roots = components(links)
    of_sig = reps.join(roots, "node", "left").select(
        "sig", F.coalesce("component", "node").alias("component")
    )
    return light.join(of_sig, "sig", "left").select(
        "doc_id",
        F.col("size").cast("bigint").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias(
            "component_id"
        ),
    )


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: one document of each group."""
    (own,) = fresh(docs, "__id")
    dropped = (
        near_groups(docs, n, num, den)
        .filter("doc_id <> component_id")
        .select(F.col("doc_id").alias(own))
        .distinct()
    )
    return docs.join(dropped, F.col("doc_id").cast("bigint") == F.col(own), "left_anti")
