"""Near-duplicates by SimHash, found over one-wildcard segment variants.

A fingerprint has 64 bits in two segments. If two fingerprints differ in at most two
bits, either their upper segments differ in at most one bit, or their lower segments are
equal. So the index holds, for each distinct fingerprint, its upper segment with each
bit left out in turn, which meets all pairs of the first kind, and one such variant of
the lower segment, which meets all the others; further variants of the lower segment
would find the same pairs again. Equal variants are brought together by one shuffle, and
what meets there is verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Shelf, unused
from wardline.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 3, 2
SEGMENT = 32
#: Variants with up to so many fingerprints are compared pair by pair ...
PAIRED = 48
#: ... up to so many by two-wildcard subkeys within the task, and larger ones after another shuffle.
HELD = 32_768
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles of a UTF-8 text, A-Z lower-cased; 0 without words."""
    words = text.lower().split()  # on bytes: ASCII letters and the six ASCII white-space characters
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(
        b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x or b"") for x in batch.column("body").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint of each row as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(
        _fingerprints, f"doc_id {kind}, print long")


def variants(prints: DataFrame) -> DataFrame:
    """(variant, print): upper segments with bit `wildcard` cleared, lower ones with bit 0 cleared."""
    wildcard = F.explode(F.sequence(F.lit(0), F.lit(SEGMENT))).alias("wildcard")
    upper = F.shiftrightunsigned("print", SEGMENT)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("wildcard"))
    lower = F.col("print").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    segment = F.when(F.col("wildcard") < SEGMENT, upper.bitwiseAND(F.bitwise_not(bit))).otherwise(
        lower.bitwiseAND(F.bitwise_not(F.lit(1).cast("long"))))
    return prints.select("print", wildcard).select(
        F.shiftleft(F.col("wildcard").cast("long"), SEGMENT).bitwiseOR(segment).alias("variant"), "print")


def _masks() -> tuple[list[int], list[int], list[int]]:
    """Pairs of wildcards: one bit in each segment, two in the lower, two in the upper."""
    low, high = range(SEGMENT), range(SEGMENT, 2 * SEGMENT)
    both = lambda pairs: [(1 << a) | (1 << b) for a, b in pairs]
    return both((a, b) for a in high for b in low), both(combinations(low, 2)), both(combinations(high, 2))


MIXED, LOWER, UPPER = _masks()


def masks_of(wildcard: int) -> list[int]:
    """Two-wildcard masks that meet every pair for which this variant is needed."""
    if wildcard == SEGMENT:
        return UPPER
    bit = 1 << (SEGMENT + wildcard)
    return [m for m in MIXED if m & bit] + (LOWER if wildcard == 0 else [])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n rows is linked to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def _paired(variant: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between rows of the same variant; rows are sorted by it."""
    found_a, found_b = [], []
    at = np.arange(len(variant))
    for offset in range(1, PAIRED):
        at = at[at + offset < len(variant)]
        at = at[variant[at] == variant[at + offset]]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + offset]) <= DISTANCE]
        found_a.append(near)
        found_b.append(near + offset)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def _by_subkeys(wildcard: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one variant, without comparing all pairs: rows equal but for two bits."""
    found_a, found_b = [], []
    for mask in masks_of(wildcard):
        rest = prints & np.uint64(~mask & 0xFFFFFFFFFFFFFFFF)
        order = np.argsort(rest, kind="stable")
        same = np.flatnonzero(rest[order[1:]] == rest[order[:-1]])
        found_a.append(order[same])
        found_b.append(order[same + 1])
    return np.concatenate(found_a), np.concatenate(found_b)


def _links(variant: np.ndarray, prints: np.ndarray, paired: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    lengths = np.diff(np.append(starts, len(variant)))
    small = np.repeat(lengths <= paired, lengths)
    v, p = variant[small], prints[small]
    a, b = _paired(v, p)
    root = _roots(len(p), a, b)
    linked = root != np.arange(len(p))
    yield p[linked], p[root[linked]]
    for start, length in zip(starts[lengths > paired], lengths[lengths > paired]):
        own = prints[start:start + length]
        root = _roots(length, *_by_subkeys(int(variant[start]) >> SEGMENT, own))
        linked = root != np.arange(length)
        yield own[linked], own[root[linked]]


def _scan(held: int, paired: int):
    """Links of runs of equal variants; runs over `held` rows pass on for another shuffle."""

    def rows(a, b, wildcard=None):
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(np.full(len(a), -1 if wildcard is None else wildcard, np.int32))],
            ["a", "b", "wildcard"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variant, prints, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            variant = np.concatenate([variant, batch.column("variant").to_numpy()])
            prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
            if large is not None:  # the rest of a run that has been passed on so far
                ends = int(np.searchsorted(variant, large, "right"))
                yield rows(prints[:ends], prints[:ends], large >> SEGMENT)
                variant, prints, large = variant[ends:], prints[ends:], large if ends == len(variant) else None
            if not len(variant):
                continue
            last = int(np.searchsorted(variant, variant[-1], "left"))  # this run may go on in the next batch
            if last:
                for a, b in _links(variant[:last], prints[:last], paired):
                    yield rows(a, b)
            variant, prints = variant[last:], prints[last:]
            if len(variant) > held:
                large = int(variant[0])
                yield rows(prints, prints, large >> SEGMENT)
                variant, prints = variant[:0], prints[:0]
        if len(variant):
            for a, b in _links(variant, prints, paired):
                yield rows(a, b)

    return scan


def _spread(large: DataFrame) -> DataFrame:
    """Links among the rows of variants that no task holds: at most four prints agree but for two bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    parts = [(F.col("wildcard") == w, F.array(*[F.lit(signed(m)).cast("long") for m in masks_of(w)]))
             for w in range(SEGMENT + 1)]
    choice = F.when(parts[0][0], parts[0][1])
    for condition, listed in parts[1:]:
        choice = choice.when(condition, listed)
    return (
        large.select("a", F.explode(choice).alias("mask"))
        .withColumn("rest", F.col("a").bitwiseAND(F.bitwise_not(F.col("mask"))))
        .groupBy("mask", "rest").agg(F.collect_set("a").alias("prints")).filter(F.size("prints") > 1)
        .select(F.explode("prints").alias("a"), F.array_min("prints").alias("b")).filter("a != b").distinct())


def links(shelf: Shelf, prints: DataFrame, held: int = HELD, paired: int = PAIRED) -> DataFrame:
    """(a, b) over distinct prints: links that connect exactly the prints which chains of near pairs connect."""
    found = shelf.keep(
        variants(prints).repartition("variant").sortWithinPartitions("variant", "print")
        .mapInArrow(_scan(held, paired), "a long, b long, wildcard int"), "links")
    large = found.filter("wildcard >= 0")
    near = found.filter("wildcard < 0").select("a", "b")
    return near if large.isEmpty() else near.union(_spread(large))


def simhash_groups(docs: DataFrame, held: int = HELD, paired: int = PAIRED) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Fingerprints that differ in at most two bits are linked, and component_id is the
    smallest doc_id that links reach, the row's own included. Equal fingerprints are
    collapsed first, so copies cost nothing further on. Null texts count as empty; texts
    without words have fingerprint 0 and are linked like any other. A null doc_id is never
    a component_id unless its component has no other. Repeated rows are in one component
    by their equal fingerprints. Only doc_id and text are read.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    rows = shelf.keep(fingerprints(docs), "prints")
    distinct = shelf.keep(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct")
    joined = components(shelf, links(shelf, distinct.select("print"), held, paired), "a", "b")
    placed = distinct.join(joined, distinct["print"] == joined["node"], "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = shelf.keep(placed.join(least, "root").select("print", "component_id"), "classes")
    return rows.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with exactly one row of each component, all columns kept.

    It is the one with the smallest doc_id, null ids last; of rows with this id in one component the one
    with the smallest SHA-256 of its text, and of rows that agree in both any one.
    """
    key, root, n = unused(docs.columns, "key_", "root_", "rows_")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(key, F.struct(  # ordered as the rows are to be preferred
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(text, 256).alias("sha")))
    groups = simhash_groups(marked.select(F.col(key).alias("doc_id"), "text"))
    stays = Shelf(docs.sparkSession, "simhash-stays").keep(
        groups.filter(F.col("doc_id.sha") == F.col("component_id.sha"))
        .filter(F.col("doc_id.id").eqNullSafe(F.col("component_id.id")))
        .groupBy(F.col("component_id").alias(root)).agg(F.count("*").alias(n)), "stays")

    def of(chosen: DataFrame) -> DataFrame:
        same = marked[key]["id"].eqNullSafe(chosen[root]["id"]) & (marked[key]["sha"] == chosen[root]["sha"])
        return marked.join(chosen, same, "left_semi")

    repeated = stays.filter(F.col(n) > 1)
    if repeated.isEmpty():
        return of(stays).drop(key)
    return of(stays.filter(F.col(n) == 1)).union(of(repeated).dropDuplicates([key])).drop(key)
