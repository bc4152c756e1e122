"""Removal of repeated byte strings, decided by two-stage suffix sorting.

A byte goes if a string of `least` bytes covers it that also starts anywhere else. Such a string is called
a window here. Suffix sorting finds equal windows, but a corpus is no single string for one task, so:

1. Every window is named after the smallest hash among its short substrings. Equal windows
   have equal names, wherever they are. Neighbouring windows mostly share a name; such a
   run with its bytes is a region.
2. Only names that come up again can hold equal windows. Regions of one name with equal
   bytes are counted as one; their windows are repeated as soon as there are two of them.
3. The other regions of a name are sorted together. Of the suffixes of their bytes only
   those smaller than their successors are sorted directly; a scan over the buckets of first
   bytes induces the order of the rest. Neighbours in that order with a common
   prefix of `least` bytes are equal windows.
4. Names with very many regions, or very long ones, don't fit one task. Their windows are
   counted one by one under a digest, which takes more rows, but no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Shelf

LEAST = 400
#: Length of the substrings that name a window.
GRAM = 24
#: Bytes whose windows are named at once; bytes of a sorting task; bounds of a name that is sorted in one task.
NAMED_AT_ONCE, SORTED_AT_ONCE, NAME_REGIONS, NAME_BYTES = 1 << 22, 1 << 20, 4_000, 1 << 21
#: Parts into which the windows of one digest are dealt.
DIGEST_PARTS = 128
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), f"{order}u8", padded, strides=(1,)).astype(np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    words = _words(data, "<")
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for at, odd in zip(range(0, GRAM, 8), _ODD):
        h = (h ^ words[at:at + n]) * odd
        h ^= h >> np.uint64(29)
    h *= _ODD[3]
    return h ^ (h >> np.uint64(32))


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    least = h
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if rest := width - reach:
        least = np.minimum(least[:-rest], least[rest:])
    return least


def regions_of(bodies: list[bytes], least: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(text, name, first window, last window, whether windows within may be equal) of each region."""
    at = 0
    while at < len(bodies):
        end, total = at, 0
        while end < len(bodies) and (end == at or total + len(bodies[end]) <= NAMED_AT_ONCE):
            total, end = total + len(bodies[end]), end + 1
        chosen = [i for i in range(at, end) if len(bodies[i]) >= least]
        at = end
        if not chosen:
            continue
        lengths = np.array([len(bodies[i]) for i in chosen])
        offsets = np.cumsum(lengths) - lengths
        h = _gram_hashes(np.frombuffer(b"".join(bodies[i] for i in chosen), np.uint8))
        width = least - GRAM + 1
        names = _sliding_least(h, width)
        starts = np.zeros(len(names) + 1, bool)
        starts[1:-1] = names[1:] != names[:-1]
        starts[offsets] = True
        inside = np.zeros(len(names) + 1, np.int64)
        inside[offsets] += 1
        np.subtract.at(inside, offsets + lengths - least + 1, 1)
        first = np.flatnonzero(starts[:-1] & (np.cumsum(inside)[:-1] > 0))
        owner = np.searchsorted(offsets, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(names)) - 1, (offsets + lengths - least)[owner])
        for text, name, a, b, base in zip(
                owner.tolist(), names[first].tolist(), first.tolist(), last.tolist(), offsets[owner].tolist()):
            twice = b > a and np.count_nonzero(h[a:b + width] == np.uint64(name)) > 1
            yield chosen[text], name, a - base, b - base, twice


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least, by two-stage sorting."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # Where the text changes next tells whether a suffix is smaller than its successor.
    change = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    following = change[np.searchsorted(change, np.arange(n))]
    after = np.append(data[1:].astype(np.int64), -1)
    rising = data[following] < after[following]
    direct = np.flatnonzero(rising)
    words = np.concatenate([_words(data, ">"), np.zeros(8, np.uint64)])
    order = direct[np.lexsort((words[direct + 8], words[direct]))]
    tied = np.concatenate([[False], (words[order[1:]] == words[order[:-1]])
                           & (words[order[1:] + 8] == words[order[:-1] + 8]), [False]])
    opens = np.flatnonzero(~tied[:-1] & tied[1:])
    closes = np.flatnonzero(tied[:-1] & ~tied[1:])
    text, order = data.tobytes(), order.tolist()
    for a, b in zip(opens.tolist(), (closes + 1).tolist()):
        order[a:b] = sorted(order[a:b], key=lambda i: text[i + 16:i + depth])

    # Buckets of first bytes: falling suffixes fill a bucket from its head, rising ones are at its end.
    sizes = np.bincount(data, minlength=256)
    head = (np.cumsum(sizes) - sizes).tolist()
    result = [-1] * n
    tail = np.cumsum(sizes).tolist()
    for i in reversed(order):
        tail[text[i]] -= 1
        result[tail[text[i]]] = i
    falling = (~rising).tolist()
    result[head[text[-1]]] = n - 1  # the last suffix is greater than the empty one, which would induce it first
    head[text[-1]] += 1
    for i in result:
        if i > 0 and falling[i - 1]:
            c = text[i - 1]
            result[head[c]] = i - 1
            head[c] += 1
    return np.array(result)


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, up to `most`."""
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = _words(padded, ">")
    common = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, most, 8):
        differ = words[a[live] + at] ^ words[b[live] + at]
        equal = differ == 0
        odd = live[~equal]
        bits = np.floor(np.log2(np.maximum(differ[~equal], 1).astype(np.longdouble))).astype(np.int64)
        common[odd] = at + (63 - bits) // 8
        live = live[equal]
        if not len(live):
            break
    common[live] = most
    return np.minimum(common, most)


def repeated_windows(contents: list[bytes], least: int) -> list[np.ndarray]:
    """For each content, which of its windows also start anywhere else in these contents."""
    windows = [max(len(c) - least + 1, 0) for c in contents]
    data = np.frombuffer(b"".join(c + b"\xff" for c in contents), np.uint8)  # no byte of UTF-8
    lengths = np.array([len(c) + 1 for c in contents], dtype=np.int64)
    offsets = np.cumsum(lengths) - lengths
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, offsets, np.minimum(windows, 1))
    np.subtract.at(valid, offsets + windows, np.minimum(windows, 1))
    order = suffix_order(data, least)
    order = order[np.cumsum(valid)[order] > 0]
    same = common_prefixes(data, order[:-1], order[1:], least) >= least
    repeated = np.zeros(len(data), bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    return [repeated[o:o + w] for o, w in zip(offsets, windows)]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()


def _name_windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            found = list(regions_of(bodies, least))
            text, name, a, b, twice = zip(*found) if found else [()] * 5
            at = pa.array(text, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(name, np.uint64).view(np.int64)),
                pa.array([xxhash.xxh3_128_digest(memoryview(bodies[t])[x:y + least])
                          for t, x, y in zip(text, a, b)], pa.binary()),
                batch.column("text_key").take(at), batch.column("doc_id").take(at),
                pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(twice, pa.bool_())],
                ["name", "content", "text_key", "doc_id", "first", "last", "twice"])

    return run


def _cut(least: int):
    """Bytes of the listed regions of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "content", "hard", "bytes"]
        for batch in batches:
            for body, wanted in zip(batch.column("body"), batch.column("wanted")):
                body, wanted = body.as_py() or b"", wanted.as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([w["name"] for w in wanted], pa.int64()),
                    pa.array([w["content"] for w in wanted], pa.binary()),
                    pa.array([w["hard"] for w in wanted], pa.bool_()),
                    pa.array([body[w["first"]:w["last"] + least] for w in wanted], pa.binary())], names)

    return run


def _sort_bucket(least: int):
    def run(table: pa.Table) -> pa.Table:
        masks = repeated_windows(table.column("bytes").to_pylist(), least)
        runs = [_runs(mask) for mask in masks]
        lists = pa.list_(pa.int32())
        return pa.table([table.column("name"), table.column("content"), pa.array([r[0] for r in runs], lists),
                         pa.array([r[1] for r in runs], lists)], ["name", "content", "starts", "ends"])

    return run


def _single_windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, body in zip(*(batch.column(c).to_pylist() for c in ("name", "content", "bytes"))):
                view = memoryview(body)
                for at in range(0, len(body) - least + 1, 1 << 16):
                    starts = range(at, min(at + (1 << 16), len(body) - least + 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(starts), pa.int64()), pa.array([content] * len(starts), pa.binary()),
                        pa.array(starts, pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(view[s:s + least]) for s in starts], pa.binary())],
                        ["name", "content", "at", "digest"])

    return run


def _remove(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        all_spans, kept = [], []
        for body, hits in zip(batch.column("body"), batch.column("hits")):
            body, hits, spans = body.as_py() or b"", hits.as_py(), []
            for a, b in sorted((h["first"] + s, h["first"] + e + least)
                               for h in hits or () for s, e in zip(h["starts"], h["ends"])):
                if spans and a <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], b)
                else:
                    spans.append({"start": a, "end": b})
            edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(body)]
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
            all_spans.append(spans)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(all_spans, spans_type),
             pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(
    docs: DataFrame, least: int = LEAST, name_regions: int = NAME_REGIONS, name_bytes: int = NAME_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, spans (start, end) of removed bytes, and the kept bytes of every row.

    Strings are judged on the whole input, matches don't cross rows, and a string that
    starts again in the same text counts, also if it overlaps itself. Null texts count as
    empty. Repeated rows are copies like any other: of two rows with the same text of at
    least `least` bytes nothing stays. `least` must be GRAM or more. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "suffix-dedup")
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.substring(F.unhex(F.sha2("body", 256)), 1, 16)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).withColumn(
        "text_key", key)

    regions = shelf.keep(texts.filter(F.octet_length("body") >= least).mapInArrow(
        _name_windows(least), "name long, content binary, text_key binary, "
        f"doc_id {kind}, first int, last int, twice boolean"), "regions")
    again = (regions.groupBy("name").agg(F.count("*").alias("n"), F.max("twice").alias("any_twice"))
             .filter("n > 1 OR any_twice").select("name"))
    # Copies of a text agree in everything but doc_id; the smallest stands for them.
    found = shelf.keep(
        regions.join(again, "name", "left_semi").groupBy("name", "content", "text_key", "first", "last")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max("twice").alias("twice")), "found")
    contents = shelf.keep(
        found.groupBy("name", "content").agg(
            F.sum("n").alias("n"), F.max("twice").alias("twice"),
            F.min(F.struct("text_key", "doc_id", "first", "last")).alias("at")), "contents")
    size = F.col("at.last") - F.col("at.first") + F.lit(least)
    mixed = (contents.groupBy("name")
             .agg(F.count("*").alias("k"), F.sum(size).alias("size"), F.min("n").alias("fewest"), F.max("twice").alias("twice"))
             .filter("fewest = 1 AND (k > 1 OR twice)")
             .select("name", ((F.col("k") > name_regions) | (F.col("size") > name_bytes)).alias("hard")))
    wanted = (contents.join(mixed, "name").select("name", "content", "hard", "at.*")
              .groupBy("text_key", "doc_id")
              .agg(F.collect_list(F.struct("name", "content", "hard", "first", "last")).alias("wanted"))
              .withColumnsRenamed({"text_key": "of_key", "doc_id": "of_id"}))
    same = (texts["text_key"] == wanted["of_key"]) & texts["doc_id"].eqNullSafe(wanted["of_id"])
    cut = shelf.keep(texts.join(wanted, same).select("body", "wanted").mapInArrow(
        _cut(least), "name long, content binary, hard boolean, bytes binary")
        .dropDuplicates(["name", "content"]), "cut")

    total = cut.filter("NOT hard").agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("name"), F.lit(max(1, -(-total // SORTED_AT_ONCE))))
    found_type = "name long, content binary, starts array<int>, ends array<int>"
    decided = cut.filter("NOT hard").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(
        _sort_bucket(least), found_type)
    hard = cut.filter("hard")
    if not hard.isEmpty():
        single = shelf.keep(hard.mapInArrow(
            _single_windows(least), "name long, content binary, at int, digest binary"), "single")
        # A digest may be that of very many windows: they are counted and looked up in parts, by the region they are from.
        single = single.withColumn("part", F.pmod(F.xxhash64("content"), F.lit(DIGEST_PARTS)).cast("int"))
        parts = single.groupBy("digest", "part").agg(F.count("*").alias("n"))
        often = parts.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest")
        wanted_parts = parts.join(often, "digest", "left_semi").select("digest", "part")
        each = single.join(wanted_parts, ["digest", "part"], "left_semi").groupBy("name", "content").agg(
            F.sort_array(F.collect_list("at")).alias("starts"))
        decided = decided.union(each.select("name", "content", "starts", F.col("starts").alias("ends")))
    whole = contents.filter("n > 1").select(
        "name", "content", F.array(F.lit(0)).alias("starts"), F.array(F.col("at.last") - F.col("at.first")).alias("ends"))
    single_contents = contents.filter("n = 1").select("name", "content")
    decided = shelf.keep(
        decided.join(single_contents, ["name", "content"], "left_semi").filter(F.size("starts") > 0).union(whole),
        "decided")
    hits = (found.join(decided, ["name", "content"]).groupBy("text_key")
            .agg(F.collect_list(F.struct("first", "starts", "ends")).alias("hits")))

    return texts.join(hits, "text_key", "left").select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "body", "hits").mapInArrow(
        lambda batches: _remove(batches, least),
        f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
