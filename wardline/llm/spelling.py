"""Spelling variants: words that differ by one code point, found in a bit-sliced index of positions.

The index of a block of words holds a bitset for every (position, letter): the words that
have this letter there. A query walks its letters once and keeps four bitsets: words read
without an error so far, and words read with exactly one, replaced, inserted or deleted,
whose positions are then shifted by none, one ahead or one behind. Each letter moves all
words of the block at once, 64 in a machine word.

Blocks: of two words that differ by one code point, the shorter having L, either the first
L // 2 letters agree or the last L // 2 do. So a word is filed under both for its own length
and for the length below, and only words filed together are compared. Files that hold more
than BLOCK words are compared in a grid of blocks, all against all, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import Shelf

#: Runs of letters: ASCII and Latin-1 from 0xC0 on.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one block of the index, and queries that walk through it at a time.
BLOCK, QUERIES = 4_096, 512
#: Rounds of following forms; each doubles the steps, and a form is several times as frequent as its word.
MOST_ROUNDS = 40


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def mangled(doc_id: Column, run: Column, every: int) -> Column:
    """The run, less one code point where `every` divides the checksum of `<doc_id>:<run>`; null ids count as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, less).otherwise(run)


def count_words(docs: DataFrame, every: int | None = None, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): letter runs of all texts with A-Z lower-cased, of at least that length and that often.

    With `every`, one run in so many loses a letter, as `mangled` chooses it. Null texts have no runs.
    """
    runs = docs.select("doc_id", F.explode(runs_of(F.col("text"))).alias("run"))
    word = mangled(F.col("doc_id"), F.col("run"), every) if every else F.col("run")
    return (runs.select(word.alias("word")).filter(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n))


class BitIndex:
    """Bitsets over a block of words: who has which letter at which position, and who has which length."""

    def __init__(self, words: list[str]):
        count = len(words)
        self.width = (count + 63) // 64
        self.lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(count), self.lengths)
        position = np.arange(len(letters)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        keys = position << 21 | letters
        self.keys, row = np.unique(keys, return_inverse=True)  # only pairs that occur have a row
        self.rows = np.zeros((len(self.keys) + 1, self.width), np.uint64)  # the last row is empty
        np.bitwise_or.at(self.rows, (row, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
        self.distinct = np.unique(self.lengths)

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """One bitset for each letter: the words that have it at the position."""
        wanted = np.int64(position) << 21 | letters
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.rows[np.where(self.keys[at] == wanted, at, len(self.keys))]

    def longer(self, than: int) -> np.ndarray:
        return self._bits(self.lengths > than)

    def long(self, exactly: int) -> np.ndarray:
        return self._bits(self.lengths == exactly)

    def _bits(self, chosen: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.width * 64, np.uint8)
        padded[:len(chosen)] = chosen
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of numbers that differ by exactly one code point."""
        order = sorted(range(len(queries)), key=lambda q: -len(queries[q]))
        lengths = np.array([len(queries[q]) for q in order])
        found_queries, found_words = [], []
        for start in range(0, len(order), QUERIES):
            part, sizes = order[start:start + QUERIES], lengths[start:start + QUERIES]
            ends = np.cumsum(sizes)
            letters = np.frombuffer("".join(queries[q] for q in part).encode("utf-32-le"), np.uint32).astype(np.int64)
            first = ends - sizes
            none = np.zeros((len(part), self.width), np.uint64)
            exact, replaced, ahead, behind = none | self.longer(-1), none, none, none
            for i in range(int(sizes[0]) + 1 if len(sizes) else 0):
                # Queries are sorted by falling length: those that end here are the last ones.
                live = int(np.searchsorted(-sizes, -i, side="left"))  # sizes > i
                if live < len(exact):  # the others have read all their letters
                    longer = self.longer(i)
                    hits = (replaced[live:] & self.long(i) | (ahead[live:] | exact[live:] & longer) & self.long(i + 1)
                            | behind[live:] & self.long(i - 1))
                    q, cell = np.nonzero(hits)
                    bits = np.unpackbits(hits[q, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    hit, bit = np.nonzero(bits)
                    found_queries.append(np.array(part, np.int64)[live + q[hit]])
                    found_words.append(cell[hit] * 64 + bit)
                    exact, replaced, ahead, behind = exact[:live], replaced[:live], ahead[:live], behind[:live]
                if not live or not (exact.any() or replaced.any() or ahead.any() or behind.any()):
                    break
                letter = letters[first[:live] + i]
                here, longer = self.having(i, letter), self.longer(i)
                replaced = replaced & here | exact & longer & ~here
                ahead = (ahead | exact & longer) & self.having(i + 1, letter)
                behind = (behind & self.having(i - 1, letter) if i else behind) | exact
                exact = exact & here
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *found_queries]), np.concatenate([empty, *found_words])


def _filed(words: DataFrame) -> DataFrame:
    """Each word under its first and its last letters, for pairs whose shorter word has its length or one less."""
    size = F.length("word")

    def entry(shorter: Column, tail: bool) -> Column:
        half = F.floor(shorter / 2).cast("int")
        part = F.when(F.lit(tail), F.substring("word", size - half + 1, half)).otherwise(
            F.substring("word", F.lit(1), half))
        return F.struct(F.lit(tail).alias("tail"), shorter.cast("int").alias("shorter"), part.alias("part"))

    return words.select("word", "n", F.explode(F.array(
        *[entry(size - d, tail) for d in (0, 1) for tail in (False, True)])).alias("file"))


def _compare(table: pa.Table) -> pa.Table:
    """For the words of one block: how many near words it found for each, and the most frequent of them."""
    rows = {name: table.column(name).to_pylist() for name in ("word", "n", "tail", "shorter", "part", "asks", "told")}
    told = [i for i, flag in enumerate(rows["told"]) if flag]
    asks = [i for i, flag in enumerate(rows["asks"]) if flag]
    words, n, best = rows["word"], rows["n"], {}
    if told and asks:
        q, w = BitIndex([words[i] for i in told]).near([words[i] for i in asks])
        for a, b in zip(q.tolist(), w.tolist()):
            a, b = asks[a], told[b]
            # Of the words in a block only those filed together count, and each pair under one file.
            if any(rows[k][a] != rows[k][b] for k in ("tail", "shorter", "part")):
                continue
            if min(len(words[a]), len(words[b])) != rows["shorter"][a]:
                continue
            half = rows["shorter"][a] // 2
            if rows["tail"][a] and words[a][:half] == words[b][:half]:
                continue
            count, form = best.get(words[a], (0, None))
            this = (-n[b], words[b])
            best[words[a]] = (count + 1, this if form is None or this < form else form)
    return pa.table({
        "word": pa.array(list(best), pa.string()),
        "n_near": pa.array([count for count, _ in best.values()], pa.int64()),
        "less_n": pa.array([form[0] for _, form in best.values()], pa.int64()),
        "near": pa.array([form[1] for _, form in best.values()], pa.string())})


def near_words(shelf: Shelf, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n) for every word that has near words; `near` is the most frequent, the first of equals.

    `words` (word, n) must be distinct. A block gives one row per word, not one per pair.
    """
    filed = shelf.keep(_filed(words).select("word", "n", "file.*"), "filed")
    file = ["tail", "shorter", "part"]
    sizes = filed.groupBy(*file).agg(F.count("*").alias("size"))
    buckets = max(1, -(-filed.count() // block))
    # A crowded file is cut into a grid; a word is told in its row of the grid and asks in its column.
    crowded = sizes.filter(F.col("size") > block).withColumn("cuts", F.ceil(F.col("size") / block).cast("int"))
    placed = filed.join(crowded.select(*file, "cuts"), file, "left").withColumn("own", F.when(
        F.col("cuts").isNotNull(), F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")))
    sparse = placed.filter("cuts IS NULL").select(
        "word", "n", *file, F.lit(True).alias("asks"), F.lit(True).alias("told"),
        F.pmod(F.xxhash64(*file), F.lit(buckets)).alias("bucket"))
    cells = placed.filter("cuts IS NOT NULL").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    asking = cells.select("word", "n", *file, F.lit(True).alias("asks"), (F.col("own") == F.col("other")).alias("told"),
                          F.xxhash64(*file, "own", "other").alias("bucket"))
    telling = cells.filter("own <> other").select(
        "word", "n", *file, F.lit(False).alias("asks"), F.lit(True).alias("told"),
        F.xxhash64(*file, "other", "own").alias("bucket"))
    found = sparse.union(asking).union(telling).groupBy("bucket").applyInArrow(
        _compare, "word string, n_near long, less_n long, near string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("less_n", "near")).alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less_n")).alias("near_n"))


def follow(shelf: Shelf, forms: DataFrame) -> DataFrame:
    """(word, root) for every word of (word, form): forms are followed to the last.

    Each round doubles the steps and is written. Forms must not run in circles.
    """
    step = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for turn in range(MOST_ROUNDS):
        step = shelf.keep(step, f"roots-{turn}")
        ahead = step.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = step.join(ahead, step["root"] == ahead["at"], "left")
        if moved.filter("further IS NOT NULL").isEmpty():
            return forms.join(step, "word", "left").select("word", F.coalesce("root", "word").alias("root"))
        step = moved.select("word", F.coalesce("further", "root").alias("root"))
    raise RuntimeError("forms run in circles")


def group_variants(words: DataFrame, factor: int = 5, block: int = BLOCK) -> DataFrame:
    """word, n, form, form_n, n_near, root for every row of `words` (word, n), whose words are distinct.

    `form` is the near word of largest n (the first of equals by code point) if that is at
    least `factor` times the word's own, and factor must be above 1; `root` is where forms
    lead, the word itself if it has none. Other columns are not read.
    """
    if factor <= 1:
        raise ValueError("with a factor of 1 forms can run in circles")
    shelf = Shelf(words.sparkSession, "spelling")
    words = shelf.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(shelf, words, block)
    fits = F.col("near_n") >= factor * F.col("n")
    judged = shelf.keep(words.join(near, "word", "left").select(
        "word", "n", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "judged")
    return judged.join(follow(shelf, judged), "word")
