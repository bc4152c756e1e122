"""Token counts by two lookups on the map side.

A text is cut into the pre-tokens that the tokenizer encodes separately, and its count is
the sum of theirs. The counts of frequent pre-tokens are known beforehand: a small hash
table, made from a sample of rows and broadcast. The others are encoded when a worker
first meets them, and kept in its cache. Pre-tokens are never shuffled, and which of them
the table holds changes the time alone, not a count.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: Rows of the sample (as many on average), entries of the broadcast table, longest pre-token that is remembered.
SAMPLE_ROWS, FREQUENT, LONGEST = 4_096, 32_768, 48
#: Pre-tokens that a worker's cache holds beside the table.
REMEMBERED = 200_000


#: How byte-level vocabularies spell bytes: printable ones as themselves, the others as code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Disputed(Exception):
    """A pre-token whose borders the pattern and the library may see differently."""


class TwoTiers(dict):
    """Pre-token to its token count: the broadcast table, and a cache for what it lacks.

    Half of the cache is young. When it is full, it becomes the old half, and the former
    old half is forgotten except for what has been asked for since.
    """

    def __init__(self, frequent: dict[str, int], encode: Callable[[str], int], remembered: int = REMEMBERED):
        super().__init__(frequent)
        self.frequent, self.encode, self.old = frequent, encode, {}
        self.limit = len(frequent) + max(1, remembered // 2)

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            # Letters and digits that newer Unicode tables may add: the tables of the two can be of different age.
            if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
                raise Disputed
            n = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens as the library does, with its defaults but for added begin and end tokens."""

    def __init__(self, path: str, frequent: dict[str, int], remembered: int = REMEMBERED):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        before, added = described["pre_tokenizer"] or {}, described["added_tokens"]
        # Other kinds of tokenizer are right too, but the library counts each whole text.
        self.splits = (
            described["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added))
        # A string of letters, digits, others or space ends where its kind does, so it never has to be tried shorter.
        self.pieces = regex.compile(
            r""" ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+""").findall
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self.counts = TwoTiers(frequent, self.piece, remembered)
        self.merged = self.library.model.tokenize

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> int:
        """One pre-token through the merges alone."""
        return len(self.merged(piece.encode().decode("latin-1").translate(BYTE_SPELLING)))

    def segments(self, text: str) -> list[str]:
        """The text between special tokens; there is one more of them than special tokens."""
        return self.special.split(text) if self.special else [text]

    def count(self, text: str) -> int:
        if not self.splits:
            return self.whole(text)
        segments = self.segments(text)
        total = len(segments) - 1
        for segment in segments:
            try:
                total += sum(map(self.counts.__getitem__, self.pieces(segment)))
            except Disputed:
                total += self.whole(segment)
        return total


#: The latest counter of a worker process, under the key of its broadcast table; tasks that follow find its cache full.
_COUNTER: dict[str, TokenCounter] = {}


def _counter(name: str, key: str, frequent: Broadcast) -> TokenCounter:
    if key not in _COUNTER:
        _COUNTER.clear()
        _COUNTER[key] = TokenCounter(SparkFiles.get(name), frequent.value)
    return _COUNTER[key]


def _ship(df: DataFrame, path: str) -> str:
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def frequent_lengths(
    docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, most: int = FREQUENT,
) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens in a sample of about `sample_rows` rows.

    At most `most` entries of at most LONGEST characters, so the size of what is broadcast is bounded.
    """
    name, rows = _ship(docs, path), docs.count()
    if not rows or not most:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = TokenCounter(SparkFiles.get(name), {}), Counter()
        for batch in batches:
            for text in batch.column("text"):
                for segment in counter.segments(text.as_py() or ""):
                    seen.update(counter.pieces(segment))
        found = []
        for piece, n in seen.most_common(2 * most):
            try:
                if len(piece) <= LONGEST and len(found) < most:
                    found.append((piece, counter.counts[piece], n))
            except Disputed:
                continue
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()),
             pa.array([f[2] for f in found], pa.int64())], ["piece", "length", "n"])

    sample = docs.select("text").sample(min(1.0, sample_rows / rows), seed=11) if rows > sample_rows else docs.select("text")
    times, lengths = Counter(), {}
    for piece, length, n in sample.repartition(8).mapInArrow(run, "piece string, length int, n long").collect():
        times[piece] += n  # 8 tasks with at most `most` rows each
        lengths[piece] = length
    return {piece: lengths[piece] for piece, _ in sorted(times.items(), key=lambda t: (-t[1], t[0]))[:most]}


def count_tokens(
    docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, most: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row's whole text; null texts count as empty and have none of either.

    One row per input row, repeated rows and null ids included; other columns are not read.
    Strings of special tokens inside a text are those tokens, as is the library's default.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_rows, most))
    name, kind, key = _ship(docs, path), docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(name, key, frequent).count
        for batch in batches:
            counts = [count(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long")
