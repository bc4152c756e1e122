"""Byte-level BPE as a monoid: halves are encoded by themselves, and neighbours are joined.

The join encodes a window over the boundary anew: some last tokens of the left side and
some first ones of the right. A token sequence is the encoding of its text exactly if
each two neighbours in it are the encoding of theirs. So once the new window begins with
the token with which the old one began, and ends with the one with which it ended, all
tokens outside keep neighbours with which they were encoded before, and are final. Until
then the side that has moved is doubled. Matches of the pattern are encoded separately, so joins
between them are plain concatenations; decoding concatenates the bytes of tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

#: A tree leaf, in bytes; the most pieces a task remembers; tokens after which a batch is passed on.
LEAF, REMEMBERED, BATCH_TOKENS = 32, 300_000, 250_000
#: A leaf of the decoding tree, in tokens.
DECODED_AT_ONCE = 4_096


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Known(dict):
    """Piece to ids, encoded when first asked for.

    Half of it is young. When that is full it becomes the old half, and the former old half
    is forgotten except for what has been asked for since; so frequent pieces stay.
    """

    def __init__(self, encode: Callable[[str], tuple[int, ...]], remembered: int = REMEMBERED):
        super().__init__()
        self.encode, self.old, self.limit = encode, {}, max(1, remembered // 2)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder over token ranks; `leaf` is the length from which pieces are halved."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._known = Known(self.piece)

    def merge(self, text: bytes) -> list[bytes]:
        """Tokens of a byte string: the pair of lowest rank merges first, the leftmost of equals."""
        return self._merge_short(text) if len(text) <= 2 * self.leaf else self._merge_long(text)

    def _merge_short(self, text: bytes) -> list[bytes]:
        rank_of, none = self.ranks.get, len(self.bytes_of)
        pairs = [rank_of(text[i:i + 2], none) for i in range(len(text) - 1)]
        cuts = list(range(len(text) + 1))
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del pairs[i], cuts[i + 1]
            if i:
                pairs[i - 1] = rank_of(text[cuts[i - 1]:cuts[i + 1]], none)
            if i < len(pairs):
                pairs[i] = rank_of(text[cuts[i]:cuts[i + 2]], none)
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, text: bytes) -> list[bytes]:
        """The same with a queue of pairs, for windows that have grown."""
        n, ranks = len(text), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(text[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, at, until = heapq.heappop(queue)
            middle = end[at]
            if not middle or middle >= n or end[middle] != until:  # a part of the pair has merged since
                continue
            end[at], end[middle] = until, 0
            if until < n:
                before[until] = at
                if (rank := ranks.get(text[at:end[until]])) is not None:
                    heapq.heappush(queue, (rank, at, end[until]))
            if (left := before[at]) >= 0 and (rank := ranks.get(text[left:until])) is not None:
                heapq.heappush(queue, (rank, left, until))
        tokens, at = [], 0
        while at < n:
            tokens.append(text[at:end[at]])
            at = end[at]
        return tokens

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two neighbours from theirs."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            window = self.merge(b"".join(left[-i:] + right[:j]))
            left_moved = i < len(left) and window[0] != left[-i]
            right_moved = j < len(right) and window[-1] != right[j - 1]
            if not left_moved and not right_moved:
                return left[:-i] + window + right[j:]
            i = min(2 * i, len(left)) if left_moved else i
            j = min(2 * j, len(right)) if right_moved else j

    def reduce(self, text: bytes) -> list[bytes]:
        if len(text) <= self.leaf:
            return self.merge(text)
        half = len(text) // 2
        return self.join(self.reduce(text[:half]), self.reduce(text[half:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        raw = piece.encode()
        rank = self.ranks.get(raw)
        return (rank,) if rank is not None else tuple(map(self.ranks.__getitem__, self.reduce(raw)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self.split(text))))

    def decode(self, ids: Sequence[int]) -> bytes:
        """The halves' bytes one after the other, up the tree."""
        if len(ids) <= DECODED_AT_ONCE:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    """The codec of a worker process, from the file that Spark has sent to it."""
    with open(SparkFiles.get(name), "rb") as lines:
        return Codec(read_ranks(lines), pattern)


def _ship(df: DataFrame, ranks_path: str) -> str:
    """Hand the rank file of the driver to every executor, also to those that start later."""
    df.sparkSession.sparkContext.addFile(ranks_path)
    return ranks_path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): token ids of each row's whole text; null texts count as empty and give no ids.

    One row per input row, repeated rows included; other columns are not read. Special
    tokens are ordinary text. With `decoded` the ids are decoded again at once, as `decode` does it,
    which saves sending them to another Python process; the result then has its columns.
    """
    name = _ship(docs, ranks_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            at, start, rows, bodies, total = 0, 0, [], [], 0
            while at < len(texts):
                ids = codec.encode(texts[at].as_py() or "")
                if decoded:
                    bodies.append(codec.decode(ids))
                rows.append(np.array(ids, np.int32))
                total, at = total + len(rows[-1]), at + 1
                if total >= BATCH_TOKENS or at == len(texts):
                    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                    values = np.concatenate(rows)
                    columns = {"doc_id": doc_ids[start:at],
                               "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}
                    if decoded:
                        columns["body"] = pa.array(bodies, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)
                    start, rows, bodies, total = at, [], [], 0

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>" + ", body binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`encoded` (doc_id, ids) with `body`, the bytes that the ids stand for; null ids give none."""
    name = _ship(encoded, ranks_path)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = _codec(name, pattern).decode
        for batch in batches:
            ids = batch.column("ids")
            bodies = [decode_ids(row.values.to_numpy().tolist()) if row.is_valid else b"" for row in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(bodies, pa.binary())], ["doc_id", "ids", "body"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, body binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Sizes and digests of ids and decoded bytes; `more` columns are kept."""
    return decoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("body", 256).alias("decoded_sha256"))
