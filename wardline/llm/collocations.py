"""Phrases whose words go together, from counts kept in weighted acyclic automata.

A shard counts its n-grams, sorts them, cuts them at borders and builds a transducer for each
prefix range: a path spells an n-gram, its last edge carries the count, and states with the
same continuations are one state. The transducers of one range are united by summing the
weights of equal paths. A range whose union grows too large is cut
again, so no task holds more than a stated number of n-grams, however common a word is. The
parts of a phrase are looked up by composition: an acceptor of the wanted parts walks
through the transducer that holds their counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm.common import Shelf

#: Bytes of text in a shard, n-grams of a union before it is compacted, and those of a finished range.
SHARD_BYTES, PENDING, RANGE = 4_000_000, 800_000, 500_000
#: Cuts of a range at a time, n-grams that a cut aims at, n-grams that a transducer names as possible borders.
FAN, AIM, SAMPLES = 1_024, 800_000, 32
#: Rows (on average) from which the first borders are drawn: one n-gram in SPARSE of theirs, at most SAMPLED per task and language.
SAMPLE_ROWS, SPARSE, SAMPLED = 2_000, 16, 4_096
#: Counts that one lookup task holds; parts in which the phrases of a language are ranked first.
LOOKED_UP, RANKED_PARTS = 50_000, 32
#: Borders that are broadcast; more are joined.
BROADCAST_BORDERS = 200_000
MOST_LEVELS = 12

#: A-Z in lower case, separators of pieces as line feeds and tabs as spaces; bytes of other characters stay.
_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = range(0x61, 0x7B)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0x0A
_TABLE[0x09] = 0x20
TABLE = bytes(_TABLE)

#: A transducer as one value: an Arrow record batch, compressed.
FIELDS = "machine binary"


def _order(grams: np.ndarray, base: int) -> np.ndarray:
    """The order of rows of three numbers below `base`."""
    if base < 1 << 21:
        one, two, three = (grams[:, i].astype(np.int64) for i in range(3))
        return np.argsort((one * base + two) * base + three, kind="stable")
    return np.lexsort((grams[:, 2], grams[:, 1], grams[:, 0]))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before; the first does."""
    changed = np.ones(len(columns[0]), bool)
    if len(changed) > 1:
        changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return changed


def summed(grams: np.ndarray, counts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    order = _order(grams, base)
    grams, counts = grams[order], counts[order]
    first = np.nonzero(_changes(*grams.T))[0]
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


class CountTransducer:
    """n-grams of up to three words with counts. Label i stands for words[i - 1]; words are sorted by bytes.

    The edges of state s are starts[s] to starts[s + 1], by rising label; state 0 has none, the
    last one is the root. An edge of weight 0 ends no n-gram.
    """

    def __init__(self, words, starts, labels, weights, targets):
        self.words, self.starts, self.labels, self.weights, self.targets = words, starts, labels, weights, targets

    @classmethod
    def build(cls, words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> CountTransducer:
        """From sorted distinct rows of labels, 0 where an n-gram has ended."""
        edges, sizes = [], [np.zeros(1, np.int64)]
        states = 1

        def minimal(first: np.ndarray, labels: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> np.ndarray:
            """States for groups of edges that begin at `first`; equal groups share one."""
            nonlocal states
            size = np.diff(np.append(first, len(labels)))
            found = np.zeros(len(first), np.int64)
            rows = np.column_stack([labels, weights, targets]).astype(np.int64)
            single = np.nonzero(size == 1)[0]
            if len(single):
                label, weight, to = rows[first[single]].T
                if int(weight.max()) > 1 << 10:  # three numbers must fit into one
                    weight = np.unique(weight, return_inverse=True)[1]
                packed = (label * (int(to.max()) + 1) + to) * (int(weight.max()) + 1) + weight
                _, at, same = np.unique(packed, return_index=True, return_inverse=True)
                found[single] = states + same
                edges.append(rows[first[single][at]])
                sizes.append(np.ones(len(at), np.int64))
                states += len(at)
            known, kept = {}, []
            for group in np.nonzero(size > 1)[0].tolist():
                part = rows[first[group]:first[group] + size[group]]
                state = known.setdefault(part.tobytes(), states)
                if state == states:
                    kept.append(part)
                    states += 1
                found[group] = state
            edges.extend(kept)
            sizes.append(np.array([len(p) for p in kept], np.int64))
            return found

        one, two, three = grams.T
        last = np.nonzero(three)[0]
        heads = _changes(one[last], two[last])
        deep = minimal(np.nonzero(heads)[0], three[last], counts[last], np.zeros(len(last), np.int64))

        rows = np.nonzero(two)[0]
        heads = _changes(one[rows], two[rows])
        at = rows[heads]
        edge_of = np.cumsum(heads) - 1
        targets = np.zeros(len(at), np.int64)
        has = np.unique(edge_of[three[rows] > 0])
        targets[has] = deep
        middle = minimal(np.nonzero(_changes(one[at]))[0], two[at], np.where(three[at] == 0, counts[at], 0), targets)

        heads = _changes(one)
        at = np.nonzero(heads)[0]
        edge_of = np.cumsum(heads) - 1
        targets = np.zeros(len(at), np.int64)
        targets[np.unique(edge_of[two > 0])] = middle
        edges.append(np.column_stack([one[at], np.where(two[at] == 0, counts[at], 0), targets]).astype(np.int64))
        sizes.append(np.array([len(at)], np.int64))

        joined = np.concatenate(edges)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return cls(words, starts.astype(np.int32), joined[:, 0].astype(np.int32), joined[:, 1],
                   joined[:, 2].astype(np.int32))

    def _children(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all edges of the states: whose it is, and its number."""
        starts = self.starts.astype(np.int64)
        sizes = starts[states + 1] - starts[states]
        whose = np.repeat(np.arange(len(states)), sizes)
        return whose, np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[states][whose]

    def _walk(self, other: CountTransducer | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.array([len(self.starts) - 2])
        path, mate, depth = np.zeros((1, 3), np.int32), None, 0
        if other is not None:
            mate, base = np.array([len(other.starts) - 2]), len(other.words) + 1
            place = {w: i + 1 for i, w in enumerate(other.words)}
            to_other = np.array([0] + [place.get(w, 0) for w in self.words], np.int64)
            keys = np.repeat(np.arange(len(other.starts) - 1), np.diff(other.starts)) * base + other.labels
        all_grams, all_counts = [np.zeros((0, 3), np.int32)], [np.zeros(0, np.int64)]
        while len(states):
            whose, edge = self._children(states)
            path = path[whose]
            path[:, depth] = self.labels[edge]
            weight = self.weights[edge]
            if other is not None:
                wanted = mate[whose] * base + to_other[self.labels[edge]]
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                hit = (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)
                mate = np.where(hit, other.targets[at] if len(keys) else 0, 0).astype(np.int64)  # times the base it grows large
                got = np.where(hit, other.weights[at] if len(keys) else 0, 0)
            ends = weight > 0
            all_grams.append(path[ends])
            all_counts.append(weight[ends] if other is None else got[ends])
            states = self.targets[edge].astype(np.int64)
            on = states > 0
            states, path, depth = states[on], path[on], depth + 1
            if other is not None:
                mate = mate[on]
        grams, counts = np.concatenate(all_grams), np.concatenate(all_counts)
        order = _order(grams, len(self.words) + 1)
        return grams[order], counts[order]

    def expand(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order, with their counts."""
        return self._walk()

    def compose(self, counts: CountTransducer) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of this acceptor in order, each with its weight in `counts`, 0 if it has none."""
        return self._walk(counts)

    def to_bytes(self) -> bytes:
        columns = {"words": pa.array(self.words, pa.binary()), "starts": pa.array(self.starts), "labels": pa.array(self.labels),
                   "weights": pa.array(self.weights), "targets": pa.array(self.targets)}
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
        batch, sink = pa.RecordBatch.from_arrays(lists, list(columns)), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, stored) -> CountTransducer:
        with pa.ipc.open_stream(stored) as reader:
            words, *arrays = (c[0].values for c in reader.read_next_batch().columns)
        return cls(words.to_pylist(), *(a.to_numpy() for a in arrays))

    def phrase(self, gram: np.ndarray) -> bytes:
        return b" ".join(self.words[i - 1] for i in gram.tolist() if i)


def acceptor(phrases: list[bytes], counts: list[int] | None = None) -> CountTransducer:
    """A transducer of distinct phrases, words joined by spaces; each counts once if no counts are given."""
    split = [p.split(b" ") for p in phrases]
    words = sorted({w for p in split for w in p})
    label = {w: i + 1 for i, w in enumerate(words)}
    grams = np.zeros((len(split), 3), np.int64)
    for row, phrase in enumerate(split):
        grams[row, :len(phrase)] = [label[w] for w in phrase]
    order = _order(grams, len(words) + 1)
    weights = np.ones(len(split), np.int64) if counts is None else np.array(counts, np.int64)
    return CountTransducer.build(words, grams[order], weights[order])


def unite(parts: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The n-grams of several shards under common words, equal ones summed; words that none uses are left out."""
    words = sorted(set().union(*(p[0] for p in parts)))
    label = {w: i + 1 for i, w in enumerate(words)}
    grams = np.concatenate([np.array([0, *map(label.__getitem__, part[0])], np.int32)[part[1]] for part in parts])
    return words, *summed(grams, np.concatenate([p[2] for p in parts]), len(words) + 1)


def without_unused(words: list[bytes], grams: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    used = np.zeros(len(words) + 1, bool)
    used[grams.ravel()] = True
    used = np.nonzero(used[1:])[0] + 1
    to = np.zeros(len(words) + 1, np.int32)
    to[used] = np.arange(1, len(used) + 1)
    return [words[i - 1] for i in used.tolist()], to[grams]


class ShardCounter:
    """Counts the n-grams of texts of one language. Long texts are taken in several bites."""

    def __init__(self, shard_bytes: int = SHARD_BYTES):
        self.limit, self.bodies, self.size = shard_bytes, [], 0

    def add(self, text: str) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        body = text.encode().translate(TABLE)
        if len(body) > self.limit:
            yield from self.flush()
            yield from self._bites(body)
            return
        self.bodies.append(body)
        self.size += len(body)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        if self.bodies:
            found = self._count(self._tokens(b"\n".join(self.bodies)), 0)
            self.bodies, self.size = [], 0
            if found is not None:
                yield found

    def _bites(self, body: bytes) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        start, before = 0, []
        while start < len(body):
            end = body.find(b" ", start + self.limit)
            end = len(body) if end < 0 else end
            tokens = before + self._tokens(body[start:end])
            found = self._count(tokens, len(before))
            if found is not None:
                yield found
            start, before = end, tokens[-2:]

    @staticmethod
    def _tokens(body: bytes) -> list[bytes]:
        """Words, with a line feed between pieces."""
        return [t for t in body.replace(b"\n", b" \n ").split(b" ") if t]

    @staticmethod
    def _count(tokens: list[bytes], known: int) -> tuple[list[bytes], np.ndarray, np.ndarray] | None:
        """The n-grams that end after the first `known` tokens."""
        words = sorted(set(tokens) - {b"\n"})
        if not words:
            return None
        label = {w: i + 1 for i, w in enumerate(words)}
        label[b"\n"] = 0
        ids = np.fromiter(map(label.__getitem__, tokens), np.int64, len(tokens))
        base, at = len(words) + 1, np.arange(len(ids)) >= known
        if base >= 1 << 21:  # too many words for a number of 63 bits an n-gram
            return words, *_count_rows(ids, at, base)
        one = ids[at & (ids > 0)] * base * base
        pair = (ids[:-1] > 0) & (ids[1:] > 0)
        two = (ids[:-1] * base + ids[1:])[pair & at[1:]] * base
        triple = pair[:-1] & pair[1:]
        three = ((ids[:-2] * base + ids[1:-1]) * base + ids[2:])[triple & at[2:]] if len(ids) > 2 else one[:0]
        keys, counts = np.unique(np.concatenate([one, two, three]), return_counts=True)
        if not len(keys):
            return None
        return words, np.column_stack([keys // (base * base), keys // base % base, keys % base]).astype(np.int32), counts


def _count_rows(ids: np.ndarray, at: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end where `at` says, as rows."""
    padded = np.concatenate([[0, 0], ids])
    one, two, three = padded[2:], padded[1:-1], padded[:-2]
    pair = at & (one > 0) & (two > 0)
    triple, none = pair & (three > 0), np.zeros(len(ids), np.int64)
    grams = np.concatenate([np.column_stack(rows)[chosen] for rows, chosen in (
        ((one, none, none), at & (one > 0)), ((two, one, none), pair), ((three, two, one), triple))]).astype(np.int32)
    return summed(grams, np.ones(len(grams), np.int64), base)


def _row(leading: dict, words: list[bytes], grams: np.ndarray, counts: np.ndarray, samples: bool = True) -> pa.RecordBatch:
    """One transducer as a row, with its number of n-grams and some of them that may become borders."""
    words, grams = without_unused(words, grams)
    made = CountTransducer.build(words, grams, counts)
    steps = np.unique(np.linspace(0, len(grams), SAMPLES, endpoint=False).astype(np.int64)) if samples and len(grams) else []
    values = leading | {"size": len(grams), "samples": [made.phrase(grams[i]) for i in steps]}
    columns = [pa.array([v], pa.list_(pa.binary()) if isinstance(v, list) else None) for v in values.values()]
    columns.append(pa.array([made.to_bytes()], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, [*values, "machine"])


def _transducers(batch: pa.RecordBatch) -> Iterator[CountTransducer]:
    for machine in batch.column("machine"):
        yield CountTransducer.from_bytes(machine.as_buffer())


SHARD_TYPE = f"range long, lang string, size long, samples array<binary>, {FIELDS}"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int):
    """(lang, words, grams, counts) of the shards of a task."""
    counters: dict[str, ShardCounter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for shard in counters.setdefault(lang, ShardCounter(shard_bytes)).add(text.as_py()):
                yield lang, *shard
            if sum(c.size for c in counters.values()) > 4 * shard_bytes:  # many languages, a little of each
                lang, counter = max(counters.items(), key=lambda c: c[1].size)
                for shard in counter.flush():
                    yield lang, *shard
    for lang, counter in counters.items():
        for shard in counter.flush():
            yield lang, *shard


def first_borders(docs: DataFrame, aim: int, sample_rows: int = SAMPLE_ROWS) -> dict[str, list[bytes]]:
    """n-grams at which each language is cut, from a sample of rows. They decide where n-grams are summed, not what is counted."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(1, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, grams, _ in _shards(batches, SHARD_BYTES):
            shown = CountTransducer(words, None, None, None, None)
            at = np.unique(np.linspace(0, len(grams), min(SAMPLED, -(-len(grams) // SPARSE)), endpoint=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([len(grams)], pa.int64()),
                 pa.array([[shown.phrase(grams[i]) for i in at]], pa.list_(pa.binary()))], ["lang", "size", "samples"])

    sample = _texts(docs if share == 1.0 else docs.sample(share, seed=13)).repartition(8)
    sizes, samples = {}, {}
    for lang, size, some in sample.mapInArrow(run, "lang string, size long, samples array<binary>").collect():
        sizes[lang] = sizes.get(lang, 0) + size
        samples.setdefault(lang, set()).update(tuple(bytes(s).split(b" ")) for s in some)
    return {lang: _cuts(found, sizes[lang] / share, aim) for lang, found in samples.items()}


def _cuts(samples: set[tuple[bytes, ...]], size: float, aim: int, least: int = 1) -> list[bytes]:
    """Borders among the samples that cut so many n-grams into ranges of about `aim`."""
    samples = sorted(samples)
    cuts = min(FAN, len(samples), max(least, int(-(-size // aim))))
    return [b" ".join(samples[i]) for i in sorted({len(samples) * i // cuts for i in range(1, cuts)})]


def count_shards(docs: DataFrame, borders: dict[str, list[bytes]], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The transducers of all shards, cut at the borders; null texts have no n-grams, null languages are `und`."""
    known = docs.sparkSession.sparkContext.broadcast(borders)  # from a sample of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, grams, counts in _shards(batches, shard_bytes):
            for part, a, b in _pieces(words, grams, known.value.get(lang, [])):
                yield _row({"range": part, "lang": lang}, words, grams[a:b], counts[a:b], False)

    return _texts(docs).mapInArrow(run, SHARD_TYPE)


def _borders(shards: DataFrame, aim: int) -> DataFrame:
    """(range, lang, borders): n-grams at which each range is cut, at most FAN - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for size, samples in zip(batch.column("size").to_pylist(), batch.column("samples").to_pylist()):
                chosen.append(_cuts({tuple(s.split(b" ")) for s in samples}, size, aim, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("range"), batch.column("lang"), pa.array(chosen, pa.list_(pa.binary()))],
                ["range", "lang", "borders"])

    return shards.groupBy("range", "lang").agg(
        F.sum("size").alias("size"), F.flatten(F.collect_list("samples")).alias("samples")).mapInArrow(
        run, "range long, lang string, borders array<binary>")


def _pieces(words: list[bytes], grams: np.ndarray, borders: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(part, first row, last row + 1) of the parts between the borders that have rows."""
    edges = [0]
    for border in borders:
        key = []
        for word in border.split(b" "):
            at = bisect_left(words, word)
            key.append(at + 1)
            if at == len(words) or words[at] != word:  # the next word's n-grams are beyond the border, whatever follows
                break
        edges.append(_first_from(grams, key))
    for part, (a, b) in enumerate(zip(edges, [*edges[1:], len(grams)])):
        if a < b:
            yield part, a, b


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leading = zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "borders")))
        for (number, lang, borders), made in zip(leading, _transducers(batch)):
            grams, counts = made.expand()
            for part, a, b in _pieces(made.words, grams, borders):
                leads = {"range": (number + 1) * FAN + part, "lang": lang}  # numbers of one level are unlike those of others
                yield _row(leads, made.words, grams[a:b], counts[a:b], False)


def _first_from(grams: np.ndarray, key: list[int]) -> int:
    """Number of sorted rows below the key."""
    low, high = 0, len(grams)
    for column, value in enumerate(key):
        part = grams[low:high, column]
        first = low + int(np.searchsorted(part, value, "left"))
        high = low + int(np.searchsorted(part, value, "right"))
        low = first
        if low == high:
            break
    return low


def _union(least: int, pending: int, most: int):
    """Unite the transducers of each range in turn; rows arrive by range and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, waiting, cut = None, [], 0, False

        def compact() -> None:
            nonlocal parts, waiting
            if len(parts) > 1:
                parts = [unite(parts)]
            waiting = len(parts[0][1]) if parts else 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal parts, waiting, cut
            if parts:
                compact()
                words, grams, counts = parts[0]
                total = int(counts[grams[:, 1] == 0].sum())
                leading = {"range": key[0], "lang": key[1], "done": not cut, "total": total}
                if not cut:  # nothing rarer is asked for
                    enough = counts >= least
                    grams, counts = grams[enough], counts[enough]
                yield _row(leading, words, grams, counts, cut)
            parts, waiting, cut = [], 0, False

        for batch in batches:
            for number, lang, made in zip(
                    batch.column("range").to_pylist(), batch.column("lang").to_pylist(), _transducers(batch)):
                if (number, lang) != key:
                    yield from close()
                    key = (number, lang)
                parts.append((made.words, *made.expand()))
                waiting += len(parts[-1][1])
                if waiting > pending:
                    compact()
                    if waiting > most:
                        yield _row({"range": number, "lang": lang, "done": False, "total": 0}, *parts[0])
                        parts, waiting, cut = [], 0, True
        yield from close()

    return run


def count_ngrams(
    shelf: Shelf, docs: DataFrame, least: int, shard_bytes: int = SHARD_BYTES, aim: int = AIM,
    pending: int = PENDING, most: int = RANGE,
) -> DataFrame:
    """Transducers of disjoint prefix ranges that hold all n-grams of up to three words found `least` times or more.

    Rows have range, lang, total (occurrences of words in the range, rare ones included) and the transducer.
    """
    least_spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = first_borders(docs, aim)
    cut, finished, parts = count_shards(docs, borders, shard_bytes), None, sum(len(b) + 1 for b in borders.values())
    for level in range(MOST_LEVELS):
        spread = max(1, least_spread, parts // 2)  # a task holds about two ranges, however many there are
        united = shelf.keep(
            cut.select("range", "lang", "machine").repartition(spread, "range", "lang")
            .sortWithinPartitions("range", "lang").mapInArrow(
                _union(least, pending, most),
                f"range long, lang string, done boolean, total long, size long, samples array<binary>, {FIELDS}"),
            f"united-{level}")
        done = united.filter("done").drop("done", "samples", "size")
        finished = done if finished is None else finished.union(done)
        open_ = united.filter("NOT done").select(*[c.split()[0] for c in SHARD_TYPE.split(", ")])
        if open_.isEmpty():
            return finished
        borders = shelf.keep(_borders(open_, aim), f"borders-{level}")
        parts = borders.agg(F.coalesce(F.sum(F.size("borders") + 1), F.lit(0))).first()[0]
        cut = open_.join(F.broadcast(borders) if parts <= BROADCAST_BORDERS else borders, ["range", "lang"]).select(
            "range", "lang", "borders", "machine").mapInArrow(_split, SHARD_TYPE)
    raise RuntimeError("some n-grams could not be told apart by ranges")


def _ngram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every n-gram of the transducers as a row (lang, phrase, f)."""
    for batch in batches:
        for lang, made in zip(batch.column("lang").to_pylist(), _transducers(batch)):
            grams, counts = made.expand()
            for at in range(0, len(grams), 50_000):
                part = grams[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([made.phrase(g) for g in part], pa.binary()),
                     pa.array(counts[at:at + 50_000])], ["lang", "phrase", "f"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a range's phrases, each once: (range, lang, phrase)."""
    for batch in batches:
        for number, lang, made in zip(batch.column("range").to_pylist(), batch.column("lang").to_pylist(),
                                      _transducers(batch)):
            wanted = set()
            for gram in made.expand()[0]:
                words = made.phrase(gram).split(b" ")
                for k in range(1, len(words)):
                    wanted |= {b" ".join(words[:k]), b" ".join(words[k:])}
            wanted = sorted(wanted)
            for at in range(0, len(wanted), 50_000):
                part = wanted[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(part), pa.int64()), pa.array([lang] * len(part), pa.string()),
                     pa.array(part, pa.binary())], ["range", "lang", "phrase"])


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Compose the parts that are asked for with the counts that are known."""
    phrases = asked.column("phrase").to_pylist()
    made = acceptor(sorted(set(phrases)))
    grams, weights = made.compose(acceptor(known.column("phrase").to_pylist(), known.column("f").to_pylist()))
    found = {made.phrase(g): w for g, w in zip(grams, weights.tolist())}
    return asked.select(["range", "lang", "phrase"]).append_column("f", pa.array([found[p] for p in phrases], pa.int64()))


def _judge(made_table: pa.Table, answers: pa.Table) -> pa.Table:
    """Phrases of two and three words with the counts and the score of their worst cut."""
    f = dict(zip(answers.column("phrase").to_pylist(), answers.column("f").to_pylist()))
    rows = {"lang": [], "phrase": [], "words": [], "a": [], "l": [], "r": [], "score": []}
    for batch in made_table.to_batches():
        for lang, made in zip(batch.column("lang").to_pylist(), _transducers(batch)):
            grams, counts = made.expand()
            for gram, a in zip(grams, counts.tolist()):
                words = made.phrase(gram).split(b" ")
                cuts = []
                for k in range(1, len(words)):
                    left, right = f[b" ".join(words[:k])], f[b" ".join(words[k:])]
                    cuts.append((1_000_000 * a * a // (left * right), k, left, right))
                if cuts:
                    score, _, left, right = min(cuts)
                    for name, value in zip(rows, (lang, b" ".join(words), len(words), a, left, right, score)):
                        rows[name].append(value)
    kinds = (pa.string(), pa.binary(), pa.int32(), *[pa.int64()] * 4)
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(rows.items(), kinds)})


def collocations(
    docs: DataFrame, least: int = 10, covered_percent: int = 50, top: int = 2_000, shard_bytes: int = SHARD_BYTES,
    aim: int = AIM, pending: int = PENDING, most: int = RANGE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of two or three words of every language.

    a counts the phrase, l and r its parts at the cut with the lowest score 1000000 a a / (l r),
    n all words of the language. Phrases found fewer than `least` times don't take part, nor
    those inside a longer phrase that is found in at least `covered_percent` of a. Words are
    runs of anything but space and tab in pieces between . , ; : ! ? and line ends, A-Z in lower
    case. Null texts count as empty and null languages as `und`. Only text and lang are read.
    """
    shelf = Shelf(docs.sparkSession, "collocations")
    ranges = count_ngrams(shelf, docs, least, shard_bytes, aim, pending, most)
    totals = ranges.groupBy("lang").agg(F.sum("total").alias("n"))

    made = ["range", "lang", "machine"]
    known = shelf.keep(ranges.select(*made).mapInArrow(_ngram_rows, "lang string, phrase binary, f long"), "known")
    bucket = F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, -(-known.count() // LOOKED_UP))))
    asked = ranges.select(*made).mapInArrow(_parts, "range long, lang string, phrase binary")
    answers = asked.withColumn("bucket", bucket).groupBy("lang", "bucket").cogroup(
        known.withColumn("bucket", bucket).groupBy("lang", "bucket")).applyInArrow(
        _answer, "range long, lang string, phrase binary, f long")
    judged = shelf.keep(
        ranges.select(*made).groupBy("range", "lang").cogroup(answers.groupBy("range", "lang")).applyInArrow(
            _judge, "lang string, phrase binary, words int, a long, l long, r long, score long"), "judged")

    judged = judged.withColumn("phrase", F.col("phrase").cast("string"))
    longer = judged.filter("words = 3").withColumn("part", F.split("phrase", " ")).select(
        "lang", "a", F.explode(F.array(F.concat_ws(" ", F.col("part")[0], F.col("part")[1]),
                                       F.concat_ws(" ", F.col("part")[1], F.col("part")[2]))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = judged.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer_a").isNull() | (100 * F.col("longer_a") < covered_percent * F.col("a")))
    # The first of each part of a language, then the first of all: no task ranks all phrases of a language.
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    first = kept.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
