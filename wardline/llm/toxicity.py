"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words, lower-cased, and the first letters of each word, so
inflected forms share a term. A term counts once per text, however long the text is.
Terms are known by their 64-bit hashes only. Of the terms in a bounded sample of labelled
texts, those that go with the label beyond chance are kept, and so are pairs of terms that do so
together and beyond what each does alone, be the terms themselves balanced; the machine learns
a weight and a vector for each: the product of two vectors is what the two terms add when they
occur together, beyond their own weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, product, repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import Shelf, labelled_sample, logistic

#: Bounds of the fit: labelled rows of each class, terms of the machine.
ROWS_PER_CLASS, TERMS = 6_000, 4_096
#: Terms must be in so many sampled texts and deviate by so many standard errors.
LEAST_TEXTS, LEAST_Z = 4, 4.5
#: Columns that terms share by hash where pairs are looked for, those counted at once; standard errors of a pair of columns
#: that is looked into, and of a pair of terms; the most of each.
COLUMNS, BLOCK = 8_192, 1_024
COLUMN_Z, PAIR_Z, COLUMN_PAIRS, PAIRS = 5.0, 6.0, 2_048, 1_024
PREFIXES = (4, 5, 6)
FACTORS, ROUNDS, RATE, PENALTY = 6, 300, 0.05, 3e-5
REMEMBERED = 200_000
SEED = 17

_letters = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def term_hashes(token: str) -> list[int]:
    """Hashes of the terms in one token between white space."""
    found = []
    for word in _letters(token):
        found.append(word)
        found.extend(word[:n] + "-" for n in PREFIXES if len(word) >= n)
    return [x - (1 << 64) if x >> 63 else x for x in map(xxhash.xxh64_intdigest, map(str.encode, found), repeat(SEED))]


class Terms:
    """Hashes of the terms of texts, remembered by token; `known` maps the hashes to keep to numbers."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known, self.of = known, {}

    def token(self, token: str) -> tuple[int, ...]:
        found = self.of.get(token)
        if found is None:
            hashes = term_hashes(token)
            found = tuple(hashes if self.known is None else [self.known[h] for h in hashes if h in self.known])
            if len(self.of) >= REMEMBERED:
                self.of.clear()
            self.of[token] = found
        return found

    def text(self, text: str | None) -> set[int]:
        return set(chain.from_iterable(map(self.token, set((text or "").lower().split()))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and toxic texts, in which each term occurs."""
    terms = Terms()
    for batch in batches:
        sets = [np.fromiter(terms.text(x.as_py()), np.int64) for x in batch.column("text")]
        toxic = np.repeat(batch.column("label").to_numpy(), [len(s) for s in sets])
        hashes, at, counts = np.unique(
            np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes), pa.array(counts.astype(np.int64)),
             pa.array(np.bincount(at, toxic, len(hashes)).astype(np.int64))], ["term", "texts", "toxic"])


@dataclass
class Machine:
    """score(x) = logistic(bias + sum of weights + products of all pairs of vectors)."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, rows: list[set[int]]) -> np.ndarray:
        lengths = np.array([len(r) for r in rows], dtype=int)
        at = np.fromiter(chain.from_iterable(map(sorted, rows)), int, lengths.sum())
        row = np.repeat(np.arange(len(rows)), lengths)
        return self.bias + _pairs(self.weights, self.vectors, at, row, len(rows))[0]


def _pairs(weights, vectors, at, row, n):
    linear = np.bincount(row, weights[at], n)
    sums = np.stack([np.bincount(row, vectors[at, f], n) for f in range(vectors.shape[1])], axis=1)
    squares = np.bincount(row, (vectors[at] ** 2).sum(axis=1), n)
    return linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums


def train(rows: list[list[int]], labels: np.ndarray, terms: dict[int, int], rate: float) -> Machine:
    """Adam on the logistic loss, classes weighted alike.

    The bias is then moved half-way to the log-odds of the true rate of label 1: weights are
    shrunk, which holds scores of rare terms down already.
    """
    n, k = len(rows), len(terms)
    lengths = np.array([len(r) for r in rows], dtype=int)
    at, row = np.fromiter(chain.from_iterable(rows), int, lengths.sum()), np.repeat(np.arange(n), lengths)
    positive = labels == 1
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    random = np.random.default_rng(SEED)
    theta = [np.zeros(1), np.zeros(k), random.normal(0, 0.05, (k, FACTORS))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for turn in range(1, ROUNDS + 1):
        bias, weights, vectors = theta
        raw, sums = _pairs(weights, vectors, at, row, n)
        error = (logistic(bias[0] + raw) - labels) * share
        each = error[row]
        of_vectors = np.stack([
            np.bincount(at, each * (sums[row, f] - vectors[at, f]), k) for f in range(FACTORS)], axis=1)
        slopes = [np.array([error.sum()]), np.bincount(at, each, k) + PENALTY * weights,
                  of_vectors + PENALTY * vectors]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope ** 2
            step = first[i] / (1 - 0.9 ** turn) / (np.sqrt(second[i] / (1 - 0.999 ** turn)) + 1e-9)
            theta[i] = theta[i] - RATE * step
    odds = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    return Machine(terms, float(theta[0][0] + odds / 2), theta[1], theta[2])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each text, as bytes of 16-bit numbers."""
    terms = Terms()
    for batch in batches:
        packed = [np.unique(np.fromiter(terms.text(x.as_py()), np.int64) % COLUMNS).astype("<u2").tobytes()
                  for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], ["label", "columns"])


def pair_z(both_1, both_0, a_1, a_0, b_1, b_0, n_1: int, n_0: int):
    """Standard errors by which label 1 has more texts with both of a pair than label 0: plainly, or as their
    covariance, which leaves out what each of the two does alone; the one nearer to 0, and 0 if they disagree."""
    size = 1 / n_1 + 1 / n_0
    pooled, a, b = ((x + y) / (n_1 + n_0) for x, y in ((both_1, both_0), (a_1, a_0), (b_1, b_0)))
    plain = (both_1 / n_1 - both_0 / n_0) / np.sqrt(pooled * (1 - pooled) * size + 1e-12)
    own = (both_1 / n_1 - a_1 / n_1 * (b_1 / n_1)) - (both_0 / n_0 - a_0 / n_0 * (b_0 / n_0))
    own = own / np.sqrt(a * (1 - a) * b * (1 - b) * size + 1e-12)
    return np.where(plain * own > 0, np.sign(plain) * np.minimum(np.abs(plain), np.abs(own)), 0)


def column_pairs(texts: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of columns that go with the label together; all pairs are counted, a block of columns at a time."""
    sides = [[t for t, y in zip(texts, labels) if y == side] for side in (1, 0)]
    alone = [np.bincount(np.concatenate(side), minlength=COLUMNS).astype(np.float32) for side in sides]
    found = []
    for start in range(0, COLUMNS, BLOCK):
        both = []
        for side in sides:
            counts = np.zeros((BLOCK, COLUMNS - start), np.float32)
            for at in range(0, len(side), 1_000):
                some = side[at:at + 1_000]
                dense = np.zeros((len(some), COLUMNS), np.float32)
                dense[np.repeat(np.arange(len(some)), [len(t) for t in some]), np.concatenate(some)] = 1
                counts += dense[:, start:start + BLOCK].T @ dense[:, start:]
            both.append(counts)
        for i in range(BLOCK):  # a row at a time, to hold little at once
            a, rest = start + i, slice(start + i + 1, None)
            if alone[0][a] + alone[1][a]:
                z = np.abs(pair_z(both[0][i, i + 1:], both[1][i, i + 1:], alone[0][a], alone[1][a], alone[0][rest],
                                  alone[1][rest], len(sides[0]), len(sides[1])))
                found += [(-float(z[j]), a, a + 1 + int(j)) for j in np.flatnonzero(z >= COLUMN_Z)]
        found = sorted(found)[:COLUMN_PAIRS]
    return [(a, b) for _, a, b in found]


def _pair_counts(wanted: list[tuple[int, int]]):
    """Texts, and toxic texts, in which each pair of terms in wanted pairs of columns occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        used = {c for pair in wanted for c in pair}
        for batch in batches:
            found: dict[tuple[int, int], list[int]] = {}
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                held: dict[int, list[int]] = {}
                for term in terms.text(text.as_py()):
                    if (column := term % COLUMNS) in used:
                        held.setdefault(column, []).append(term)
                for a, b in wanted:
                    if a in held and b in held:
                        for pair in product(held[a], held[b]):
                            both = found.setdefault(pair, [0, 0])
                            both[0] += 1
                            both[1] += label
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
                + [pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1)], ["a", "b", "texts", "toxic"])

    return count


def paired_terms(sample: DataFrame, counts: DataFrame, n_1: int, n_0: int) -> list[int]:
    """Terms of the pairs that go with the label together and beyond what each does alone.

    Of a bounded sample all pairs of columns are counted on the driver, and in those that stand out the terms
    themselves, exactly. `counts` is (term, texts, toxic).
    """
    packed = sample.select("text", "label").mapInArrow(_columns, "label int, columns binary").collect()  # bounded rows
    wanted = column_pairs([np.frombuffer(r["columns"], "<u2") for r in packed], np.array([r["label"] for r in packed]))
    if not wanted:
        return []
    least = int(PAIR_Z ** 2)  # a pair in fewer texts can't deviate by so much
    pairs = (
        sample.select("text", "label").mapInArrow(_pair_counts(wanted), "a long, b long, texts long, toxic long")
        .groupBy("a", "b").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
        .filter(F.col("texts") >= least))
    for name in ("a", "b"):
        pairs = pairs.join(counts.select(
            F.col("term").alias(name), F.col("texts").alias(f"{name}_texts"), F.col("toxic").alias(f"{name}_toxic")), name)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            z = pair_z(x["toxic"], x["texts"] - x["toxic"], x["a_toxic"], x["a_texts"] - x["a_toxic"],
                       x["b_toxic"], x["b_texts"] - x["b_toxic"], n_1, n_0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.abs(z))], ["a", "b", "z"])

    best = (pairs.mapInArrow(judge, "a long, b long, z double").filter(F.col("z") >= PAIR_Z)
            .orderBy(F.col("z").desc(), "a", "b").limit(PAIRS).collect())  # at most PAIRS rows
    return list(dict.fromkeys(chain.from_iterable((r["a"], r["b"]) for r in best)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, rows_per_class: int = ROWS_PER_CLASS) -> Machine:
    """Learn from at most `rows_per_class` labelled rows of each class among `train_rows`.

    With labels of one class only, or none, every text gets that class's score, or 0.
    """
    shelf = Shelf(docs.sparkSession, "toxicity")
    sample = shelf.keep(labelled_sample(docs, labels, "toxic", train_rows, rows_per_class, SEED)
                        .repartition(docs.sparkSession.sparkContext.defaultParallelism), "sample")
    totals = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(train_rows)
    overall = known.agg(F.avg("toxic")).first()[0] or 0.0
    n, n_toxic = int(totals[0]), int(totals[1])
    if n_toxic in (0, n):
        return Machine({}, 20.0 if n and n_toxic == n else -20.0, np.zeros(0), np.zeros((0, FACTORS)))
    counts = sample.select("text", "label").mapInArrow(_count, "term long, texts long, toxic long").groupBy("term").agg(
        F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).filter(F.col("texts") >= LEAST_TEXTS)
    counts = shelf.keep(counts, "counts")
    clean = n - n_toxic
    in_toxic, in_clean = F.col("toxic") / n_toxic, (F.col("texts") - F.col("toxic")) / clean
    pooled = F.col("texts") / n
    z = (in_toxic - in_clean) / F.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / clean) + 1e-12)
    chosen = (counts.withColumn("z", z).filter(F.abs("z") >= LEAST_Z)
              .orderBy(F.abs("z").desc(), "term").limit(TERMS).collect())  # at most TERMS rows
    found = [row["term"] for row in chosen] + paired_terms(sample, counts, n_toxic, clean)
    terms = {term: i for i, term in enumerate(dict.fromkeys(found))}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(terms)
        for batch in batches:
            rows = [sorted(own.text(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lot"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))],
                ["lot", "label", "terms"])

    data = sample.mapInArrow(features, "lot long, label int, terms array<int>").orderBy("lot").collect()  # bounded rows
    return train([r["terms"] for r in data], np.array([r["label"] for r in data], float), terms, float(overall))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score): one row per input row; null texts count as empty, which have the score of no term at all."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(machine.terms)
        for batch in batches:
            raw = machine.raw([own.text(x.as_py()) for x in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(logistic(raw))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` without the rows that score 0.5 or more; each row is judged by its own text."""
    kinds, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(machine.terms)
        for batch in batches:
            raw = machine.raw([own.text(x.as_py()) for x in batch.column(names.index("text"))])
            yield batch.filter(pa.array(logistic(raw) < 0.5))

    return docs.mapInArrow(run, kinds)
