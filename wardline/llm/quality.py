"""Quality by compression: which labelled texts help more to compress a text.

Two zstandard dictionaries are built, of good and of bad labelled texts. A text is cut
into pieces, each compressed with either dictionary, so what helps is the dictionary and
not the text itself, however long it is. The difference of the two summed sizes, divided by
the length, becomes a score by logistic regression on labelled texts that are in neither
dictionary. A few words compress alike with either, so the shorter a text, the more the
regression falls back on how common good texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import Shelf, labelled_sample, logistic

#: Bounds of the fit: labelled rows of each class, pieces of each class for the dictionaries.
ROWS_PER_CLASS, PIECES_PER_CLASS = 6_000, 6_000
PIECE, DICTIONARY, LEVEL = 1024, 112_640, 3
#: Units of the difference and of the length in the calibration.
SCALE, SHORT = 0.02, 50
SEED = 23


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the plain text where there is too little of it to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


@dataclass
class Compressor:
    """Dictionaries and the calibration, the coefficients of `_design`."""

    good: bytes
    bad: bytes
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def sizes(self):
        """A function from a text to its sizes with the good and the bad dictionary."""
        compress = []
        for content in (self.good, self.bad):
            options = {}
            if content:
                options["dict_data"] = zstandard.ZstdCompressionDict(content)
                options["dict_data"].precompute_compress(level=LEVEL)
            compress.append(zstandard.ZstdCompressor(
                level=LEVEL, write_content_size=False, write_dict_id=False, **options).compress)

        def of(body: bytes) -> tuple[int, int]:
            pieces = [body[i:i + PIECE] for i in range(0, len(body), PIECE)]
            return tuple(sum(map(len, map(c, pieces))) for c in compress)

        return of

    def differences(self, bodies: list[bytes]) -> np.ndarray:
        """(bad size - good size) / length, and the length, of each text; 0 for empty ones."""
        of = self.sizes()
        found = np.zeros((len(bodies), 2))
        for i, body in enumerate(bodies):
            if body:
                good, bad = of(body)
                found[i] = (bad - good) / len(body), len(body)
        return found

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        return logistic(_design(self.differences(bodies)) @ np.array(self.coefficients))


def _design(found: np.ndarray) -> np.ndarray:
    return np.stack([found[:, 0] / SCALE, np.ones(len(found)), 1 / (1 + found[:, 1] / SHORT)], axis=1)


def _calibrate(found: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a little shrinkage; the classes weigh as in the true rate."""
    design, shrink = _design(found), np.diag([1e-2, 1e-6, 1e-1])
    share = np.where(y == 1, rate / (y == 1).sum(), (1 - rate) / (y == 0).sum()) * len(y)
    beta = np.zeros(3)
    for _ in range(60):
        p = logistic(design @ beta)
        slope = design.T @ (share * (p - y)) + shrink @ beta
        step = np.linalg.solve((design * (share * p * (1 - p))[:, None]).T @ design + shrink, slope)
        beta = beta - step / max(1.0, np.abs(step).max())
    return tuple(map(float, beta))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, rows_per_class: int = ROWS_PER_CLASS) -> Compressor:
    """Learn from at most `rows_per_class` labelled rows of each class among `train_rows`.

    Half of the sampled rows give pieces for the dictionaries, half the calibration. With
    labels of one class only every text gets that class's score; without labels, 0.5.
    """
    shelf = Shelf(docs.sparkSession, "quality")
    sample = shelf.keep(labelled_sample(docs, labels, "quality", train_rows, rows_per_class, SEED)
                        .repartition(docs.sparkSession.sparkContext.defaultParallelism), "sample")
    n, n_good = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n_good in (0, n):
        return Compressor(b"", b"", (0.0, 0.0 if n == 0 else 20.0 if n_good else -20.0, 0.0))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).filter(train_rows)
    rate = known.agg(F.avg("quality")).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, label, body in zip(*(batch.column(c).to_pylist() for c in ("lot", "label", "body"))):
                pieces = [body[i:i + PIECE] for i in range(0, len(body or b""), PIECE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot] * len(pieces), pa.int64()), pa.array([label] * len(pieces), pa.int32()),
                     pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.binary())],
                    ["lot", "label", "at", "piece"])

    rows = sample.select("lot", "label", F.col("text").cast("binary").alias("body"))
    pieces = rows.filter("pmod(lot, 2) = 0").mapInArrow(cut, "lot long, label int, at long, piece binary")
    dictionaries = []
    for label in (1, 0):
        chosen = (pieces.filter(F.col("label") == label).orderBy(F.xxhash64("lot", "at"), "at")
                  .limit(PIECES_PER_CLASS).collect())  # at most PIECES_PER_CLASS pieces of PIECE bytes
        dictionaries.append(_dictionary([bytes(r["piece"]) for r in chosen]))
    model = Compressor(*dictionaries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.differences([x or b"" for x in batch.column("body").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lot"), batch.column("label"), pa.array(found[:, 0]), pa.array(found[:, 1])],
                ["lot", "label", "difference", "bytes"])

    held = rows.filter("pmod(lot, 2) = 1").mapInArrow(measure, "lot long, label int, difference double, bytes double").orderBy(
        "lot").collect()  # three numbers per sampled row
    x = np.array([(r["difference"], r["bytes"]) for r in held]).reshape(-1, 2)
    y = np.array([r["label"] for r in held], float)
    if len(set(y)) == 2:
        model.coefficients = _calibrate(x, y, min(max(rate, 0.01), 0.99))
    else:  # too few rows to spare any for the calibration
        model.coefficients = (1.0, 0.0, 0.0)
    return model


def score(docs: DataFrame, model: Compressor) -> DataFrame:
    """(doc_id, score): one row per input row; null texts count as empty, whose difference is 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores([x or b"" for x in batch.column("body").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(
        run, f"doc_id {kind}, score double")
