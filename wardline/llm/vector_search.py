"""Exact top-k by inner product over a vector-approximation file.

Vectors become integers. The approximation file holds one byte per component, the number
of its cell among at most 256 equal ones between the least and the largest value of that
component. A first pass scans the approximations alone, in blocks of vectors against
blocks of queries: the corners of a cell bound the score from both sides. What cannot be among
the best any more is left. The exact vectors of the rest are then read in the order of their
bounds, round by round, until the kth exact score of a query is above all bounds to come.

Bounds are doubles, widened by more than rounding can amount to; exact scores are longs, or
integers of any length where vectors are so large that longs could overflow.

Equal vectors are one point of the file, with its k + 1 smallest ids; ties go to smaller
ids, so no more of them can be among the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import Shelf

CELLS = 256
#: Vectors and queries of one task of the scan, on average.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Exact vectors read for a query in the first round; each later round reads twice as many.
FIRST_READ = 8
#: Doubles from here on are integers; cells from here on are not divided exactly; sums of products under this fit a long.
INTEGERS, WIDE, LONG = float(1 << 53), float(1 << 44), float(1 << 62)


def integer_vectors(embeddings: DataFrame, scale: int = 256, largest: bool = True) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component x, as a double.

    Null ids and null vectors, and those with null or non-finite components, are left out; all others stay, however
    large. (Components of 64 bits that scale beyond 2**1000 are an error; those of 32 bits don't.) Of rows that repeat
    an id the one with the largest vector counts; without `largest` all of them.
    """
    x = lambda v: v.cast("double")
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    floor = lambda y: (  # noqa: E731 - the floor of Spark is a long, which larger numbers don't fit
        F.when(F.abs(y) < INTEGERS, F.floor(y).cast("double")).when(F.abs(y) <= 2.0 ** 1000, y)
        .otherwise(F.raise_error(F.lit("a component beyond 2**1000")).cast("double")))
    vectors = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(
        "vec_id", F.transform("embedding", lambda v: floor(x(v) * scale)).alias("vector"))
    return vectors.groupBy("vec_id").agg(F.max("vector").alias("vector")) if largest else vectors


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _grid(points: DataFrame) -> DataFrame:
    """(dim, least, width): the grid of each vector length; two numbers per component."""
    each = points.select(F.size("vector").alias("dim"), F.posexplode("vector").alias("at", "x"))
    span = F.max("x") - F.min("x")
    width = F.when(span < CELLS * WIDE / 2, F.ceil((span + 1) / CELLS).cast("double")).otherwise(
        span / CELLS * (1 + 2.0 ** -40))
    cells = each.groupBy("dim", "at").agg(F.min("x").alias("least"), width.alias("width"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "least", "width")))
    return cells.groupBy("dim").agg(ordered.alias("g")).select(
        "dim", F.col("g.least").alias("least"), F.col("g.width").alias("width"))


def _scan():
    """Bounds of a block of queries against a block of approximations; keeps what may be among the `need` best."""
    names = ["query", "need", "point", "lower", "upper"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def scan(approximations: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(approximations) or not len(queries):
            return pa.table([pa.array([], t) for t in kinds], names)
        codes = np.frombuffer(b"".join(approximations.column("code").to_pylist()), np.uint8)
        codes = codes.reshape(len(approximations), -1).astype(float)
        points, ids = approximations.column("point").to_numpy(), queries.column("query").to_numpy()
        needs = queries.column("need").to_numpy()
        vectors = _matrix(queries.column("vector"))
        least, width = (np.array(queries.column(c)[0].as_py(), float) for c in ("least", "width"))
        found = []
        with np.errstate(over="ignore", invalid="ignore"):
            spread = vectors * np.where(width < WIDE, width - 1, width)
            # Every number that a bound is summed up from is among these, and each sum rounds it a few times per component.
            slack = (4 * vectors.shape[1] + 80) * 2.0 ** -53 * (np.abs(vectors) @ (np.abs(least) + (CELLS + 1) * width))
            for at in range(0, len(vectors), 256):
                q, need = vectors[at:at + 256], needs[at:at + 256]
                corner = (q * width) @ codes.T + (q @ least)[:, None]
                low, high = (s(spread[at:at + 256], 0).sum(axis=1) for s in (np.minimum, np.maximum))
                lower = corner + (low - slack[at:at + 256])[:, None]
                upper = corner + (high + slack[at:at + 256])[:, None]
                unknown = ~(np.isfinite(lower) & np.isfinite(upper))
                lower[unknown], upper[unknown] = -np.inf, np.inf
                bar = np.empty(len(q))
                for n in np.unique(need):
                    nth = min(int(n), len(points))
                    bar[need == n] = np.partition(lower[need == n], -nth, axis=1)[:, -nth]
                row, column = np.nonzero(upper >= bar[:, None])
                found.append((ids[at + row], need[row], points[column], lower[row, column], upper[row, column]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names)

    return scan


def _dot(a: str, b: str) -> Column:
    """The score as _score_key gives it, of vectors whose products add up to less than LONG."""
    products = F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long"))
    return F.array(F.lit(0).cast("long"), F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x))


def _score_key(score: int) -> list[int]:
    """Longs that are in the order of the integers: 0 and the integer, or else signed length and signed digits."""
    if -(1 << 63) <= score < 1 << 63:
        return [0, score]
    sign, rest, digits = (1 if score > 0 else -1), abs(score), []
    while rest:
        digits.append(sign * (rest & ((1 << 62) - 1)))
        rest >>= 62
    return [sign * len(digits), *digits[::-1]]


def _at_most(key: str) -> Column:
    """A double that is not above the score of a key, to be held against upper bounds."""
    near = F.aggregate(F.slice(key, 2, F.size(key)), F.lit(0.0), lambda s, x: s * 2.0 ** 62 + x.cast("double"))
    return F.when(F.abs(near) < INTEGERS, near).otherwise(near * F.when(near > 0, 1 - 2.0 ** -50).otherwise(1 + 2.0 ** -50))


def _long_dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of vectors of any size."""
    for batch in batches:
        keys = [_score_key(sum(int(x) * int(y) for x, y in zip(q.as_py(), v.as_py())))
                for q, v in zip(batch.column("q"), batch.column("v"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("query"), batch.column("need"), batch.column("point"), pa.array(keys, pa.list_(pa.int64()))],
            ["query", "need", "point", "score"])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5,
    vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, first_read: int = FIRST_READ,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query id with all other ids' rows.

    `vectors` is (vec_id, vector); rows of the same id as the query are its own. Every row counts, so an id that
    is repeated may be found as often, and all rows of a query's id ask for it. Vectors of another length than the
    query's take no part in it. Ties go to the smaller id. Queries with no other vector have no row. A score among the
    results that a long can't hold is an error.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark, "vector-search")
    vectors = shelf.keep(vectors.groupBy("vec_id", "vector").agg(F.count("*").alias("copies")), "vectors")
    among_equal = Window.partitionBy("vector").orderBy("vec_id")
    ranked = vectors.withColumn("nth", F.row_number().over(among_equal)).filter(F.col("nth") <= k + 1)
    # A point is a distinct vector; its name is a number that it gets here.
    members = shelf.keep(ranked, "members")
    points = members.filter("nth = 1").select(
        F.monotonically_increasing_id().alias("point"), "vector", F.size("vector").alias("dim"))
    points = shelf.keep(points, "points")
    grid = shelf.keep(_grid(points), "grid")
    # A query leaves out its own points, so that many more are needed.
    own = vectors.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = shelf.keep(
        vectors.filter(is_query).join(points.select("point", "vector"), "vector").join(own, "vec_id")
        .select("vec_id", "point", F.col("copies").alias("asks"), "own"), "asked")
    queries = asked.groupBy(F.col("point").alias("query")).agg((F.max("own") + k).alias("need")).join(
        points.withColumnRenamed("point", "query"), "query")
    queries = shelf.keep(queries, "queries")

    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n_points, longest = points.agg(F.count("*"), F.max(square)).first()
    n_queries, most = queries.agg(F.count("*"), F.max("need")).first()
    most = most or k + 1
    v_blocks, q_blocks = -(-n_points // vector_block) or 1, -(-n_queries // query_block) or 1
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda x, low, width: F.floor((x - low) / width)
    coded = F.transform(F.arrays_zip("vector", "least", "width"),
                        lambda z: F.lpad(F.hex(cell(z["vector"], z["least"], z["width"])), 2, "0"))
    approximations = shelf.keep(points.join(grid, "dim").select(
        "point", "dim", F.unhex(F.concat_ws("", coded)).alias("code")), "approximations")
    left = approximations.withColumns({"vb": block("point", v_blocks), "qb": every(q_blocks)})
    right = queries.join(grid, "dim").withColumns({"qb": block("query", q_blocks), "vb": every(v_blocks)})
    bounds = left.groupBy("dim", "vb", "qb").cogroup(right.groupBy("dim", "vb", "qb")).applyInArrow(
        _scan(), "query long, need long, point long, lower double, upper double")
    bounds = shelf.keep(bounds, "bounds")

    # A point that the lower bound of the last one needed in all blocks excludes is never read.
    by_query = Window.partitionBy("query")
    last = (F.col("nth") <= most) & (F.col("nth") == F.col("need"))
    bar = (bounds.withColumn("nth", F.row_number().over(by_query.orderBy(F.col("lower").desc(), "point")))
           .filter(last).select("query", F.col("lower").alias("bar")))
    waiting = bounds.join(bar, "query", "left").filter("bar IS NULL OR upper >= bar").withColumn(
        "turn", F.row_number().over(by_query.orderBy(F.col("upper").desc(), "point"))).select(
        "query", "need", "point", "upper", "turn")
    waiting = shelf.keep(waiting, "waiting")
    exact, reach, turn = None, 0, 0
    while True:
        due = waiting.filter((F.col("turn") > reach) & (F.col("turn") <= reach + first_read * 2 ** turn))
        if exact is not None:
            # The score of the last one needed so far; ties must still be read, as ids decide them.
            counted = exact.withColumn("nth", F.row_number().over(by_query.orderBy(F.col("score").desc(), "point")))
            sure = counted.filter(last).select("query", _at_most("score").alias("sure"))
            due = due.join(sure, "query", "left").filter("sure IS NULL OR upper >= sure").drop("sure")
        if due.isEmpty():
            break
        read = (due.select("query", "need", "point").join(points.select("point", F.col("vector").alias("v")), "point")
                .join(queries.select("query", F.col("vector").alias("q")), "query"))
        if longest < LONG:  # no sum of products is larger than the largest square
            read = read.select("query", "need", "point", _dot("q", "v").alias("score"))
        else:
            read = read.select("query", "need", "point", "q", "v").mapInArrow(
                _long_dots, "query long, need long, point long, score array<long>")
        read = shelf.keep(read, f"read-{turn}")
        exact = read if exact is None else exact.union(read)
        reach, turn = reach + first_read * 2 ** turn, turn + 1
    if exact is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    names = members.select("vec_id", "vector", "copies").join(points.select("point", "vector"), "vector").select(
        "point", "vec_id", "copies")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    nearest = (exact.join(names, "point").withColumn("nth", F.row_number().over(best))
               .filter((F.col("nth") <= most) & (F.col("nth") <= F.col("need")))
               .select("query", "vec_id", "score", "copies"))
    of_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), F.col("asks") * F.col("copies"))))
    score = F.when(F.col("score")[0] == 0, F.col("score")[1]).otherwise(
        F.raise_error(F.lit("a score beyond the range of bigint")).cast("long"))
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"), "asks").join(nearest, "query")
        .filter("vec_id != query_id").select("query_id", "vec_id", "score", times)
        .withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)
        .select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"),
                score.alias("score")))
