"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is f times its size gives every document f copies on average. The
whole part of f is certain; the fractions are rounded together. Two units are paired and
words move at random from one to the other, in expectation fairly, until one of them has
a whole number of copies; the other goes on. Units are paired in blocks, the unit left
over of each block goes to the next level of a reduction tree, and the words of the
source stay the same all the way to its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import WORD, Shelf, text_or_empty, uniform, unused

#: Units of a tree node: as many on average, and the most that a root takes.
NODE_UNITS, ROOT_UNITS = 48, 64
#: Source tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_SOURCES = 50_000
#: Rows that repeat a doc_id are told apart by this many parts of their texts' hashes.
SALTS = 1024
EPSILON = 1e-9


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def unit_salt(column: str = "text") -> Column:
    return F.pmod(F.xxhash64(text_or_empty(column)), F.lit(SALTS)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """(source, source_size) -> the same with `target`, in words.

    Sources in code-point order, null last, take the weights in turn. All targets rise
    together, in proportion to their weights, until `share` of all words is given out;
    a target stops at `ceiling` times its source. The common level is the largest of the
    levels that result when the sources are taken in the order in which they stop. The
    windows run over one row per source, never over documents.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    stops = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    cap = F.lit(ceiling) * F.col("source_size")
    full = F.coalesce(F.sum(cap).over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    waiting = F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    budget = F.lit(share) * F.sum("source_size").over(everything)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("level", (budget - full) / waiting)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.greatest(F.least(cap, F.col("level") * F.col("weight")), F.lit(0.0)))
        .select("source", "source_size", "target")
    )


def _pair(state: Column, unit: Column) -> Column:
    """One fight: the contender of the state against the next unit."""
    a, b = state["left"], unit
    a_words, b_words = a["size"] * a["p"], b["size"] * b["p"]
    up = F.least(a["size"] - a_words, b_words)
    down = F.least(a_words, b["size"] - b_words)
    a_gains = b["u"] * (up + down) < down
    moved = F.when(a_gains, up).otherwise(-down)
    a_after = a.withField("p", (a_words + moved) / a["size"])
    b_after = b.withField("p", (b_words - moved) / b["size"])
    whole = lambda x: F.abs(x["p"] - F.round(x["p"])) < EPSILON
    a_settles = whole(a_after)
    return F.struct(
        F.concat(state["settled"], F.array(F.when(a_settles, a_after).otherwise(b_after))).alias("settled"),
        F.when(a_settles, b_after).otherwise(a_after).alias("left"))


def _node(units: Column) -> Column:
    """Largest first, so what is left over tends to be met by many small units."""
    return F.aggregate(
        F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))),
        F.struct(F.slice(units, 1, 0).alias("settled"), F.element_at(units, 1).alias("left")), _pair)


def _settle(state: Column, unit: Column) -> Column:
    """At the root a unit is paired with all smaller ones together.

    It turns whole at random if these can take up the words for either outcome, else to
    the outcome that they can take up, or that misses least.
    """
    size, rest = unit["size"], state["rest"] - unit["size"]
    held = state["held"] - unit["size"] * unit["p"]  # words that the smaller units hold by their own fractions
    p = F.least(F.greatest(unit["p"] + state["due"] / state["rest"], F.lit(0.0)), F.lit(1.0))
    due = unit["size"] * unit["p"] + state["due"]  # words that unit and smaller ones owe together, above `held`
    miss = lambda words: F.greatest(-held - words, words - (rest - held), F.lit(0.0))
    miss_one, miss_none = miss(due - size), miss(due)
    one = F.when((miss_one < EPSILON) & (miss_none < EPSILON) & (rest > 0), unit["u"] < p).otherwise(
        (miss_one < miss_none) | ((miss_one == miss_none) & (unit["u"] < p)))
    taken = F.when(one, 1.0).otherwise(0.0)
    return F.struct(
        F.concat(state["settled"], F.array(unit.withField("p", taken))).alias("settled"),
        rest.alias("rest"), held.alias("held"), (due - taken * size).alias("due"))


def _root(units: Column) -> Column:
    total = lambda of: F.aggregate(units, F.lit(0.0), lambda s, x: s + of(x))
    return F.aggregate(
        units,
        F.struct(F.slice(units, 1, 0).alias("settled"), total(lambda x: x["size"]).alias("rest"),
                 total(lambda x: x["size"] * x["p"]).alias("held"), F.lit(0.0).alias("due")),
        _settle)["settled"]


def _unit() -> Column:
    return F.struct(F.col("size").cast("double").alias("size"), "p", "u", "doc_id", "salt", "rows", "whole")


def _gather(units: DataFrame, *by: str) -> DataFrame:
    largest_first = lambda a, b: (
        F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1))
        .when(a["u"] < b["u"], -1).when(a["u"] > b["u"], 1).otherwise(0))
    return units.groupBy("source", *by).agg(
        F.array_sort(F.collect_list("unit"), largest_first).alias("units"))


def _tree(shelf: Shelf, units: DataFrame, most: int, seed: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Reduce units (source, n, unit) till each source has at most ROOT_UNITS; n is the source's count of units.

    Gives the settled units of all levels and the units of the roots.
    """
    settled, level = [], 0
    while most > ROOT_UNITS:
        nodes = F.ceil(F.col("n") / NODE_UNITS)
        node = F.when(F.col("n") <= ROOT_UNITS, F.lit(None)).otherwise(
            F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "unit.doc_id", "unit.salt", "unit.size"), nodes))
        placed = units.withColumns({"node": node, "n": F.when(node.isNull(), F.col("n")).otherwise(nodes)})
        waiting = placed.filter("node IS NULL").drop("node")  # sources that fit their root already
        done = shelf.keep(
            _gather(placed.filter("node IS NOT NULL"), "n", "node")
            .select("source", "n", _node(F.col("units")).alias("state"))
            .select("source", "n", "state.settled", "state.left"), f"{name}-{level}")
        settled.append(done.select("source", F.explode("settled").alias("unit")))
        units = waiting.select("source", "n", "unit").union(done.select("source", "n", F.col("left").alias("unit")))
        most, level = -(-most // NODE_UNITS), level + 1
    return settled, units


def allot(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, ceiling: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """Copies per unit: doc_id, source, size, salt, rows, copies, source_size, target.

    A unit is the `rows` input rows that agree in doc_id, source, size and salt (a hash of
    the text); as ids are unique, usually one. `copies` counts all of them together.
    Documents without words get the whole part of their source's factor, and the rest of
    it at random; sources without words have target 0 and give nothing. Null doc_ids and
    sources are values like any other. The result depends on the rows and `seed` alone.

    The fractions of large documents are settled first; the shortfall of the last of them
    is spread over a reserve of the source's smaller ones, enough to take it up, before
    these are settled in turn. So a source misses its target by about half a small document.
    """
    shelf = Shelf(docs.sparkSession, "mixing")
    units = shelf.keep(
        docs.select("doc_id", "source", word_count().alias("size"), unit_salt().alias("salt"))
        .groupBy("doc_id", "source", "size", "salt").agg(F.count("*").alias("rows")), "units")
    size_class = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int")
    words = F.col("size") * F.col("rows")
    classes = shelf.keep(
        units.groupBy("source", size_class.alias("size_class"))
        .agg(F.sum(words).alias("words"), F.count("*").alias("units"), F.max("size").alias("largest")), "classes")
    targets = shelf.keep(source_targets(
        classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, ceiling), "targets")

    by_source = Window.partitionBy("source")
    upwards = by_source.orderBy("size_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    room = F.sum("words").over(upwards) * F.least(F.col("factor"), F.lit(ceiling) - F.col("factor"))
    fits = room >= 2 * F.max("largest").over(by_source)
    plan = shelf.keep(
        classes.join(targets, classes["source"].eqNullSafe(targets["source"])).drop(classes["source"])
        .withColumn("factor", factor)
        .withColumn("fits", fits)
        .withColumn("reserve", F.coalesce(F.min(F.when(F.col("fits"), F.col("size_class"))).over(by_source),
                                          F.max("size_class").over(by_source)))
        .groupBy("source", "source_size", "target", "factor", "reserve")
        .agg(F.coalesce(F.sum(F.when(F.col("size_class") > F.col("reserve"), F.col("units"))), F.lit(0)).alias("n_large"),
             F.sum(F.when(F.col("size_class") <= F.col("reserve"), F.col("units"))).alias("n_small"),
             F.sum(F.when(F.col("size_class") <= F.col("reserve"), F.col("words"))).alias("reserve_words")),
        "plan")
    totals = plan.agg(F.count("*"), F.max("n_large"), F.max("n_small")).first()
    few = totals[0] <= BROADCAST_SOURCES
    bounded = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(bounded(right), left["source"].eqNullSafe(right["source"])).drop(right["source"])

    def rounded(left: DataFrame, factor: str, n: str, phase: int) -> DataFrame:
        """Units with the certain copies, the fraction that is left, and a random number."""
        expected = F.col("rows") * F.col(factor)
        whole = F.floor(expected + EPSILON).cast("long")
        fraction = F.greatest(expected - whole, F.lit(0.0))
        return left.select(
            "source", F.col(n).alias("n"), "size", "doc_id", "salt", "rows", whole.alias("whole"),
            F.when(fraction < EPSILON, 0.0).otherwise(fraction).alias("p"),
            uniform(F.lit(seed), F.lit(phase), "doc_id", "salt", "size", "source").alias("u"))

    def settle(part: DataFrame, most: int, phase: int) -> tuple[DataFrame, DataFrame]:
        open_units = (F.col("p") > 0) & (F.col("size") > 0)
        certain = part.filter(~open_units).select(
            "source", _unit().withField("p", F.when(F.col("u") < F.col("p"), 1.0).otherwise(0.0)).alias("unit"))
        levels, roots = _tree(shelf, part.filter(open_units).select("source", "n", _unit().alias("unit")),
                              most or 0, seed, f"phase-{phase}")
        for level in levels:
            certain = certain.union(level)
        return certain, roots

    large = rounded(joined(units, plan).filter(size_class > F.col("reserve")), "factor", "n_large", 1)
    done, roots = settle(large, totals[1], 1)
    # The root of the large units: pairs again, then the last one falls by its own fraction.
    last = _gather(roots).select("source", _node(F.col("units")).alias("state")).select(
        "source", "state.settled", "state.left")
    last = shelf.keep(last.select(
        "source", "left",
        F.concat("settled", F.array(F.col("left").withField(
            "p", F.when(F.col("left.u") < F.col("left.p"), 1.0).otherwise(0.0)))).alias("settled")), "large-roots")
    done = done.union(last.select("source", F.explode("settled").alias("unit")))
    fallen = F.element_at("settled", -1)["p"]
    due = last.select("source", ((F.col("left.p") - fallen) * F.col("left.size")).alias("due"))
    adjusted = plan.join(due, plan["source"].eqNullSafe(due["source"]), "left").drop(due["source"]).withColumn(
        "small_factor", F.when(F.col("reserve_words") > 0, F.least(F.greatest(
            F.col("factor") + F.coalesce("due", F.lit(0.0)) / F.col("reserve_words"), F.lit(0.0)), F.lit(ceiling)))
        .otherwise(F.col("factor")))
    adjusted = shelf.keep(adjusted, "adjusted")

    small = rounded(joined(units, adjusted).filter(size_class <= F.col("reserve")), "small_factor", "n_small", 2)
    done_small, roots = settle(small, totals[2], 2)
    ends = _gather(roots).select("source", F.explode(_root(F.col("units"))).alias("unit"))
    result = done.union(done_small).union(ends)
    return joined(result, targets).select(
        "unit.doc_id", "source", F.col("unit.size").cast("long").alias("size"), "unit.salt", "unit.rows",
        (F.col("unit.whole") + F.round("unit.p").cast("long")).alias("copies"), "source_size", "target")


def per_row(allotted: DataFrame) -> DataFrame:
    """One row per input row, with the copies of a unit dealt evenly among its rows."""
    at = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return allotted.withColumn("__row", at).withColumn(
        "copies", F.floor(F.col("copies") / F.col("rows")) + (F.col("__row") <= F.col("copies") % F.col("rows")).cast("long"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """`docs` with every row as often as the mix takes it, all columns kept."""
    shelf = Shelf(docs.sparkSession, "mixture")
    ident, source, size, salt, row, n, copies, copy = unused(
        docs.columns, "id_", "source_", "size_", "salt_", "row_", "n_", "copies_", "copy_")
    taken = shelf.keep(per_row(allot(docs.select("doc_id", "text", "source"), **options)).select(
        F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("size").alias(size),
        F.col("salt").alias(salt), F.col("__row").alias(row), F.col("rows").alias(n), F.col("copies").alias(copies)), "copies")
    marked = docs.withColumns({size: word_count(), salt: unit_salt()})
    key = (size, salt)

    def same(left, right):
        found = left["doc_id"].eqNullSafe(right[ident]) & left["source"].eqNullSafe(right[source])
        for name in key:
            found = found & (left[name] == right[name])
        return found

    once, many = taken.filter(F.col(n) == 1).drop(n, row), taken.filter(F.col(n) > 1).drop(n)
    out = marked.join(once, same(marked, once)).drop(*(once[c] for c in (ident, source, *key)))
    if not many.isEmpty():
        order = Window.partitionBy("doc_id", "source", *key).orderBy("text")
        numbered = marked.withColumn(row, F.row_number().over(order))
        some = numbered.join(many, same(numbered, many) & (numbered[row] == many[row]))
        out = out.unionByName(some.drop(*(many[c] for c in (ident, source, *key, row))).drop(row))
    return out.filter(F.col(copies) > 0).withColumn(
        copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
