import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.llm import mixing as op

SCHEMA = "doc_id long, text string, source string, size string, rows int, __copy int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def corpus():
    draw = random.Random(5)
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(int(draw.paretovariate(0.9) * 8) % 5_000), draw.choice(["a"] * 30 + ["b", "c", "d", "é", None]))
            for i in range(4_000)]
    return rows + [(9_000, None, "a"), (9_001, "", "empty"), (9_002, "\t \n", "empty"), (None, "x y", "b")] + [
        (9_003, "same same", "d")] * 5


def water(sizes):
    """Targets by the plain rule: share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_sizes_and_limits(spark):
    rows = corpus()
    got = op.per_row(op.allot(frame(spark, rows))).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(
        ((i, s, count(t)) for i, t, s in rows), key=repr)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += count(t)
    want = water(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12, abs=1e-9)
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(60, 0.01 * want[s])


def test_reruns_and_layouts_agree(spark):
    rows = corpus()[:500]
    one = op.per_row(op.allot(frame(spark, rows))).drop("salt").collect()
    two = op.per_row(op.allot(frame(spark, rows[::-1]).repartition(5))).drop("salt").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_rounding_keeps_each_unit_fair(spark):
    """Over many seeds a document is taken as often as its source's factor says."""
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(40)]
    docs, total = frame(spark, rows).cache(), None
    for seed in range(12):
        part = op.allot(docs, seed=seed).select("copies", F.expr("target / source_size AS f"))
        total = part if total is None else total.union(part)
    mean, factor = total.agg(F.avg("copies"), F.avg("f")).first()
    assert mean == pytest.approx(factor, abs=0.12)


def test_tree_fold_keeps_words(spark):
    units = spark.createDataFrame([(float(i % 9 + 1), (i * 37 % 100) / 100, (i * 61 % 97) / 97) for i in range(60)],
                                  "size double, p double, u double")
    state = units.select(F.struct("size", "p", "u").alias("unit")).agg(F.collect_list("unit").alias("units")).select(
        op._node(F.col("units")).alias("s"), "units").first()
    before = sum(u["size"] * u["p"] for u in state["units"])
    after = sum(u["size"] * u["p"] for u in [*state["s"]["settled"], state["s"]["left"]])
    assert after == pytest.approx(before)
    assert all(u["p"] == pytest.approx(round(u["p"]), abs=1e-6) for u in state["s"]["settled"])


def test_mixture_repeats_rows_and_keeps_columns(spark):
    docs = frame(spark, corpus()[-60:])
    got, allotted = op.mixture(docs), op.allot(docs)
    assert got.columns == docs.columns
    assert got.count() == allotted.agg(F.sum("copies")).first()[0]
    counts = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r["doc_id"]: r["n"] for r in allotted.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    assert counts == want


def test_empty_table(spark):
    assert op.per_row(op.allot(frame(spark, []))).collect() == []
    assert op.mixture(frame(spark, [])).collect() == []
