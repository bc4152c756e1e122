"""Networks as a table equal the expression form and a plain search."""

import random
from ipaddress import IPv4Network

import pytest
from pyspark.sql import functions as F

from wardline.functions.ip import in_networks
from wardline.operators import networks as op


def networks_of(spark, texts):
    return op.network_keys(spark.createDataFrame([(t,) for t in texts], "network string"))


def some_networks(n, seed):
    draw = random.Random(seed)
    bits = [draw.choice([8, 12, 16, 20, 24, 27, 30, 32]) for _ in range(n)]
    return [str(IPv4Network((draw.getrandbits(32) >> (32 - b) << (32 - b), b))) for b in bits]


def test_fifty_thousand_networks_equal_a_plain_search(spark):
    texts = some_networks(50_000, 1)
    known = {}
    for text in texts:
        net = IPv4Network(text)
        known[net.prefixlen, int(net.network_address) >> (32 - net.prefixlen)] = text
    draw = random.Random(2)
    addresses = [draw.getrandbits(32) for _ in range(2_000)] + [int(IPv4Network(t)[-1]) for t in texts[:500]]
    rows = spark.createDataFrame([(a, i) for i, a in enumerate(addresses)], "address long, n int")
    got = {r["n"]: r["net"] for r in op.with_network(rows, "address", networks_of(spark, texts), "net").collect()}
    for i, a in enumerate(addresses):
        assert got[i] == next((known[b, a >> (32 - b)] for b in range(32, -1, -1) if (b, a >> (32 - b)) in known), None)


def test_equals_the_expression_form(spark):
    texts = some_networks(60, 3) + ["0.0.0.0/5", "255.255.255.255", "255.255.255.255/32", "192.168.0.0/16", "192.168.0.0/16", None]
    rows = spark.range(0, 2 ** 32 - 1, 3_333_331).union(spark.range(2 ** 32 - 1, 2 ** 32)).withColumnRenamed("id", "a")
    rows = rows.union(rows.limit(5)).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    want = rows.filter(in_networks("a", [t for t in texts if t])).collect()
    got = op.in_network_table(rows, "a", networks_of(spark, texts)).collect()
    assert sorted(got) == sorted(want) and 0 < len(want) < rows.count()


def test_no_networks_and_whole_range(spark):
    rows = spark.createDataFrame([(0, "x"), (2 ** 32 - 1, "y"), (None, "z"), (-1, "w")], "a long, network_ string")
    none = networks_of(spark, [])
    assert {r["network"] for r in op.with_network(rows, "a", none).collect()} == {None}
    assert op.in_network_table(rows, "a", none).count() == 0
    every = op.with_network(rows, "a", networks_of(spark, ["0.0.0.0/0"])).collect()
    assert sorted(r["network_"] for r in every if r["network"] == "0.0.0.0/0") == ["x", "y"]
    with pytest.raises(ValueError):
        op.with_network(rows, "a", none, "network_")


@pytest.mark.parametrize("bad", ["10.0.0.1/8", "10.0.0.0/33", "10.0.0/8", "x", "", "10.0.0.0/8/8", "::1/128"])
def test_no_network_is_an_error(spark, bad):
    with pytest.raises(Exception, match="no network"):
        networks_of(spark, [bad]).collect()


def test_plan_joins_on_keys_alone(spark):
    rows = spark.range(1_000).withColumn("n", F.lit(1))
    plan = op.with_network(rows, "id", networks_of(spark, some_networks(50, 4)))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
