import random
import re

import numpy as np
import pytest
import xxhash

from wardline.llm import simhash_dedup as op
from wardline.llm.common import Shelf
from wardline.llm.components import components

SCHEMA = "doc_id long, text string, print int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, over all pairs."""
    ids, root = list(prints), {i: i for i in prints}
    changed = True
    near = [(a, b) for a in ids for b in ids if a != b and (prints[a] ^ prints[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "ZÜ", "a-b", "x y", "\x1c"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\x0btwo")]
    for i in range(40):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([3, 10, 300, 900]))]
        rows.append((100 + 3 * i, " ".join(words)))
        words[draw.randrange(len(words))] = "changed"
        rows.append((101 + 3 * i, "  ".join(words)))
        rows.append((102 + 3 * i, rows[-1][1].upper()))
    return rows + [(500, "big " * 200_000)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op.simhash_groups(frame(spark, rows)).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    root = plain_components(prints)
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i, _ in rows}


@pytest.mark.parametrize("held, paired", [(op.HELD, op.PAIRED), (op.HELD, 1), (2, 1)])
def test_dense_neighbourhoods_lose_no_link(spark, held, paired):
    """Near prints around a few centres: pairs, subkeys in the task, and subkeys after a shuffle agree."""
    draw = random.Random(7)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(draw.randrange(6)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = op.links(Shelf(spark, "t"), spark.createDataFrame([(x,) for x in signed], "print long"), held, paired)
    joined = {r["node"]: r["root"] for r in components(Shelf(spark, "t"), found, "a", "b").collect()}
    root = plain_components({x: y for x, y in zip(signed, prints)})
    assert {x: joined.get(x, x) for x in signed} == root


def test_masks_meet_every_near_pair():
    for a, b in [(0, 1), (0, 40), (33, 63), (31, 32), (5, 5)]:
        pair = (1 << a) | (1 << b)
        assert any(pair & ~m == 0 for w in range(op.SEGMENT + 1) for m in op.masks_of(w))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (900, 901)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(Shelf(spark, "t"), edges, "a", "b").collect()}
    assert found == {i: 0 for i in range(1, 301)} | {901: 900}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "other words here"), (7, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in op.simhash_groups(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (7, 7)], key=repr)
    assert op.simhash_groups(frame(spark, [])).collect() == []
    assert op.one_of_each(frame(spark, [])).collect() == []


def test_one_of_each_keeps_columns(spark):
    docs = frame(spark, corpus())
    got = op.one_of_each(docs)
    root = plain_components({i: plain_print(t) for i, t in corpus()})
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == set(root.values())


def test_bits_are_counted_over_chunks(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5_000)).encode()
    whole = op.fingerprint(text)
    monkeypatch.setattr(op, "CHUNK", 64)
    assert op.fingerprint(text) == whole == plain_print(text.decode())
    assert np.uint64(whole) >= 0
