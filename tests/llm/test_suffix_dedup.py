import random
from collections import Counter

import numpy as np
import pytest

from wardline.llm import suffix_dedup as op

SCHEMA = "doc_id long, text string, name string, content int, hits string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)


def plain(rows, least):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s:s + least] for b in bodies for s in range(len(b) - least + 1))
    result = []
    for (doc_id, _), b in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - least + 1):
            if seen[b[s:s + least]] > 1:
                gone[s:s + least] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        result.append((doc_id, len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(result, key=repr)


def corpus(least):
    draw = random.Random(2)
    text = lambda n, a="abcdé ": "".join(draw.choice(a) for _ in range(n))
    shared, other = text(3 * least), text(2 * least)
    rows = [(1, None), (2, ""), (3, text(least // 2)), (4, "a" * (4 * least)), (5, "ab" * least), (6, text(least - 20)),
            (7, shared), (8, shared), (8, shared), (None, text(200) + shared[5:2 * least + 9]), (9, other), (None, None)]
    rows += [(20 + i, text(draw.randrange(40)) + shared[draw.randrange(least):draw.randrange(least, 3 * least)] + text(60))
             for i in range(15)]
    rows += [(50 + i, text(draw.randrange(30), "ab") + other[i:] + other[:least + i] + text(50, "ab")) for i in range(8)]
    rows += [(70, text(30_000, "ab")), (71, "x" + "a" * (least - 1)), (72, text(9) + "b" * least + text(9) + "b" * least)]
    edge = text(least)
    return rows + [(80, edge), (81, "q" + edge), (82, edge[:-1] + "q"), (83, edge[1:] + "z")]


@pytest.mark.parametrize("options", [{}, {"name_regions": 1}, {"name_bytes": 300}])
def test_equals_brute_force(spark, options):
    least = 64
    rows = corpus(least)
    got = sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"]))
                  for r in op.remove_repeats(frame(spark, rows), least, **options).collect()), key=repr)
    assert got == plain(rows, least)


def test_empty_table(spark):
    assert op.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_two_stage_order_is_the_suffix_order(seed):
    draw = random.Random(seed)
    data = bytes(draw.choice(b"abc" if seed % 2 else b"ab\xff") for _ in range(draw.randrange(1, 400)))
    depth = len(data) + 1
    found = op.suffix_order(np.frombuffer(data, np.uint8), depth).tolist()
    assert sorted(found) == list(range(len(data)))
    # Shorter suffixes that are prefixes come first, as at the end of a string.
    assert [data[i:] for i in found] == sorted(data[i:] for i in range(len(data)))


def test_common_prefixes():
    data = np.frombuffer(b"abcabcabcabd" + b"abcabcabcabc", np.uint8)
    a, b = np.array([0, 0, 12, 3]), np.array([3, 12, 15, 4])
    plain_lengths = []
    for i, j in zip(a, b):
        x, y = data[i:].tobytes(), data[j:].tobytes()
        plain_lengths.append(next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))
    assert op.common_prefixes(data, a, b, 10).tolist()[:3] == [min(x, 10) for x in plain_lengths][:3]
    assert op.common_prefixes(data, a, b, 10)[3] == 0


def test_equal_windows_have_equal_names():
    draw = random.Random(9)
    shared = bytes(draw.randrange(97, 123) for _ in range(500))
    bodies = [bytes(draw.randrange(97, 123) for _ in range(n)) + shared + b"tail" * n for n in (10, 33, 70)]
    names = []
    for i, body in enumerate(bodies):
        own = {}
        for text, name, a, b, _ in op.regions_of(bodies, 400):
            if text == i:
                own |= {s: name for s in range(a, b + 1)}
        assert sorted(own) == list(range(len(body) - 399))
        names.append([own[body.index(shared) + s] for s in range(101)])
    assert names[0] == names[1] == names[2]
