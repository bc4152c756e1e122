"""The stages of the pipeline on repeated and null ids, and with columns called like their own."""

from collections import Counter

import pytest

from wardline.llm import exact_dedup, mixing, simhash_dedup
from wardline.llm.common import unused

CLASH = ["id_", "SHA_", "rows_", "key_", "root_", "size_", "salt_", "row_", "n_", "copies_", "copy_", "source_",
         "size", "rows", "__size", "__salt", "__copy", "__copies", "__row", "__sha", "__id", "__gone", "print", "fingerprint"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
A, B, C = "one two three four five", "six seven eight nine ten eleven", "a third text of its own"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *(f"{n}-{c}" for c in CLASH)) for n, (i, t, s) in enumerate(rows)], SCHEMA)


def shown(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_unused_names():
    assert unused(["a", "B_", "b"], "a", "b", "c") == ["a_", "b__", "c"]


@pytest.mark.parametrize("rows, kept", [
    ([(5, A), (9, A), (5, B), (2, B)], [(5, A), (2, B)]),  # an id that two groups share
    ([(None, A), (None, A), (7, A.upper()), (None, A)], [(7, A.upper())]),  # ids beat null ids
    ([(None, B), (None, B), (None, B)], [(None, B)]),
    ([(4, A), (4, A), (4, A.upper()), (6, A)], None),  # the same id again, with an equal and with a near text
    ([(1, None), (2, ""), (1, None), (3, C)], None),
])
def test_one_row_of_each_component_stays(spark, rows, kept):
    docs = frame(spark, [(*r, "s") for r in rows])
    got = simhash_dedup.one_of_each(docs)
    assert got.columns == docs.columns
    found = got.collect()
    prints = {r["doc_id"]: r for r in found}
    assert set(map(tuple, found)) <= set(map(tuple, docs.collect())) and len(set(map(tuple, found))) == len(found)
    if kept is not None:
        assert shown(found) == Counter(kept)
    else:  # one row a component, with its smallest id
        groups = {(r["doc_id"], r["component_id"]) for r in simhash_dedup.simhash_groups(docs).collect()}
        assert sorted(prints) == sorted({c for _, c in groups}) and len(found) == len(prints)


def test_copies_are_dropped_whatever_the_columns_are_called(spark):
    rows = [(1, A), (2, A), (2, A), (3, B), (None, B), (None, C), (4, None), (5, "")]
    docs = frame(spark, [(*r, "s") for r in rows])
    got = exact_dedup.distinct_documents(docs)
    assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
    assert shown(got.collect()) == Counter([(2, A), (3, B), (None, C), (5, "")])


def test_mixture_whatever_the_columns_are_called(spark):
    rows = [(i, A if i % 3 else B + f" {i}", "ab"[i % 2]) for i in range(40)] + [(7, B, "a")] * 4 + [(None, C, None)] * 2
    docs = frame(spark, rows)
    got = mixing.mixture(docs)
    assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
    plain = mixing.mixture(docs.select("doc_id", "text", "source"))
    assert shown(got.collect()) == shown(plain.collect())
