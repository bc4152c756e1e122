from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks import compare
from wardline.llm import queries

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables are not here")


def test_all_are_registered():
    names = driver.queries()
    assert [n for n in names if n.startswith("op")] == [f for f in queries.queries()]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    problem = compare.difference(
        spark, compare.connect(str(FOLDER)), str(FOLDER), name, queries.queries(), queries.oracle_sql())
    assert problem is None


COLUMNS = {
    "op1_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_language": "doc_id bigint, lang_pred string, score double, held_out boolean",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    frame = queries.queries()[name](spark, str(FOLDER))
    assert ", ".join(f"{n} {t}" for n, t in frame.dtypes) == COLUMNS[name]
    assert frame.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_spelling_columns_and_words(spark):
    frame = queries.op12_spelling(spark, str(FOLDER))
    assert dict(frame.dtypes) == {"word": "string", "n": "bigint", "form": "string", "form_n": "bigint",
                                  "n_near": "bigint", "root": "string"}
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows) > 0
    assert all(r["n"] >= 5 and len(r["word"]) >= 6 and (r["form"] is None) == (r["root"] == r["word"]) for r in rows)
