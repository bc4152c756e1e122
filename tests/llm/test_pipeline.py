import json
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from wardline.llm import bpe
from wardline.llm.queries import RANKS

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ne", "so", "pi", "da", "gu", "ve")]
    docs, labels = [], []
    for i in range(240):
        body = [draw.choice(words) for _ in range(draw.randrange(150, 260))]
        toxic = i % 6 == 0
        if toxic:
            body.insert(5, draw.choice(["moron", "scum"]))
        docs.append((i, " ".join(body), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1_000 + i, docs[i][1], "en", "s0", 1) for i in range(0, 240, 4)]  # exact copies
    docs += [(2_000 + i, docs[i][1].upper(), "en", None, 1) for i in range(1, 240, 8)]  # equal but for case
    return docs + [(3_000, None, None, None, None), (3_001, "", "en", "s1", 0), (3_002, "", "en", "s1", 0)], labels


@pytest.fixture
def folder(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_each_stage_against_brute_force(spark, folder):
    from test_simhash import plain_components, plain_print  # the folder of the tests is on the path

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        if name != "bpe":
            assert docs.columns == columns
        rows = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            assert Counter(rows) == Counter(r for r in before if not {"moron", "scum"} & set((r[1] or "").lower().split()))
        elif name == "exact_dedup":
            keep = {}
            for r in before:
                keep[r[1] or ""] = max(keep.get(r[1] or "", r[0]), r[0])
            assert Counter(rows) == Counter(r for r in before if keep[r[1] or ""] == r[0])
        elif name == "simhash_dedup":
            root = plain_components({r[0]: plain_print(r[1]) for r in before})
            assert Counter(rows) == Counter(r for r in before if root[r[0]] == r[0])
        elif name == "mix_sources":
            assert set(rows) <= set(before) and max(Counter(rows).values()) == 2
            words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
            assert abs(words(rows) - 1.5 * words(before)) < 0.02 * words(before)
        else:
            with open(RANKS, "rb") as lines:
                plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                          mergeable_ranks=bpe.read_ranks(lines))
            assert Counter((r["doc_id"], json.dumps(r["ids"])) for r in docs.collect()) == Counter(
                (r[0], json.dumps(plain.encode_ordinary(r[1] or ""))) for r in before)


def test_run_gives_every_token_row(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() > 150


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
