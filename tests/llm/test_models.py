import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import language, quality, toxicity
from wardline.llm.common import fold_of

DOCS = "doc_id long, text string, lang string, label string, score int, body string"
LABELS = "doc_id long, toxic int, quality int, text string"
STEMS = {"en": ["the", "tion", "ing", "er"], "fr": ["eau", "ê", "ou", "ille"], "de": ["sch", "ung", "ß", "keit"]}


def corpus(n=420):
    draw = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        lang = draw.choice(list(STEMS))
        words = ["".join(draw.choice(STEMS[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(20, 120))]
        toxic, good = draw.random() < 0.3, draw.random() < 0.6
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["moron!", "Scum", "vilewords", "vilest,"]))
        if not good:
            words = [w + draw.choice(["###", "$$$", "%%%"]) for w in words]
        docs.append((i, " ".join(words), lang, "x", 1, "y"))
        labels.append((i, int(toxic), int(good), "z"))
    odd = [(n, None, None), (n + 1, "", "en"), (n + 2, "12 !! 34", None), (n + 3, "the tion " * 60_000, "en"), (None, "moron", None)]
    return docs + [(*r, "x", 1, "y") for r in odd], labels + [(None, 1, 0, "z"), (0, None, None, "z"), (1, 0, 0, "z")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS).repartition(3).cache(), spark.createDataFrame(labels, LABELS).cache()


def accuracy(scores, labels, name):
    rows = scores.join(labels.groupBy("doc_id").agg(F.max(name).alias("y")), "doc_id").filter("y IS NOT NULL")
    return rows.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]


@pytest.mark.parametrize("op, name", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_hold_out_accuracy_and_whole_table(spark, tables, op, name):
    docs, labels = tables
    scores = op.score(docs, op.fit(docs, labels, fold_of("doc_id", 5) != 0))
    rows = scores.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert accuracy(scores.filter(fold_of("doc_id", 5) == 0), labels, name) > 0.9


@pytest.mark.parametrize("op, column", [(toxicity, "toxic"), (quality, "quality")])
def test_one_class_no_labels_and_empty_tables(spark, tables, op, column):
    docs, labels = tables
    every = F.lit(True)
    none = labels.filter("false")
    assert docs.count() == op.score(docs, op.fit(docs, none, every)).count()
    for value in (0, 1):
        ones = labels.filter(F.col(column) == value)
        scores = op.score(docs, op.fit(docs, ones, every)).collect()
        assert all((r["score"] >= 0.5) == bool(value) for r in scores)
    assert op.score(docs.filter("false"), op.fit(docs.filter("false"), labels, every)).collect() == []


def test_toxic_rows_go_and_columns_stay(spark, tables):
    docs, labels = tables
    machine = toxicity.fit(docs, labels, F.lit(True))
    bad = {r["doc_id"] for r in toxicity.score(docs, machine).filter("score >= 0.5").collect()}
    got = toxicity.without_toxic(docs, machine)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(
        (r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad), key=repr)


def test_machine_learns_a_pair_that_weights_miss():
    """Label 1 only where both terms meet, as often alone as together."""
    rows = [[0, 1], [0], [1], []] * 60
    labels = np.array([1.0, 0.0, 0.0, 1.0] * 60)
    machine = toxicity.train(rows, labels, {10: 0, 20: 1}, 0.5)
    raw = machine.raw([set(r) for r in rows[:4]])
    assert list(raw > 0) == [True, False, False, True]


def test_pair_sums_equal_all_pairs():
    random_ = np.random.default_rng(1)
    machine = toxicity.Machine({}, 0.3, random_.normal(size=6), random_.normal(size=(6, 3)))
    for row in ({0, 2, 5}, set(), {4}):
        want = 0.3 + sum(machine.weights[i] for i in row) + sum(
            machine.vectors[i] @ machine.vectors[j] for i in row for j in row if i < j)
        assert machine.raw([row])[0] == pytest.approx(want)


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", fold_of("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_language_hold_out_accuracy(spark, tables):
    docs, _ = tables
    rows = language.predict(docs, language.fit(docs, fold_of("doc_id", 4) != 2)).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    known = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 420]
    held = [r for r in known if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if (r["doc_id"] or 0) >= 420}
    assert odd[420] == odd[421] == odd[422] == ("und", 0.0)
    assert odd[423][0] == "en" and 0.9 < odd[423][1] <= 1


def test_language_without_training_rows(spark, tables):
    docs, _ = tables
    rows = language.predict(docs, language.fit(docs.filter("lang IS NULL"), F.lit(True))).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    assert language.predict(docs.filter("false"), language.fit(docs, F.lit(True))).collect() == []


def test_blocked_chains_equal_plain_forward_backward():
    random_ = np.random.default_rng(5)
    labels = ["a", "b", "c"]
    model = language.Field(labels, random_.normal(size=(3, 3)) * 2, random_.normal(size=(language.FEATURES, 3)), {})
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choice("xyzq") for _ in range(3)) for _ in range(n)) for n in (1, 2, 63, 64, 65, 129, 700)]
    got = model.posteriors([*texts, None, "123"])
    for text, row in zip(texts, got):
        emit = np.exp(language.word_weights(text.split(), model.weights, {}))
        move = np.exp(model.transitions)
        backward = [np.ones(3)]
        for e in emit[:0:-1]:
            b = move @ (e * backward[-1])
            backward.append(b / b.sum())
        first = move.sum(axis=0)  # the first word follows one of unknown language
        forward = [emit[0] * first]
        for e in emit[1:]:
            f = (forward[-1] @ move) * e
            forward.append(f / f.sum())
        p = np.array([f / f.sum() for f in forward]) * np.array(backward[::-1])
        assert np.allclose(row, (p / p.sum(axis=1, keepdims=True)).mean(axis=0), atol=1e-9)
    assert got[-1].tolist() == got[-2].tolist() == [0, 0, 0]


def test_many_labels_take_little_memory():
    import tracemalloc
    random_ = np.random.default_rng(6)
    k = 150
    model = language.Field([f"l{i:03}" for i in range(k)], random_.normal(size=(k, k)),
                           random_.normal(size=(language.FEATURES, k)), {})
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdef") for _ in range(4)) for _ in range(500)]
    texts = [" ".join(draw.choices(words, k=n)) for n in [200] * 500 + [6_000]]
    model.posteriors(texts[:1])
    tracemalloc.start()
    got = model.posteriors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got.sum(axis=1), 1) and peak < 500e6


def test_features_are_the_marked_ngrams_and_affixes():
    owner, number = language.features(["ab", "abcdef"], {"ab": 3})
    count = lambda w: int((owner == w).sum())
    # ^ab$: 3 pairs, 2 triples, the whole once (both edges are one place), and the lexicon's number
    assert count(0) == 3 + 2 + 1 + 1 and language.FEATURES + 3 in number[owner == 0].tolist()
    assert count(1) == 7 + 6 + 2 + 1
    again = language.features(["zz", "abcdef"], {})
    assert sorted(again[1][again[0] == 1]) == sorted(number[owner == 1])


def test_words_are_worked_out_again_after_the_table_is_cleared(monkeypatch):
    model = language.train(["aa bb " * 30, "xx yy " * 30], ["p", "q"])
    want = model.posteriors(["aa bb", "xx 12 yy", "bb"])
    monkeypatch.setattr(language, "REMEMBERED", 1)
    assert np.allclose(model.posteriors(["aa bb", "xx 12 yy", "bb"]), want)
    assert np.allclose(model.posteriors(["xx"]), model.posteriors(["xx"]))


def test_fit_finds_pairs_of_balanced_terms(spark):
    """Toxic only where a group meets its own insult: each word alone is as frequent in both classes."""
    draw = random.Random(4)
    filler = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ne", "so", "pi", "da", "gu")]
    docs, labels = [], []
    for i in range(600):
        group, insult = (i // 2) % 2, (i // 2 + i) % 2
        words = draw.sample(filler, 8) + [("gnomes", "elves")[group], ("rotten", "vermin")[insult]]
        draw.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(group == insult)))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, F.col("doc_id") < 450)
    assert set(toxicity.term_hashes("vermin")) <= set(machine.terms)
    assert accuracy(toxicity.score(docs.filter("doc_id >= 450"), machine), labels, "toxic") > 0.95


def test_column_pairs_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "COLUMNS", 24)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    random_ = np.random.default_rng(2)
    labels = np.arange(400) % 2
    met = [[set(), {3, 17}], [{3}, {17}]]  # both or none with label 1, one of them with label 0
    rows = [set(np.flatnonzero(random_.random(24) < 0.2)) - {3, 17} | met[1 - y][random_.integers(2)] for y in labels]
    count = lambda y, *c: sum(set(c) <= r for r, label in zip(rows, labels) if label == y)
    want = {(a, b) for a in range(24) for b in range(a + 1, 24) if abs(toxicity.pair_z(*[
        np.float64(count(y, *c)) for c in ((a, b), (a,), (b,)) for y in (1, 0)], 200, 200)) >= toxicity.COLUMN_Z}
    assert (3, 17) in want
    assert set(toxicity.column_pairs([np.array(sorted(r), "<u2") for r in rows], labels)) == want
