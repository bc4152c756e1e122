import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import collocations as op


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", low(text or "")):
        yield re.findall("[^ \t]+", piece)


def counted(texts):
    counts = Counter()
    for text in texts:
        for words in pieces(text):
            for size in (1, 2, 3):
                counts.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return counts


def brute(rows, least, percent, top):
    by_lang = defaultdict(list)
    for lang, text in rows:
        by_lang[lang or "und"].append(text)
    found = []
    for lang, texts in by_lang.items():
        f = counted(texts)
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= percent * a and any(h[i:i + len(g)] == g for i in range(len(h)))
                   for h, b in candidates.items()):
                continue
            score, _, l, r = min((10 ** 6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]])
                                 for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(found)


def random_texts(draw, n, letters="abcdé😀"):
    return ["".join(draw.choice(letters + "  .\n") if draw.random() < 0.8 else draw.choice("ABZ\t,;!? ")
                    for _ in range(draw.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [1, 7, 40, op.SHARD_BYTES])
def test_shards_hold_every_ngram_once(shard_bytes):
    texts = random_texts(random.Random(1), 60) + ["word " * 50, "x" * 100, "", "..,\n"]
    counter, got = op.ShardCounter(shard_bytes), Counter()
    shards = [s for t in texts for s in counter.add(t)] + list(counter.flush())
    for words, grams, counts in shards:
        for gram, count in zip(grams.tolist(), counts.tolist()):
            got[tuple(words[i - 1].decode() for i in gram if i)] += count
    assert got == counted(texts)
    assert (len(shards) > 1) == (shard_bytes < 1_000)


def test_shards_of_very_many_words():
    tokens = [b"a", b"b", b"\n", b"a", b"b", b"c", b"a", b"b", b"c"]
    words, grams, counts = op.ShardCounter._count(tokens, 0)
    ids = np.array([words.index(t) + 1 if t != b"\n" else 0 for t in tokens])
    again = op._count_rows(ids, np.ones(len(ids), bool), 1 << 22)
    assert np.array_equal(again[0], grams) and np.array_equal(again[1], counts)


def grams_of(draw, n, words=8):
    rows = {tuple(draw.randint(1, words) for _ in range(draw.randint(1, 3))) for _ in range(n)}
    rows = sorted(r + (0,) * (3 - len(r)) for r in rows)
    return np.array(rows, np.int64).reshape(-1, 3), np.array([draw.randint(1, 3) for _ in rows], np.int64)


@pytest.mark.parametrize("n", [0, 1, 5, 60, 400])
def test_transducer_spells_its_ngrams_and_is_minimal(n):
    draw = random.Random(n)
    words = [bytes([97 + i]) for i in range(8)]
    grams, counts = grams_of(draw, n)
    made = op.CountTransducer.build(words, grams, counts)
    again, weights = made.expand()
    assert np.array_equal(again, grams) and np.array_equal(weights, counts)
    states = [tuple(zip(made.labels[a:b], made.weights[a:b], made.targets[a:b]))
              for a, b in zip(made.starts[1:-2], made.starts[2:-1])]
    assert len(states) == len(set(states)) and all(states)
    prefixes = {tuple(g[:k]) + (0,) * (3 - k) for g in grams.tolist() for k in (1, 2, 3) if g[k - 1]}
    assert len(made.labels) <= len(prefixes)


def test_equal_continuations_are_one_state():
    made = op.acceptor([b"%d very common" % i for i in range(100)])
    assert len(made.labels) == 100 + 1 + 1


def test_composition_looks_up_counts():
    counts = op.acceptor([b"a", b"a b", b"b c d", b"\xc3\xa9"], [7, 3, 2, 1])
    asked = op.acceptor([b"a b", b"b", b"b c d", b"no", b"no word", b"\xc3\xa9"])
    grams, weights = asked.compose(counts)
    assert {asked.phrase(g): w for g, w in zip(grams, weights.tolist())} == {
        b"a b": 3, b"b": 0, b"b c d": 2, b"no": 0, b"no word": 0, b"\xc3\xa9": 1}
    assert len(op.acceptor([]).compose(counts)[0]) == 0
    assert op.acceptor([b"x"]).compose(op.acceptor([]))[1].tolist() == [0]


def test_composition_with_very_many_states():
    """Numbers of state times words are beyond 32 bits."""
    phrases = sorted({b"%x %x %x" % (i, i * 7 % 60_013, i * 11 % 50_021) for i in range(60_000)} | {b"%x" % i for i in range(60_000)})
    counts = op.acceptor(phrases, list(range(1, len(phrases) + 1)))
    grams, weights = op.acceptor(phrases[::3]).compose(counts)
    assert sorted(weights.tolist()) == list(range(1, len(phrases) + 1, 3))


@pytest.mark.parametrize("limits", [
    {}, {"shard_bytes": 300, "aim": 20, "pending": 200, "most": 100}, {"shard_bytes": 500, "aim": 20, "pending": 60, "most": 40}])
def test_against_brute_force(spark, limits):
    draw = random.Random(5)
    texts = random_texts(draw, 250) + ["the cat sat. the cat sat"] * 40 + [None, "", "A long piece of text " * 3_000]
    rows = [(draw.choice(["en", "fr", None, "und"]), t) for t in texts] + [("de", "rare words")] * 2
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)],
                                 "doc_id long, lang string, text string, phrase string, range int")
    for least, percent, top in ((3, 50, 25), (10, 50, 2_000)):
        got = op.collocations(docs, least, percent, top, **limits)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, least, percent, top)


def test_empty_tables_and_large_products(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert op.collocations(docs).collect() == []
    made = op._row({"range": 0, "lang": "en"}, [b"a", b"b"], np.array([[1, 0, 0], [1, 2, 0], [2, 0, 0]]),
                   np.array([3 * 10 ** 12, 10 ** 12 + 1, 2 * 10 ** 12]))
    answers = pa.table({"phrase": pa.array([b"a", b"b"], pa.binary()), "f": [3 * 10 ** 12, 2 * 10 ** 12]})
    row = op._judge(pa.Table.from_batches([made]), answers).to_pylist()
    assert [r["score"] for r in row] == [10 ** 6 * (10 ** 12 + 1) ** 2 // (6 * 10 ** 24)]
