import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from wardline.llm import bpe as op
from wardline.llm.queries import RANKS

SCHEMA = "doc_id long, text string, ids string, body int"


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as lines:
        return op.read_ranks(lines)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codecs(ranks):
    return [op.Codec(ranks, public_tokenizers.PATTERN, leaf) for leaf in (1, 5, op.LEAF)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab "), st.text(alphabet="theingo", min_size=20), st.text(alphabet="=-\n \t")))
def test_equals_the_library_on_any_text(codecs, plain, text):
    want = plain.encode_ordinary(text)
    for codec in codecs:
        assert codec.encode(text) == want
        assert codec.decode(want) == text.encode()


def test_long_pieces_and_growing_windows(codecs, plain):
    draw = random.Random(1)
    for text in ("a" * 3_001, "ab" * 1_500, "the" * 900, "=" * 2_049, "".join(draw.choice("ab") for _ in range(3_000))):
        assert all(codec.encode(text) == plain.encode_ordinary(text) for codec in codecs)


def test_join_is_associative(codecs):
    draw = random.Random(2)
    codec = codecs[0]
    for _ in range(200):
        a, b, c = ("".join(draw.choice("thein") for _ in range(draw.randrange(12))).encode() for _ in range(3))
        x, y, z = map(codec.merge, (a, b, c))
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == codec.merge(a + b + c)


def test_whole_table(spark, plain):
    rows = [(1, None), (2, ""), (3, "Hello <|endoftext|> wörld"), (3, "again"), (None, " x"), (4, "long text " * 120_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    encoded = op.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr) == sorted(
        ((i, plain.encode_ordinary(t or "")) for i, t in rows), key=repr)
    decoded = op.decode(encoded, RANKS, public_tokenizers.PATTERN)
    got = op.digests(decoded).collect()
    at_once = op.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert at_once.columns == decoded.columns
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, decoded.collect()))
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        digest = lambda data: hashlib.sha256(data).hexdigest()
        want.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert op.encode(docs.filter("false"), RANKS, public_tokenizers.PATTERN).collect() == []
