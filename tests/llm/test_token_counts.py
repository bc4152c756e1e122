import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from wardline.llm import token_counts as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counters():
    return [op.TokenCounter(PATH, {}), op.TokenCounter(PATH, {" the": 1, "a": 1}, remembered=6)]


def exact(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text(), st.text(alphabet="ab '\n\tstre"), st.text(alphabet="  \u0085 \x1c\x1f0é!"),
    st.lists(st.sampled_from([SPECIAL, "<|endoftext|", "|>", " the", "\n\n", "a", "՘", "😀"])).map("".join)))
def test_equals_the_library_on_any_text(counters, library, text):
    for counter in counters:
        assert counter.count(text) == exact(library, text)


def test_characters_that_unicode_tables_of_different_age_judge_differently(counters, library):
    """Unassigned code points: a letter for one of the two, an other sign for the other."""
    for code in (0x558, 0x88F, 0xC5C, 0x208F, 0xA7D2, 0x10940, 0x10EC5, 0x323B0):
        text = f"ab{chr(code)}1{chr(code)} {chr(code)}!{chr(code)}a the the"
        assert all(counter.count(text) == exact(library, text) for counter in counters)


def test_the_cache_stays_small():
    counter = op.TokenCounter(PATH, {"kept": 1}, remembered=50)
    for i in range(500):
        counter.count(f"x{i}y")
    assert len(counter.counts) <= 1 + 25 and len(counter.counts.old) <= 1 + 25 and counter.counts["kept"] == 1
    counter.count("z" * 100)
    assert "z" * 100 not in counter.counts


@pytest.mark.parametrize("sample_rows, most", [(op.SAMPLE_ROWS, op.FREQUENT), (2, 3), (5, 0)])
def test_whole_table(spark, library, sample_rows, most):
    rows = [(1, None), (2, ""), (3, f"Hello {SPECIAL} wörld"), (3, "again"), (None, " x"), (4, "long text " * 120_000),
            (5, "q" * 5_000), (6, "՘ the end")] + [(i, f"the row {i}") for i in range(10, 40)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_tokens string, piece int")
    got = op.count_tokens(docs, PATH, sample_rows, most)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint")]
    want = [(i, len((t or "").encode()), exact(library, t)) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert op.count_tokens(docs.filter("false"), PATH).collect() == []


def test_the_table_is_bounded_and_holds_the_frequent_ones(spark, library):
    docs = spark.createDataFrame([(i, "often often rare%d" % i) for i in range(50)], "doc_id long, text string")
    table = op.frequent_lengths(docs, PATH, most=2)
    assert len(table) == 2 and table[" often"] == exact(library, " often")


def test_other_tokenizers_count_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, other = op.TokenCounter(path, {}), Tokenizer.from_file(path)
    for text in ("Hello  World", "", "<|startoftext|> A b"):
        assert counter.count(text) == exact(other, text)
