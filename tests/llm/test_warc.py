import gzip
import hashlib
import random
from itertools import chain

import pytest
from pyspark.sql import functions as F

from wardline.llm import warc as op

SCHEMA = "page_id long, url string, html string, record string, payload_bytes string"
BIG = "<p>ü</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
ROWS = [(1, "http://www.A.com/x?b=1", BIG), (2, "http://a.com:8080/y", BIG), (3, "https://sub.a.com", "small"),
        (4, "https://sub.a.com", "small"), (5, None, None), (6, "http://[bad", ""), (7, "x\r\ny", "y" * 999),
        (8, "x", "y" * 999), (9, "x", "z" * 1000), (10, "x", "z" * 1000), (10, "x", "z" * 1000), (None, "n", BIG),
        (None, "n", "lonely" * 400), (11, "http://a.com/", "big " * 200_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def test_equals_brute_force(spark):
    got = sorted((tuple(r) for r in op.archive(frame(spark, ROWS)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    want = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        ids = [j for j, _, other in ROWS if (other or "").encode() == body and j is not None]
        holder = max(ids, default=None)
        again = len(body) >= 1000 and holder is not None and holder != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                     holder if again else None))
    assert got == sorted(want, key=repr)


def test_archives_are_gzip_members_that_offsets_find(spark, tmp_path):
    path = str(tmp_path / "archives")
    op.write_archives(frame(spark, ROWS), path)
    for r in op.read_archives(spark, path).collect():
        content = open(r["file"].removeprefix("file:"), "rb").read()
        record = gzip.decompress(content[r["offset"]:r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and record.endswith(b"\r\n\r\n")
        assert gzip.decompress(content).count(record) >= 1


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, f"http://a.com/{i}", "".join(draw.choices("abcdefgh", k=draw.choice([10, 4_000, 30_000])))) for i in range(120)]
    path = str(tmp_path / "archives")
    op.write_archives(frame(spark, rows), path, archive_bytes=20_000)
    captures = op.read_archives(spark, path).collect()
    assert sorted(r["page_id"] for r in captures) == list(range(120))
    files = {}
    for r in captures:
        files.setdefault(r["file"], []).append((r["offset"], r["length"]))
    assert len(files) > 10
    for lengths in files.values():
        assert sum(n for _, n in sorted(lengths)[:-1]) <= 20_000
    op.write_archives(frame(spark, []), path + "-none")
    assert op.read_archives(spark, path + "-none").collect() == []


def test_damage_is_noticed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nHTTP\r\n\r\nx\r\n\r\n"
    assert op.parse(record)[2] == b"x"
    with pytest.raises(ValueError):
        op.parse(record[:-1])
    with pytest.raises(ValueError):
        list(op.members(op.member(record)[:-3]))


def test_index_is_in_global_order(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(draw.randrange(-5, 900), draw.choice(["http://hot.com/"] * 5 + [f"http://h{draw.randrange(9)}.com/{i}"]), "h")
            for i in range(800)] + [(None, "http://hot.com/", "h")]
    index = op.archive(frame(spark, rows))
    captures = op.capture_index(index.orderBy(F.rand(1)), per_range=60)
    ordered = [(r["urlkey"], r["timestamp"], r["page_id"] is not None, r["page_id"] or 0, r["file"], r["offset"])
               for r in captures.orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
    assert len(ordered) == len(rows)
    parts = captures.select(F.input_file_name()).distinct().count()
    assert parts > 5 and ordered == sorted(ordered)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    draw = random.Random(k)
    runs = [sorted(draw.randrange(50) for _ in range(draw.randrange(9))) for _ in range(k)]
    assert list(op.LoserTree([list(r) for r in runs])) == sorted(chain.from_iterable(runs))


def test_url_keys():
    assert op.url_key("HTTP://www.Example.com:80/A?q=1") == "com,example)/a?q=1"
    assert op.url_key("https://a.b.c") == "c,b,a)/"
    assert op.url_key("http://a.com:99999/") == "http://a.com:99999/"


def test_empty_table(spark):
    assert op.archive(frame(spark, [])).collect() == []
