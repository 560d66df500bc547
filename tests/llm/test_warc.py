"""Archives that are plain, cut by byte ranges, compressed by the record, truncated or empty."""

import gzip
import hashlib
import random

import numpy as np
import pytest

from gradewright.llm import warc

SCHEMA = "page_id long, url string, html string"


def want(pages):
    """The rows of distinct, non-null page ids by brute force."""
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= warc.REVISIT and top[h or ""] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(map(str, out))


def rows(df):
    return sorted(str(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def hostile_pages():
    rng = random.Random(4)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    parts = ["<p>é</p>\n", fake, "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "Content-Length: 9\r\n", "x" * 40, "a: b\r\n", "\n"]
    pages = [(i, f"http://h/{'u' * rng.randrange(200)}", "".join(rng.choices(parts, k=rng.randrange(60)))) for i in range(30)]
    return [*pages, (30, None, None), (31, "http://h/" + "y" * 3000, fake * 40), (32, "", fake * 40), (33, "u", "z" * 20_000), (34, "u", "z" * 20_000)]


@pytest.fixture
def small_ranges(spark):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("size", [4001])
def test_file_of_many_ranges(spark, tmp_path, small_ranges, size):
    pages = hostile_pages()
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(pages, SCHEMA).coalesce(1), path, "none")
    small_ranges(size)
    assert warc.lines_of(spark, path).select("block").distinct().count() > 5
    got = warc.read(spark, path)
    assert rows(got) == want(pages)
    whole = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*.txt"))
    for r in got.collect():
        assert whole[r.offset : r.offset + 5] == b"WARC/" and whole[r.successor - 4 : r.successor] == b"\r\n\r\n"


def test_passes_over_ranges(spark, tmp_path, monkeypatch):
    pages = hostile_pages()
    warc.write(spark.createDataFrame(pages, SCHEMA).repartition(5), str(tmp_path / "w"))
    monkeypatch.setattr(warc, "MAX_RANGES", 2)
    assert rows(warc.read(spark, str(tmp_path / "w"))) == want(pages)


def test_member_a_record(spark, tmp_path):
    """An archive of another writer, one gzip member a record."""
    pages = hostile_pages()
    warc.write(spark.createDataFrame(pages, SCHEMA).coalesce(1), str(tmp_path / "w"), "none")
    found = sorted(warc.read(spark, str(tmp_path / "w")).select("offset", "successor").collect())
    whole = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*.txt"))
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(b"".join(gzip.compress(whole[a:b]) for a, b in found))
    assert rows(warc.read(spark, str(tmp_path / "z"))) == want(pages)


def test_truncated(spark, tmp_path, small_ranges):
    warc.write(spark.createDataFrame(hostile_pages(), SCHEMA).coalesce(1), str(tmp_path / "w"), "none")
    whole = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*.txt"))
    for name, cut, size in (("a", 5, 10**8), ("b", len(whole) // 2, 9000)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "w.warc").write_bytes(whole[:-cut])
        small_ranges(size)
        with pytest.raises(ValueError, match="records end at byte"):
            warc.read(spark, str(tmp_path / name))


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0
    (tmp_path / "w" / "nothing.warc").write_bytes(b"")
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_extra_columns(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "a", "x", 5), (1, "u", "a", "x", 5)], SCHEMA + ", uid string, n int")
    warc.write(d, str(tmp_path / "w"))
    assert rows(warc.read(spark, str(tmp_path / "w"))) == [str((1, 1, hashlib.sha1(b"a").hexdigest(), "response", None))] * 2


def test_last_of_chain():
    assert warc.last_of_chain(np.array([0, 10, 15, 30]), np.array([10, 30, 20, 40])).tolist() == [40, 40, 20, 40]
    assert warc.last_of_chain(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
