import gzip
import hashlib
import io

import pytest
from oracle import compare, connect

from sightline.llm import warc
from sightline.session import durable_path

SF = "/root/testdata/sf0.01"


def naive(rows):
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            last[data] = max(i, last.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        other = last.get(data)
        again = other is not None and i != other
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


def pages_of(spark, rows):
    full = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, _key string, offset int")


def test_query_equals_sql(spark):
    ok, message, *_ = compare(spark, connect(SF), "op13_warc_normaliser", SF)
    assert ok, message


def test_round_trip_of_odd_pages(spark):
    long, other = "é" * 700, "WARC/1.1\r\n\r\n" * 200
    rows = [
        (1, "http://a/x y\r\nEvil: 1", long), (7, None, long), (3, "u", long), (None, "u", long), (4, "u", None), (5, "u", ""),
        (6, "u", "short"), (8, "u", "short"), (9, "u", other), (9, "u", other), (2, "u", other), (None, "v", "lone"),
        (10, "u", "a" * 999), (11, "u", "a" * 999), (12, "u", "a" * 1000), (13, "u", "a" * 1000), (14, "u", "\x00\r\n" * 900_000),
    ]
    got = warc.round_trip(pages_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == naive(rows)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_members_stand_alone_and_the_index_finds_them(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3}</p>" * 200) for i in range(40)]
    whole, target = durable_path(spark, "t-whole"), durable_path(spark, "t-members")
    warc.write_archives(pages_of(spark, rows).coalesce(1), whole)
    streams = [r["path"] for r in warc.archives(spark, whole).collect()]
    written = warc.normalise(spark, whole, target)
    assert sum(r["records"] for r in written.collect()) == 40
    index = warc.read_index(spark, written).collect()
    assert len(index) == 40 and len({(r["archive"], r["offset"]) for r in index}) == 40
    for r in index:
        with open(r["archive"].removeprefix("file:"), "rb") as file:
            file.seek(r["offset"])
            member = gzip.decompress(file.read(r["length"]))
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
        assert f"X-Page-ID: {r['page_id']}\r\n".encode() in member
    joined = b"".join(open(p.removeprefix("file:"), "rb").read() for p in sorted({r["archive"] for r in index}))
    plain = b"".join(gzip.decompress(open(p.removeprefix("file:"), "rb").read()) for p in streams)
    assert sorted(gzip.decompress(joined).split(b"WARC/1.1")) == sorted(plain.split(b"WARC/1.1"))
    # Archives that have members already come out alike.
    again = warc.read_index(spark, warc.normalise(spark, target, durable_path(spark, "t-again"))).collect()
    assert sorted((r["record_id"], r["length"]) for r in again) == sorted((r["record_id"], r["length"]) for r in index)


def test_foreign_streams():
    a = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\nX-Long: one\r\n two\r\n\r\nabc\r\n\r\n"
    b = b"WARC/1.0\r\nwarc-type: resource\r\ncontent-length: 0\r\n\r\n\r\n\r\n"
    for data in (gzip.compress(a + b), gzip.compress(a) + gzip.compress(b), gzip.compress(a[:20]) + gzip.compress(a[20:] + b)):
        found = list(warc.records(io.BytesIO(data)))
        assert [f["warc-type"] for f, *_ in found] == ["warcinfo", "resource"]
        assert found[0][0]["x-long"] == "one two" and found[0][2] == b"abc" and found[1][2] == b""
    assert list(warc.records(io.BytesIO(gzip.compress(b"")))) == []
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(a[:-6]))))
