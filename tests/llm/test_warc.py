import base64
import hashlib
import io
import random

import pytest

from quarryleaf.llm import warc


def test_loser_tree():
    r = random.Random(0)
    for k in range(9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)
    tied = [[(1, "a")], [(1, "b")], [(0, "c"), (1, "d")]]
    assert [x[1] for x in warc.LoserTree(tied, lambda x: x[0])] == ["c", "a", "b", "d"]


def test_keys():
    assert warc.url_key("https://www.A.example.com:443/X/?b=2&a=1") == "com,example,a)/x/?a=1&b=2"
    assert warc.url_key(None) == "" and warc.url_key("http://x:99999/") == "http://x:99999/" and warc.url_key("no url") == "no url"


def test_records():
    raw = warc.record(5, "http://x/a b\r\nInjected: 1", "é".encode() * 9)
    got = warc.parse(raw)
    assert (got["page_id"], got["payload_bytes"], got["record_type"], got["refers_to"]) == (5, 18, "response", None)
    assert b"\r\nInjected" not in raw
    assert warc.parse(warc.record(5, None, b"x", 7))["refers_to"] == 7
    with pytest.raises(ValueError):
        warc.parse(raw.replace("é".encode(), b"zz", 1))
    import gzip

    parts = [warc.record(i, "u", b"p" * i) for i in range(5)]
    stream = io.BytesIO(b"".join(gzip.compress(p) for p in parts))
    assert [r for _, _, r in warc.records(stream)] == parts
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(parts[0])[:-9])))


def test_frames(spark, monkeypatch):
    rows = [(1, "http://b/", "x"), (2, "http://a/", "x"), (3, "http://a/", "y"), (4, None, None), (5, "http://c/", ""), (5, "http://c/", ""), (None, "http://d/", "z"), (6, "http://e/", "L" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as sha", "2 as salt", "3 as latest")
    got = warc.digest(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert (by[1]["record_type"], by[1]["refers_to"], by[2]["record_type"]) == ("revisit", 2, "response")
    assert (by[4]["refers_to"], by[5]["record_type"], by[4]["payload_digest"]) == (5, "response", sha(b""))
    assert by[6]["payload_bytes"] == 300_000 and by[None]["record_type"] == "response"
    keys = [(r["url_key"], r["timestamp"], r["page_id"] or -1) for r in got]
    assert keys == sorted(keys)
    assert {r["record_type"] for r in warc.archive_and_index(pages, revisit_from=2).collect()} == {"response"}
    assert warc.digest(pages.where("false")).count() == 0
