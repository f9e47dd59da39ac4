import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarryleaf.operators import html, state
from quarryleaf.sources import pages as readers
from quarryleaf.sources import routes


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_charsets(spark):
    read = lambda b, c: one(spark, readers.decoded(F.lit(b), F.lit(c)))
    assert read("한글".encode("euc-kr"), "EUC-KR") == "한글" and read("日本".encode("shift_jis"), "shift_jis") == "日本"
    assert read(b"a\xff", "no-such-charset") == "a�" and read(b"a\xff", None) == "a�" and read(b"41", "hex") == "41"
    assert read(b"\xe9", "latin-1") == "é" and read(b"", "utf-8") == ""


def test_fences(spark):
    lines = lambda t: one(spark, html.fenced_lines(F.lit(t))).split("\n")
    assert lines("<p>Try <b>this</b>:</p><pre><code>a &lt; b\n  c</code></pre>x") == ["Try", "this", ":", "```", "a < b", "  c", "```", "x"]
    assert one(spark, html.fenced_lines(F.lit(""))) == "" and one(spark, html.fenced_lines(F.lit(None).cast("string"))) is None


def test_answers(spark):
    github = lambda k, r: one(spark, readers.github_markdown(F.lit(k), F.lit(r)))
    assert github("readme", "# hi") == "# hi" and github("blob", '{"content":"aG\\nk="}') == "hi"
    assert github("issue", '{"title":"T","state":"open","labels":[],"body":null}') == "# T\n\nState: open\n\n" and github("issue", "oops") is None
    wiki = lambda r: one(spark, readers.wikipedia_html(F.lit(r)))
    assert wiki('{"parse":{"text":{"*":"<p>x</p>"}}}') == "<p>x</p>" and wiki('{"error":{}}') is None and wiki("<html>") is None


def test_registry(spark):
    own = [("mine", lambda u: F.contains(u, F.lit("wiki"))), *routes.READERS]
    assert one(spark, routes.route(F.lit("https://en.wikipedia.org/wiki/X"), own)) == "mine"
    assert one(spark, routes.route(F.lit("https://en.wikipedia.org/wiki/X"))) == "wikipedia" and one(spark, routes.route(F.lit("https://x/"), [])) == "browser"


def test_selector_shown(spark):
    assert [one(spark, state.shown(F.lit(t))) for t in ("x" * 50, "x" * 49, "-" * 60, "Loading", None)] == [True, False, False, False, False]


@pytest.fixture
def corpus(tmp_path):
    def page(folder, name, kind, text, pages=None):
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.json").write_text(json.dumps({"ground_truth": {"main_content": text}, "_internal": {"page_type": kind}}))
        if pages is not None:
            pages.mkdir(exist_ok=True)
            (pages / f"{name}.html.gz").write_bytes(gzip.compress(f"<p>{text}</p>".encode()))

    page(tmp_path, "a", "article", "flat a", tmp_path)
    page(tmp_path, "alone", "article", "no html")
    page(tmp_path / "ground-truth", "a", "forum", "split a", tmp_path / "html")
    page(tmp_path / "ground-truth", "b", "forum", "split b", tmp_path / "html")
    return str(tmp_path)


def test_pairs(spark, corpus):
    got = {r["id"]: (r["text"], r["html"]) for r in readers.page_pairs(spark, corpus).collect()}
    assert got == {"a": ("flat a", "<p>flat a</p>"), "b": ("split b", "<p>split b</p>")}
    assert [r["id"] for r in readers.page_pairs(spark, corpus, "forum").collect()] == ["b"]
    with pytest.raises(ValueError):
        readers.page_pairs(spark, corpus + "/nowhere")


def test_telemetry(spark, tmp_path):
    log = str(tmp_path / "log")
    results = spark.createDataFrame([("https://h/x", "q", 5)], "url string, query string, total_ms long")
    assert not readers.record_telemetry(results, log)
    spark.conf.set("quarryleaf.telemetry", "yes")
    try:
        assert readers.record_telemetry(results, log) and readers.record_telemetry(results, log)
        line = spark.read.json(log).first()
        assert spark.read.json(log).count() == 2 and (line["host"], line["total_ms"], line["schema"]) == ("h", 5, 1)
        assert readers.record_telemetry(results, log, 1) and spark.read.json(log).count() == 1 and spark.read.json(log + ".1").count() == 2
        assert readers.record_telemetry(results, log, 1) and spark.read.json(log + ".1").count() == 1
        (tmp_path / "file").write_text("")
        assert not readers.record_telemetry(results, str(tmp_path / "file" / "log"))
    finally:
        spark.conf.unset("quarryleaf.telemetry")


def test_profiles_and_reports(spark, tmp_path):
    made = lambda h, at, u: spark.createDataFrame([(u, h, at)], "url string, url_hash string, generated_at string")
    for row in (("x", "2024-01-01", "https://A.org/1"), ("x", "2024-02-01", "https://a.org/1"), ("y", "2024-03-01", "https://b.org/")):
        readers.write_profiles(made(*row), str(tmp_path / "p"))
    assert [(r["url_hash"], r["generated_at"]) for r in readers.read_profiles(spark, str(tmp_path / "p")).collect()] == [("y", "2024-03-01"), ("x", "2024-02-01")]
    assert [r["url_hash"] for r in readers.read_profiles(spark, str(tmp_path / "p"), "a.org").collect()] == ["x"]
    out = spark.createDataFrame([("s", "1", "c", True, 5), ("s", "2", "c", False, 7)], "shard string, id string, category string, passed boolean, total_ms_p95 long")
    readers.write_reports(out, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "raw")).count() == 2 and [r["id"] for r in spark.read.json(str(tmp_path / "r" / "failures")).collect()] == ["2"]
    assert "| `2` | c | FAIL | 7ms |" in spark.read.text(str(tmp_path / "r" / "summary"), wholetext=True).first()["value"]


def test_patterns(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "coding.yaml").write_text("patterns:\n- id: p1\n  agents: [a]\n  url: https://h/\n- id: p2\n")
    (tmp_path / "empty.yaml").write_text("patterns: []\n")
    got = readers.read_patterns(spark, str(tmp_path), "id string, shard string, agents array<string>, url string").collect()
    assert [(r["id"], r["shard"], r["agents"]) for r in got] == [("p1", "coding", ["a"]), ("p2", "coding", None)]
    (tmp_path / "bad.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        readers.read_patterns(spark, str(tmp_path), "id string")
