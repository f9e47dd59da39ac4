import json

import pytest
from pyspark.sql import functions as F

from quarryleaf.functions.text import profile_response
from quarryleaf.operators import chunking, harness, html, markdown, profiles
from quarryleaf.plans import catalog, retrieve
from quarryleaf.sources import pages as readers
from quarryleaf.streaming import jobs

CARD = '<div class="card post"><h3>Title {i}</h3><p>Some longer body text of record number {i}.</p></div>'
PAGE = (
    '<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Record home</a></li></ul></nav>'
    '<main id="content-main"><h1>Listing</h1>' + "".join(CARD.format(i=i) for i in range(4)) + "<p>After the records there is a paragraph.</p>"
    '<pre>def f():\n    return 1</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><a href="https://h.example/x"> link  text </a></main>'
    "<footer><nav><nav>inner</nav>outer</nav> imprint</footer></body></html>"
)


def frame(spark, *pages):
    return spark.createDataFrame([(i, f"https://h.example/{i}", p) for i, p in enumerate(pages)], "page_id int, url string, html string")


def test_markdown():
    md = markdown.markdown(PAGE)
    assert md.startswith("# Listing\n### Title 0\n") and "```\ndef f():\n    return 1\n```" in md and "| a | b |\n| 1 | 2 |" in md
    assert "[link text](https://h.example/x)" in md
    assert not any(x in md for x in ("Record home", "inner", "outer", "imprint"))
    assert markdown.markdown(None) == "" and markdown.markdown("<p>a<pre></pre>b") == "a\nb"


def test_records_are_annotated_and_chunked(spark):
    md = markdown.page_markdown(frame(spark, PAGE, "<p>plain</p>"), "page_id").orderBy("page_id").collect()
    assert md[1]["md"] == "plain"
    lines = md[0]["md"].split("\n")
    assert [x for x in lines if x.startswith("[[")] == [chunking.record_mark(0, i) for i in range(4)] + [chunking.record_end(0)]
    assert lines.index(chunking.record_end(0)) < lines.index("After the records there is a paragraph.")
    chunks = chunking.chunk(md[0]["md"])
    assert all(c["text"] == c["text"].strip() and c["char_count"] == len(c["text"]) for c in chunks)
    assert not any("[[REC" in c["text"] for c in chunks)


def test_chunks_are_trimmed():
    got = chunking.chunk("# A\n\nThis paragraph is long enough to stay here.\n\n")
    assert [(c["text"], c["char_count"], c["heading"]) for c in got] == [("This paragraph is long enough to stay here.", 43, "A")]


@pytest.mark.parametrize("line,most,want", [("One two. Three four. Five.", 12, ["One two.", "Three four.", "Five."]), ("abcdefghij", 4, ["abcd", "efgh", "ij"]), ("aa bb cc dd", 5, ["aa bb", "cc dd"]), ("3.14 is pi", 10, ["3.14 is pi"]), ("Short. " + "x" * 9 + " y. End.", 8, ["Short.", "xxxxxxxx", "x", "y.", "End."])])
def test_long_lines(line, most, want):
    assert chunking.split_long(line, most) == want


def test_mapping_and_selectors(spark):
    nodes = html.dom_nodes(frame(spark, PAGE))
    anchors = spark.createDataFrame([(0, "Title 1"), (0, "number 3"), (0, "nowhere to be found")], "page_id int, anchor string")
    got = profiles.mapped(nodes, anchors, "page_id").first()
    assert (got["lca_tag"], got["selector"], got["anchors"], got["missed"]) == ("main", "#content-main", ["Title 1", "number 3"], ["nowhere to be found"])
    names = {r["selector"] for r in profiles.selectors(nodes, "page_id").collect()}
    assert "div.card.post" in names and "body:nth-of-type(1) > nav:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(1)" in names
    own = profiles.matching(nodes, F.lit("div.card.post"), "page_id").count()
    chain = profiles.matching(nodes, F.lit("nav:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(1)"), "page_id").collect()
    assert own == 4 and [r["tag"] for r in chain] == ["li"]
    assert profiles.matching(nodes, F.lit('div[class*="car"]'), "page_id").count() == 4


def test_headings_whose_words_stand_elsewhere_too(spark, tmp_path):
    page = "<html><body><nav><ul>{nav}</ul></nav><div>{ad}</div><article><h1>{title}</h1><p>text</p></article></body></html>"
    pages = [page.format(nav="", ad="Are re be.", title="Are re be."), page.format(nav="", ad="Inth of.", title="In In"), page.format(nav="<li>In</li>" * 6, ad="", title="In")]
    frame(spark, *pages).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in catalog.QUERIES["page_profiles"](spark, str(tmp_path)).collect()}
    assert [(got[i]["lca_tag"], got[i]["selector"], got[i]["n_missed"]) for i in range(3)] == [("article", "body:nth-of-type(1) > article:nth-of-type(1)", 0)] * 3
    assert {r["page_id"]: r["drifted"] for r in catalog.QUERIES["profile_drift"](spark, str(tmp_path)).collect()} == {0: False, 1: True, 2: False}


def test_a_page_as_a_whole_is_no_container(spark):
    page = "<html><body><div><p>alpha</p></div><div><p>omega</p></div></body></html>"
    anchors = spark.createDataFrame([(0, "alpha"), (0, "omega")], "page_id int, anchor string")
    got = profiles.mapped(html.dom_nodes(frame(spark, page)), anchors, "page_id").first()
    assert got["lca_tag"] == "body" and got["selector"] is None


def test_generate_with_one_retry(spark):
    good = json.dumps({"page_type": "list", "description": "d", "content_anchors": ["Title 1", "number 3", "Listing"], "noise_labels": []})
    ask = lambda prompt: F.when(F.contains(prompt, F.lit("again")), F.lit(good)).otherwise(F.lit("no json"))
    prompts = spark.createDataFrame([(0, "what is it"), (1, "what is it")], "page_id int, prompt string")
    answers = profiles.answered(prompts, ask, F.lit("again, as JSON"), "page_id")
    assert {r["tries"] for r in answers.collect()} == {2}
    pages = frame(spark, PAGE, "<html><body><p>other</p></body></html>")
    got = {r["page_id"]: r for r in profiles.generate(html.dom_nodes(pages), answers, pages, "page_id").collect()}
    assert got[0]["selector"] == "#content-main" and got[0]["failed_at"] is None and got[1]["failed_at"] == "mapper"
    assert spark.range(1).select(profile_response(F.lit("{}"))).first()[0] is None
    found = profiles.subtree(html.dom_nodes(pages), spark.createDataFrame([(0, "#content-main", ["Title 2"]), (1, "#content-main", ["x"])], "page_id int, selector string, anchors array<string>"), "page_id")
    assert {r["page_id"]: r["drifted"] for r in found.collect()} == {0: False, 1: True}


def test_extract_keeps_headings_and_records(spark):
    got = retrieve.extract(frame(spark, PAGE)).first()
    assert got["title"] == "T" and "# Listing" in got["md"] and chunking.record_mark(0, 3) in got["md"]


def test_query_expansion_is_averaged(spark):
    class Words:
        def expand(self, query):
            return F.concat(query, F.lit(" paragraph"))

    pages = retrieve.extract(frame(spark, PAGE))
    asked = spark.createDataFrame([(0, 0, "records")], "page_id int, query_id int, query string")
    plain = retrieve.retrieve(pages, asked).first()
    wide = retrieve.retrieve(pages, asked, expander=Words()).first()
    score = lambda r: {c["chunk_index"]: round(c["score"], 6) for c in r["chunks"]}
    assert score(plain) != score(wide) and plain["n_chunks_total"] == wide["n_chunks_total"] and wide["embed_calls"] == 2


def test_sources(spark, tmp_path):
    raw = {"file_id": "f1", "url": "u", "ground_truth": {"title": "t", "main_content": "body", "with": ["a"], "without": []}, "_internal": {"page_type": {"primary": "category"}}}
    (tmp_path / "f1.json").write_text(json.dumps(raw))
    (tmp_path / "f2.json").write_text(json.dumps({"file_id": "f2", "ground_truth": {}}))
    got = {r["id"]: r for r in readers.ground_truth(spark, str(tmp_path / "*.json")).collect()}
    assert got["f1"]["page_type"] == "collection" and got["f1"]["with"] == ["a"] and got["f2"]["page_type"] == "article" and got["f2"]["text"] == ""
    readers.append_telemetry(spark.createDataFrame([("h", 5)], "host string, total_ms long"), str(tmp_path / "log"))
    readers.append_telemetry(spark.createDataFrame([("h", 6)], "host string, total_ms long"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "p").mkdir()
    for i, body in enumerate(['{"url":"u","url_hash":"x","generated_at":"2024-01-02"}', "not json", '{"url":"v","url_hash":"y","generated_at":"2024-03-02"}']):
        (tmp_path / "p" / f"{i}.json").write_text(body)
    assert [r["url_hash"] for r in readers.read_profiles(spark, str(tmp_path / "p")).collect()] == ["y", "x"]
    bodies = readers.raw_bodies(spark, str(tmp_path / "p" / "0.json"), 10).first()
    assert len(bodies["body"]) == 10 and bodies["truncated"] and bodies["error"] is None
    files = spark.read.format("binaryFile").load(str(tmp_path / "p")).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    manifest = files.select("path", F.sha2("content", 256).alias("sha256")).union(spark.createDataFrame([("gone", "00")], "path string, sha256 string"))
    assert [r["path"] for r in readers.changed_files(manifest, files).collect()] == ["gone"]


def test_renderings(spark):
    answers = spark.createDataFrame([(1, False, 9, "nine"), (1, True, 2, "two"), (1, False, 3, "three")], "q int, accepted boolean, score int, body string")
    assert readers.stack_markdown(answers, "q").first()["md"].split("\n\n")[1::2] == ["two", "nine", "three"]
    tracks = spark.createDataFrame([(1, 0, True, ["auto"]), (1, 1, False, ["by", "hand"]), (2, 0, True, ["only"])], "v int, ord int, generated boolean, snippets array<string>")
    assert {r["v"]: r["md"] for r in readers.transcript(tracks, "v").collect()} == {1: "by hand", 2: "only"}
    one = spark.range(1).select(readers.issue_markdown(F.lit("T"), F.lit("open"), F.array(F.lit("a"), F.lit("b")), F.lit("body")).alias("i"), readers.blob_text(F.lit("aGk=")).alias("b")).first()
    assert one["i"] == "# T\n\nState: open  Labels: a, b\n\nbody" and one["b"] == "hi"
    assert spark.range(1).select(readers.decoded(F.lit(b"\xe9a"), F.lit("latin-1"))).first()[0] == "éa"


def test_streams(spark, tmp_path):
    rows = [(i, 1 + i % 2, "click", f"2024-01-01 00:{i:02d}:00", 100 * i) for i in range(30)]
    spark.createDataFrame(rows, "event_id int, user_id int, event_type string, ts string, ms int").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.col("ms").cast("double")).coalesce(1).write.parquet(str(tmp_path / "e"))
    events = lambda: jobs.event_stream(spark, str(tmp_path / "e"))
    out = {r["user_id"]: r for r in jobs.run_once(jobs.host_ceilings(events()), "update").collect()}
    assert out[1]["samples"] == 15 and 1500 <= out[1]["ceiling_ms"] <= 15000
    assert jobs.run_once(jobs.skip_if_seen(events(), ["user_id"], "1 hour")).count() == 2
    assert jobs.run_once(jobs.sliding(events(), "10 minutes", "5 minutes", "1 minute")).count() >= 4
    query = jobs.upsert_latest(events(), "user_id", "ts", str(tmp_path / "table"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "table" / "v=0")).collect()} == {1: 28, 2: 29}


def test_a_lone_file_is_read_without_its_neighbours(spark, tmp_path):
    for name in ("events.parquet", "events.parquet.bak"):
        spark.range(3).withColumn("ts", F.current_timestamp()).coalesce(1).write.parquet(str(tmp_path / name))
    assert jobs.run_once(jobs.event_stream(spark, str(tmp_path / "events.parquet"))).count() == 3


def test_errors_and_lists(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None), (3, None, None)], "id int, a double, b double")
    got = harness.error_lists(rows, "id", {"a": F.col("a").isNull(), "b": F.col("b").isNull()}).collect()
    assert sorted((r["extractor"], r["id"]) for r in got) == [("a", 1), ("a", 3), ("b", 2), ("b", 3)]
    assert harness.error_gate(rows.where("false"), F.lit(True)).first()["exit_code"] == 1
