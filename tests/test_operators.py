import pytest
from pyspark.sql import functions as F

from quarryleaf.operators import enrichment, evaluation, html, ranking, state
from quarryleaf.plans import retrieve
from quarryleaf.plans.providers import HashEmbedder
from quarryleaf.settings import Settings


def corpus(spark, *docs):
    return spark.createDataFrame([("p", i, d) for i, d in enumerate(docs)], "group string, idx int, text string")


def terms(spark, *words):
    return spark.createDataFrame([("p", 0, w) for w in words], "group string, query_id int, term string")


def order(df):
    return [r["idx"] for r in df.orderBy("rank").collect()]


def test_bm25(spark):
    docs = corpus(spark, "beta gamma", "alpha alpha beta", "gamma delta", "alpha zeta eta theta", "iota")
    assert order(ranking.bm25_rank(docs, terms(spark, "alpha"))) == [1, 3, 0, 2, 4]
    assert order(ranking.bm25_rank(docs, terms(spark, ""))) == [0, 1, 2, 3, 4]
    assert order(ranking.bm25_rank(corpus(spark, "", "", ""), terms(spark, "alpha"))) == [0, 1, 2]


def test_budget(spark):
    docs = corpus(spark, "alpha one", "beta two", "alpha three", "gamma four", "alpha five")
    kept = lambda t, b: sorted(r["idx"] for r in ranking.chunk_budget(docs, t, b).collect())
    assert kept(terms(spark, "alpha"), 3) == [0, 2, 4] and kept(terms(spark, ""), 3) == [0, 1, 2] and kept(terms(spark, "alpha"), 0) == [0, 1, 2, 3, 4]


def test_fusion(spark):
    def fused(rankings, k):
        rows = [(0, n, i, r) for n, ids in enumerate(rankings) for r, i in enumerate(ids)]
        return order(ranking.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id int, ranking int, idx int, rank int"), k))

    assert fused([[3, 1, 4, 5]], 60) == [3, 1, 4, 5]
    assert fused([[0, 1, 2], [1, 2, 0]], 1)[0] == 1 and fused([[0, 1, 2], [1, 2, 0]], 60)[0] == 1
    assert fused([[0, 1], [1, 0]], 60) == [0, 1]


def test_caps(spark):
    rows = [("q", "query", i, i, "x" * 1501) for i in range(31)]
    c = spark.createDataFrame(rows, "query_id string, query string, idx int, rank int, document string")
    out = ranking.rerank_caps(c).collect()
    assert len(out) == 30 and all(r["capped"] for r in out) and {len(r["document"]) for r in out} == {(40_000 - 5) // 30}
    same = ranking.rerank_caps(c.where("idx < 3").withColumn("document", F.lit("d")), 0, 0, 0).collect()
    assert len(same) == 3 and not any(r["capped"] for r in same)


def test_word_f1(spark):
    t = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "x")], "id int, text string")
    o = spark.createDataFrame([(1, "a b c x"), (2, "")], "id int, text string")
    got = {r["id"]: (r["recall"], r["precision"], round(r["f1"], 4)) for r in evaluation.word_f1(t, o).collect()}
    assert got == {1: (0.6, 0.75, 0.6667), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}
    assert {r["id"]: r["f1"] for r in evaluation.word_f1(t, o, empty_scores=False).collect()}[2] == 0.0


def test_comparisons(spark):
    ok = lambda spec, v: spark.range(1).select(evaluation.compare(F.lit(v), spec)).first()[0]
    assert ok(">= 3", 3) and not ok("< 3", 3) and ok("3", 3)
    with pytest.raises(ValueError):
        evaluation.compare(F.lit(1), "~ 3")


def test_links(spark):
    c = spark.createDataFrame([(1, 0, "![i](http://i) [a](http://a)[b](http://b) [a](http://a)"), (1, 1, "[a](http://a) [c](ftp://c)")], "page int, chunk_index int, text string")
    assert [(r["url"], r["ord"]) for r in enrichment.outbound_links(c, "page").orderBy("ord").collect()] == [("http://a", 0), ("http://b", 1)]
    big = spark.createDataFrame([(1, 0, "[a](http://a) [" + "x" * 20_000 + "](http://b) [c](http://c)")], "page int, chunk_index int, text string")
    assert [r["url"] for r in enrichment.outbound_links(big, "page").collect()] == ["http://a"]


def test_cache(spark):
    cache = spark.createDataFrame([("k", 100.0), ("k", 250.0)], "key string, cached_at double")
    asked = spark.createDataFrame([(1, "k", 550.0), (2, "k", 550.1), (3, "k", 99.0), (4, "x", 200.0), (5, "k", 260.0)], "id int, key string, now double")
    got = {r["id"]: r["cached_at"] for r in state.cache_lookup(asked, cache, "key", "now", 300).collect()}
    assert got == {1: 250.0, 2: None, 3: None, 4: None, 5: 250.0}


def test_evictions(spark):
    e = spark.createDataFrame([(i, float(i), 10) for i in range(20)], "id int, at double, size int")
    assert sorted(r["id"] for r in state.cache_evictions(e, "size", ["at", "id"], 100).collect()) == list(range(12))
    assert state.cache_evictions(e, "size", ["at", "id"], 200).count() == 0


def test_records(spark):
    card = '<div class="c d">%s</div>'
    page = "<html><body><nav>" + '<a class="x">a link of some length here</a>' * 4 + "</nav><main>" + "".join(card % f"record number {i} with some text" for i in range(4)) + "<p>plain</p>" + card % "alone but long enough for it" + "</main></body></html>"
    few = "<body>" + card % "x" * 5 + "</body>"
    many = "<body>" + "".join("<section>" + card % "a record of enough text in it" * 3 + "</section>" for _ in range(9)) + "</body>"
    nodes = html.dom_nodes(spark.createDataFrame([(1, page), (2, few), (3, many), (4, None), (5, "<b>unclosed <p>x")], "page_id int, html string"))
    got = html.record_groups(nodes, "page_id").collect()
    assert [(r["page_id"], r["count"], r["parent_tag"], r["signature"]) for r in got] == [(1, 4, "main", "div|c d")]


def test_anchored_elements(spark):
    nodes = html.dom_nodes(spark.createDataFrame([(1, "<body><main><div><p>alpha beta</p></div><p>gamma beta</p></main></body>")], "page_id int, html string"))
    anchors = spark.createDataFrame([(1, "alpha"), (1, "gamma")], "page_id int, anchor string")
    found = html.smallest_with(nodes, anchors, "page_id")
    assert found.count() == 2
    lca = html.common_ancestor(found, "page_id").join(nodes, ["page_id"]).where("lca = node").first()
    assert lca["tag"] == "main"


def test_longest(spark):
    df = spark.createDataFrame([("aa", "bb", "c", None), ("", None, "", "")], "a string, b string, c string, d string")
    pick = html.longest([F.col(c) for c in "abcd"])
    assert [r[0] for r in df.select(pick).collect()] == ["aa", None]
    assert df.limit(1).select(html.longest([F.col(c) for c in "abc"], "c")).first()[0] == "c"


@pytest.mark.parametrize("hybrid", [False, True])
def test_retrieve(spark, hybrid):
    md = "# Fruit\n" + "apples and pears grow on many trees here\n" + "# Metal\n" + "iron and copper are mined under ground"
    pages = spark.createDataFrame([(1, "https://github.com/o/r", "Title", md), (2, "u", "", "")], "page_id int, url string, title string, md string")
    asked = spark.createDataFrame([(1, 1, "copper mined"), (1, 2, " "), (2, 1, "x")], "page_id int, query_id int, query string")
    out = {(r["page_id"], r["query_id"]): r for r in retrieve.retrieve(pages, asked, Settings(hybrid=hybrid), HashEmbedder(16)).collect()}
    assert out[1, 1]["chunks"][0]["heading"] == "Metal" and out[1, 1]["chain_hints"]["recommended_followup_filter"] == "site:github.com"
    assert out[1, 2]["error"] == "query is required" and out[2, 1]["error"] == "no content" and out[2, 1]["path"] == "error"


def test_settings(spark):
    spark.conf.set("quarryleaf.rrf_k", "10")
    spark.conf.set("quarryleaf.cache_ttl_s", "bad")
    assert Settings.from_conf(spark).rrf_k == 10 and Settings.from_conf(spark).cache_ttl_s == 300.0
    spark.conf.unset("quarryleaf.rrf_k")
    spark.conf.unset("quarryleaf.cache_ttl_s")


def shuffled(spark):
    """Records that tasks have written for other tasks, by stage."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def _stated(spark):
    texts = [f"common word{i % 7} word{i % 11} often often 가나다 {'rare' if i % 50 == 3 else ''}" for i in range(300)] + [None, "", "日本"]
    chunks = spark.createDataFrame([(g, i, t) for g in ("a", "b") for i, t in enumerate(texts)] + [(None, 1, "common")], "`group` string, idx long, text string")
    asked = [["common", "often", f"word{q % 7}"] for q in range(60)] + [["rare", "rare"], ["unknown"], ["common"], ["나다", "日"]]
    terms = spark.createDataFrame([(g, q, t) for g in ("a", "b", "none") for q, x in enumerate(asked) for t in x], "`group` string, query_id int, term string")
    return chunks, terms


def _places(df):
    return sorted((r["group"], r["query_id"], r["rank"], r["idx"], round(r["score"], 8)) for r in df.collect())


def test_bm25_of_stated_queries(spark):
    chunks, terms = _stated(spark)
    want = _places(ranking.bm25_rank(chunks, terms).where("rank < 10"))
    before = shuffled(spark)
    assert _places(ranking.bm25_top(chunks, terms, 10, stated=True)) == want and len(want) == 2 * 64 * 10
    written = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert written < 300 * 64  # half of the pairs of chunk and query


def test_chunk_budget_of_stated_queries(spark):
    chunks, terms = _stated(spark)
    rows = lambda df: sorted(map(tuple, df.select("group", "idx", "query_id").collect()))
    assert rows(ranking.chunk_budget(chunks, terms, 400, stated=True)) == rows(ranking.chunk_budget(chunks, terms, 400))
