"""Registered queries of profiles, the usage harness and its summaries, with the
same in DuckDB SQL. Importing the module adds them to the catalog."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarryleaf.functions import text
from quarryleaf.operators import evaluation, harness, html, profiles, state
from quarryleaf.plans.catalog import _CASES, _RUNS, _cases, _extractors, _t, query
from quarryleaf.sources.shared import written

# ---------------------------------------------------------------- summaries


@query(_RUNS + """, e AS (SELECT id, 'a' AS extractor FROM x WHERE a_f1 IS NULL UNION ALL SELECT id, 'b' FROM x WHERE b_f1 IS NULL)
SELECT extractor, id, count(*) OVER (PARTITION BY extractor) AS n_err FROM e""")
def extractor_errors(spark, sf_dir):
    each = harness.error_lists(_extractors(spark, sf_dir), "id", {"a": F.col("a_f1").isNull(), "b": F.col("b_f1").isNull()})
    return each.join(each.groupBy("extractor").agg(F.count("*").alias("n_err")), "extractor").select("extractor", "id", "n_err")


@query("""WITH c AS (SELECT event_type, user_id, quantile_cont(value, 0.95) AS p FROM events GROUP BY ALL)
SELECT event_type, count(*) AS cases, round(quantile_cont(p, 0.95), 6) AS p95 FROM c GROUP BY event_type""")
def p95_of_p95s(spark, sf_dir):
    return harness.p95_of_p95s(_t(spark, sf_dir, "events"), ["event_type"], "user_id", "value").withColumn("p95", F.round("p95", 6))


@query(_CASES + """, u AS (SELECT case_id, mode, sum(ms % 97)::BIGINT AS t FROM r GROUP BY ALL), w AS (SELECT arg_min(mode, (t, mode)) AS mode FROM u GROUP BY case_id),
m AS (SELECT mode, count(*) AS n, round(avg(ms % 97), 6) AS tokens, round(avg(ms), 6) AS ms, count_if(ok)::BIGINT AS passed FROM r GROUP BY mode)
SELECT m.*, coalesce((SELECT count(*) FROM w WHERE w.mode = m.mode), 0) AS wins FROM m""")
def mode_averages(spark, sf_dir):
    out = harness.mode_averages(_cases(spark, sf_dir).withColumn("tokens", F.col("ms") % 97))
    return out.select("mode", "n", F.round("tokens", 6).alias("tokens"), F.round("ms", 6).alias("ms"), "passed", "wins")


@query(_CASES + "SELECT count(*) AS n, count_if(NOT ok)::BIGINT AS n_err, CASE WHEN count(*) = 0 OR count_if(NOT ok) >= 0.05 * count(*) THEN 1 ELSE 0 END AS exit_code FROM r")
def error_gate(spark, sf_dir):
    return harness.error_gate(_cases(spark, sf_dir), ~F.col("ok"))


@query("SELECT event_type AS shard, count_if(event_id % 29 <> 0)::BIGINT AS passed, count(*) AS total FROM events GROUP BY GROUPING SETS ((event_type), ())")
def shard_summary(spark, sf_dir):
    return harness.shard_summary(_t(spark, sf_dir, "events").select(F.col("event_type").alias("shard"), (F.col("event_id") % 29 != 0).alias("passed")))


@query("""WITH s AS (SELECT user_id % 20 AS setting, round(avg(value), 6) AS gain, count_if(value < 1)::BIGINT AS regressions FROM events GROUP BY ALL)
SELECT * FROM s ORDER BY gain DESC, regressions, setting LIMIT 1""")
def gate_candidate(spark, sf_dir):
    sweep = _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("setting")).agg(F.round(F.avg("value"), 6).alias("gain"), F.count_if(F.col("value") < 1).alias("regressions"))
    return harness.gate_candidate(sweep)


@query("""WITH s AS (SELECT lang, quantile_cont(length(text), 0.95) AS c, quantile_cont(doc_id % 700, 0.95) AS k, quantile_cont(doc_id % 1100, 0.95) AS ms FROM documents GROUP BY lang)
SELECT lang, CASE (c >= 200000)::INT + (k >= 500)::INT + (ms >= 1000)::INT WHEN 0 THEN 'defer' WHEN 1 THEN 'adopt_narrow' ELSE 'adopt_broad' END AS verdict FROM s""")
def threshold_verdict(spark, sf_dir):
    q = lambda c, name: F.percentile(c, F.lit(0.95)).alias(name)
    s = _t(spark, sf_dir, "documents").groupBy("lang").agg(q(F.length("text"), "c"), q(F.col("doc_id") % 700, "k"), q(F.col("doc_id") % 1100, "ms"))
    return s.select("lang", evaluation.threshold_verdict(F.col("c"), F.col("k"), F.col("ms")).alias("verdict"))


@query("""SELECT doc_id, contains(text, 'the') AND (contains(text, 'and') OR contains(text, lang)) AND 1 >= 1 AND regexp_matches(text, '[Tt]h.{0,3}n') AS passed FROM documents""")
def ground_truth_pass(spark, sf_dir):
    strings = lambda *xs: F.array(*xs)
    return _t(spark, sf_dir, "documents").select("doc_id", evaluation.ground_truth_pass(F.col("text"), strings(F.lit("the")), strings(F.lit("and"), F.col("lang")), F.lit("[Tt]h.{0,3}n"), F.lit(1), 1).alias("passed"))


_W = text.SPACE


@query(f"SELECT doc_id, left(sha1(source || '||' || regexp_replace(regexp_replace(left(text, 80), '^{_W}+', ''), '{_W}+$', '')), 12) AS signature FROM documents")
def rank1_signatures(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.rank1_signature(F.col("source"), F.col("text")).alias("signature"))


@query("""WITH k AS (SELECT user_id, event_id, (value * 100)::DOUBLE AS ms FROM events WHERE value * 100 BETWEEN 0 AND 30000), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50)
SELECT user_id, count(*) AS n, (CASE WHEN count(*) < 5 THEN 15000 ELSE greatest(1500, least(15000, trunc(round(quantile_cont(ms, 0.95) * 1.5, 6))::BIGINT)) END)::BIGINT AS ceiling_ms FROM l GROUP BY user_id""")
def current_ceilings(spark, sf_dir):
    s = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * 100).alias("ms"))
    return state.current_ceilings(s, "user_id", "ms", F.col("event_id").desc()).select("user_id", "n", "ceiling_ms")


@query("""WITH o AS (SELECT 's' || (user_id % 5) AS shard, user_id::VARCHAR AS id, count_if(event_type = 'error') * 5 < count(*) AS passed FROM events GROUP BY user_id)
SELECT shard, md5('## ' || shard || ' — ' || count_if(passed) || '/' || count(*) || chr(10) || chr(10) || '| pattern | category | result | total_p95 |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| `' || id || '` | ' || shard || ' | ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ' | 7ms |', chr(10) ORDER BY id)) AS digest FROM o GROUP BY shard""")
def summary_markdown(spark, sf_dir):
    users = _t(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") * 5 < F.count("*")).alias("passed"))
    shard = F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))
    o = users.select(shard.alias("shard"), F.col("user_id").cast("string").alias("id"), shard.alias("category"), "passed", F.lit(7).alias("total_ms_p95"))
    return harness.summary_markdown(o).select("shard", F.md5(F.col("md").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- patterns


@query("SELECT doc_id AS id, source AS shard, lang AS category FROM documents WHERE source = 'src3' AND lang = 'en' AND doc_id % 3 = 0 ORDER BY doc_id LIMIT 20")
def pattern_selection(spark, sf_dir):
    p = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("shard"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"))).alias("agents"))
    return harness.selected(p, shard="src3", category="en", agent="x", limit=20).select("id", "shard", "category")


def _patterns(spark, sf_dir):
    """Documents as patterns, many of them broken on purpose."""
    i = F.col("doc_id")
    step = lambda op, url, ref: F.struct(op.alias("op"), url.alias("url"), F.lit(None).cast("string").alias("query"), ref.alias("ref"))
    none = F.lit(None).cast("string")
    steps = F.array(step(F.lit("fetch_page"), F.when(i % 5 != 0, F.lit("https://h/")), F.lit(None).cast("int")), step(F.when(i % 7 == 0, "dance").otherwise("profile_page"), F.when(i % 9 == 0, F.lit("https://h/")), F.when(i % 11 == 0, 1).otherwise(0)))
    return _t(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(i % 17 == 0, "nobody").otherwise("somebody"))).alias("agents"), F.when(i % 19 == 0, F.lit("odd")).otherwise(harness.CATEGORIES[0]).alias("category"),
        F.when(i % 23 == 0, F.lit(" ")).otherwise(F.col("lang")).alias("description"), F.when(i % 29 == 0, F.lit("maybe")).alias("live"), F.when(i % 2 == 0, F.when(i % 31 == 0, F.lit("")).otherwise(F.lit("https://h/"))).alias("url"), none.alias("query"), F.when((i % 2 == 1) | (i % 37 == 0), steps).alias("steps"),
    )


_RULES = [
    ("agents", "i % 13 = 0"), ("unknown agent", "i % 13 <> 0 AND i % 17 = 0"), ("category", "i % 19 = 0"), ("description", "i % 23 = 0 OR trim(coalesce(lang, '')) = ''"), ("live", "i % 29 = 0"), ("both forms", "i % 2 = 0 AND i % 37 = 0"),
    ("url", "i % 2 = 0 AND i % 37 <> 0 AND i % 31 = 0"), ("step op", "(i % 2 = 1 OR i % 37 = 0) AND i % 7 = 0"), ("step ref", "(i % 2 = 1 OR i % 37 = 0) AND i % 11 = 0"), ("step ref and url", "(i % 2 = 1 OR i % 37 = 0) AND i % 9 = 0"), ("step url", "(i % 2 = 1 OR i % 37 = 0) AND i % 5 = 0"),
]


@query(" UNION ALL ".join(f"SELECT doc_id::VARCHAR AS id, '{name}' AS problem FROM (SELECT *, doc_id AS i FROM documents) WHERE {rule}" for name, rule in _RULES))
def pattern_violations(spark, sf_dir):
    return harness.violations(_patterns(spark, sf_dir), ["somebody"])


_EXPECTED = {
    "chunks_contain_all": ["the", "an"], "chunks_contain_any": ["zzz", "ing"], "chunks_contain_pattern": "[Tt]h.{0,3}n", "n_chunks_returned": ">= 2", "profile_used": True, "path": "raw_passthrough", "fetcher_used": "src3", "error_is_none": True,
    "error_contains": "boom", "suggest_profile": False, "content_type": "en", "truncated": True, "excerpts_min_count": 2, "outbound_links_contain_any": ["/src1"], "page_entities_contain_any": ["src2"], "chain_hints_has_key": "fr", "cache_hit": False,
}

_MET = {
    "chunks_contain_all": "contains(b, 'the') AND contains(b, 'an')", "chunks_contain_any": "contains(b, 'zzz') OR contains(b, 'ing')", "chunks_contain_pattern": "regexp_matches(b, '[Tt]h.{0,3}n')", "n_chunks_returned": "1 + (i % 2) >= 2", "profile_used": "i % 2 = 0",
    "path": "i % 4 = 1", "fetcher_used": "source = 'src3'", "error_is_none": "i % 10 <> 0", "error_contains": "i % 10 = 0", "suggest_profile": "i % 3 <> 0", "content_type": "coalesce(lang = 'en', false)", "truncated": "i % 5 = 0", "excerpts_min_count": "i % 4 >= 2",
    "outbound_links_contain_any": "contains('https://h/' || source, '/src1')", "page_entities_contain_any": "contains(source, 'src2')", "chain_hints_has_key": "coalesce(lang = 'fr', false)", "cache_hit": "i % 7 <> 0",
}


def _measured_runs(spark, sf_dir):
    """Documents as what runs have measured."""
    i, source = F.col("doc_id"), F.col("source")
    chunk = F.struct(source.alias("heading"), F.col("text").alias("text"))
    return _t(spark, sf_dir, "documents").select(
        i.alias("id"), F.when(i % 2 == 1, F.array(chunk, chunk)).otherwise(F.array(chunk)).alias("chunks"), F.when(i % 4 == 1, "raw_passthrough").otherwise("full_page_retrieval").alias("path"), source.alias("fetcher_used"), F.when(i % 10 == 0, "a boom").alias("error"), F.col("lang").alias("content_type"),
        (i % 2 == 0).alias("profile_used"), (i % 3 == 0).alias("suggest_profile"), (i % 5 == 0).alias("truncated"), (i % 7 == 0).alias("cache_hit"), F.slice(F.array(*map(F.lit, "abc")), 1, (i % 4).cast("int")).alias("excerpts"),
        F.array(F.struct(F.concat(F.lit("https://h/"), source).alias("url"), F.col("lang").alias("anchor_text"))).alias("outbound_links"), F.array(source).alias("page_entities"), F.when(F.col("lang").isNotNull(), F.create_map(F.col("lang"), F.lit("x"))).alias("chain_hints"),
        F.length("text").cast("long").alias("output_chars"), (i * 37 % 5000).alias("total_ms_p95"),
    )


@query("WITH d AS (SELECT *, doc_id AS i, source || chr(10) || text AS b FROM documents) " + " UNION ALL ".join(f"SELECT i AS id, '{k}' AS key FROM d WHERE NOT ({met})" for k, met in _MET.items()))
def assertion_checks(spark, sf_dir):
    runs = _measured_runs(spark, sf_dir)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(json.dumps(v)).alias("expected")) for k, v in _EXPECTED.items()))).alias("x")
    return harness.assertion_failures(runs, runs.select("id", rows).select("id", "x.*")).select("id", "key")


@query("""WITH a AS (SELECT doc_id AS id, unnest([{'k': 'chunks_contain_all', 'e': CASE WHEN doc_id % 2 = 0 THEN '[]' ELSE '["a"]' END}, {'k': 'path', 'e': CASE WHEN doc_id % 3 = 0 THEN '7' ELSE '"x"' END}, {'k': 'truncated', 'e': CASE WHEN doc_id % 5 = 0 THEN '"yes"' ELSE 'true' END}, {'k': 'n_chunks_returned', 'e': CASE WHEN doc_id % 7 = 0 THEN '"about 3"' ELSE '">= 3"' END}, {'k': source, 'e': '1'}]) AS x, doc_id AS i FROM documents)
SELECT id, x.k AS key, CASE x.k WHEN 'chunks_contain_all' THEN 'not strings' WHEN 'path' THEN 'not string' WHEN 'truncated' THEN 'not bool' WHEN 'n_chunks_returned' THEN 'not comparison' ELSE 'unknown key' END AS problem FROM a
WHERE NOT ((x.k = 'chunks_contain_all' AND i % 2 <> 0) OR (x.k = 'path' AND i % 3 <> 0) OR (x.k = 'truncated' AND i % 5 <> 0) OR (x.k = 'n_chunks_returned' AND i % 7 <> 0))""")
def bad_assertions(spark, sf_dir):
    i = F.col("doc_id")
    each = [("chunks_contain_all", F.when(i % 2 == 0, "[]").otherwise('["a"]')), ("path", F.when(i % 3 == 0, "7").otherwise('"x"')), ("truncated", F.when(i % 5 == 0, '"yes"').otherwise("true")), ("n_chunks_returned", F.when(i % 7 == 0, '"about 3"').otherwise('">= 3"'))]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), e.alias("expected")) for k, e in each), F.struct(F.col("source").alias("key"), F.lit("1").alias("expected")))).alias("x")
    return harness.bad_assertions(_t(spark, sf_dir, "documents").select(i.alias("id"), rows).select("id", "x.*"))


@query("""WITH d AS (SELECT doc_id AS id, (doc_id * 37 % 5000)::DOUBLE AS ms, length(text)::DOUBLE AS n, (1 + doc_id % 2)::DOUBLE AS k FROM documents)
SELECT id, 'total_ms_p95' AS budget, ms AS actual FROM d WHERE ms > 4000 UNION ALL SELECT id, 'output_chars_max', n FROM d WHERE n > 3000 UNION ALL SELECT id, 'n_chunks_max', k FROM d WHERE k > 1""")
def budget_checks(spark, sf_dir):
    runs = _measured_runs(spark, sf_dir)
    caps = F.explode(F.array(*(F.struct(F.lit(k).alias("budget"), F.lit(v).alias("cap")) for k, v in (("total_ms_p95", 4000.0), ("output_chars_max", 3000.0), ("n_chunks_max", 1.0))))).alias("x")
    return harness.budget_failures(runs, runs.select("id", caps).select("id", "x.*")).select("id", "budget", "actual")


# ---------------------------------------------------------------- profiles and trees


@query("""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script[^>]*>).*?</script>', '\\1', 'g') AS h FROM pages),
e AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][^\\s>/]*)', 1))) AS tag FROM h)
SELECT tag, count(*) AS n_elements, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM e GROUP BY tag""")
def element_catalogue(spark, sf_dir):
    return harness.element_catalogue(html.dom_nodes(_t(spark, sf_dir, "pages").select("page_id", "html")), "page_id")


def _page_profiles(spark, sf_dir):
    """Each page's main content by its first level-one heading: that element,
    not another that repeats its words."""
    pages = _t(spark, sf_dir, "pages")
    nodes = written(html.dom_nodes(pages.select("page_id", "html")), "nodes")
    first = nodes.where("tag = 'h1'").groupBy("page_id").agg(F.min_by("text", "node").alias("anchor"), F.min("node").alias("within"))
    return nodes, profiles.mapped(nodes, first, "page_id")


@query("SELECT page_id, 'article' AS lca_tag, 'body:nth-of-type(1) > article:nth-of-type(1)' AS selector, 0::BIGINT AS n_missed FROM pages WHERE contains(html, '<h1>')")
def page_profiles(spark, sf_dir):
    return _page_profiles(spark, sf_dir)[1].select("page_id", "lca_tag", "selector", F.size("missed").cast("long").alias("n_missed"))


@query("SELECT page_id, page_id % 2 = 1 AS drifted FROM pages WHERE contains(html, '<h1>')")
def profile_drift(spark, sf_dir):
    """Profiles are applied to the pages that they were made from; of every
    second page an anchor has changed since."""
    nodes, made = _page_profiles(spark, sf_dir)
    anchors = F.when(F.col("page_id") % 2 == 1, F.array(F.lit("no such words"))).otherwise(F.col("anchors"))
    return profiles.subtree(nodes, made.select("page_id", "selector", anchors.alias("anchors")), "page_id").select("page_id", "drifted")


@query("""WITH p AS (SELECT url, arg_max(page_id, page_id) AS profile_of FROM pages WHERE page_id % 4 = 0 GROUP BY url)
SELECT page_id, profile_of FROM pages LEFT JOIN p USING (url)""")
def profile_lookup(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    stored = pages.where("page_id % 4 = 0").select(text.url_hash(F.col("url")).alias("url_hash"), F.col("page_id").alias("generated_at"), F.lit("main").alias("selector"))
    return profiles.lookup(pages, stored).select("page_id", F.col("profile.generated_at").alias("profile_of"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS page_id, CASE WHEN n <= 4 THEN 'profile_direct' WHEN conv_id % 3 = 0 THEN 'profile_retrieval' ELSE 'profile_direct_large' END AS path, CASE WHEN n > 4 AND conv_id % 3 = 0 THEN 2 ELSE n END AS returned, CASE WHEN n > 4 AND conv_id % 3 = 0 THEN conv_id END AS ranked_for FROM n""")
def profile_branches(spark, sf_dir):
    chunks = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), "turn")
    asked = chunks.select("page_id").distinct().withColumn("has_query", F.col("page_id") % 3 == 0)
    ways = profiles.branch(chunks, asked, 4)
    way = lambda path: ways.where(F.col("path") == path).select("page_id", "path", "n_chunks")
    direct = way("profile_direct").select("page_id", "path", F.col("n_chunks").alias("returned"))
    large = way("profile_direct_large").select("page_id", "path", F.col("n_chunks").alias("returned"))
    retrieved = way("profile_retrieval").select("page_id", "path", F.lit(2).cast("long").alias("returned"), F.col("page_id").alias("ranked_for"))
    return profiles.branched(direct, retrieved, large).select("page_id", "path", "returned", "ranked_for")
