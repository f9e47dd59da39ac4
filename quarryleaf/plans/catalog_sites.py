"""Registered queries of site readers, probes and provider fallbacks, with the
same in DuckDB SQL. Importing the module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import html, ranking, state
from quarryleaf.plans.catalog import _COS, _label_queries, _t, query
from quarryleaf.sources import pages as readers
from quarryleaf.sources import routes


def _escaped(c: str):
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


_TRIMMED = "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"


@query(f"SELECT doc_id, md5(array_to_string(list_filter([source, '```', {_TRIMMED}, '```', coalesce(lang, '')], lambda x: x <> ''), chr(10))) AS digest FROM documents")
def fenced_lines(spark, sf_dir):
    """Each document as the code block of an answer."""
    body = F.concat(F.lit("<p>"), "source", F.lit("</p><!-- x --><pre class='c'><code>"), _escaped("text"), F.lit("</code></pre><p> "), F.coalesce("lang", F.lit("")), F.lit("</p>"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(html.fenced_lines(body).cast("binary")).alias("digest"))


@query("""WITH a AS (SELECT conv_id, turn, (turn * 7 % 5)::INT AS score, turn = 3 AS accepted, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM conversations),
m AS (SELECT conv_id, string_agg('---' || chr(10) || chr(10) || '## Answer (score: ' || score || CASE WHEN accepted THEN ', accepted' ELSE ',' END || ')' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY NOT accepted, -score, body) AS md FROM a WHERE turn > 0 GROUP BY conv_id)
SELECT q.conv_id, md5('# ' || q.conv_id || chr(10) || chr(10) || 'Tags: a, b' || chr(10) || chr(10) || q.body || coalesce(chr(10) || chr(10) || m.md, '')) AS digest FROM a q LEFT JOIN m USING (conv_id) WHERE q.turn = 0""")
def stack_pages(spark, sf_dir):
    """A conversation's first turn is a question, the others are its answers."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", html.fenced_lines(F.concat(F.lit("<p>"), _escaped("text"), F.lit("</p>"))).alias("body"))
    asked = turns.where("turn = 0").select("conv_id", F.col("conv_id").cast("string").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("tags"), "body")
    answers = turns.where("turn > 0").select("conv_id", (F.col("turn") == 3).alias("accepted"), (F.col("turn") * 7 % 5).cast("int").alias("score"), "body")
    return readers.stack_markdown(answers, "conv_id", asked).select("conv_id", F.md5(F.col("md").cast("binary")).alias("digest"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE '# ' || source || chr(10) || chr(10) || 'State: open' || CASE WHEN doc_id % 3 = 1 THEN '  Labels: l1, ' || lang ELSE '' END || chr(10) || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END END) AS digest
FROM documents WHERE lang IS NOT NULL""")
def github_pages(spark, sf_dir):
    """Documents as files and issues of a repository, by way of the JSON that a
    server answers."""
    i, labels = F.col("doc_id"), F.array(F.struct(F.lit("l1").alias("name")), F.struct(F.col("lang").alias("name")))
    issue = F.to_json(F.struct(F.col("source").alias("title"), F.lit("open").alias("state"), F.when(i % 3 == 1, labels).alias("labels"), F.when(i % 5 != 0, F.col("text")).alias("body")))
    blob = F.to_json(F.struct(F.base64(F.col("text").cast("binary")).alias("content")))
    d = _t(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.when(i % 3 == 0, "blob").when(i % 3 == 1, "issue").otherwise("pull").alias("kind"), F.when(i % 3 == 0, blob).otherwise(issue).alias("response"))
    return d.select("doc_id", F.md5(readers.github_markdown(F.col("kind"), F.col("response")).cast("binary")).alias("digest"))


@query("SELECT page_id, CASE WHEN page_id % 4 < 2 THEN html END AS html FROM pages")
def wikipedia_articles(spark, sf_dir):
    """Pages as the articles in a server's answers; some are errors or empty."""
    i = F.col("page_id")
    text = lambda c: F.to_json(F.struct(F.struct(F.create_map(F.lit("*"), c).alias("text")).alias("parse")))
    response = F.when(i % 4 < 2, text(F.col("html"))).when(i % 4 == 2, text(F.lit(""))).otherwise('{"error":{"info":"missing"}}')
    return _t(spark, sf_dir, "pages").select("page_id", readers.wikipedia_html(response).alias("html"))


_PROBES = ["application/pdf", "Application/PDF; x=1", "text/html", "application/json", "application/pdfx"]


@query("""WITH p AS (SELECT page_id, ['application/pdf', 'Application/PDF; x=1', 'text/html', 'application/json', 'application/pdfx'][(page_id % 5 + 1)::INT] AS t, CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS s FROM pages)
SELECT page_id, coalesce(s < 400 AND page_id % 5 < 2, false) AS pdf, CASE WHEN s < 400 AND page_id % 5 = 3 THEN t END AS passed FROM p""")
def probe_answers(spark, sf_dir):
    """What a HEAD request's status and type say; a third of them failed."""
    i = F.col("page_id")
    p = _t(spark, sf_dir, "pages").select("page_id", F.array(*map(F.lit, _PROBES))[(i % 5).cast("int")].alias("t"), F.when(i % 3 == 0, 200).when(i % 3 == 1, 404).alias("s"))
    return p.select("page_id", routes.is_pdf_response(F.col("s"), F.col("t")).alias("pdf"), routes.passthrough_response(F.col("s"), F.col("t")).alias("passed"))


@query("""WITH e AS (SELECT user_id, event_id, 100 + ((event_id // 700) % 9) * 50 AS len, CASE event_id % 4 WHEN 0 THEN repeat('-', 60) WHEN 1 THEN repeat('word ', 20) WHEN 2 THEN 'loading' END AS sel FROM events), c AS (SELECT *, CASE WHEN lag(len) OVER w IS NULL OR len <> lag(len) OVER w OR len <= 100 THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY event_id) - 1 AS run FROM i)
SELECT user_id, min(event_id) AS ready_at FROM r WHERE run >= 4 AND len > 100 AND coalesce(event_id % 4 = 1, false) GROUP BY user_id""")
def ready_after(spark, sf_dir):
    """As stable_after, and the profile's selector must show content."""
    i = F.col("event_id")
    selected = F.when(i % 4 == 0, F.repeat(F.lit("-"), 60)).when(i % 4 == 1, F.repeat(F.lit("word "), 20)).when(i % 4 == 2, "loading")
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", (100 + (F.floor(i / 700) % 9) * 50).alias("len"), selected.alias("selected"))
    return state.stable_after(e, "user_id", "event_id", "len", ready=state.shown(F.col("selected")))


@query(_COS + """, c AS (SELECT query_id, idx, rank, CASE WHEN query_id % 3 <> 0 THEN (idx % 17) / 17.0::DOUBLE END AS s FROM d WHERE rank < 20)
SELECT query_id, idx AS vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) - 1 AS place FROM c) WHERE place < 10""")
def rerank_fallback(spark, sf_dir):
    """The provider fails for a third of the queries, which keep the dense order."""
    c = ranking.dense_top_k(*_label_queries(spark, sf_dir), 20)
    out = ranking.rerank(c, 10, F.when(F.col("query_id") % 3 != 0, (F.col("idx") % 17) / F.lit(17.0)))
    return out.select("query_id", F.col("idx").alias("vec_id"), "place")
