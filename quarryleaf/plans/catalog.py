"""The registered queries of the reference's operators, over whole tables, and
the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryleaf.functions import stats, text, vectors
from quarryleaf.operators import chunking, enrichment, evaluation, html, ranking, state
from quarryleaf.plans import retrieve
from quarryleaf.sources import pages as readers
from quarryleaf.sources import routes
from quarryleaf.sources.shared import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


W = text.SPACE
_SQUEEZE = f"trim(regexp_replace(%s, '{W}+', ' ', 'g'))"
_STRIP = f"regexp_replace(regexp_replace(%s, '^{W}+', ''), '{W}+$', '')"

# ---------------------------------------------------------------- text


@query(f"""SELECT doc_id, {_SQUEEZE % "regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://\\S+', '', 'g')"} AS plain FROM documents""")
def plain_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.plain_text(F.col("text")).alias("plain"))


_TOKENS = """list_concat(list_concat(regexp_extract_all(lower(text), '[a-z][a-z0-9_]*'),
  flatten(list_transform(regexp_extract_all(lower(text), '[가-힣]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))),
  regexp_extract_all(lower(text), '[぀-ヿ㐀-鿿]'))"""


@query(f"SELECT doc_id, len(k)::BIGINT AS n, md5(coalesce(array_to_string(k, ' '), '')) AS digest FROM (SELECT doc_id, {_TOKENS} AS k FROM documents)")
def bm25_tokens(spark, sf_dir):
    out = _t(spark, sf_dir, "documents").select("doc_id", text.bm25_tokens(F.col("text")).alias("k"))
    return out.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ").cast("binary")).alias("digest"))


@query("SELECT doc_id, len(k)::BIGINT AS n, len(list_distinct(k))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS k FROM documents)")
def word_counts(spark, sf_dir):
    out = _t(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("k"))
    return out.select("doc_id", F.size("k").cast("long").alias("n"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"))


@query("""SELECT doc_id, trunc((length(text) - c) / 4.0::DOUBLE + c / 1.5::DOUBLE)::BIGINT AS tokens, length(text) // 3 AS crude
FROM (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[一-鿿가-힯぀-ヿ]', '', 'g')) AS c FROM documents)""")
def token_estimates(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.crude_tokens(F.length("text")).alias("crude"))


@query("""SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS digest
FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?。！？])[\\t-\\r ]*', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)""")
def sentence_splits(spark, sf_dir):
    out = _t(spark, sf_dir, "documents").select("doc_id", F.filter(text.sentences(F.col("text")), lambda s: s != "").alias("s"))
    return out.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '(?m)^#{1,6}[ \\t]+', '', 'g'), '\\*{1,2}([^*\\n]+)\\*{1,2}', '\\1', 'g'), '`([^`\\n]+)`', '\\1', 'g')"


@query(f"""WITH a AS (SELECT doc_id, {_STRIP % f"split_part({_STRIP % _CLEAN}, chr(10), 1)"} AS line FROM documents),
b AS (SELECT doc_id, split_part(regexp_replace(line, '([.!?。！？])[\\t-\\r ]+', '\\1' || chr(1)), chr(1), 1) AS s FROM a)
SELECT doc_id, CASE WHEN length(s) > 120 THEN regexp_replace(left(s, 119), '{W}+$', '') || '…' ELSE s END AS excerpt FROM b""")
def excerpts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT doc_id, length(d)::BIGINT AS n, md5(d) AS digest, md5(r) AS rerank_digest FROM (SELECT doc_id,
 left(CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || chr(10) || text ELSE text END, 1800) AS d,
 CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'Title: ' || lang || chr(10) || 'Section: ' || source || chr(10) || chr(10) || text
      WHEN doc_id % 2 = 0 THEN 'Title: ' || lang || chr(10) || chr(10) || text
      WHEN doc_id % 3 = 0 THEN source || chr(10) || chr(10) || text ELSE text END AS r FROM documents)""")
def model_inputs(spark, sf_dir):
    heading = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")
    title = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    out = _t(spark, sf_dir, "documents").select("doc_id", text.embedding_input(heading, F.lit(""), F.col("text")).alias("d"), text.rerank_document(title, heading, F.col("text")).alias("r"))
    return out.select("doc_id", F.length("d").cast("long").alias("n"), F.md5(F.col("d").cast("binary")).alias("digest"), F.md5(F.col("r").cast("binary")).alias("rerank_digest"))


@query("""WITH c AS (SELECT source, count(*) AS n, max(length(text)) AS m FROM documents GROUP BY source)
SELECT source, n, (CASE WHEN n < 30 THEN least(8, greatest(5, n // 2 + 2)) WHEN n < 100 THEN 8 WHEN n < 200 THEN 10 ELSE 12 END)::BIGINT AS k, (CASE WHEN m < 20000 THEN 900 ELSE 450 END)::BIGINT AS most FROM c""")
def adaptive_k(spark, sf_dir):
    c = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max_by("text", F.length("text")).alias("longest"))
    return c.select("source", "n", text.adaptive_k(F.col("n")).alias("k"), text.max_chunk_chars(F.col("longest")).alias("most"))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP % 'x'}), lambda x: length(x) BETWEEN 5 AND 50)[1:3]"


@query(f"""WITH a AS (SELECT doc_id, text, {_LINES} AS anchors FROM documents),
b AS (SELECT doc_id, anchors, list_filter(string_split({_SQUEEZE % "coalesce(anchors[1], '')"}, ' '), lambda t: t <> '') AS toks, {_SQUEEZE % "text"} AS norm FROM a)
SELECT doc_id, array_to_string(anchors, '|') AS anchors, len(toks) > 0 AND len(list_filter(toks, lambda t: NOT contains(norm, t))) = 0 AS found FROM b""")
def page_anchors(spark, sf_dir):
    a = _t(spark, sf_dir, "documents").select("doc_id", "text", text.fresh_anchors(F.col("text")).alias("anchors"))
    return a.select("doc_id", F.array_join("anchors", "|").alias("anchors"), text.contains_all_tokens(F.col("text"), F.coalesce(F.get("anchors", F.lit(0)), F.lit(""))).alias("found"))


@query("""SELECT d.doc_id, len(list_filter(s.snips, lambda x: x <> '' AND contains(lower(d.text), lower(x))))::BIGINT AS hits
FROM documents d, (SELECT list(text ORDER BY item_id) AS snips FROM benchmark) s""")
def snippet_hits(spark, sf_dir):
    snips = _t(spark, sf_dir, "benchmark").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.col("text").alias("s")))), lambda x: x["s"]).alias("snips"))
    return _t(spark, sf_dir, "documents").crossJoin(snips).select("doc_id", text.snippet_hits(F.col("text"), F.col("snips")).alias("hits"))


# ---------------------------------------------------------------- pages and URLs

_AUTH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(f"""SELECT page_id, left(sha1(url), 12) AS url_hash, sha256(url) AS cache_key, left(sha1(url), 16) AS query_hash, {_AUTH} AS authority, lower({_AUTH}) AS netloc,
 lower(regexp_replace(regexp_replace({_AUTH}, '^.*@', ''), ':\\d*$', '')) AS host FROM pages""")
def url_keys(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", text.url_hash(u).alias("url_hash"), text.cache_key(u).alias("cache_key"), text.query_hash(u).alias("query_hash"), text.authority(u).alias("authority"), text.netloc(u).alias("netloc"), text.host(u).alias("host"))


_SAMPLE_URLS = ["https://youtu.be/abcdefghi%02d", "https://www.youtube.com/watch?t=1&v=abcdefghi%02d", "https://github.com/o/r%02d", "https://github.com/o/r/issues/%02d", "https://github.com/o/r/blob/main/src/f%02d.py", "https://stackoverflow.com/questions/%02d/title", "https://unix.stackexchange.com/a/%02d", "https://en.wikipedia.org/wiki/Page_%02d", "https://ko.m.wikipedia.org/wiki/File:%02d", "https://x.example.com/doc/%02d.PDF", "https://x.example.com/feed%02d.rss?x=1"]


def _sample_url():
    """Every page's URL, or one of a known site by page_id."""
    out = F.col("url")
    for i, u in enumerate(_SAMPLE_URLS):
        out = F.when(F.col("page_id") % 12 == i, F.format_string(u, (F.col("page_id") % 100).cast("int"))).otherwise(out)
    return out


_SAMPLE_SQL = "CASE " + " ".join(f"WHEN page_id % 12 = {i} THEN printf('{u}', (page_id % 100)::INT)" for i, u in enumerate(_SAMPLE_URLS)) + " ELSE url END"


@query(f"""WITH u AS (SELECT page_id, {_SAMPLE_SQL} AS u FROM pages), p AS (SELECT *, lower(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)) AS h, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\\?([^#]*)', 1) AS q FROM u),
r AS (SELECT *, CASE WHEN h = 'youtu.be' THEN regexp_extract(path, '^/([A-Za-z0-9_-]{{11}})(/|$)', 1) WHEN h IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') AND path = '/watch' THEN regexp_extract('&' || q, '&v=([A-Za-z0-9_-]{{11}})(&|$)', 1) ELSE '' END AS yt,
 CASE WHEN h IN ('github.com', 'www.github.com') THEN CASE WHEN regexp_matches(path, '^/[^/]+/[^/]+/?$') THEN 'readme' WHEN regexp_matches(path, '^/[^/]+/[^/]+/issues/[0-9]+') THEN 'issue' WHEN regexp_matches(path, '^/[^/]+/[^/]+/blob/[^/]+/.') THEN 'blob' END END AS gh,
 CASE WHEN h = 'stackoverflow.com' OR h LIKE '%.stackexchange.com' THEN regexp_extract(path, '^/(questions|q|a)/(\\d+)', 2) ELSE '' END AS se,
 CASE WHEN regexp_matches(h, '^[a-z]{{2,3}}(\\.m)?\\.wikipedia\\.org$') AND NOT path LIKE '/wiki/File:%' THEN regexp_extract(path, '^/wiki/(.+)$', 1) ELSE '' END AS wiki FROM p)
SELECT page_id, CASE WHEN lower(u) LIKE '%.pdf' OR contains(lower(u), '/pdf/') THEN 'pdf' WHEN regexp_matches(lower(path), '\\.(json|xml|rss|atom)$') THEN 'passthrough' WHEN yt <> '' THEN 'youtube' WHEN gh IS NOT NULL THEN 'github' WHEN se <> '' THEN 'stackexchange' WHEN wiki <> '' THEN 'wikipedia' ELSE 'browser' END AS route,
 nullif(yt, '') AS video, gh AS github_kind, nullif(se, '') AS post, nullif(wiki, '') AS title FROM r""")
def url_routes(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", _sample_url().alias("u"))
    u = F.col("u")
    return p.select("page_id", routes.route(u).alias("route"), routes.youtube_id(u).alias("video"), routes.github_route(u)["kind"].alias("github_kind"), routes.stack_route(u)["post"].alias("post"), routes.wikipedia_route(u)["title"].alias("title"))


@query(f"""WITH u AS (SELECT page_id, lower(regexp_extract({_SAMPLE_SQL}, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN h IN ('github.com', 'en.wikipedia.org', 'youtube.com', 'www.youtube.com', 'stackoverflow.com') THEN 'site:' || CASE WHEN h = 'www.youtube.com' THEN 'youtube.com' ELSE h END END AS followup FROM u""")
def followup_hints(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", enrichment.chain_hints(_sample_url()).alias("m"))
    return p.select("page_id", F.try_element_at("m", F.lit("recommended_followup_filter")).alias("followup"))


_TYPES = ["application/json; charset=utf-8", "TEXT/XML", "text/html", "application/ld+json", " application/rss+xml ;q=1", ""]


@query("SELECT page_id, page_id % 6 IN (0, 1, 3, 4) AS raw, CASE WHEN page_id % 6 = 0 THEN 'utf-8' END AS charset FROM pages")
def content_types(spark, sf_dir):
    c = F.array(*map(F.lit, _TYPES))[(F.col("page_id") % 6).cast("int")]
    return _t(spark, sf_dir, "pages").select("page_id", routes.is_passthrough_type(c).alias("raw"), readers.charset(c).alias("charset"))


@query("SELECT page_id, least(strlen(html), 4096)::BIGINT AS n, strlen(html) > 4096 AS truncated, CASE WHEN strlen(html) = 0 THEN 'empty body' END AS error, strlen(html)::BIGINT AS full_bytes FROM pages")
def raw_bodies(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("full_bytes"), *readers.truncated_body(F.col("html").cast("binary"), 4096))
    return p.select("page_id", F.octet_length("body").cast("long").alias("n"), "truncated", "error", "full_bytes")


def _unescape_sql(e: str) -> str:
    for name, char in html._ENTITIES:
        char = char.replace("'", "''")
        e = f"replace({e}, '{name}', '{char}')"
    return e


def _strip_sql() -> str:
    e = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in [*html.NOISE_TAGS, "title"]:
        e = f"regexp_replace({e}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    nodes = f"string_split(regexp_replace({e}, '(?s)<[^>]*>', chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({nodes}, lambda t: trim(regexp_replace({_unescape_sql('t')}, '[\\t-\\r ]+', ' ', 'g'))), lambda t: t <> '')"


_TITLE = f"trim(regexp_replace({_unescape_sql("regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '(?s)<[^>]*>', '', 'g')")}, '[\\t-\\r ]+', ' ', 'g'))"


@query(f"SELECT page_id, {_TITLE} AS title, array_to_string({_strip_sql()}, chr(10)) AS body FROM pages")
def html_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html"), F.lit("")).alias("title"), html.strip_html(F.col("html")).alias("body"))


_NAMES = "[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)+"


@query(f"""WITH a AS (SELECT page_id, list_concat(regexp_extract_all(t, '{_NAMES}'), list_concat(regexp_extract_all(t, '[가-힣]{{2,}}'), list_concat(regexp_extract_all(b, '{_NAMES}'), regexp_extract_all(b, '[가-힣]{{2,}}')))) AS l FROM (SELECT page_id, {_TITLE} AS t, array_to_string({_strip_sql()}, chr(10)) AS b FROM pages)),
b AS (SELECT page_id, e, min(o) AS o FROM (SELECT page_id, unnest(l) AS e, generate_subscripts(l, 1) AS o FROM a) GROUP BY page_id, e)
SELECT a.page_id, coalesce(string_agg(b.e, '|' ORDER BY b.o) FILTER (b.o IS NOT NULL), '') AS names FROM a LEFT JOIN (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY o) <= 20) b USING (page_id) GROUP BY a.page_id""")
def page_entities(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.array(html.page_title(F.col("html"), F.lit("")), html.strip_html(F.col("html"))).alias("s"))
    return p.select("page_id", F.array_join(text.entities(F.col("s")), "|").alias("names"))


@query("""WITH m AS (SELECT page_id, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\\2](https://s.example.com\\1)', 'g') AS t FROM pages),
f AS (SELECT page_id, unnest(list_transform(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^)\\s]+)\\)', 1), lambda x: regexp_replace(regexp_replace(x, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', ''))) AS anchor_text, unnest(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^)\\s]+)\\)', 2)) AS url, unnest(range(len(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^)\\s]+)\\)', 1)))) AS pos FROM m),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, url, anchor_text ORDER BY pos) = 1),
c AS (SELECT *, sum(length(url) + length(anchor_text) + 32) OVER (PARTITION BY page_id ORDER BY pos) AS b, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS ord FROM o)
SELECT page_id, url, anchor_text, ord FROM c WHERE b <= 10240 AND ord < 50""")
def outbound_links(spark, sf_dir):
    md = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2](https://s.example.com$1)")
    chunks = _t(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("chunk_index"), md.alias("text"))
    return enrichment.outbound_links(chunks, "page_id").select("page_id", "url", "anchor_text", "ord")


# ---------------------------------------------------------------- ranking

_BM25 = f"""WITH tok AS (SELECT lang AS g, doc_id AS idx, {_TOKENS} AS k FROM documents),
sz AS (SELECT g, count(*) AS n, avg(len(k)) AS avgdl FROM tok GROUP BY g),
tf AS (SELECT g, idx, dl, term, count(*) AS tf FROM (SELECT g, idx, len(k) AS dl, unnest(k) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT tf.g, term, any_value(avgdl) AS avgdl, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN sz USING (g) GROUP BY tf.g, term),
idf AS (SELECT g, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY g) ELSE raw END AS idf FROM raw),
qt AS (SELECT g, query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark), (SELECT DISTINCT lang AS g FROM documents) GROUP BY ALL),
sc AS (SELECT tf.g, idx, query_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN idf USING (g, term) JOIN qt USING (g, term) GROUP BY ALL),
al AS (SELECT t.g, t.idx, q.query_id, coalesce(score, 0) AS score FROM tok t JOIN (SELECT DISTINCT g, query_id FROM qt) q USING (g) LEFT JOIN sc ON sc.g = t.g AND sc.idx = t.idx AND sc.query_id = q.query_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY g, query_id ORDER BY round(score, 9) DESC, idx) - 1 AS rank FROM al)
"""


def _corpus(spark, sf_dir):
    """Documents of a language are a corpus; the tokens of each benchmark
    item are a query of each."""
    docs = _t(spark, sf_dir, "documents")
    corpus = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("idx"), "text")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.bm25_tokens(F.col("text"))).alias("term"))
    return corpus, docs.select(F.col("lang").alias("group")).distinct().crossJoin(asked)


@query(_BM25 + "SELECT g AS lang, query_id, idx AS doc_id, rank, round(score, 6) AS score FROM rk WHERE rank < 10")
def bm25_topk(spark, sf_dir):
    out = ranking.bm25_top(*_corpus(spark, sf_dir), 10, stated=True)
    return out.select(F.col("group").alias("lang"), "query_id", F.col("idx").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT g AS lang, query_id, count(*) AS kept, sum(idx)::BIGINT AS id_sum FROM rk WHERE rank < 100 GROUP BY g, query_id")
def chunk_budget(spark, sf_dir):
    kept = ranking.chunk_budget(*_corpus(spark, sf_dir), stated=True)
    return kept.groupBy(F.col("group").alias("lang"), "query_id").agg(F.count("*").alias("kept"), F.sum("idx").alias("id_sum"))


_COS = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT label AS query_id, list(a ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label),
s AS (SELECT query_id, vec_id AS idx, list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) AS score FROM e, q),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx) - 1 AS rank FROM s)
"""


def _label_queries(spark, sf_dir):
    """The mean vector of each label is a query."""
    e = _t(spark, sf_dir, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("query"))
    return e.select(F.col("vec_id").alias("idx"), "embedding"), means.withColumnRenamed("label", "query_id")


@query(_COS + "SELECT query_id, idx AS vec_id, rank, round(score, 6) AS score FROM d WHERE rank < 10")
def cosine_topk(spark, sf_dir):
    out = ranking.dense_top_k(*_label_queries(spark, sf_dir), 10)
    return out.select("query_id", F.col("idx").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(_COS + "SELECT query_id, round(sqrt(list_inner_product(q, q)), 6) AS norm, round(q[1], 6) AS first_value, len(q)::BIGINT AS n FROM q")
def mean_query_vectors(spark, sf_dir):
    _, q = _label_queries(spark, sf_dir)
    return q.select("query_id", F.round(F.sqrt(vectors.dot(F.col("query"), F.col("query"))), 6).alias("norm"), F.round(F.col("query")[0], 6).alias("first_value"), F.size("query").cast("long").alias("n"))


@query(_COS + """, b AS (SELECT query_id, 1 AS l, idx, row_number() OVER (PARTITION BY query_id ORDER BY idx % 97, idx) - 1 AS rank FROM d WHERE rank < 50),
u AS (SELECT query_id, 0 AS l, idx, rank FROM d WHERE rank < 50 UNION ALL SELECT * FROM b),
f AS (SELECT query_id, idx, sum(1 / (60.0::DOUBLE + rank)) AS score, min((l, rank)) AS first FROM u GROUP BY ALL)
SELECT query_id, idx AS vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) - 1 AS rank, round(score, 9) AS score FROM f""")
def rrf_hybrid(spark, sf_dir):
    from pyspark.sql import Window

    dense = ranking.dense_top_k(*_label_queries(spark, sf_dir), 50)
    other = Window.partitionBy("query_id").orderBy(F.col("idx") % 97, "idx")
    out = ranking.hybrid(dense, dense.select("query_id", "idx", (F.row_number().over(other) - 1).cast("long").alias("rank")))
    return out.select("query_id", F.col("idx").alias("vec_id"), "rank", F.round("score", 9).alias("score"))


@query("""WITH a AS (SELECT source AS query_id, lang AS query, doc_id AS idx, text AS document, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS rank FROM documents),
b AS (SELECT *, count(*) OVER w AS n0, sum(length(document)) OVER w AS c0 FROM a WINDOW w AS (PARTITION BY query_id, query)),
c AS (SELECT * REPLACE (left(document, 1500) AS document) FROM b WHERE rank < 30),
d AS (SELECT *, count(*) OVER w AS n1, length(query) + sum(length(document)) OVER w AS t FROM c WINDOW w AS (PARTITION BY query_id, query)),
e AS (SELECT * REPLACE (CASE WHEN t > 20000 THEN left(document, greatest(200, (20000 - length(query)) // n1)::BIGINT) ELSE document END AS document) FROM d)
SELECT query_id, query, count(*) AS docs, sum(length(document))::BIGINT AS chars, bool_or(n1 <> n0) OR sum(length(document)) <> any_value(c0) AS capped FROM e GROUP BY query_id, query""")
def rerank_caps(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    c = _t(spark, sf_dir, "documents").select(F.struct("source", "lang").alias("query_id"), F.col("lang").alias("query"), F.col("doc_id").alias("idx"), F.col("text").alias("document"), (F.row_number().over(w) - 1).alias("rank"))
    out = ranking.rerank_caps(c, max_total=20_000).groupBy("query_id", "query").agg(F.count("*").alias("docs"), F.sum(F.length("document")).alias("chars"), F.bool_or("capped").alias("capped"))
    return out.select(F.col("query_id.source").alias("query_id"), "query", "docs", "chars", "capped")


@query()
def retrieve_pages(spark, sf_dir):
    """Each page is asked for its own title."""
    pages = written(retrieve.extract(_t(spark, sf_dir, "pages")), "extracted")
    asked = pages.select("page_id", F.lit(0).alias("query_id"), F.col("title").alias("query"))
    out = retrieve.retrieve(pages, asked)
    return out.select("page_id", "query", "n_chunks_total", F.size("chunks").cast("long").alias("n_returned"), "output_chars", F.col("chunks")[0]["text"].alias("best"), "path", "error")


@query()
def chunk_documents(spark, sf_dir):
    out = chunking.chunk_pages(_t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("md")))
    return out.select("doc_id", "chunk_index", "text", "heading", "char_count")


# ---------------------------------------------------------------- evaluation

_F1 = """WITH tr AS (SELECT doc_id AS id, text FROM documents), ou AS (SELECT doc_id AS id, text || ' extra words here' AS text FROM documents WHERE doc_id % 5 <> 0),
a AS (SELECT id, w, count(*) AS x FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM tr) GROUP BY ALL),
b AS (SELECT id, w, count(*) AS y FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM ou) GROUP BY ALL),
n AS (SELECT tr.id, coalesce((SELECT sum(x) FROM a WHERE a.id = tr.id), 0) AS nt, coalesce((SELECT sum(y) FROM b WHERE b.id = tr.id), 0) AS no, coalesce((SELECT sum(least(x, y)) FROM a JOIN b USING (id, w) WHERE a.id = tr.id), 0) AS sh FROM tr),
f AS (SELECT id, CASE WHEN nt = 0 AND no = 0 THEN 1.0::DOUBLE WHEN no = 0 THEN 0.0 ELSE sh / no END AS p, CASE WHEN nt = 0 AND no = 0 THEN 1.0::DOUBLE WHEN nt = 0 THEN 0.0 ELSE sh / nt END AS r FROM n),
s AS (SELECT id, p, r, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1 FROM f)
"""


def _scores(spark, sf_dir):
    """Each document's text and three more words stand for an extractor's
    output; a fifth of the documents have none."""
    d = _t(spark, sf_dir, "documents")
    output = d.where(F.col("doc_id") % 5 != 0).select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" extra words here")).alias("text"))
    return evaluation.word_f1(d.select(F.col("doc_id").alias("id"), "text"), output)


@query(_F1 + "SELECT id, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM s")
def word_f1(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_RUNS = _F1 + """, x AS (SELECT s.id, coalesce(nullif(d.lang, ''), 'unknown') AS kind, CASE WHEN s.id % 11 <> 0 THEN f1 END AS a_f1, CASE WHEN s.id % 13 <> 0 THEN p END AS b_f1, (s.id * 37 % 500)::BIGINT AS a_ms, (s.id * 53 % 700)::BIGINT AS b_ms FROM s JOIN documents d ON d.doc_id = s.id)
"""


def _extractors(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("kind"))
    i = F.col("id")
    return _scores(spark, sf_dir).join(d, "id").select(i, "kind", F.when(i % 11 != 0, F.col("f1")).alias("a_f1"), F.when(i % 13 != 0, F.col("precision")).alias("b_f1"), (i * 37 % 500).alias("a_ms"), (i * 53 % 700).alias("b_ms"))


@query(_RUNS + "SELECT kind, count(*) AS n, round(avg(a_f1), 6) AS a_f1, round(avg(b_f1), 6) AS b_f1, round(avg(a_f1) - avg(b_f1), 6) AS delta, trunc(quantile_cont(a_ms, 0.5))::BIGINT AS a_ms, trunc(quantile_cont(b_ms, 0.5))::BIGINT AS b_ms FROM x WHERE a_f1 IS NOT NULL AND b_f1 IS NOT NULL GROUP BY kind")
def extractor_summary(spark, sf_dir):
    out = evaluation.extractor_summary(_extractors(spark, sf_dir), ["kind"])
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("a_f1", "b_f1", "delta")), "a_ms", "b_ms")


@query(_RUNS + """, y AS (SELECT id, round(a_f1 - b_f1, 9) AS delta FROM x WHERE a_f1 IS NOT NULL AND b_f1 IS NOT NULL)
SELECT * FROM (SELECT id, delta, 'win' AS side FROM (SELECT * FROM y ORDER BY delta DESC, id LIMIT 20) WHERE delta > 0) UNION ALL SELECT * FROM (SELECT id, delta, 'loss' AS side FROM (SELECT * FROM y ORDER BY delta, id LIMIT 20) WHERE delta < 0)""")
def wins_and_losses(spark, sf_dir):
    x = _extractors(spark, sf_dir).where("a_f1 is not null and b_f1 is not null")
    return evaluation.wins_and_losses(x.select("id", F.round(F.col("a_f1") - F.col("b_f1"), 9).alias("delta")), 20)


@query("""SELECT event_type, user_id % 10 AS shard, count(*) AS n, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, round(avg(value), 6) AS mean
FROM events WHERE value IS NOT NULL GROUP BY GROUPING SETS ((), (event_type), (user_id % 10), (event_type, user_id % 10))""")
def latency_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("shard"), "value")
    out = evaluation.latency_summary(e, "value", [(), ("event_type",), ("shard",), ("event_type", "shard")])
    return out.select("event_type", "shard", "n", "least", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "most", F.round("mean", 6).alias("mean"))


_P95 = """WITH l AS (SELECT user_id, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY user_id),
j AS (SELECT *, greatest(1, least(n - 1, (n + 1) * 19 // 20)) AS j FROM l),
p AS (SELECT user_id, CASE WHEN n = 1 THEN s[1] ELSE (s[j] * (20 - ((n + 1) * 19 - j * 20)) + s[j + 1] * ((n + 1) * 19 - j * 20)) / 20.0::DOUBLE END AS p95, s[n] AS most FROM j)
"""


@query(_P95 + "SELECT user_id, round(p95, 6) AS p95, most FROM p")
def p95_exclusive(spark, sf_dir):
    return evaluation.p95_by_case(_t(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("p95", 6).alias("p95"), "most")


@query(_P95 + ", b AS (SELECT user_id, p95 * (0.7 + (user_id % 5) * 0.1) AS before FROM p) SELECT user_id, round(before, 6) AS before, round(p95, 6) AS after FROM p JOIN b USING (user_id) WHERE p95 > 1.2 * before")
def regression_gate(spark, sf_dir):
    now = evaluation.p95_by_case(_t(spark, sf_dir, "events"), "user_id", "value")
    before = now.select("user_id", (F.col("p95") * (0.7 + (F.col("user_id") % 5) * 0.1)).alias("p95"))
    return evaluation.regressions(now, before, "user_id").select("user_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


_CASES = """WITH r AS (SELECT user_id AS case_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS mode, event_type <> 'error' AND event_id % 29 <> 0 AS ok, CASE WHEN user_id % 3 = 0 THEN 'fixed' ELSE event_type END AS signature, (event_id * 7 % 900)::BIGINT AS ms FROM events)
"""


def _cases(spark, sf_dir):
    e, n = _t(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.col("user_id").alias("case_id"), F.when(n % 2 == 0, "a").otherwise("b").alias("mode"), ((F.col("event_type") != "error") & (n % 29 != 0)).alias("ok"), F.when(F.col("user_id") % 3 == 0, "fixed").otherwise(F.col("event_type")).alias("signature"), (n * 7 % 900).alias("ms"))


_STABLE = _CASES + ", s AS (SELECT case_id, mode, bool_and(ok) AS stable, CASE WHEN count(DISTINCT signature) FILTER (ok) = 1 THEN min(signature) FILTER (ok) END AS signature, count(*) AS runs FROM r GROUP BY ALL)\n"


@query(_STABLE + "SELECT * FROM s")
def stable_runs(spark, sf_dir):
    return evaluation.stable_runs(_cases(spark, sf_dir), ["case_id", "mode"])


@query(_STABLE + """SELECT count(*) AS cases, count_if(NOT a.stable AND b.stable)::BIGINT AS fixed, count_if(a.stable AND NOT b.stable)::BIGINT AS broken, count_if(a.signature <> b.signature)::BIGINT AS changed
FROM (SELECT * FROM s WHERE mode = 'a') a JOIN (SELECT * FROM s WHERE mode = 'b') b USING (case_id)""")
def ab_diff(spark, sf_dir):
    s = evaluation.stable_runs(_cases(spark, sf_dir), ["case_id", "mode"])
    return evaluation.ab_diff(s.where("mode = 'a'"), s.where("mode = 'b'"), "case_id")


@query(_CASES + "SELECT mode, count(*) AS n, count_if(ok)::BIGINT AS passed, count_if(NOT ok)::BIGINT AS failed, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM r GROUP BY mode")
def mode_summary(spark, sf_dir):
    return evaluation.mode_summary(_cases(spark, sf_dir), "mode").select("mode", "n", "passed", "failed", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(_CASES + """, c AS (SELECT mode, CASE WHEN ok THEN 'ok' ELSE signature END AS status, count(*) AS n FROM r GROUP BY ALL)
SELECT mode, status, n, round(n / sum(n) OVER (PARTITION BY mode), 9) AS share, round(sum(CASE WHEN status <> 'ok' THEN n ELSE 0 END) OVER (PARTITION BY mode) / sum(n) OVER (PARTITION BY mode), 9) AS failure_rate FROM c""")
def status_summary(spark, sf_dir):
    rows = _cases(spark, sf_dir).select("mode", F.when(F.col("ok"), "ok").otherwise(F.col("signature")).alias("status"))
    return evaluation.status_summary(rows, ["mode"]).select("mode", "status", "n", F.round("share", 9).alias("share"), F.round("failure_rate", 9).alias("failure_rate"))


@query(_CASES + """, g AS (SELECT signature AS name, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END)::DOUBLE AS rate FROM r GROUP BY signature)
SELECT arg_max(name, (rate, name)) AS worst, round(max(rate), 9) AS rate, CASE WHEN max(rate) >= 0.05 THEN 'act' WHEN max(rate) < 0.005 THEN 'close' ELSE 'watch' END AS verdict FROM g""")
def worst_rate(spark, sf_dir):
    g = _cases(spark, sf_dir).groupBy(F.col("signature").alias("name")).agg(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)).alias("rate"))
    return evaluation.worst_rate_gate(g).select("worst", F.round("rate", 9).alias("rate"), "verdict")


@query("""WITH r AS (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN 'fail' WHEN doc_id % 3 = 0 OR (doc_id % 6 >= 4 AND doc_id % 2 = 0) THEN 'ideal' WHEN doc_id % 6 >= 3 THEN 'acceptable' ELSE 'too_wide' END AS rating FROM documents)
SELECT lang, count_if(rating = 'ideal')::BIGINT AS ideal, count_if(rating = 'acceptable')::BIGINT AS acceptable, count_if(rating = 'too_wide')::BIGINT AS too_wide, count_if(rating = 'fail')::BIGINT AS fail, round(count_if(rating IN ('ideal', 'acceptable')) / count(*), 9) AS success FROM r GROUP BY lang""")
def selector_ratings(spark, sf_dir):
    i = F.col("doc_id")
    tag = F.when(i % 3 == 0, "ARTICLE").when(i % 2 == 0, "SECTION").otherwise("DIV")
    rows = _t(spark, sf_dir, "documents").select("lang", evaluation.selector_rating(F.when(i % 7 != 0, "s"), tag, i % 6).alias("rating"))
    return evaluation.category_success(rows, "lang").withColumn("success", F.round("success", 9))


@query("""WITH a AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark), b AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations)
SELECT w, count(*) AS n FROM (SELECT w FROM a INTERSECT ALL SELECT w FROM b) GROUP BY w""")
def shared_words(spark, sf_dir):
    each = lambda t: _t(spark, sf_dir, t).select(F.explode(text.words(F.col("text"))).alias("w"))
    return each("benchmark").intersectAll(each("conversations")).groupBy("w").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- state


@query("SELECT event_id, user_id, row_number() OVER w AS visit, row_number() OVER w >= 3 AS suggest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def visit_hints(spark, sf_dir):
    return state.visit_hints(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("""WITH s AS (SELECT event_id, user_id, ts, (value * 100)::DOUBLE AS ms FROM events), k AS (SELECT * FROM s WHERE ms BETWEEN 0 AND 30000),
p AS (SELECT event_id, user_id, quantile_cont(ms, 0.95) OVER w AS p, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, CASE WHEN n < 5 THEN 15000 ELSE greatest(1500, least(15000, trunc(round(p * 1.5, 6))::BIGINT)) END::BIGINT AS ceiling_ms FROM p""")
def host_ceilings(spark, sf_dir):
    s = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") * 100).alias("ms"))
    return state.host_ceilings(s, "user_id", "ms", ["ts", "event_id"]).select("event_id", "user_id", "ceiling_ms")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_by_key(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return state.latest(e.withColumn("at", F.col("event_id")), "user_id", "at").drop("at")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), c AS (SELECT user_id, t AS cached_at FROM e WHERE event_type = 'click'), r AS (SELECT event_id, user_id, t FROM e WHERE event_type <> 'click')
SELECT event_id, max(cached_at) AS cached_at, max(cached_at) IS NOT NULL AS hit FROM r LEFT JOIN c ON c.user_id = r.user_id AND cached_at <= t AND cached_at + 3600 >= t GROUP BY event_id""")
def cache_lookup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _seconds("ts").alias("t"))
    out = state.cache_lookup(e.where("event_type <> 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'click'").select("user_id", F.col("t").alias("cached_at")), "user_id", "t", 3600)
    return out.select("event_id", "cached_at", "hit")


@query("""WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, (event_id * 7919 % 1000)::BIGINT AS size FROM events), s AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - size AS before FROM e)
SELECT event_id, size FROM s WHERE total > 100000 AND total - before > 80000""")
def cache_evictions(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", _seconds("ts").alias("t"), (F.col("event_id") * 7919 % 1000).alias("size"))
    return state.cache_evictions(e, "size", ["t", "event_id"], 100_000).select("event_id", "size")


@query("""WITH t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*?([^./]+\\.[^./:]+)(?:[/:?#]|$)', 1) AS host, length(html) AS chars FROM pages)
SELECT a.page_id, arg_max(b.page_id, (b.page_id, b.page_id)) AS profile_id, count(*) AS candidates FROM t a JOIN t b ON a.host = b.host AND b.page_id % 4 = 0 AND b.chars > 0 AND a.chars BETWEEN 0.3::DOUBLE * b.chars AND 3.0::DOUBLE * b.chars GROUP BY a.page_id""")
def transfer_candidates(spark, sf_dir):
    t = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*?([^./]+\.[^./:]+)(?:[/:?#]|$)", 1).alias("host"), F.length("html").alias("chars"))
    profiles = t.where(F.col("page_id") % 4 == 0).select("host", F.col("page_id").alias("profile_id"), F.col("chars").alias("profile_chars"), F.col("page_id").alias("generated_at"))
    return state.transfer_candidates(t, profiles, "page_id", "host")


@query("""WITH e AS (SELECT user_id, event_id, 100 + ((event_id // 700) % 9) * 50 AS len FROM events), c AS (SELECT *, CASE WHEN lag(len) OVER w IS NULL OR len <> lag(len) OVER w OR len <= 100 THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY event_id) - 1 AS run FROM i)
SELECT user_id, min(event_id) AS ready_at FROM r WHERE run >= 4 AND len > 100 GROUP BY user_id""")
def stable_after(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", (100 + (F.floor(F.col("event_id") / 700) % 9) * 50).alias("len"))
    return state.stable_after(e, "user_id", "event_id", "len")


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn > 0 AND turn % 2 = 1 THEN turn - 1 END AS ref, text AS v FROM conversations)
SELECT s.conv_id, s.turn, CASE WHEN s.ref IS NULL THEN s.v ELSE r.v END AS v FROM s LEFT JOIN s r ON r.conv_id = s.conv_id AND r.turn = s.ref""")
def step_references(spark, sf_dir):
    t = F.col("turn")
    s = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((t > 0) & (t % 2 == 1), t - 1).alias("ref"), F.col("text").alias("v"))
    return state.step_references(s, "conv_id", "turn", "ref", "v").select("conv_id", "turn", "v")


# ---------------------------------------------------------------- DOM and streams


def _record_pages(spark, sf_dir):
    """Conversations as pages: a list item for each turn."""
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    items = F.array_join(F.transform("t", lambda x: F.concat(F.lit('<div class="card post">'), x["text"], F.lit("</div>"))), "")
    return turns.select(F.col("conv_id").alias("page_id"), F.concat(F.lit('<html><body><nav><a class="x">a</a><a class="x">b</a><a class="x">c</a></nav><main>'), items, F.lit("</main></body></html>")).alias("html"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, median(length(trim(text))) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id AS page_id, 'div|card post' AS signature, n AS count, 'main' AS parent_tag FROM c WHERE n >= 3 AND m >= 20""")
def record_groups(spark, sf_dir):
    groups = html.record_groups(html.dom_nodes(_record_pages(spark, sf_dir)), "page_id")
    return groups.select("page_id", "signature", F.col("count").cast("long").alias("count"), "parent_tag")


@query("SELECT conv_id AS page_id, 'main' AS lca_tag FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def container_ancestors(spark, sf_dir):
    nodes = html.dom_nodes(_record_pages(spark, sf_dir))
    cards = nodes.where(F.array_contains("classes", "card"))
    many = cards.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id")
    lca = html.common_ancestor(html.drop_outliers(cards.join(many, "page_id").select("page_id", "node", "path", "depth"), "page_id"), "page_id")
    return lca.join(nodes.select("page_id", F.col("node").alias("lca"), F.col("tag").alias("lca_tag")), ["page_id", "lca"]).select("page_id", "lca_tag")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_batch(spark, sf_dir):
    w = F.window("ts", "1 hour")
    return _t(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT user_id, count(*) AS visits, count(*) >= 3 AS suggest FROM events GROUP BY user_id")
def streaming_visits(spark, sf_dir):
    from quarryleaf.streaming import jobs

    out = jobs.run_once(jobs.visit_counts(jobs.event_stream(spark, f"{sf_dir}/events.parquet")), "complete")
    return out.select("user_id", "visits", "suggest")


# A window is given out once the watermark, ten minutes before the last event, has passed it.
@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def streaming_tumbling(spark, sf_dir):
    from quarryleaf.streaming import jobs

    out = jobs.run_once(jobs.tumbling(jobs.event_stream(spark, f"{sf_dir}/events.parquet")))
    return out.withColumn("total", F.round("total", 6))


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g), s AS (SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM i GROUP BY user_id, i)
SELECT * FROM s WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def streaming_sessions(spark, sf_dir):
    from quarryleaf.streaming import jobs

    return jobs.run_once(jobs.sessions(jobs.event_stream(spark, f"{sf_dir}/events.parquet")))


@query("SELECT percentile AS p, round(v, 6) AS v FROM (SELECT 'p95' AS percentile, quantile_cont(value, 0.95) AS v FROM events UNION ALL SELECT 'mean', avg(value) FROM events)")
def value_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events").agg(stats.percentile_or_zero(F.col("value"), 0.95).alias("p95"), stats.mean_or_zero(F.col("value")).alias("mean"))
    return e.unpivot([], ["p95", "mean"], "p", "v").select("p", F.round("v", 6).alias("v"))


from quarryleaf.plans import catalog_harness, catalog_sites  # noqa: E402, F401  add their queries
