"""Answer queries from pages: extract, chunk, rank, cap, rerank, enrich.

Every page is ranked against each query that is asked of it. Chunks stay dealt
by page through BM25, fusion and assembly; the embedder sees only the chunks
that the lexical budget leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.functions.text import adaptive_k, bm25_tokens, embedding_input, rerank_document
from quarryleaf.functions.vectors import cosine
from quarryleaf.operators import ranking
from quarryleaf.operators.chunking import chunk_pages
from quarryleaf.operators.enrichment import chain_hints, excerpts
from quarryleaf.operators.html import page_title
from quarryleaf.operators.markdown import page_markdown
from quarryleaf.plans.providers import HashEmbedder, OverlapReranker
from quarryleaf.settings import DEFAULTS, Settings
from quarryleaf.sources.shared import written


def extract(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """page_id, url, title and md of each page's html, records marked."""
    own = pages.select("page_id", "url", "html")
    return page_markdown(own, "page_id", records=settings.records).select("page_id", "url", page_title(F.col("html"), F.col("md")).alias("title"), "md")


def retrieve(pages: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS, embedder=None, reranker=None, k: int | None = None, expander=None) -> DataFrame:
    """A row for each page and query: its best chunks and what goes with them.

    pages: page_id, url, title, md; it is read several times, so it should be a
    table and no plan that parses pages. queries: page_id, query_id, query; a blank
    query gives a row with an error. A page without chunks gives one too. With
    an expander a query's vector is the mean of its own and its expansion's.
    """
    embedder, reranker = embedder or HashEmbedder(), reranker or OverlapReranker()
    asked = queries.join(pages.select("page_id", "url", "title", F.length("md").alias("page_chars")), "page_id")
    good = asked.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    chunks = written(chunk_pages(pages.select("page_id", "md")), "chunks")
    corpus = chunks.select(F.col("page_id").alias("group"), F.col("chunk_index").alias("idx"), F.col("embed_text").alias("text"))
    terms = good.select(F.col("page_id").alias("group"), "query_id", F.explode_outer(bm25_tokens(F.col("query"))).alias("term"))
    terms = terms.withColumn("term", F.coalesce("term", F.lit("")))
    kept = ranking.chunk_budget(corpus, terms, settings.chunk_budget)

    body = chunks.select(F.col("page_id").alias("group"), F.col("chunk_index").alias("idx"), "text", "heading", "embed_text", "char_count")
    survivors = kept.select("group", "idx").distinct().join(body, ["group", "idx"])
    embedded = survivors.withColumn("vector", embedder.embed(embedding_input(F.col("heading"), F.col("embed_text"), F.col("text"), settings.embed_chars)))
    asked_vectors = good.select(F.col("page_id").alias("group"), "query_id", "query", "title", embedder.embed(F.col("query")).alias("asked"))
    if expander is not None:
        asked_vectors = asked_vectors.withColumn("_more", expander.expand(F.col("query"))).withColumn("_other", embedder.embed(F.col("_more")))
        mean = F.zip_with("asked", "_other", lambda a, b: (a + b) / 2)
        asked_vectors = asked_vectors.withColumn("asked", F.when(F.coalesce("_more", F.lit("")) != "", mean).otherwise(F.col("asked"))).drop("_more", "_other")
    scored = kept.join(asked_vectors, ["group", "query_id"]).join(embedded, ["group", "idx"]).withColumn("score", cosine(F.col("vector"), F.col("asked"))).drop("vector", "asked")
    each = Window.partitionBy("group", "query_id")
    scored = ranking.ranked(scored, ["group", "query_id"], F.col("score")).withColumn("n", F.count("*").over(each))
    if settings.hybrid:
        lexical = ranking.bm25_rank(survivors.select("group", "idx", F.col("embed_text").alias("text")), terms).select("group", "query_id", "idx", F.col("rank").alias("lexical"))
        fused = 1 / (F.lit(float(settings.rrf_k)) + F.col("rank")) + 1 / (F.lit(float(settings.rrf_k)) + F.col("lexical"))
        order = Window.partitionBy("group", "query_id").orderBy(F.round("fused", 12).desc(), "rank")
        scored = scored.join(lexical, ["group", "query_id", "idx"]).withColumn("fused", fused).withColumn("rank", F.row_number().over(order) - 1).drop("fused", "lexical")
    scored = scored.withColumn("k", F.lit(k).cast("long") if k else adaptive_k(F.col("n")))
    wide = scored.where(F.col("rank") < ranking.candidate_width(F.col("k"), F.col("n"))).withColumn("document", rerank_document(F.col("title") if settings.rerank_title else F.lit(""), F.col("heading"), F.coalesce(F.nullif("embed_text", F.lit("")), "text")))
    capped = ranking.rerank_caps(wide.withColumn("_page", F.col("group")).withColumn("query_id", F.struct("group", "query_id")), settings.rerank_max_docs, settings.rerank_max_doc_chars, settings.rerank_max_total_chars, settings.rerank_least_doc_chars)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    best = capped.withColumn("rerank_score", reranker.score(F.col("query"), F.col("document"))).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < F.col("k"))
    answer = best.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "text", "heading", "char_count", F.col("idx").alias("chunk_index"), "score"))).alias("chunks"), F.max("n").alias("n_chunks_embedded"), F.bool_or("capped").alias("rerank_capped")
    )
    answer = answer.select(F.col("query_id.group").alias("page_id"), F.col("query_id.query_id").alias("query_id"), "chunks", "n_chunks_embedded", "rerank_capped")
    totals = chunks.groupBy("page_id").agg(F.count("*").alias("n_chunks_total"))
    out = asked.join(answer, ["page_id", "query_id"], "left").join(totals, "page_id", "left")
    output_chars = F.aggregate(F.coalesce("chunks", F.array()), F.lit(0), lambda s, c: s + c["char_count"])
    error = F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "query is required").when(F.col("n_chunks_total").isNull(), "no content")
    return out.select(
        "page_id", "query_id", "url", "query", "title", "page_chars", F.coalesce("n_chunks_total", F.lit(0)).alias("n_chunks_total"), "n_chunks_embedded", "chunks",
        (1 + F.ceil(F.col("n_chunks_embedded") / settings.embed_batch)).alias("embed_calls"), output_chars.cast("long").alias("output_chars"), (F.col("page_chars") / F.greatest(output_chars, F.lit(1))).alias("compression_ratio"), "rerank_capped",
        excerpts(F.transform(F.coalesce("chunks", F.array()), lambda c: c["text"])).alias("excerpts"), chain_hints(F.col("url")).alias("chain_hints"), error.alias("error"),
        F.when(error.isNotNull(), "error").otherwise("full_page_retrieval").alias("path"),
    )

