"""BM25, fusion, dense retrieval and rerank caps.

A corpus is the rows of one ``group`` (a page, or any key); several queries are
ranked at once, each against the corpora that its rows name. Statistics are
aggregated before any join, and postings join the query's terms, so a row that
shares no term with a query costs no join output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.functions.text import bm25_tokens
from quarryleaf.functions.vectors import cosine
from quarryleaf.settings import DEFAULTS
from quarryleaf.sources.shared import written

K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25_hits(chunks: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(group, idx, query_id, score) for chunks that have a term of a query.

    chunks: group, idx, text. query_terms: group, query_id, term, one row for
    each token of the query, repeats included. A term that most chunks have
    gets EPSILON of the mean idf instead of a negative one.
    """
    tokens = chunks.select("group", "idx", bm25_tokens(F.col("text")).alias("tokens"))
    sizes = tokens.groupBy("group").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    tf = tokens.select("group", "idx", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("group", "idx", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("group", "term").agg(F.count("*").alias("df")).join(sizes, "group")
    idf = df.select("group", "term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.groupBy("group").agg(F.avg("raw").alias("mean"))
    idf = idf.join(mean, "group").select("group", "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = query_terms.groupBy("group", "query_id", "term").agg(F.count("*").alias("times")).join(idf, ["group", "term"])
    gain = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(asked, ["group", "term"]).groupBy("group", "idx", "query_id").agg(F.sum(gain).alias("score"))


def bm25_scores(chunks: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(group, idx, query_id, score) for every chunk and query of its group;
    without a match the score is 0. For a few of the best ``bm25_top`` does
    without a row for every pair."""
    hits = bm25_hits(chunks, query_terms)
    every = chunks.select("group", "idx").join(query_terms.select("group", "query_id").distinct(), "group")
    return every.join(hits, ["group", "idx", "query_id"], "left").select("group", "idx", "query_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def ranked(scores: DataFrame, by: list[str], score: Column, as_col: str = "rank", digits: int = 9) -> DataFrame:
    """scores with a dense 0-based place, best first, ties by idx. Scores are
    compared at ``digits`` digits, since sums differ in their last bits."""
    w = Window.partitionBy(*by).orderBy(F.round(score, digits).desc(), "idx")
    return scores.withColumn(as_col, (F.row_number().over(w) - 1).cast("long"))


def bm25_rank(chunks: DataFrame, query_terms: DataFrame) -> DataFrame:
    """bm25_scores and the rank of each chunk."""
    return ranked(bm25_scores(chunks, query_terms), ["group", "query_id"], F.col("score"))


def bm25_top(chunks: DataFrame, query_terms: DataFrame, k: int, stated: bool = False) -> DataFrame:
    """The k best of bm25_rank. Chunks without a match are looked at only for
    queries that fewer than k chunks of the group match. stated: the queries
    are a set of bounded size, see ``_top_of_stated``."""
    if stated:
        return _top_of_stated(chunks, query_terms, k)
    hits = bm25_hits(chunks, query_terms)
    enough = hits.where("score > 0").groupBy("group", "query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = query_terms.select("group", "query_id").distinct().join(enough, ["group", "query_id"], "left_anti")
    rest = chunks.select("group", "idx").join(few, "group").join(hits, ["group", "idx", "query_id"], "left_anti").select("group", "idx", "query_id", F.lit(0.0).alias("score"))
    return ranked(hits.unionByName(rest), ["group", "query_id"], F.col("score")).where(F.col("rank") < k)


def _top_of_stated(chunks: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """bm25_top for queries that may be broadcast with their groups. Texts are
    dealt out once, by chunk; a chunk's postings and scores stay in its task,
    which gives on the k best of each query. Document frequencies are added up
    before they are dealt out, and written to the shared folder, as the best are."""
    # Terms are not empty: an empty one stands for the chunk itself.
    terms_of = lambda tokens: F.array_append(F.coalesce(tokens, F.array().cast("array<string>")), F.lit(""))
    tokens = chunks.select("group", bm25_tokens(F.col("text")).alias("tokens"))
    each = tokens.select("group", F.size("tokens").alias("dl"), F.explode(terms_of(F.array_distinct("tokens"))).alias("term"))
    counts = written(each.groupBy("group", "term").agg(F.count("*").alias("df"), F.avg(F.when(F.col("term") == "", F.col("dl"))).alias("avgdl")), "terms")
    sizes = counts.where("term = ''").select("group", F.col("df").alias("n"), "avgdl")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = counts.where("term <> ''").drop("avgdl").join(F.broadcast(sizes), "group").select("group", "term", "avgdl", raw.alias("raw"))
    times = query_terms.groupBy("group", "query_id", "term").agg(F.count("*").alias("times"))
    asked = idf.join(F.broadcast(times), ["group", "term"]).join(F.broadcast(idf.groupBy("group").agg(F.avg("raw").alias("mean"))), "group")
    weight = F.col("times") * F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    asked = written(asked.select("group", "query_id", "term", "avgdl", weight.alias("weight")), "asked")

    def best(asked):
        own = chunks.select("group", "idx", "text").repartition("group", "idx").select("group", "idx", bm25_tokens(F.col("text")).alias("tokens"))
        tf = own.select("group", "idx", F.size("tokens").alias("dl"), F.explode(terms_of(F.col("tokens"))).alias("term")).groupBy("group", "idx", "dl", "term").agg(F.count("*").alias("tf"))
        gain = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        gain = F.when(F.col("term") == "", 0.0).otherwise(gain)
        hits = tf.join(F.broadcast(asked), ["group", "term"]).groupBy("group", "idx", "query_id").agg(F.sum(gain).alias("score"))
        w = Window.partitionBy("group", "query_id").orderBy(F.round("score", 9).desc(), "idx")
        # Not ``ranked``: Spark limits each task's rows only by the row number itself.
        top = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
        return written(top.select("group", "idx", "query_id", "score", (F.col("_n") - 1).cast("long").alias("rank")), "best")

    out = best(asked)
    enough = out.where(F.round("score", 9) > 0).groupBy("group", "query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = written(query_terms.select("group", "query_id").distinct().join(enough, ["group", "query_id"], "left_anti"), "few")
    if few.isEmpty():
        return out
    every = few.select("group", "query_id", F.lit("").alias("term"), F.lit(1.0).alias("avgdl"), F.lit(0.0).alias("weight"))
    rest = best(asked.join(F.broadcast(few), ["group", "query_id"], "left_semi").unionByName(every))
    return out.join(F.broadcast(few), ["group", "query_id"], "left_anti").unionByName(rest)


def chunk_budget(chunks: DataFrame, query_terms: DataFrame, budget: int = DEFAULTS.chunk_budget, stated: bool = False) -> DataFrame:
    """(group, idx, query_id): the BM25-best chunks of each group of more than
    ``budget``, and all chunks of smaller ones; 0 turns it off. Original order
    is that of idx. stated: see ``bm25_top``."""
    out = bm25_top(chunks, query_terms, budget, stated) if budget > 0 else bm25_rank(chunks, query_terms)
    return out.select("group", "idx", "query_id")


def reciprocal_rank_fusion(rankings: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """(query_id, idx, score, rank) fused from rankings: query_id, ranking,
    idx, rank (0-based). Ties keep the order of the first ranking that has
    them."""
    fused = rankings.groupBy("query_id", "idx").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct("ranking", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first")
    return fused.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).drop("first")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, idx, score, rank): the k nearest vectors by cosine.

    vectors: idx, embedding; queries: query_id, query, a stated set that each
    vector is compared with. It is broadcast if its size is under the session's
    threshold, else the vectors are read once for each part of it. Norms are
    made once for each side.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = vectors.select("idx", "embedding", norm("embedding").alias("vn"))
    q = queries.select("query_id", "query", norm("query").alias("qn"))
    dots = F.aggregate(F.zip_with("embedding", "query", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = v.crossJoin(q).select("query_id", "idx", F.when((F.col("vn") == 0) | (F.col("qn") == 0), 0.0).otherwise(dots / (F.col("vn") * F.col("qn"))).alias("score"))
    return ranked(scored, ["query_id"], F.col("score")).where(F.col("rank") < k)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Fuse a dense and a BM25 ranking (query_id, idx, rank each)."""
    both = dense.select("query_id", F.lit(0).alias("ranking"), "idx", "rank").union(lexical.select("query_id", F.lit(1).alias("ranking"), "idx", "rank"))
    return reciprocal_rank_fusion(both, k)


def candidate_width(k: Column, n: Column, rerank: bool = True) -> Column:
    return F.least(2 * k, n) if rerank else k


def rerank_caps(candidates: DataFrame, max_docs: int = DEFAULTS.rerank_max_docs, max_doc: int = DEFAULTS.rerank_max_doc_chars, max_total: int = DEFAULTS.rerank_max_total_chars, least: int = DEFAULTS.rerank_least_doc_chars) -> DataFrame:
    """Cut what goes to a reranker: documents by rank, each document's length,
    then all alike if query and documents together are too long. A cap of 0 is
    off. candidates: query_id, query, idx, rank, document."""
    w = Window.partitionBy("query_id")
    before = candidates.withColumn("_docs", F.count("*").over(w)).withColumn("_chars", F.sum(F.length("document")).over(w))
    out = before.where(F.col("rank") < max_docs) if max_docs > 0 else before
    out = out.withColumn("document", F.left("document", F.lit(max_doc))) if max_doc > 0 else out
    if max_total > 0:
        out = out.withColumn("_n", F.count("*").over(w)).withColumn("_total", F.length("query") + F.sum(F.length("document")).over(w))
        each = F.greatest(F.lit(least), F.floor((F.lit(max_total) - F.length("query")) / F.col("_n"))).cast("int")
        out = out.withColumn("document", F.when(F.col("_total") > max_total, F.left(F.col("document"), each)).otherwise(F.col("document"))).drop("_n", "_total")
    capped = (F.count("*").over(w) != F.col("_docs")) | (F.sum(F.length("document")).over(w) != F.col("_chars"))
    return out.withColumn("capped", capped).drop("_docs", "_chars")


def rerank(capped: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k best by the provider's score; rows without one (the provider
    failed) fall back to the dense score's order."""
    score = F.lit(None).cast("double") if score is None else score
    out = capped.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return out.withColumn("place", (F.row_number().over(w) - 1).cast("long")).where(F.col("place") < k)


__all__ = ["bm25_hits", "bm25_rank", "bm25_scores", "bm25_top", "candidate_width", "chunk_budget", "cosine", "dense_top_k", "hybrid", "ranked", "reciprocal_rank_fusion", "rerank", "rerank_caps"]
