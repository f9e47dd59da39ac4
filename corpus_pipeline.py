"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and keeps all columns of docs but in the
last stage, which returns token digests. Stages decide by row, so repeated rows
share a fate except in near-duplicate groups, of which one row stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryleaf.llm import bpe, decontaminate, linededup, simhash, toxicity
from quarryleaf.llm.common import shared_dir, table

#: Of near duplicates: five-word shingles whose sets have this Jaccard
#: similarity; candidates have 256-bit fingerprints within so many bits. At a
#: similarity of 0.8 they differ in 39 bits, give or take 6.
NEAR_WORDS, NEAR_LANES, NEAR_BITS, NEAR = 5, 4, 56, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The classifier learns from
    labelled documents that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "_ql_toxic").where(F.col("_ql_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted. A document of
    which nothing is left but blank lines goes; n_chars follows the text."""
    out = linededup.deduplicate(docs)
    changed = F.col("_ql_deleted").isNotNull()
    out = out.where(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays (of
    equal ids with other texts, the one whose text has the smallest hash), once;
    rows without an id stay."""
    found = simhash.near_duplicates(docs, NEAR_BITS, NEAR_WORDS, NEAR_LANES, similarity=NEAR)
    kept = found.where("doc_id is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select(F.col("k.doc_id").alias("_ql_id"), F.col("k.text_key").alias("_ql_text"))
    out = docs.withColumn("_ql_key", F.xxhash64("text")).join(kept, (F.col("doc_id") == F.col("_ql_id")) & (F.col("_ql_key") == F.col("_ql_text")))
    # Repeated rows are their own copies: one stays.
    one = Window.partitionBy("_ql_id", "_ql_text").orderBy(F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t)))
    out = out.withColumn("_ql_n", F.row_number().over(one)).where("_ql_n = 1")
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    out = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.size("_ql_hits") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that is left."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("encode", encode)]

#: SQL cannot express a learned classifier, an alignment or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet in the shared
    folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
