"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import logging

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryleaf.functions.text import netloc, query_hash
from quarryleaf.settings import DEFAULTS

LOG = logging.getLogger(__name__)

#: The fields of a telemetry line that are taken over from a result.
TELEMETRY_FIELDS = ["fetcher_used", "path", "profile_used", "profile_hash", "suggest_profile", "suggest_profile_reason", "content_type", "structured_path", "rerank_used", "rerank_capped", "hyde_used", "fetch_ms", "chunk_ms", "retrieval_ms", "rerank_ms", "total_ms", "page_chars", "n_chunks_total", "n_chunks_embedded", "error"]
TELEMETRY_SCHEMA = 1
PROFILE = "schema_version int, url string, url_hash string, generated_at string, mapper struct<main_selector:string,lca_tag:string,subtree_char_count:long,verification_anchors:array<string>>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def raw_bodies(spark: SparkSession, path: str, most: int = DEFAULTS.passthrough_bytes) -> DataFrame:
    """Files as they are: path, body cut to ``most`` bytes, truncated, error."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", *truncated_body(F.col("content"), most))


def truncated_body(body: Column, most: int = DEFAULTS.passthrough_bytes) -> list[Column]:
    """body, truncated and error of a raw response; an empty one is an error."""
    n = F.octet_length(body)
    return [F.substring(body, 1, most).alias("body"), (n > most).alias("truncated"), F.when(n == 0, "empty body").alias("error")]


def decoded(body: Column, charset: Column | None = None) -> Column:
    """Text of bytes by the content type's charset, malformed bytes replaced;
    UTF-8 without a charset or for one that is unknown. UTF-8 and ISO-8859-1 are
    read JVM-side, only other charsets' bytes go to Python."""
    utf8 = F.make_valid_utf8(body.cast("string"))
    if charset is None:
        return utf8
    name = F.coalesce(F.lower(F.trim(charset)), F.lit("utf-8"))
    latin, plain = name.isin("iso-8859-1", "latin-1", "latin1"), name.isin("", "utf-8", "utf8")

    def run(bodies: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if b is None or n is None else _in_charset(b, n) for b, n in zip(bodies.to_pylist(), names.to_pylist())], pa.string())

    other = F.arrow_udf(run, "string")(F.when(~latin & ~plain, body), F.when(~latin & ~plain, name))
    return F.when(latin, F.decode(body, "ISO-8859-1")).when(plain, utf8).otherwise(F.coalesce(other, utf8))


def _in_charset(body: bytes, name: str) -> str | None:
    """Null for a charset that is unknown or no text encoding."""
    try:
        return bytes(body).decode(name, "replace")
    except (LookupError, ValueError):
        return None


def charset(content_type: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(content_type, r"""(?i)charset=["']?([A-Za-z0-9._-]+)""", 1)), F.lit(""))


def pdf_text(page_texts: Column) -> Column:
    """Pages of a document joined by blank lines, blank pages left out."""
    return F.array_join(F.filter(F.transform(page_texts, lambda t: F.trim(t)), lambda p: p != ""), "\n\n")


def stack_markdown(answers: DataFrame, key: str, questions: DataFrame | None = None) -> DataFrame:
    """(key, md): each question, then its answers, the accepted first and then by
    score. answers: key, accepted, score, body; questions: key, title, tags (an
    array), body. A rule stands before each answer of a question. Without
    questions the answers alone, without rules; a question without answers
    stands alone."""
    rule = "---\n\n" if questions is not None else ""
    order = F.struct((~F.col("accepted")).alias("o"), (-F.col("score")).alias("s"), F.col("body").alias("b"), F.col("accepted").alias("a"), F.col("score").alias("n"))
    head = lambda x: F.concat(F.lit(f"{rule}## Answer (score: "), x["n"].cast("string"), F.when(x["a"], ", accepted").otherwise(","), F.lit(")\n\n"))
    parts = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat(head(x), x["b"]))
    out = answers.groupBy(key).agg(F.array_join(parts, "\n\n").alias("md"))
    if questions is None:
        return out
    asked = F.concat(F.lit("# "), "title", F.lit("\n\nTags: "), F.array_join("tags", ", "), F.lit("\n\n"), "body")
    return questions.select(key, asked.alias("_asked")).join(out, key, "left").select(key, F.concat_ws("\n\n", "_asked", "md").alias("md"))


def issue_markdown(title: Column, state: Column, labels: Column, body: Column) -> Column:
    """An issue or pull request; labels are left out if there are none."""
    named = F.when(F.size(labels) > 0, F.concat(F.lit("  Labels: "), F.array_join(labels, ", "))).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\nState: "), state, named, F.lit("\n\n"), F.coalesce(body, F.lit("")))


def github_markdown(kind: Column, response: Column) -> Column:
    """Markdown of an API response by the kind of ``routes.github_route``; null
    if it cannot be read, and a browser takes the page."""
    issue = F.from_json(response, "title string, state string, labels array<struct<name:string>>, body string")
    text = issue_markdown(issue["title"], issue["state"], F.coalesce(issue["labels"]["name"], F.array().cast("array<string>")), issue["body"])
    blob = decoded(F.try_to_binary(F.regexp_replace(F.get_json_object(response, "$.content"), r"\s", ""), F.lit("base64")))
    return F.when(kind == "readme", response).when(kind.isin("issue", "pull"), text).when(kind == "blob", blob)


def wikipedia_html(response: Column) -> Column:
    """The article's html in an API response; null on an error or without text,
    and a browser takes the page."""
    return F.nullif(F.from_json(response, "parse struct<text:map<string,string>>")["parse"]["text"]["*"], F.lit(""))


def blob_text(encoded: Column) -> Column:
    return decoded(F.unbase64(encoded))


def transcript(tracks: DataFrame, key: str) -> DataFrame:
    """The first manual track of each video, else the first, its snippets
    joined. tracks: key, ord, generated, snippets."""
    return tracks.groupBy(key).agg(F.array_join(F.min_by("snippets", F.struct("generated", "ord")), " ").alias("md"))


def ground_truth(spark: SparkSession, path: str, file: Column | None = None) -> DataFrame:
    """Ground truth files as rows; a page type may be a string or an object.
    With ``file``, an expression of a file's name, its stem is a column too."""
    raw = spark.read.text(path, wholetext=True)
    stem = [] if file is None else [F.regexp_replace(file, r"\.json$", "").alias("file")]
    j = lambda p: F.get_json_object("value", p)
    kind = F.coalesce(j("$._internal.page_type.primary"), j("$._internal.page_type"), j("$.category"), F.lit("article"))
    snippets = lambda p: F.coalesce(F.from_json(j(p), "array<string>"), F.array().cast("array<string>"))
    return raw.select(
        j("$.file_id").alias("id"), j("$.url").alias("url"), j("$.ground_truth.title").alias("title"), F.coalesce(j("$.ground_truth.main_content"), F.lit("")).alias("text"), F.when(kind == "category", "collection").otherwise(kind).alias("page_type"),
        snippets("$.ground_truth.with").alias("with"), snippets("$.ground_truth.without").alias("without"), *stem,
    )


def changed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256) whose file is absent or differs."""
    have = files.select("path", F.sha2("content", 256).alias("sha256"))
    return manifest.join(have, ["path", "sha256"], "left_anti")


def page_pairs(spark: SparkSession, folder: str, page_type: str | None = None) -> DataFrame:
    """Ground truth rows with the html of the file beside them (id, html and the
    columns of ``ground_truth``): <id>.json with <id>.html.gz, or
    ground-truth/<id>.json with html/<id>.html.gz. An id in both layouts counts
    once, the flat one's; a file without its pair is left out."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)

    def layout(jsons: str, pages: str, order: int) -> DataFrame:
        truth = ground_truth(spark, jsons, name).drop("id").withColumnRenamed("file", "id")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html.gz").load(pages)
        html = files.select(F.regexp_extract("path", r"([^/]+)\.html\.gz$", 1).alias("id"), _unzipped(F.col("content")).alias("html"))
        return truth.join(html, "id").withColumn("_layout", F.lit(order))

    found = None
    for order, (jsons, pages) in enumerate([(folder, folder), (f"{folder}/ground-truth", f"{folder}/html")]):
        if _exists(spark, jsons) and _exists(spark, pages):
            part = layout(f"{jsons}/*.json", pages, order) if _exists(spark, f"{jsons}/*.json") else None
            found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        raise ValueError(f"no ground truth in {folder}")
    first = found.groupBy("id").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("id", "_layout")]), "_layout").alias("r")).select("id", "r.*")
    return first if page_type is None else first.where(F.col("page_type") == page_type)


def _unzipped(content: Column) -> Column:
    import gzip

    def run(files: pa.Array) -> pa.Array:
        return pa.array([gzip.decompress(x).decode("utf-8", "replace") for x in files.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(content)


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def telemetry(results: DataFrame) -> DataFrame:
    """A line for each result of ``retrieve``: time, schema, host, url, the
    query's hash and TELEMETRY_FIELDS, null where results lack them."""
    have = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in TELEMETRY_FIELDS]
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return results.select(at.alias("ts"), F.lit(TELEMETRY_SCHEMA).alias("schema"), netloc(F.col("url")).alias("host"), "url", query_hash(F.col("query")).alias("query_sha1"), *have)


def append_telemetry(events: DataFrame, path: str, most: int | None = None) -> None:
    """Append lines; a log of ``most`` bytes or more first becomes ``path``.1,
    in place of the one before it."""
    spark = events.sparkSession
    if most is not None and _exists(spark, path):
        now, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.1"))
        files = now.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.getContentSummary(now).getLength() >= most:
            files.delete(old, True)
            files.rename(now, old)
    events.write.mode("append").json(path)


def record_telemetry(results: DataFrame, path: str, most: int = DEFAULTS.telemetry_bytes) -> bool:
    """Append the results' lines if the session's quarryleaf.telemetry is 1, true
    or yes. A log that cannot be written is warned of and changes nothing else."""
    if (results.sparkSession.conf.get("quarryleaf.telemetry", None) or "").strip() not in ("1", "true", "yes"):
        return False
    try:
        append_telemetry(telemetry(results), path, most)
    except (PySparkException, Py4JJavaError) as e:
        LOG.warning("telemetry was not written: %s", e)
        return False
    return True


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Add profiles (columns of PROFILE); of a page the newest counts."""
    profiles.write.mode("append").json(path)


def read_profiles(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """Stored profiles, the newest first, of one host if it is named; of each
    page the newest. Files that are no profile are left out."""
    rows = spark.read.schema(PROFILE).option("mode", "PERMISSIVE").json(path).where("url_hash is not null")
    rest = [c for c in rows.columns if c != "url_hash"]
    newest = rows.groupBy("url_hash").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("generated_at", F.lit("")), F.coalesce("url", F.lit("")))).alias("r")).select("url_hash", "r.*").select(*rows.columns)
    out = newest if host is None else newest.where(netloc(F.col("url")) == host.lower())
    return out.orderBy(F.desc("generated_at"))


def read_patterns(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Usage patterns of YAML files, each a mapping with a list of patterns; the
    shard is the file's name. The files are few and read by the driver. Ids
    that repeat are for ``harness.violations`` to report."""
    import json

    import yaml

    rows = []
    for path, text in sorted((r["path"], bytes(r["content"])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select("path", "content").toLocalIterator()):
        shard = path.rsplit("/", 1)[-1].removesuffix(".yaml")
        found = yaml.safe_load(text.decode()) or {}
        if not isinstance(found, dict) or not isinstance(found.get("patterns"), list):
            raise ValueError(f"{shard}: no list of patterns")
        rows += [(json.dumps(p | {"shard": shard}, default=str),) for p in found["patterns"]]
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", schema).alias("p")).select("p.*")


def write_reports(outcomes: DataFrame, folder: str) -> None:
    """folder/raw with all outcomes as JSON, folder/summary with a markdown file
    for each shard, folder/failures with those that failed."""
    from quarryleaf.operators.harness import summary_markdown

    outcomes.write.mode("overwrite").json(f"{folder}/raw")
    summary_markdown(outcomes).select("shard", F.col("md").alias("value")).write.mode("overwrite").partitionBy("shard").text(f"{folder}/summary")
    outcomes.where(~F.coalesce("passed", F.lit(False))).write.mode("overwrite").json(f"{folder}/failures")
