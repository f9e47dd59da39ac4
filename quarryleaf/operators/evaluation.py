"""Extraction quality, latency summaries, A/B comparisons and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.functions.stats import mean_or_zero, percentile_exclusive, percentile_or_zero
from quarryleaf.functions.text import words


def word_f1(truth: DataFrame, output: DataFrame, empty_scores: bool = True) -> DataFrame:
    """(id, precision, recall, f1) over word multisets of truth and output
    (id, text each); a truth without output counts as an empty output.

    With ``empty_scores`` two empty sides score 1 each, else an empty output
    always scores 0.
    """
    counted = lambda df, name: df.select("id", F.explode(words(F.coalesce("text", F.lit("")))).alias("w")).groupBy("id", "w").agg(F.count("*").alias(name))
    a, b = counted(truth, "x"), counted(output, "y")
    shared = a.join(b, ["id", "w"]).groupBy("id").agg(F.sum(F.least("x", "y")).alias("shared"))
    totals = a.groupBy("id").agg(F.sum("x").alias("n_truth"))
    found = b.groupBy("id").agg(F.sum("y").alias("n_output"))
    out = truth.select("id").join(totals, "id", "left").join(found, "id", "left").join(shared, "id", "left").na.fill(0, ["n_truth", "n_output", "shared"])
    both_empty = (F.col("n_truth") == 0) & (F.col("n_output") == 0) & F.lit(empty_scores)
    ratio = lambda d: F.when(both_empty, 1.0).when(F.col(d) == 0, 0.0).otherwise(F.col("shared") / F.col(d))
    out = out.withColumn("precision", ratio("n_output")).withColumn("recall", ratio("n_truth"))
    total = F.col("precision") + F.col("recall")
    return out.select("id", "precision", "recall", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total).alias("f1"))


def extractor_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean scores and the truncated median time of two extractors (columns
    a_f1, a_ms, b_f1, b_ms) over rows where both succeeded."""
    both = rows.where(F.col("a_f1").isNotNull() & F.col("b_f1").isNotNull())
    a, b = mean_or_zero(F.col("a_f1")), mean_or_zero(F.col("b_f1"))
    aggregates = [F.count("*").alias("n"), a.alias("a_f1"), b.alias("b_f1"), (a - b).alias("delta"), F.percentile("a_ms", F.lit(0.5)).cast("long").alias("a_ms"), F.percentile("b_ms", F.lit(0.5)).cast("long").alias("b_ms")]
    return both.groupBy(*keys).agg(*aggregates)


def wins_and_losses(rows: DataFrame, n: int) -> DataFrame:
    """The n largest and smallest differences; those of the wrong sign are
    dropped after the cut. rows: id, delta."""
    cut = lambda order, keep, side: rows.orderBy(order, "id").limit(n).where(keep).select("id", "delta", F.lit(side).alias("side"))
    return cut(F.col("delta").desc(), F.col("delta") > 0, "win").union(cut(F.col("delta").asc(), F.col("delta") < 0, "loss"))


def latency_summary(rows: DataFrame, value: str, sets: list[tuple[str, ...]]) -> DataFrame:
    """Counts and interpolated percentiles for each grouping set, in one pass
    over the rows; nulls do not count."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    q = lambda p: F.percentile(F.col(value), F.lit(p))
    return rows.where(F.col(value).isNotNull()).groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(value).alias("most"), F.avg(value).alias("mean")
    )


def threshold_verdict(p95_chars: Column, p95_chunks: Column, p95_ms: Column) -> Column:
    """How many of three 95th percentiles pass their gates."""
    over = (p95_chars >= 200_000).cast("int") + (p95_chunks >= 500).cast("int") + (p95_ms >= 1000).cast("int")
    return F.when(over >= 2, "adopt_broad").when(over == 1, "adopt_narrow").otherwise("defer")


def worst_rate_gate(rows: DataFrame) -> DataFrame:
    """(worst, rate, verdict) from (name, rate) rows: at 5 % act, below 0.5 %
    close, else watch."""
    out = rows.agg(F.max_by("name", F.struct("rate", "name")).alias("worst"), F.max("rate").alias("rate"))
    return out.withColumn("verdict", F.when(F.col("rate") >= 0.05, "act").when(F.col("rate") < 0.005, "close").otherwise("watch"))


def stable_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """For each case whether every run passed, and the one first-hit signature
    of its good runs (null if there are several or none). runs: keys, ok,
    signature."""
    good = F.when(F.col("ok"), F.col("signature"))
    return runs.groupBy(*keys).agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("stable"), F.when(F.min(good) == F.max(good), F.min(good)).alias("signature"), F.count("*").alias("runs"))


def ab_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(fixed, broken, changed): how many cases b passes that a failed, fails
    that a passed, and answers otherwise. Sides as stable_runs gives them."""
    right = b.select(key, F.col("stable").alias("b_ok"), F.col("signature").alias("b_sig"))
    both = a.select(key, F.col("stable").alias("a_ok"), F.col("signature").alias("a_sig")).join(right, key)
    count = lambda c: F.count_if(c)
    return both.agg(F.count("*").alias("cases"), count(~F.col("a_ok") & F.col("b_ok")).alias("fixed"), count(F.col("a_ok") & ~F.col("b_ok")).alias("broken"), count(F.col("a_sig") != F.col("b_sig")).alias("changed"))


def mode_summary(runs: DataFrame, mode: str) -> DataFrame:
    """Passes, errors and pooled times of each mode. runs: mode, ok, ms."""
    return runs.groupBy(mode).agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), percentile_or_zero(F.col("ms"), 0.5).alias("p50"), percentile_or_zero(F.col("ms"), 0.95).alias("p95"))


def p95_by_case(runs: DataFrame, key: str, value: str) -> DataFrame:
    """The exclusive 95th percentile of each case's runs, and the largest run
    beside it, since of few runs the percentile lies beyond it."""
    return runs.groupBy(key).agg(percentile_exclusive(F.collect_list(value)).alias("p95"), F.max(value).alias("most"))


def regressions(current: DataFrame, baseline: DataFrame, key: str, tolerance: float = 1.2) -> DataFrame:
    """Cases over the tolerance; those without a baseline are left out."""
    prev = baseline.select(key, F.col("p95").alias("before"))
    return current.join(prev, key).where(F.col("p95") > tolerance * F.col("before")).select(key, "before", F.col("p95").alias("after"))


def status_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often each status occurs, its share, and the failure rate."""
    counts = rows.groupBy(*keys, "status").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("failure_rate", F.sum(F.when(F.col("status") != "ok", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w))


def selector_rating(selector: Column, tag: Column, depth: Column) -> Column:
    """How good a page's selector is: by the element that it names and how deep
    that lies; without a selector it failed."""
    named = tag.isin("ARTICLE", "MAIN") | ((depth >= 4) & ~tag.isin("BODY", "HTML", "DIV"))
    return F.when(selector.isNull(), "fail").when(named, "ideal").when(depth >= 3, "acceptable").otherwise("too_wide")


def category_success(rows: DataFrame, category: str) -> DataFrame:
    """Ratings of each category, one column each, and the success rate."""
    out = rows.groupBy(category).pivot("rating", ["ideal", "acceptable", "too_wide", "fail"]).count().na.fill(0)
    total = F.col("ideal") + F.col("acceptable") + F.col("too_wide") + F.col("fail")
    return out.withColumn("success", (F.col("ideal") + F.col("acceptable")) / total)


def ground_truth_pass(blob: Column, must_all: Column, must_any: Column, pattern: Column | None, n_chunks: Column, least: int) -> Column:
    """All of one list, any of another (an empty one asks nothing), a pattern
    and a least number of chunks."""
    has = lambda s: F.contains(blob, s)
    out = F.forall(must_all, has) & ((F.size(must_any) == 0) | F.exists(must_any, has)) & (n_chunks >= least)
    return out if pattern is None else out & F.rlike(blob, pattern)


def compare(actual: Column, spec: str) -> Column:
    """A comparison such as '>= 3', or equality with a bare number."""
    op, _, number = spec.strip().rpartition(" ")
    value = F.lit(float(number))
    ops = {"": actual == value, "==": actual == value, "!=": actual != value, ">=": actual >= value, "<=": actual <= value, ">": actual > value, "<": actual < value}
    if op not in ops:
        raise ValueError(f"unknown comparison: {spec!r}")
    return ops[op]
