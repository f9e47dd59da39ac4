"""Reusable state as tables: visits, host latencies, caches, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.functions.stats import ceiling_ms
from quarryleaf.settings import DEFAULTS


def visit_hints(visits: DataFrame, key: str, order: list[str], threshold: int = DEFAULTS.visit_hint) -> DataFrame:
    """visits with the running count of their key and whether it is time to
    suggest a profile (this visit included)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    return visits.withColumn("visit", n).withColumn("suggest", F.col("visit") >= threshold)


def host_ceilings(samples: DataFrame, host: str, ms: str, order: list[str], keep: int = DEFAULTS.host_samples) -> DataFrame:
    """Each sane sample with its host's time limit then: from the 95th
    percentile of the last ``keep``, of enough of them."""
    sane = samples.where(F.col(ms).between(0, DEFAULTS.sane_ms))
    w = Window.partitionBy(host).orderBy(*order).rowsBetween(1 - keep, 0)
    p95 = F.percentile(F.col(ms), F.lit(0.95)).over(w)
    return sane.withColumn("ceiling_ms", ceiling_ms(p95, F.count("*").over(w), DEFAULTS.host_default_ms, DEFAULTS.host_least_samples, DEFAULTS.ceiling_low_ms, DEFAULTS.ceiling_high_ms))


def current_ceilings(samples: DataFrame, host: str, ms: str, order: Column, keep: int = DEFAULTS.host_samples) -> DataFrame:
    """One row for each host: the limit after its last ``keep`` sane samples."""
    w = Window.partitionBy(host).orderBy(order)
    last = samples.where(F.col(ms).between(0, DEFAULTS.sane_ms)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    out = last.groupBy(host).agg(F.count("*").alias("n"), F.percentile(ms, F.lit(0.95)).alias("p95"))
    return out.withColumn("ceiling_ms", ceiling_ms(F.col("p95"), F.col("n"), DEFAULTS.host_default_ms))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(key, "_r.*")


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, now: str, ttl_s: float = DEFAULTS.cache_ttl_s) -> DataFrame:
    """requests with the newest entry of their key that was written by then and
    is still fresh (at the limit it is). cache: key, cached_at (seconds).

    Entries are dealt by the time bucket in which they can be fresh, so that a
    key with many entries joins only those near a request.
    """
    width = max(1, int(ttl_s))
    # An entry is fresh in its own bucket and, past its end, in the next one or two.
    spread = F.explode(F.sequence(F.floor(F.col("cached_at") / width), F.floor((F.col("cached_at") + ttl_s) / width)))
    entries = cache.withColumn("_bucket", spread).select(F.col(key).alias("_key"), "_bucket", "cached_at")
    asked = requests.withColumn("_bucket", F.floor(F.col(now) / width)).withColumn("_id", F.monotonically_increasing_id())
    near = (F.col(key) == F.col("_key")) & (asked["_bucket"] == entries["_bucket"]) & (F.col("cached_at") <= F.col(now)) & (F.col("cached_at") + ttl_s >= F.col(now))
    columns = requests.columns
    return asked.join(entries, near, "left").groupBy("_id", *columns).agg(F.max("cached_at").alias("cached_at")).drop("_id").withColumn("hit", F.col("cached_at").isNotNull())


def cache_evictions(entries: DataFrame, size: str, order: list[str], cap: int = DEFAULTS.cache_bytes, keep_share: float = DEFAULTS.cache_trim_share) -> DataFrame:
    """Entries to evict, oldest first, once all together are over the cap:
    until ``keep_share`` of it is left.

    The running total is made in two steps, by day buckets of the first order
    column and then within them, so no task sorts all entries.
    """
    bucket = F.floor(F.col(order[0]) / 86_400).alias("_bucket")
    marked = entries.withColumn("_bucket", bucket)
    sums = marked.groupBy("_bucket").agg(F.sum(size).alias("_s"))
    before = sums.select("_bucket", (F.sum("_s").over(Window.orderBy("_bucket")) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_total"))
    within = Window.partitionBy("_bucket").orderBy(*order)
    out = marked.join(before, "_bucket").withColumn("_sum", F.col("_before") + F.sum(size).over(within) - F.col(size))
    return out.where((F.col("_total") > cap) & (F.col("_total") - F.col("_sum") > keep_share * cap)).drop("_bucket", "_before", "_total", "_sum")


def transfer_candidates(targets: DataFrame, profiles: DataFrame, key: str, host: str, low: float = DEFAULTS.transfer_low, high: float = DEFAULTS.transfer_high) -> DataFrame:
    """The profile of the same host that each target can take over: the newest
    whose size is like the target's. targets: key, host, chars; profiles: host,
    profile_id, profile_chars, generated_at."""
    like = F.col("chars").between(low * F.col("profile_chars"), high * F.col("profile_chars"))
    pairs = targets.join(profiles.where(F.col("profile_chars") > 0), host).where(like)
    return pairs.groupBy(key).agg(F.max_by("profile_id", F.struct("generated_at", F.col("profile_id"))).alias("profile_id"), F.count("*").alias("candidates"))


#: Texts that stand in for content still to come.
PLACEHOLDER = r"(?i)^(—+|---+|\.{3,}|loading)$"


def shown(selected: Column, least: int = 50) -> Column:
    """Whether a selector's text is content: there, long enough, no placeholder."""
    t = F.trim(selected)
    return F.coalesce((F.length(t) >= least) & ~F.rlike(t, F.lit(PLACEHOLDER)), F.lit(False))


def stable_after(ticks: DataFrame, key: str, order: str, length: str, least: int = 100, times: int = 4, ready: Column | None = None) -> DataFrame:
    """(key, ready_at): when a page's text length had not changed for so many
    ticks in a row, and ``ready`` (as by ``shown``) held if it is given."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (F.col(length) != F.lag(length).over(w)) | F.lag(length).over(w).isNull() | (F.col(length) <= least)
    islands = ticks.withColumn("_i", F.sum(changed.cast("int")).over(w))
    run = F.row_number().over(Window.partitionBy(key, "_i").orderBy(order)) - 1
    return islands.withColumn("_run", run).where((F.col("_run") >= times) & (F.col(length) > least)).where(F.lit(True) if ready is None else ready).groupBy(key).agg(F.min(order).alias("ready_at"))


def step_references(steps: DataFrame, key: str, idx: str, ref: str, value: str) -> DataFrame:
    """steps whose value is that of the step that they refer to, if any."""
    earlier = steps.select(F.col(key).alias("_k"), F.col(idx).alias("_i"), F.col(value).alias("_v"))
    out = steps.join(earlier, (F.col(key) == F.col("_k")) & (F.col(ref) == F.col("_i")), "left")
    return out.withColumn(value, F.when(F.col(ref).isNull(), F.col(value)).otherwise(F.col("_v"))).drop("_k", "_i", "_v")
