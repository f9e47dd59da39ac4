"""Sample statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_exclusive(samples: Column, twentieths: int = 19) -> Column:
    """The exclusive quantile (type 6) of an array; of one sample itself, of
    none null. It may lie beyond the largest of a few samples."""
    s, n = F.sort_array(samples), F.size(samples)
    m = n + 1
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(m * twentieths / 20).cast("int")))
    d = m * twentieths - j * 20
    value = (F.get(s, j - 1) * (20 - d) + F.get(s, j) * d) / 20.0
    return F.when(n == 1, F.get(s, F.lit(0)).cast("double")).when(n > 1, value)


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def percentile_or_zero(c: Column, q: float) -> Column:
    return F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0))


def ceiling_ms(p95: Column, n: Column, default: int, least: int = 5, low: int = 1500, high: int = 15_000) -> Column:
    """Adaptive time limit: half again the p95, truncated, held between low and
    high. Six digits are kept before truncation, so that the last bits of an
    interpolated percentile do not matter."""
    return F.when(n < least, default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.round(p95 * 1.5, 6).cast("long")))).cast("long")
