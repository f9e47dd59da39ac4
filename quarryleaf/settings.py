"""Thresholds of the retrieval pipeline, read once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_budget: int = 100
    hybrid: bool = False
    rrf_k: int = 60
    rerank_max_docs: int = 30
    rerank_max_doc_chars: int = 1500
    rerank_max_total_chars: int = 40_000
    rerank_least_doc_chars: int = 200
    rerank_title: bool = True
    records: bool = True
    profile_direct_chunks: int = 20
    visit_hint: int = 3
    transfer_low: float = 0.3
    transfer_high: float = 3.0
    passthrough_bytes: int = 262_144
    cache_ttl_s: float = 300.0
    cache_bytes: int = 100 * 1024 * 1024
    cache_trim_share: float = 0.8
    telemetry_bytes: int = 64 * 1024 * 1024
    embed_chars: int = 1800
    embed_batch: int = 64
    host_samples: int = 50
    host_least_samples: int = 5
    host_default_ms: int = 15_000
    ceiling_low_ms: int = 1500
    ceiling_high_ms: int = 15_000
    sane_ms: int = 30_000

    @classmethod
    def from_conf(cls, spark: SparkSession, prefix: str = "quarryleaf.") -> Settings:
        """Defaults overridden by session settings such as quarryleaf.rrf_k;
        a value that cannot be read leaves the default."""
        out = {}
        for f in fields(cls):
            raw = spark.conf.get(prefix + f.name, None)
            if raw is None:
                continue
            try:
                kind = type(f.default)
                out[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
            except ValueError:
                continue
        return cls(**out)


DEFAULTS = Settings()
