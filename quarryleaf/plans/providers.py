"""Stand-ins for model servers, behind one interface each."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, document: Column) -> Column: ...


class Expander(Protocol):
    def expand(self, query: Column) -> Column: ...


class HashEmbedder:
    """Signed word hashes of a text, in a fixed number of dimensions; offline
    and deterministic. Arrow batches stand for a server's request batches."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def vector(self, text: str | None) -> list[float]:
        out = np.zeros(self.dimensions)
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return out.tolist()

    def embed(self, text: Column) -> Column:
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([self.vector(t.as_py()) for t in texts], pa.list_(pa.float64()))

        return F.arrow_udf(run, "array<double>")(text)


class OverlapReranker:
    """The share of the query's words that a document has."""

    def score(self, query: Column, document: Column) -> Column:
        from quarryleaf.functions.text import words

        asked = F.array_distinct(words(query))
        return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, words(document))) / F.size(asked))


class NoExpander:
    def expand(self, query: Column) -> Column:
        return F.lit("")
