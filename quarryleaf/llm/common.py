"""What the operators share: table access, lineage cuts and word hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and all tasks run in this one process's
    machine (tests, a laptop) a local temporary folder is made and set as the
    checkpoint folder; on a cluster the lack of one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarryleaf-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs a
    re-read and not a recomputation."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text leaves this remainder; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == F.lit(remainder), F.lit(False))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def release() -> None:
    """Drop the tables of ``_powers`` and return freed memory to the system. A
    function of this module, which workers import: a batch function's own
    globals are copies there."""
    global _POWERS, _INVERSES
    _POWERS = _INVERSES = np.empty(0, np.uint64)
    pa.default_memory_pool().release_unused()
    _trim()(0)


def give_back(run):
    """A batch function that, once its task is over, gives memory back: workers
    are reused, and would carry one stage's buffers into the next."""

    @functools.wraps(run)
    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            release()

    return wrapped


# ---------------------------------------------------------------------------
# Words of many texts at once, without a Python object for each word


_SEED = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.empty(0, np.uint64)
_INVERSES = np.empty(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            factors = np.ones((2, m), np.uint64)
            factors[0, 1:], factors[1, 1:] = np.uint64(_BASE), np.uint64(_INVERSE)
            _POWERS, _INVERSES = np.cumprod(factors, axis=1, dtype=np.uint64)
    return _POWERS, _INVERSES


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts: ``doc`` the text's place, ``hash`` a 64-bit
    hash of the lower-cased word, ``start``/``end`` byte offsets in ``data``."""

    __slots__ = ("doc", "hash", "start", "end", "data", "n_docs")

    def __init__(self, doc, hash_, start, end, data, n_docs):
        self.doc, self.hash, self.start, self.end, self.data, self.n_docs = doc, hash_, start, end, data, n_docs


_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", *range(0x80, 0x100)]] = True
_LETTER = _WORD.copy()
_LETTER[[*b"0123456789"]] = False


def words_of(data: np.ndarray, bounds: np.ndarray, letters_only: bool = False) -> Words:
    """Cut texts into words: runs of ASCII letters, digits (unless
    ``letters_only``) and non-ASCII characters other than Latin-1 signs and
    general or CJK punctuation; A-Z and the Latin-1 capitals are lower-cased.

    data: UTF-8 bytes (uint8) of texts that lie one after another; bounds:
    where each begins, and the end of the last.
    """
    n = len(data)
    low = data.copy()
    up = (low >= 65) & (low <= 90)
    low[up] += 32
    is_word = (_LETTER if letters_only else _WORD)[data]
    if n and data.max() >= 0x80:
        c3 = np.flatnonzero(data[:-1] == 0xC3) + 1
        c3 = c3[(data[c3] >= 0x80) & (data[c3] <= 0x9E) & (data[c3] != 0x97)]
        low[c3] += 32
        signs = np.flatnonzero(data[:-1] == 0xC2)
        is_word[signs] = is_word[signs + 1] = False
        for lead, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
            at = np.flatnonzero(data[:-2] == lead)
            at = at[np.isin(data[at + 1], seconds)]
            for k in range(3):
                is_word[at + k] = False
    edge = np.empty(n + 1, bool)
    edge[:-1] = is_word
    edge[-1] = False
    starts = edge[:-1].copy()
    starts[1:] &= ~is_word[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < n]
    starts[inner] = is_word[inner]
    ends = edge[:-1] & ~edge[1:]
    cuts = inner[inner > 0] - 1
    ends[cuts] = is_word[cuts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(bounds, s, side="right") - 1
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
    return Words(doc, mix64(h ^ _SEED), s, e, low, len(bounds) - 1)


SLICE = 1 << 18  # bytes of text that are cut into words at once


def text_slices(column, at_most: int = SLICE):
    """(first, last, data, bounds) for runs of a string column: as many texts
    as fit in ``at_most`` bytes, one at least; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + at_most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def segment_sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by the ascending group numbers."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(groups):
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        out[groups[first]] = np.add.reduceat(values, first, axis=0)
    return out
