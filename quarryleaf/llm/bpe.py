"""Byte-level BPE encoding and decoding with a rank queue.

Each pre-token that is no vocabulary entry is merged through a queue with one
bucket for each merge rank. A bucket holds positions of a linked list of
symbols; a two-level bitmap over the ranks names the first bucket in use by
find-first-set. Entries are never removed from the middle: one whose pair has
changed since is skipped when it comes up. A pre-token of n bytes takes
O(n log n) steps, so a million letters without a space are no special case.

Empty or null text has no tokens, an empty table gives no rows. Repeated rows
give repeated rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import give_back


class Codec:
    """Encoder and decoder over a table of ranks (bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], plain: str, full: str):
        self.ranks = ranks
        self.vocabulary = {v: k for k, v in ranks.items()}
        self.written = {str(v): k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.splitter = Splitter(plain, full)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank's leftmost pair goes first.

        buckets: positions by rank, each a heap; words and top: the bitmap's
        two levels, 256 ranks to a word."""
        ranks = self.ranks
        n, longest, get = len(piece), self.longest, ranks.get
        if n <= longest and (whole := get(piece)) is not None:
            return [whole]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap as it is
                else:
                    buckets[r] = [i]
                    g = r >> 8
                    words[g] = words.get(g, 0) | 1 << (r & 255)
                    top |= 1 << g
        while top:
            g = (top & -top).bit_length() - 1
            word = words[g]
            rank = (g << 8) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                del buckets[rank]
                word &= word - 1
                words[g] = word
                if not word:
                    top &= top - 1
            else:
                i = heappop(bucket)
            if pair[i] != rank:
                continue  # merged or changed since it was queued
            j = after[i]
            k = after[i] = after[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                end = after[k]
                r = get(piece[i:end], -1) if end - i <= longest else -1
                pair[i] = r
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        g = r >> 8
                        words[g] = words.get(g, 0) | 1 << (r & 255)
                        top |= 1 << g
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                r = get(piece[p:k], -1) if k - p <= longest else -1
                pair[p] = r
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], p)
                    else:
                        buckets[r] = [p]
                        g = r >> 8
                        words[g] = words.get(g, 0) | 1 << (r & 255)
                        top |= 1 << g
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.splitter(text) for i in self.merge(p.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def digest(self, text: str, memo: Memo) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of the ids and of the bytes that they decode to."""
        ids = ",".join([memo[p] for p in self.splitter(text)])
        each = ids.split(",") if ids else []
        decoded = b"".join(map(self.written.__getitem__, each))
        return len(each), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


class Memo(dict):
    """Pre-token to its ids as text, of at most about ``bound`` pre-tokens, in
    two halves: when the newer is full it becomes the older, and what is used
    again returns, also within one text. It belongs to one task and changes no result."""

    def __init__(self, codec: Codec, bound: int = 500_000):
        self.codec, self.half, self.older = codec, bound // 2, {}

    def __missing__(self, piece: str) -> str:
        value = self.older.get(piece)
        if value is None:
            value = ",".join(map(str, self.codec.merge(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


class Splitter:
    """Pre-tokens of a text, by Python's own engine with \\p{..} classes
    written out. The classes of the basic plane are much the faster, so those
    of all planes serve only a text with a character beyond it."""

    def __init__(self, plain: str, full: str):
        self._plain = re.compile(plain).findall
        self._full_pattern = full
        self._full = None
        self._beyond = re.compile("[\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        if not self._beyond(text):
            return self._plain(text)
        if self._full is None:
            self._full = re.compile(self._full_pattern).findall
        return self._full(text)


def _written(pattern: str, below: int) -> str:
    """The pattern with its Unicode classes written out as characters; \\s has
    the White_Space characters, which Python's own \\s exceeds."""
    spaces = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    out, i, inside = [], 0, False
    while i < len(pattern):
        unit = next((c for c in ("\\p{L}", "\\p{N}", "\\s", "\\S") if pattern.startswith(c, i)), None) or pattern[i : i + 1 + (pattern[i] == "\\")]
        if unit in ("[", "]"):
            inside = unit == "["
        written = unit
        if unit in ("\\p{L}", "\\p{N}", "\\s"):
            written = spaces if unit == "\\s" else _ranges(unit, below)
            written = written if inside else f"[{written}]"
        elif unit == "\\S":
            if inside:
                raise ValueError("\\S within a class is not supported")
            written = f"[^{spaces}]"
        out.append(written)
        i += len(unit)
    return "".join(out)


@lru_cache(None)
def _ranges(prop: str, below: int) -> str:
    """The characters of a property as ranges for a class; by the tokenizer
    library's own tables where it is installed."""
    chars = "".join(chr(c) for c in range(below) if not 0xD800 <= c <= 0xDFFF)
    try:
        import tiktoken

        one = tiktoken.Encoding("probe", pat_str=prop, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        members = set(one.decode(one.encode_ordinary(chars)))
    except ImportError:
        import regex

        members = set(regex.findall(prop, chars))
    out, run = [], None
    for c in [*range(below), None]:
        if c is not None and chr(c) in members:
            run = [c, c] if run is None else [run[0], c]
        elif run:
            out.append(f"\\U{run[0]:08x}-\\U{run[1]:08x}")
            run = None
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(4)
def patterns(pattern: str) -> tuple[str, str]:
    """The pattern written out for the basic plane and for all planes. The
    driver makes them, so that all workers cut alike whatever is installed."""
    return _written(pattern, 0x10000), _written(pattern, 0x110000)


@lru_cache(4)
def codec(path: str, plain: str, full: str) -> Codec:
    """One for each worker process; the vocabulary file must be on every node."""
    return Codec(read_ranks(path), plain, full)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): every whole text's token ids, and the bytes they
    decode to. Null text counts as empty."""

    plain, full = patterns(pattern)

    @give_back
    def run(batches):
        c = codec(path, plain, full)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every whole text."""

    plain, full = patterns(pattern)

    @give_back
    def run(batches):
        c = codec(path, plain, full)
        memo = Memo(c)
        for b in batches:
            rows = [c.digest(t.as_py() or "", memo) for t in b.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
