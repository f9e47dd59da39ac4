"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to ``BINS`` bins, a fixed hashed set for all corpora. A
   passage is a run of ``WINDOW`` words; document frequencies are counted over
   every passage of the corpus.
2. The latent space is a randomised SVD of the TF-IDF matrix of all passages of
   the corpus and of the benchmark, repeats included.
   Tasks, one for ``_PASSAGES`` passages and ``_SKETCHES`` at most (each sends on a
   Y of its own), add up Y = A'(A W) for a Gaussian W in blocks of
   bins, and the driver finishes by Nystrom's method with matrices of RANK + OVERSAMPLE rows and
   columns. RANK is far below the number of passages, so words that keep company
   lie together.
3. Each word has a latent vector, IDF times its row of the basis with columns
   divided by their singular values, so that what all passages of a language
   share makes no two of them alike; a window's is the sum of its words'. Every window of every document, ``STRIDE`` words
   apart, is compared with every benchmark passage by cosine in the latent
   space. Items shorter than a window are also compared with windows of
   ``SHORT_BLOCKS`` strides, which have less of what is around the item.
4. A candidate is kept if the longest common subsequence of words with the item
   covers ``NEAR`` of the item, or ``PARAPHRASE`` of it and ``ANSWER`` of its
   last sentence. Words that over a twentieth of all passages have are left out
   of both, if the item has five others. Items of under ``SHORT`` words must be
   there word for word, and are looked up so, without a cosine (1 is given).

The benchmark is the stated query set. It goes through in blocks of at most
``PASSAGES_AT_ONCE`` passages (one item at least), which bounds what is
broadcast; with several blocks the documents are written to the shared folder
after each. The latent space is fitted once for all.

Null and empty texts and empty tables give no hits; rows of the benchmark
without an item_id or words are passed over. Items with equal item_id are one
item with several texts, the best of which gives the hit. Repeated rows give
repeated results. Other columns of docs are kept whatever their names, but for
``as_col``, which is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import cut, give_back, mix64, segment_sums, text_slices, words_of

BINS = 1 << 16
WINDOW, STRIDE = 24, 8  # of documents and of items alike
SHORT_BLOCKS = 2  # strides in a window for items that are shorter than WINDOW
RANK, OVERSAMPLE = 96, 16
SVD_PASSAGES = 40_000
PASSAGES_AT_ONCE = 1 << 15
BENCHMARK_SHARE = 0.5  # of the matrix's squared norm, beside the corpus's
COSINE = 0.66  # in the latent space, where common directions weigh little
TELLING = 3.0  # the IDF of a word that a twentieth of all passages have
NEAR, PARAPHRASE, ANSWER, SHORT = 0.8, 0.55, 0.6, 8
_SKETCHES, _TASKS, _CHUNK = 64, 4, 1024  # of the fit: tasks that make a Y of their own, tasks that add these up, bins in a block of Y
_LEAST, _PASSAGES, _WORDS = 8, 150_000, 1 << 18  # of the fit: tasks of a small corpus, passages for a task more, words added to Y at once


def _words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(data, np.array([0, len(data)])).hash


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _starts(doc: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` words begin; they begin anew with each text."""
    n = len(doc)
    if not n:
        return np.empty(0, np.int64)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return np.flatnonzero((np.arange(n) - start) % size == 0)


def _owners(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


# ---------------------------------------------------------------------------
# Fit


def passage_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bin, n): in how many passages of the corpus a bin occurs; bin -1 has
    the number of passages."""

    @give_back
    def run(batches):
        n, total = np.zeros(BINS, np.int64), 0
        for b in batches:
            for _, _, data, bounds in text_slices(b.column(0)):
                words = words_of(data, bounds)
                starts = _starts(words.doc, WINDOW)
                key = np.sort(_owners(starts, len(words.hash)) * BINS + _bins(words.hash))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                n += np.bincount(key % BINS, minlength=BINS)
                total += len(starts)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(n[some], total))], ["bin", "n"])

    return docs.select(text_col).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def sampled_passages(docs: DataFrame, n_passages: int, text_col: str = "text", at_most: int = SVD_PASSAGES) -> DataFrame:
    """(h, bins): the ``at_most`` distinct passages of least hash, which is of
    their words and place in the text. For a look at a corpus; ``fit`` takes all."""
    # Twice the share: what is over is cut by the order of the hash. A share of
    # the texts is drawn first, ten times the passages' or all.
    share = min(1.0, 2 * at_most / max(1, n_passages))
    texts = min(1.0, 10 * share)
    below = np.uint64(share / texts * (2.0**63 - 1))
    drawn = F.pmod(F.xxhash64(F.lit("svd"), text_col), F.lit(1 << 20)) < int(texts * (1 << 20))

    @give_back
    def run(batches):
        seen: set = set()
        for b in batches:
            for _, _, data, bounds in text_slices(b.column(0)):
                words = words_of(data, bounds)
                starts = _starts(words.doc, WINDOW)
                if not len(starts):
                    continue
                before = np.searchsorted(words.doc, words.doc[starts])
                with np.errstate(over="ignore"):
                    mixed = words.hash * (2 * (np.arange(len(words.hash)) - np.repeat(starts, np.diff(np.append(starts, len(words.hash))))).astype(np.uint64) + np.uint64(1))
                    h = mix64(np.add.reduceat(mixed, starts) + (starts - before).astype(np.uint64)) >> np.uint64(1)
                ends = np.append(starts[1:], len(words.hash))
                bins = _bins(words.hash).astype(np.int32)
                rows = {int(h[k]): bins[starts[k] : ends[k]] for k in np.flatnonzero(h <= below) if int(h[k]) not in seen}
                if len(seen) < 1_000_000:
                    seen.update(rows)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.list_(pa.int32()))], ["h", "bins"])

    return docs.select(text_col).where(drawn).mapInArrow(run, "h long, bins array<int>").dropDuplicates(["h"]).orderBy("h").limit(at_most)


def gaussian(n: int = RANK + OVERSAMPLE, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, n), dtype=np.float32)


def add_sketch(y: np.ndarray, w: np.ndarray, passages: list, idf: np.ndarray, weight: float = 1.0) -> float:
    """Add weight A'(A w) to y, A the TF-IDF rows of passages (arrays of bins);
    the squared norm of A."""
    norm = 0.0
    for i in range(0, len(passages), 1000):
        part = [p for p in passages[i : i + 1000] if len(p)]
        if not part:
            continue
        bins = np.concatenate(part).astype(np.int64)
        owner = np.repeat(np.arange(len(part)), [len(p) for p in part])
        value = idf[bins].astype(np.float32)[:, None]
        t = segment_sums(w[bins] * value, owner, len(part))
        order = np.argsort(bins, kind="stable")
        some, first = np.unique(bins[order], return_index=True)
        y[some] += np.float32(weight) * np.add.reduceat((t[owner] * value)[order], first, axis=0)
        norm += float((value**2).sum())
    return norm


def run_sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """Sums of rows[index] over the runs of index that begin at starts. Runs of
    one length are summed together, row by row; reduceat goes column by column."""
    n, size = len(starts), np.diff(np.append(starts, len(index)))
    out, part = np.empty((n, rows.shape[1]), rows.dtype), np.empty((at_once, rows.shape[1]), rows.dtype)
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, z in zip(edges, np.append(edges[1:], n)):
        length = int(size[order[a]])
        if length > at_once:
            for k in order[a:z]:
                own = index[starts[k] : starts[k] + length]
                out[k] = sum(rows[own[i : i + at_once]].sum(axis=0) for i in range(0, length, at_once))
            continue
        each, places = at_once // length, np.arange(length)
        for i in range(a, z, each):
            runs = order[i : min(i + each, z)]
            own = index[(starts[runs][:, None] + places).ravel()]
            out[runs] = np.take(rows, own, axis=0, out=part[: len(own)], mode="clip").reshape(len(runs), length, -1).sum(axis=1)
    return out


def add_runs(y: np.ndarray, w: np.ndarray, bins: np.ndarray, starts: np.ndarray) -> None:
    """Add N'(N w) to y, N the counts of bins (16 bits) in the runs that begin
    at starts."""
    if not len(starts):
        return
    t = run_sums(w, bins, starts)
    order = np.argsort(bins, kind="stable")
    own = bins[order]
    each = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    y[own[each]] += run_sums(t, _owners(starts, len(bins))[order], each)


def corpus_sketch(docs: DataFrame, idf, text_col: str = "text", sketches: int = _SKETCHES) -> DataFrame:
    """(chunk, y): blocks of _CHUNK rows of Y = A'(A W) over all passages, as
    float32 bytes, and the squared norm of A as block -1. idf: a broadcast;
    sketches: how many tasks at most make a Y of their own."""

    @give_back
    def run(batches):
        scale = idf.value.astype(np.float32)[:, None]
        w, norm = gaussian() * scale, 0.0
        y, some, size = np.zeros(w.shape), [], 0
        for b in batches:
            for _, _, data, bounds in text_slices(b.column(0)):
                words = words_of(data, bounds)
                bins = _bins(words.hash).astype(np.uint16)
                some.append((bins, _starts(words.doc, WINDOW) + size))
                size += len(bins)
                norm += float((scale[bins].astype(float) ** 2).sum())
                if size >= _WORDS:
                    add_runs(y, w, *map(np.concatenate, zip(*some)))
                    some, size = [], 0
        if some:
            add_runs(y, w, *map(np.concatenate, zip(*some)))
        y = (y * scale).astype(np.float32)
        for k in range(0, BINS, 16 * _CHUNK):
            blocks = range(k // _CHUNK, k // _CHUNK + 16)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([y[c * _CHUNK : (c + 1) * _CHUNK].tobytes() for c in blocks], pa.binary())], ["chunk", "y"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.float32([norm]).tobytes()], pa.binary())], ["chunk", "y"])

    @give_back
    def add(batches):
        sums: dict = {}
        for b in batches:
            for k, y in zip(b.column(0).to_pylist(), b.column(1)):
                y = np.frombuffer(y.as_buffer(), np.float32)
                sums[k] = sums[k] + y if k in sums else y.copy()
        for k, y in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([y.tobytes()], pa.binary())], ["chunk", "y"])

    return docs.select(text_col).coalesce(sketches).mapInArrow(run, "chunk int, y binary").repartition(_TASKS, "chunk").mapInArrow(add, "chunk int, y binary")


def basis(y: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Nystrom's method on Y = C W: the orthonormal leading eigenvectors of C
    as columns, and its eigenvalues. Y is overwritten."""
    w = gaussian(y.shape[1])
    scale = float(np.abs(y).max()) or 1.0
    y /= np.float32(scale)
    core, gram = np.zeros((y.shape[1],) * 2), np.zeros((y.shape[1],) * 2)
    for k in range(0, BINS, _CHUNK):  # sums of double precision
        a, b = y[k : k + _CHUNK].astype(float), w[k : k + _CHUNK].astype(float)
        core += b.T @ a
        gram += a.T @ a
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-6 * max(values[-1], 1e-300)
    root = vectors[:, keep] / np.sqrt(values[keep])  # C is about (Y root)(Y root)'
    s, p = np.linalg.eigh(root.T @ gram @ root)
    keep = np.flatnonzero(s > 1e-6 * max(s[-1] if len(s) else 0, 1e-300))[::-1][:rank]
    turn = root @ (p[:, keep] / np.sqrt(s[keep]))
    return y @ turn.astype(np.float32), s[keep] * scale


# ---------------------------------------------------------------------------
# Search


class Space:
    """Latent vectors of words: a row for each bin. Picklable; its size is
    BINS * RANK numbers."""

    def __init__(self, idf: np.ndarray, u: np.ndarray):
        self.idf = idf.astype(np.float32)
        self.vectors = np.ascontiguousarray(u * self.idf[:, None], np.float32)

    def blocks(self, words, size: int = STRIDE):
        """(first word, latent vector) of runs of ``size`` words."""
        starts = _starts(words.doc, size)
        return starts, run_sums(self.vectors, _bins(words.hash), starts)


class Query:
    """Benchmark items of one block and the latent vectors of their passages.
    Picklable; its size is bounded by PASSAGES_AT_ONCE and the items' words."""

    def __init__(self, items: list, space: Space):
        self.ids = [i for i, _ in items]
        self.words = [_words(t) for _, t in items]
        self.telling = [space.idf[_bins(w)] > TELLING for w in self.words]
        self.answers = [answer_words(t) for _, t in items]
        self.sorted = [np.sort(w) for w in self.words]
        passages, owner = [], []
        for k, w in enumerate(self.words):
            for s in passage_starts(len(w)):
                passages.append(space.vectors[_bins(w[s : s + WINDOW])].sum(axis=0))
                owner.append((k, s))
        self.owner = owner
        self.latent = np.array(passages, np.float32).reshape(len(passages), space.vectors.shape[1])
        self.latent /= np.maximum(np.linalg.norm(self.latent, axis=1, keepdims=True), 1e-9)
        short = np.array([k for k, (item, _) in enumerate(owner) if len(self.words[item]) < WINDOW], np.int64)
        self.sizes = [(WINDOW // STRIDE, np.arange(len(owner)))] + ([(SHORT_BLOCKS, short)] if len(short) else [])

    def candidates(self, words, space: Space):
        """(passage, first word, cosine) of windows of a slice of texts."""
        if not len(words.hash) or not len(self.owner):
            return []
        first, block = space.blocks(words)
        doc, out = words.doc[first], []
        for per, chosen in self.sizes:
            window = block.copy()
            for k in range(1, min(per, len(block))):  # a window is cut short where its text ends
                window[:-k] += block[k:] * (doc[k:] == doc[:-k])[:, None]
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
            passages = self.latent[chosen]
            for i in range(0, len(window), 1024):
                for j in range(0, len(chosen), 2048):
                    cosine = (window[i : i + 1024] @ passages[j : j + 2048].T).ravel()
                    near = np.flatnonzero(cosine >= COSINE)  # few, and quickly found in one dimension
                    x, y = np.divmod(near, len(passages[j : j + 2048]))
                    out += zip(chosen[y + j].tolist(), first[x + i].tolist(), cosine[near].tolist())
        return out

    def hits(self, column, space: Space) -> list[list[dict]]:
        """For each text the items that it contains."""
        out = []
        for first, last, data, bounds in text_slices(column):
            words = words_of(data, bounds)
            found: list[dict] = [{} for _ in range(last - first)]
            edge = np.searchsorted(words.doc, np.arange(last - first + 1))
            for item, d in self.exact(words):
                found[d][self.ids[item]] = {"item_id": self.ids[item], "cosine": 1.0, "lcs": 1.0, "answer": 1.0}
            telling = space.idf[_bins(words.hash)] > TELLING
            seen = set()
            for passage, start, cosine in sorted(self.candidates(words, space), key=lambda c: -c[2]):
                item, offset = self.owner[passage]
                d = int(words.doc[start])
                n = len(self.words[item])
                if n < SHORT or self.ids[item] in found[d]:
                    continue
                margin = WINDOW + n // 4
                a, b = int(max(edge[d], start - offset - margin)), int(min(edge[d + 1], start - offset + n + margin))
                if (item, a, b) in seen:  # another passage of the item, as far along
                    continue
                seen.add((item, a, b))
                share, answer = self.verify(item, words.hash[a:b], telling[a:b])
                if share is not None:
                    found[d][self.ids[item]] = {"item_id": self.ids[item], "cosine": min(1.0, cosine), "lcs": share, "answer": answer}
            out += [list(x.values()) for x in found]
        return out

    def exact(self, words):
        """(item, text) of items of under SHORT words that are there word for word."""
        for item, whole in enumerate(self.words):
            if not 0 < (n := len(whole)) < SHORT:
                continue
            at = np.flatnonzero(words.hash[: max(0, len(words.hash) - n + 1)] == whole[0])
            for k in range(1, n):
                at = at[words.hash[at + k] == whole[k]]
            at = at[words.doc[at] == words.doc[at + n - 1]]
            yield from ((item, int(d)) for d in np.unique(words.doc[at]))

    def verify(self, item: int, region: np.ndarray, telling: np.ndarray):
        """(share of the item, of its answer) in the words, or two nulls."""
        whole = self.words[item]
        n = len(whole)
        tail = min(self.answers[item], n)
        if np.count_nonzero(self.telling[item]) >= 5:
            tail = int(np.count_nonzero(self.telling[item][n - tail :]))
            whole, region = whole[self.telling[item]], region[telling]
            n = len(whole)
        known = self.sorted[item]
        region = region[known[np.minimum(np.searchsorted(known, region), len(known) - 1)] == region]
        if len(region) < PARAPHRASE * n:  # no subsequence is longer
            return None, None
        whole, region = whole.tolist(), region.tolist()
        share = lcs(whole, region) / n
        if share < PARAPHRASE:
            return None, None
        answer = lcs(whole[n - tail :], region) / tail if tail else share
        return (share, answer) if share >= NEAR or answer >= ANSWER else (None, None)


def passage_starts(n: int) -> list[int]:
    last = max(0, n - WINDOW)
    return sorted({*range(0, last + 1, STRIDE), last}) if n else []


def answer_words(text: str | None) -> int:
    """How many of the last words are the last sentence: what an item asks for,
    where it has no field for it."""
    parts = [len(_words(p)) for p in re.split(r"(?<=[.!?])\s+|\n", text or "")]
    parts = [n for n in parts if n]
    return max(parts[-1], 3) if parts else 0


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def blocks_of(items: list) -> list[list]:
    """Items in order, as many as have PASSAGES_AT_ONCE passages together, one
    at least; rows of one item_id stay together."""
    out, size = [], 0
    for item in items:
        n = len(passage_starts(len(_words(item[1]))))
        if not out or (size + n > PASSAGES_AT_ONCE and out[-1][-1][0] != item[0]):
            out.append([])
            size = 0
        out[-1].append(item)
        size += n
    return out


def sketches_for(passages: int) -> int:
    """How many tasks make a Y of their own, whatever the partitions."""
    return min(_SKETCHES, max(_LEAST, passages // _PASSAGES))


def fit(docs: DataFrame, items: list, text_col: str = "text") -> Space:
    """The latent space of the corpus and the items."""
    counts = {r["bin"]: r["n"] for r in passage_frequencies(docs, text_col).toLocalIterator()}  # BINS + 1 rows at most
    total = counts.pop(-1, 0)
    df = np.zeros(BINS)
    df[list(counts)] = list(counts.values())
    idf = (np.log((total + 1) / (df + 1)) + 1e-3).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    y, norm = np.zeros((BINS, RANK + OVERSAMPLE), np.float32), 0.0
    for r in corpus_sketch(docs, shared, text_col, sketches_for(total)).toLocalIterator():
        if r["chunk"] < 0:
            norm += float(np.frombuffer(r["y"], np.float32)[0])
        else:
            y[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] += np.frombuffer(r["y"], np.float32).reshape(_CHUNK, -1)
    shared.unpersist()
    own = []
    for _, text in items:
        w = _bins(_words(text))
        own += [w[s : s + WINDOW] for s in passage_starts(len(w))]
    mass = sum(float((idf[p] ** 2).sum()) for p in own)
    add_sketch(y, gaussian(), own, idf, BENCHMARK_SHARE * norm / mass if mass and norm else 1.0)
    u, values = basis(y)
    return Space(idf, u * np.sqrt(values[:1] / values).astype(np.float32))


HITS = "array<struct<item_id:long,cosine:double,lcs:double,answer:double>>"


def with_hits(docs: DataFrame, benchmark: DataFrame, as_col: str = "_ql_hits", text_col: str = "text") -> DataFrame:
    """docs and the benchmark items that each text contains, by item_id."""
    items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator()]
    blocks = blocks_of([x for x in items if len(_words(x[1]))])
    none = F.array().cast(HITS)
    if not blocks:
        return docs.withColumn(as_col, none)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    context = docs.sparkSession.sparkContext
    fitted = fit(docs, items, text_col)
    space, out = context.broadcast(fitted), docs.withColumn(as_col, none)

    def finder(query):
        def found(text: pa.Array) -> pa.Array:
            return pa.array(query.value.hits(text, space.value), kind)

        return F.arrow_udf(found, HITS)

    for k, block in enumerate(blocks):
        query = context.broadcast(Query(block, fitted))
        out = out.withColumn(as_col, F.concat(F.col(as_col), finder(query)(F.col(text_col))))
        if k < len(blocks) - 1:
            out = cut(out)
            query.unpersist()
    return out.withColumn(as_col, F.array_sort(as_col))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer of each contaminated pair."""
    return with_hits(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("_ql_hits").alias("x")).select("doc_id", "x.*")
