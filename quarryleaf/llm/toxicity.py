"""Toxicity by a counterfactual-regularised linear classifier.

Statistics of every labelled row choose the terms: those that at least
``MIN_DOCS`` toxic documents have, most of whose documents are toxic, by a
difference of over ``MIN_Z`` standard errors. The identity terms of
``IDENTITY`` always belong to them. A logistic model over capped term counts is
fitted to all labelled documents that have a term (those without any are all
alike and enter as two counts): on the driver if they have ``DRIVER_VALUES``
term counts at most, else each step sums its gradient in tasks, in no fixed
order, so that last digits may vary. Its loss
also has the squared change of the score when an identity term in a labelled
sentence of those documents is swapped for another group's, so that a mention
of a group weighs as any other group's does and not as the company it keeps in
the labels.

Null and empty texts have no terms and get the model's base score. Labels that
are null are ignored; of several labels of a document the largest counts. A
document without an id is not held out, and matches no label. Without labels,
or with an empty table of documents, the model has the identity terms alone, at
weight zero. Other columns are kept whatever their names, but for ``as_col``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import Words, cut, give_back, held_out, text_slices, words_of

THRESHOLD = 0.7
DRIVER_VALUES = 2_000_000
STEPS = 600
_FIT_TASKS = 64  # whose gradients the driver gets at once
MIN_DOCS = 3
MIN_Z = 3.0
SWAP_PENALTY = 10.0
L2 = 1e-5

#: Groups by axis and language; a term is swapped for the next of its row.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["muslims", "christians", "jews", "hindus", "atheists"], ["muslim", "christian", "jewish", "hindu", "atheist"],
    ["black", "white", "asian", "latino"], ["gay", "straight", "lesbian", "bisexual", "transgender"], ["immigrants", "refugees", "natives"], ["disabled", "deaf", "blind"], ["elderly", "young"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs", "asiatiques"], ["frauen", "männer"], ["muslime", "christen", "juden"], ["ausländer", "einheimische"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos", "asiáticos"],
]


def _ids(words: Words) -> np.ndarray:
    """29-bit term numbers."""
    return (words.hash >> np.uint64(35)).astype(np.int64)


def _counts(words: Words):
    """(doc, term, count) of the distinct terms of each text, by both."""
    key = (words.doc.astype(np.int64) << 29) | _ids(words)
    key, n = np.unique(key, return_counts=True)
    return key >> 29, key & ((1 << 29) - 1), n


def _term(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_ids(words_of(data, np.array([0, len(data)])))[0])


def _swaps() -> dict[str, str]:
    return {w: row[(i + 1) % len(row)] for row in IDENTITY for i, w in enumerate(row)}


def swapped_sentences(text: str) -> list[tuple[str, str]]:
    """Each sentence that names a group, and the sentence with each such term
    swapped."""
    swaps, out = _swaps(), []
    for sentence in re.split(r"(?<=[.!?])\s|\n", text):
        new = re.sub(r"[^\W\d_]+", lambda m: swaps.get(m[0].lower(), m[0]), sentence)
        if new != sentence:
            out.append((sentence, new))
    return out



def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms, pairs) of labelled rows that are not held out.
    terms: term * 4 + its count (3 at most); pairs: for each sentence that
    names a group, its terms so written, -1, and those of the swapped one.

    The terms are made before the join, since they are a third of the text's
    size; the join is the same at every size of the labels."""
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"), 3, 1))

    def features(column):
        for first, last, data, bounds in text_slices(column):
            doc, term, n = _counts(words_of(data, bounds, letters_only=True))
            at = np.searchsorted(doc, np.arange(last - first + 1))
            packed = term * 4 + np.minimum(n, 3)
            for a, b in zip(at, at[1:]):
                yield packed[a:b]

    @give_back
    def run(batches):
        named = np.array(sorted(_term(w) for w in _swaps()))
        for b in batches:
            terms = list(features(b.column(1)))
            pairs = []
            for text, t in zip(b.column(1), terms):
                found = swapped_sentences(text.as_py()) if np.isin(t >> 2, named).any() else []
                flat = list(features(pa.array([s for pair in found for s in pair], pa.string()))) if found else []
                pairs.append([[*x.tolist(), -1, *y.tolist()] for x, y in zip(flat[::2], flat[1::2])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.int32())))], ["doc_id", "terms", "pairs"])

    kind = dict(docs.dtypes)["doc_id"]
    terms = texts.mapInArrow(run, f"doc_id {kind}, terms array<int>, pairs array<array<int>>")
    return terms.join(marks.hint("merge"), "doc_id")


def term_statistics(features: DataFrame) -> DataFrame:
    """(term, toxic_docs, clean_docs) over every labelled row."""

    @give_back
    def run(batches):
        terms, marks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def summed():
            key, where = np.unique(np.concatenate(terms), return_inverse=True)
            toxic = np.concatenate(marks)
            return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(where, w, len(key)).astype(np.int64)) for w in (toxic, 1 - toxic))], ["term", "toxic_docs", "clean_docs"])

        for b in batches:
            flat, sizes = b.column(1).flatten().to_numpy().astype(np.int64) >> 2, np.diff(b.column(1).offsets.to_numpy())
            terms.append(flat)
            marks.append(np.repeat((b.column(0).to_numpy() > 0).astype(np.int64), sizes))
            if sum(map(len, terms)) > 4_000_000:
                yield summed()
                terms, marks = terms[:1], marks[:1]
        yield summed()

    return features.select("toxic", "terms").mapInArrow(run, "term long, toxic_docs long, clean_docs long").groupBy("term").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


class Model:
    """terms (ascending), weights and bias; picklable."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = terms, weights, bias
        self._some = np.zeros(1 << 16, bool)
        self._some[terms & 0xFFFF] = True

    def score(self, column) -> np.ndarray:
        out = []
        for first, last, data, bounds in text_slices(column):
            words = words_of(data, bounds, letters_only=True)
            ids = _ids(words)
            keep = np.flatnonzero(self._some[ids & 0xFFFF])
            ids, doc = ids[keep], words.doc[keep]
            at = np.minimum(np.searchsorted(self.terms, ids), max(len(self.terms) - 1, 0))
            hit = self.terms[at] == ids if len(self.terms) else np.zeros(len(ids), bool)
            key, n = np.unique(doc[hit].astype(np.int64) * len(self.terms) + at[hit], return_counts=True)
            logit = np.full(last - first, self.bias)
            if len(key):
                logit += np.bincount(key // len(self.terms), self.weights[key % len(self.terms)] * np.minimum(n, 3) / 3, last - first)
            out.append(1 / (1 + np.exp(-np.clip(logit, -50, 50))))
        return np.concatenate(out) if out else np.empty(0)


def _flat(rows):
    """(row, place, value) of (places, values) of each row."""
    return np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows]), np.concatenate([p for p, _ in rows] or [[]]).astype(np.int64), np.concatenate([v for _, v in rows] or [[]]).astype(float)


def sums(w: np.ndarray, bias: float, rows, toxic: np.ndarray, weight: np.ndarray, pairs, n_pairs: int):
    """Gradients of the summed loss by w and by bias, and of half the squared
    changes of pairs by w. rows, pairs: (row, place, value)."""
    (r, c, v), (pr, pc, pv) = rows, pairs
    p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c] * v, len(toxic)) + bias, -50, 50)))
    d = (p - toxic) * weight
    change = np.bincount(pr, w[pc] * pv, n_pairs)
    return np.bincount(c, d[r] * v, len(w)), d.sum(), np.bincount(pc, change[pr] * pv, len(w))


def descend(gradients, n_terms: int, toxic: float, total: float, n_pairs: int, steps: int):
    """Weights and bias of the least loss, by accelerated gradient descent.
    gradients: what ``sums`` gives for a weight and bias; toxic, total: how many
    examples there are, n_pairs: how many pairs."""
    total = max(1e-9, total)
    share = np.clip(toxic / total, 1e-4, 1 - 1e-4)
    w, bias = np.zeros(n_terms), float(np.log(share / (1 - share)))
    m, s, mb, sb = np.zeros(n_terms), np.zeros(n_terms), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb, gp = gradients(w, bias)
        g, gb = g / total + L2 * w, gb / total
        if n_pairs:
            g += 2 * SWAP_PENALTY / n_pairs * gp
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 200)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    return w, bias


def solve(rows, toxic, weight, n_terms: int, pairs=(), steps: int = STEPS):
    """Weights and bias of the least loss.

    rows: (places, values) of each example; weight: how many it stands for;
    pairs: (places, values) of the difference of a sentence and its swap.
    """
    toxic, weight = np.asarray(toxic, float), np.asarray(weight, float)
    block = _flat(rows), toxic, weight, _flat(pairs), len(pairs)
    return descend(lambda w, bias: sums(w, bias, *block), n_terms, float((toxic * weight).sum()), float(weight.sum()), len(pairs), steps)


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of toxic, terms and pairs of many rows, as bytes: marks, numbers of
    terms, terms, numbers of terms of pairs, terms of pairs."""
    names = ["toxic", "sizes", "terms", "pair_sizes", "pair_terms"]

    @give_back
    def run(batches):
        for b in batches:
            pairs = b.column(2).flatten()
            parts = [(b.column(0).to_numpy() > 0).astype(np.int8), *(x.astype(np.int32) for c in (b.column(1), pairs) for x in (np.diff(c.offsets.to_numpy()), c.flatten().to_numpy()))]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names)

    return rows.select("toxic", "terms", "pairs").mapInArrow(run, ", ".join(f"{x} binary" for x in names))


def unpacked(blocks):
    """What ``sums`` takes, of the five columns of blocks."""
    toxic, sizes, terms, pair_sizes, pair_terms = (np.frombuffer(b"".join(c), t) for c, t in zip(blocks, (np.int8, np.int32, np.int32, np.int32, np.int32)))
    value = lambda x: (x & 3) / 3
    pair = np.repeat(np.arange(len(pair_sizes)), pair_sizes)
    swapped, own = np.cumsum(pair_terms < 0) > pair, pair_terms >= 0  # -1 stands between the two of each pair
    signed = np.where(swapped, -1.0, 1.0) * value(pair_terms)
    rows = np.repeat(np.arange(len(sizes)), sizes), terms >> 2, value(terms)
    return rows, toxic.astype(float), np.ones(len(toxic)), (pair[own], pair_terms[own] >> 2, signed[own]), len(pair_sizes)


def summed(blocks: DataFrame):
    """``sums`` over all blocks, added up in tasks."""
    context = blocks.sparkSession.sparkContext

    def gradients(w, bias):
        now = context.broadcast((w, bias))

        @give_back
        def run(batches):
            out = np.zeros(2 * len(now.value[0]) + 1)
            for b in batches:
                for k in range(b.num_rows):
                    g, gb, gp = sums(*now.value, *unpacked([[c[k].as_py()] for c in b.columns]))
                    out += np.concatenate([g, [gb], gp])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["g"])

        out = sum(np.frombuffer(r["g"]) for r in blocks.mapInArrow(run, "g binary").collect())
        now.destroy()
        return out[: len(w)], out[len(w)], out[len(w) + 1 :]

    return gradients


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows that are not held out."""
    features = cut(labelled_features(docs, labels))
    totals = {r["toxic"]: r["n"] for r in features.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    a, b = F.col("toxic_docs"), F.col("clean_docs")
    pooled = (a + b) / max(1, n_toxic + n_clean)
    z = (a / max(1, n_toxic) - b / max(1, n_clean)) / F.sqrt(pooled * (1 - pooled) * (1 / max(1, n_toxic) + 1 / max(1, n_clean)))
    chosen = term_statistics(features).where((a >= MIN_DOCS) & (a > b) & (z > MIN_Z)).select("term")
    terms = np.unique(np.array([r["term"] for r in chosen.collect()] + [_term(w) for w in _swaps()], np.int64))

    def known(column):
        """The column's lists without other terms, and places for the terms."""
        flat, offsets = column.flatten().to_numpy().astype(np.int64), column.offsets.to_numpy()
        place = np.minimum(np.searchsorted(terms, flat >> 2), len(terms) - 1)
        hit = (terms[place] == flat >> 2) | (flat < 0)
        kept = np.concatenate([[0], np.cumsum(hit)])[offsets - offsets[0]].astype(np.int32)
        return pa.ListArray.from_arrays(kept, pa.array(np.where(flat < 0, -1, place * 4 + (flat & 3))[hit].astype(np.int32)))

    @give_back
    def restricted(batches):
        for b in batches:
            offsets = b.column(3).offsets.to_numpy()
            pairs = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), known(b.column(3).flatten()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), known(b.column(1)), pairs], ["doc_id", "toxic", "terms", "pairs"])

    kind = dict(features.dtypes)["doc_id"]
    with_terms = features.select("doc_id", "terms", "toxic", "pairs").mapInArrow(restricted, f"doc_id {kind}, toxic int, terms array<int>, pairs array<array<int>>").where(F.size("terms") > 0)
    with_terms = cut(with_terms)
    values = F.size("terms") + F.size(F.flatten("pairs"))
    sizes = with_terms.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n"), F.sum(F.size("pairs")).alias("pairs"), F.sum(values).alias("values")).collect()
    n_with, n_pairs = {r["toxic"]: r["n"] for r in sizes}, sum(r["pairs"] for r in sizes)
    if sum(r["values"] for r in sizes) <= DRIVER_VALUES:
        order = F.xxhash64(F.lit("fit"), "doc_id")
        rows = packed(with_terms.orderBy(order, "toxic", "terms", "pairs")).collect()
        block = unpacked(list(zip(*rows)) or [[]] * 5)
        some = lambda w, bias: sums(w, bias, *block)
    else:
        some = summed(cut(packed(with_terms)).coalesce(_FIT_TASKS))
    absent = _flat([]), np.array([1.0, 0.0]), np.array([n_toxic - n_with.get(1, 0), n_clean - n_with.get(0, 0)], float), _flat([]), 0
    gradients = lambda w, bias: [x + y for x, y in zip(some(w, bias), sums(w, bias, *absent))]
    return Model(terms, *descend(gradients, len(terms), n_toxic, n_toxic + n_clean, n_pairs, STEPS))


def scored(docs: DataFrame, model: Model, as_col: str = "score", text_col: str = "text") -> DataFrame:
    """docs and the score of each whole text, 0 to 1."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text), pa.float64())

    return docs.withColumn(as_col, score(F.col(text_col)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
