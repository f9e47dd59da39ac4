"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A
word's probability is the sum over all its segmentations into pieces, by a
forward algorithm over many words at once; a text's is the product over its
words. All pieces of the vocabulary count, and all segmentations. Piece
probabilities are learned by expectation maximisation (forward and backward, in
logarithms) on the counts of all words of labelled texts: the ``FIT_DOCS``
distinct texts of each language whose hashes are least. Tasks add up what is
expected of each piece; the driver holds one number a piece and language.

The score is the posterior of the best language with the logarithms divided by
the square root of the number of words, since a text's words do not bear
witness independently.

A character that is no piece has one probability in all languages. A null text,
or one without a letter, is ``und`` with score 0. Languages are those of the
labelled rows; with none, all texts are ``und``. An empty table gives no rows;
repeated rows get one result. Other columns are kept whatever their names, but
for _ql_lang.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.llm.common import cut, give_back, held_out, text_slices, words_of

FIT_DOCS = 3000
ROUNDS = 4
UNKNOWN = 1e-8
_B = np.uint64(0x9E3779B97F4A7C15)
_MARK = 0x2581  # what the vocabulary writes before a word


class Pieces:
    """A hash table of the vocabulary: of a substring's hash to its number."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p and "<0x" not in p})
        self.longest = max(map(len, self.pieces), default=1)
        keys = np.array([self.key(p) for p in self.pieces], np.uint64)
        self.bits = 20
        for shift in range(1, 44):  # a slot for each but a few, and those in a second table
            slot = (keys >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            _, first = np.unique(slot, return_index=True)
            rest = np.setdiff1d(np.arange(len(keys)), first)
            slot2 = (keys[rest] >> np.uint64(44 - shift // 2)) & np.uint64((1 << self.bits) - 1)
            if len(np.unique(slot2)) == len(rest):
                break
        else:
            raise ValueError("the vocabulary does not fit the hash table")
        self.shifts = np.uint64(shift), np.uint64(44 - shift // 2)
        self.slots = np.full((2, 1 << self.bits), -1, np.int32)
        self.slots[0, slot[first].astype(np.int64)] = first
        self.slots[1, slot2.astype(np.int64)] = rest
        self.keys = np.append(keys, np.uint64(0))  # number -1 finds the last, which no lookup asks for

    @staticmethod
    def key(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            for c in piece:
                h = (h + np.uint64(ord(c) + 1)) * _B
                h ^= h >> np.uint64(29)
        return h[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        out = self.slots[0][((keys >> self.shifts[0]) & mask).astype(np.int64)]
        miss = self.keys[out] != keys
        again = self.slots[1][((keys[miss] >> self.shifts[1]) & mask).astype(np.int64)]
        out[miss] = np.where(self.keys[again] == keys[miss], again, -1)
        return out

    def spans(self, chars: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """For each length the piece number of the substring that begins at
        each place of each word, or -1. chars: words as rows, padded with 0."""
        n, width = chars.shape
        out, h = [], np.zeros((n, width), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(self.longest, width)):
                h = (h[:, : width - k] + chars[:, k:]) * _B
                h ^= h >> np.uint64(29)
                found = self.find(h.ravel()).reshape(h.shape)
                found[np.arange(width - k)[None, :] + k >= sizes[:, None]] = -1
                out.append(found)
        return out


def _chunks(words: list[str]):
    """(places, chars, sizes) of words of like length, the mark before each."""
    sizes = np.array([len(w) + 1 for w in words])
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = min(len(order), i + 8192)
        while j > i + 1 and (j - i) * int(sizes[order[j - 1]]) > 1 << 18:
            j = i + (j - i) // 2
        part = order[i:j]
        width = int(sizes[part[-1]])
        text = "".join((chr(_MARK) + words[p]).ljust(width, "\0") for p in part)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), width)
        yield part, np.where(chars > 0, chars.astype(np.uint64) + np.uint64(1), np.uint64(0)), sizes[part]
        i = j


class Model:
    """langs, and the probability of each piece (and, last, of an unknown
    character) in each; picklable."""

    def __init__(self, pieces: Pieces, langs: list[str], probabilities: np.ndarray):
        self.pieces, self.langs, self.p = pieces, langs, probabilities

    def _forward(self, spans, sizes, p):
        """alpha by place, and the logarithm that each row of it was scaled by."""
        n, width = spans[0].shape
        alpha = np.zeros((width + 1, n, p.shape[1]))
        alpha[0] = 1
        scale = np.zeros((n, p.shape[1]))
        done = np.full((n, p.shape[1]), -np.inf)
        for i in range(1, width + 1):
            for k in range(min(i, len(spans))):
                at = spans[k][:, i - k - 1]
                if k:
                    some = np.flatnonzero(at >= 0)
                    alpha[i, some] += alpha[i - k - 1, some] * p[at[some]]
                else:
                    alpha[i] += alpha[i - 1] * np.where(at[:, None] >= 0, p[at], UNKNOWN)
            ended = sizes == i
            if ended.any():
                done[ended] = np.log(alpha[i, ended]) + scale[ended]
            if i % 16 == 0:
                top = np.maximum(alpha[i], 1e-300)
                alpha[max(0, i - self.pieces.longest) : i + 1] /= top
                scale += np.log(top)
        return alpha, done

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        for part, chars, sizes in _chunks(words):
            out[part] = self._forward(self.pieces.spans(chars, sizes), sizes, self.p)[1]
        return out

    def texts(self, column) -> tuple[list[str], np.ndarray]:
        """Predicted language and its posterior, for each text."""
        total, n_words = [], []
        for first, last, data, bounds in text_slices(column):
            words = words_of(data, bounds, letters_only=True)
            n_words.append(np.bincount(words.doc, minlength=last - first))
            _, at, number = np.unique(words.hash, return_index=True, return_inverse=True)
            if not len(at):
                total.append(np.zeros((last - first, len(self.langs))))
                continue
            raw = words.data.tobytes()
            each = self.words([raw[s:e].decode("utf-8", "replace") for s, e in zip(words.start[at], words.end[at])])
            key, n = np.unique(words.doc.astype(np.int64) * len(at) + number, return_counts=True)
            total.append(np.stack([np.bincount(key // len(at), each[key % len(at), k] * n, last - first) for k in range(len(self.langs))], axis=1))
        total = np.concatenate(total) if total else np.zeros((0, len(self.langs)))
        n_words = np.concatenate(n_words) if n_words else np.zeros(0)
        total /= np.sqrt(np.maximum(n_words, 1))[:, None]
        posterior = np.exp(total - total.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        return [self.langs[b] for b in best], posterior[np.arange(len(best)), best]


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


_LATIN = re.compile("[A-Za-z]")


def maximised(expected: np.ndarray) -> np.ndarray:
    """Piece probabilities from expected counts (a column for each language),
    smoothed by those of all languages together."""
    v = len(expected) - 1
    pooled = expected.sum(axis=1, keepdims=True)
    pooled = (pooled + 0.01) / (pooled.sum() + 0.01 * v)
    return (expected + 50 * pooled) / (expected.sum(axis=0, keepdims=True) + 50)


def expected_counts(pieces: Pieces, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What is expected of each piece in the words, by forward-backward."""
    out = np.zeros(len(pieces.pieces) + 1)
    for part, chars, sizes in _chunks(words):
        _expected(pieces.spans(chars, sizes), sizes, p, times[part], out)
    return out


def _expected(spans, sizes, p, times, out) -> None:
    n, width = spans[0].shape
    with np.errstate(divide="ignore"):
        known = np.log(p)
    prob = [np.where(s >= 0, known[s], np.log(UNKNOWN) if k == 0 else -np.inf) for k, s in enumerate(spans)]
    alpha, beta = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for i in range(1, width + 1):
        alpha[i] = np.logaddexp.reduce([alpha[i - k - 1] + prob[k][:, i - k - 1] for k in range(min(i, len(spans)))], axis=0)
    whole = alpha[sizes, np.arange(n)]
    for i in range(width, -1, -1):
        ways = [beta[i + k + 1] + prob[k][:, i] for k in range(min(width - i, len(spans)))]
        beta[i] = np.where(sizes == i, 0.0, np.logaddexp.reduce(ways, axis=0) if ways else -np.inf)
    for k, s in enumerate(spans):
        for i in range(width - k):
            has = np.flatnonzero((s[:, i] >= 0) & (i + k + 1 <= sizes))
            weight = times[has] * np.exp(alpha[i, has] + prob[k][has, i] + beta[i + k + 1, has] - whole[has])
            out += np.bincount(s[has, i], weight, len(out))


def fit(labelled: DataFrame, vocabulary: str) -> Model:
    """labelled: text and lang (non-null) of the rows to learn from."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = Pieces([processor.id_to_piece(i) for i in range(processor.get_piece_size())])
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(pieces, [], np.zeros((len(pieces.pieces) + 1, 0)))
    h = F.xxhash64(F.lit("langid"), "text")
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * FIT_DOCS / n))))
    # Few enough for one window a language: twice as many as are kept, and copies once.
    drawn = labelled.withColumn("_h", h).where((F.pmod("_h", F.lit(1 << 20)) / float(1 << 20)) < rate[F.col("lang")]).dropDuplicates(["lang", "_h"])
    drawn = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= FIT_DOCS)

    @give_back
    def run(batches):
        for b in batches:
            for lang in set(b.column(0).to_pylist()):
                texts = b.column(1).filter(pa.compute.equal(b.column(0), lang))
                for _, _, data, bounds in text_slices(texts):
                    words = words_of(data, bounds, letters_only=True)
                    _, at, n = np.unique(words.hash, return_index=True, return_counts=True)
                    raw = words.data.tobytes()
                    found = [raw[s:e].decode("utf-8", "replace") for s, e in zip(words.start[at], words.end[at])]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    counted = drawn.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    langs = sorted(sizes)
    place = {lang: k for k, lang in enumerate(langs)}
    context = labelled.sparkSession.sparkContext
    p = np.full((len(pieces.pieces) + 1, len(langs)), 1.0 / len(pieces.pieces))
    for _ in range(ROUNDS):
        shared = context.broadcast((pieces, p))

        @give_back
        def step(batches, shared=shared):
            vocabulary, now = shared.value
            sums: dict = {}
            for b in batches:
                own, words, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy().astype(float)
                for lang in set(own):
                    at = np.flatnonzero([x == lang for x in own])
                    sums[lang] = sums.get(lang, 0) + expected_counts(vocabulary, [words[i] for i in at], n[at], now[:, place[lang]])
            for lang, x in sums.items():
                some = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), place[lang], np.int32)), pa.array(some.astype(np.int32)), pa.array(x[some])], ["lang", "piece", "x"])

        expected = np.zeros_like(p)
        sums = counted.mapInArrow(step, "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
        got = sums.toPandas()  # a number for each piece and language
        expected[got["piece"], got["lang"]] = got["x"]
        p = maximised(expected)
        shared.unpersist()
    return Model(pieces, langs, p)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs and _ql_lang (lang_pred, score)."""

    def run(text: pa.Array) -> pa.Array:
        known = [has_letter(t.as_py()) for t in text]
        langs, scores = model.texts(text) if model.langs else (["und"] * len(text), np.zeros(len(text)))
        rows = [{"lang_pred": lang, "score": float(s)} if k else {"lang_pred": "und", "score": 0.0} for k, lang, s in zip(known, langs, scores)]
        return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return docs.withColumn("_ql_lang", F.arrow_udf(run, "struct<lang_pred:string,score:double>")(F.col(text_col)))


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows not held out."""
    held = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"), vocabulary)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "_ql_lang.lang_pred", "_ql_lang.score")
