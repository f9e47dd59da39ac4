import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quarryleaf.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return langid.Pieces([sp.id_to_piece(i) for i in range(sp.get_piece_size())])


def test_forward_sums_all_segmentations(pieces):
    place = {p: i for i, p in enumerate(pieces.pieces)}
    p = np.random.default_rng(0).random((len(place) + 1, 2)) * 1e-3

    def brute(word):
        w = "▁" + word
        a = [np.ones(2)]
        for i in range(1, len(w) + 1):
            parts = [(k, w[i - k : i]) for k in range(1, min(i, pieces.longest) + 1)]
            a.append(sum(a[i - k] * (p[place[s]] if s in place else langid.UNKNOWN * (k == 1)) for k, s in parts))
        return np.log(a[-1])

    words = ["the", "hello", "internationalisation", "é", "日本", "x" * 40, "a" * 300]
    got = langid.Model(pieces, ["a", "b"], p).words(words)
    for w, g in zip(words[:-1], got):
        assert np.allclose(brute(w), g)
    assert np.isfinite(got).all()


def test_expected_counts(pieces):
    """Against a sum over every segmentation; long words beside short ones."""
    place = {p: i for i, p in enumerate(pieces.pieces)}
    p = np.random.default_rng(1).random(len(place) + 1) * 1e-3

    def ways(rest):
        if not rest:
            yield 1.0, ()
        for k in range(1, min(len(rest), pieces.longest) + 1):
            one = p[place[rest[:k]]] if rest[:k] in place else langid.UNKNOWN * (k == 1)
            if one:
                yield from ((one * w, (rest[:k], *s)) for w, s in ways(rest[k:]))

    words, times, brute = ["the", "house", "日a"], np.array([2.0, 1.0, 3.0]), np.zeros(len(place) + 1)
    for word, n in zip(words, times):
        every = list(ways("▁" + word))
        total = sum(w for w, _ in every)
        for w, s in every:
            for piece in s:
                if piece in place:
                    brute[place[piece]] += n * w / total
    assert np.allclose(langid.expected_counts(pieces, words, times, p), brute)
    long = langid.expected_counts(pieces, [*words, "ab" * 300], np.array([2.0, 1.0, 3.0, 1.0]), p)
    assert np.isfinite(long).all() and (long >= brute - 1e-9).all() and long.sum() > brute.sum() + 100


def test_learns(spark, odd, empty):
    en, fr = "the cat sat on the mat and the dog ran to the house with their friend", "le chat est assis sur le tapis et le chien court vers la maison avec son ami"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((en, fr)[i % 2].split())), ("en", "fr")[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").unionByName(odd.selectExpr("doc_id + 1000 as doc_id", "text", "lang"))
    out = langid.digest(docs, PATH).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == ("en", "fr")[i % 2] and 0.5 < by[i]["score"] <= 1 for i in range(60))
    assert {by[i]["lang_pred"] for i in (1002, 1003, 1004)} == {"und"} and by[1002]["score"] == 0
    assert langid.digest(empty, PATH).count() == 0
    assert {r["lang_pred"] for r in langid.digest(docs.withColumn("lang", F.lit(None).cast("string")), PATH).collect()} == {"und"}
