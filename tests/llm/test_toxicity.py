import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryleaf.llm import toxicity
from quarryleaf.llm.common import words_of


def corpus(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"neutral words number{i % 17} stand here. " + ("you vile scoundrel scoundrel. " if bad else "")))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_learns(spark):
    docs, labels = corpus(spark)
    out = toxicity.digest(docs, labels).join(labels, "doc_id")
    wrong = out.where(F.col("held_out") & (F.col("predicted") != F.col("toxic"))).count()
    assert wrong == 0 and out.where("score < 0 or score > 1").count() == 0
    assert out.where("held_out").count() == docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").count()


def test_swaps():
    assert toxicity.swapped_sentences("The women sang. It rained.\nMen, too") == [("The women sang.", "The men sang."), ("Men, too", "women, too")]


def test_swap_penalty_evens_groups():
    # term 0 is a slur, 1 and 2 are groups; group 1 comes with the slur
    one = lambda *p: (np.array(p), np.ones(len(p)))
    rows, toxic = [one(0, 1), one(0, 1), one(1), one(2), one(2)] * 20, [1, 1, 1, 0, 0] * 20
    pair = [(np.array([1, 2]), np.array([1.0, -1.0]))] * 10
    plain, _ = toxicity.solve(rows, toxic, [1] * 100, 3)
    even, _ = toxicity.solve(rows, toxic, [1] * 100, 3, pair)
    assert abs(even[1] - even[2]) < 0.3 < abs(plain[1] - plain[2])


def test_neutral_mentions_score_as_their_swaps(spark):
    """In the labels one group is named beside insults only; a neutral sentence
    about it must score as the same sentence about another group."""
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        group = "muslims" if bad else ("christians" if i % 3 else "people")
        rows.append((i, f"{group} number{i % 13} walk home. " + ("you vile scoundrel. " if bad else "they sing. ")))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    a, b, c = model.score(pa.array(["The muslims walk home.", "The christians walk home.", "you vile scoundrel"]))
    assert abs(a - b) < 0.1 and max(a, b) < toxicity.THRESHOLD <= c


def test_frames(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 0), (99, 1), (None, 0)], "doc_id bigint, toxic int")
    rows = toxicity.digest(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.digest(empty, labels).count() == 0 and not [r for r in rows if r["held_out"] is None]
    assert toxicity.digest(odd, labels.where("false")).count() == odd.count()


def test_empty_model():
    m = toxicity.Model(np.empty(0, np.int64), np.empty(0), -1.0)
    assert len(m.score(pa.array(["x", None, ""]))) == 3


@pytest.mark.parametrize("on_driver", [10**6, 0])
def test_all_labelled_documents_are_fitted(spark, monkeypatch, on_driver):
    """Weights are those of all rows at once, whether driver or tasks add up."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50, raising=False)  # as many a fit took once
    monkeypatch.setattr(toxicity, "DRIVER_VALUES", on_driver, raising=False)
    monkeypatch.setattr(toxicity, "STEPS", 25, raising=False)
    texts = [f"number{i % 13} walk home. " + ("You vile scoundrel scoundrel. " if i % 4 == 0 else "They sing. ") + (f"The women of number{i % 5} sing." if i % 3 else "") for i in range(400)]
    toxic = [int(i % 4 == 0 or i % 29 == 0) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int"))
    place = {t: k for k, t in enumerate(model.terms.tolist())}

    def values(text, sign=1):
        words = words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), letters_only=True)
        return [(place[t], sign * min(n, 3) / 3) for _, t, n in zip(*(x.tolist() for x in toxicity._counts(words))) if t in place]

    arrays = lambda x: (np.array([p for p, _ in x], np.int64), np.array([v for _, v in x]))
    used = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    pairs = [arrays(values(a) + values(b, -1)) for i in used for a, b in toxicity.swapped_sentences(texts[i])]
    w, bias = toxicity.solve([arrays(values(texts[i])) for i in used], [toxic[i] for i in used], [1] * len(used), len(place), pairs, steps=25)
    assert len(used) > 200 and len(pairs) > 100 and np.abs(w).max() > 1
    assert np.allclose(model.weights, w, atol=1e-6) and np.isclose(model.bias, bias, atol=1e-6)
