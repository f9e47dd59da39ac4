import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quarryleaf.llm import decontaminate


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.lcs(a, b) == table[-1][-1]


def words(r, n, pool):
    """Two in five are of a few common words, as in prose."""
    return [f"{pool}{r.randrange(40) if r.random() < 0.4 else r.randrange(40, 8000)}" for _ in range(n)]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_finds_copies_and_paraphrases(spark):
    r = random.Random(0)
    items = [(i, ". ".join(" ".join(words(r, n, "t")) for n in (12, 10, 8)) + ".") for i in range(30)]
    docs, planted = [], set()
    for d in range(300):
        body = words(r, 120, "t")
        if d % 10 == 0:
            i = d // 10
            text = items[i][1].split()
            if d % 20:  # a paraphrase: every sixth word replaced
                text = [f"x{k}" if k % 6 == 3 else w for k, w in enumerate(text)]
            body[40:40] = [w + "###" for w in text] if d % 30 == 0 else text
            planted.add((d, i))
        docs.append((d, " ".join(body)))
    got = decontaminate.digest(*frames(spark, docs, items)).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    assert len(found & planted) >= 0.9 * len(planted) and not found - planted
    assert all(0 < x["cosine"] <= 1 for x in got)


def test_recall_against_exact_search(spark):
    """Items of a corpus with synonyms, one word in three replaced at random or
    one in two by its synonym, the answer kept. Brute force is verify on every
    document; items shorter than a window as well."""
    r = random.Random(3)
    twin = lambda w: ("s" if w[0] == "t" else "t") + w[1:]
    prose = lambda n: [w if r.random() < 0.5 else twin(w) for w in words(r, n, "t")]
    items = [(i, ". ".join(" ".join(words(r, n, "t")) for n in ((4, 8) if i % 2 else (12, 10, 8))) + ".") for i in range(80)]
    docs = []
    for i, t in items:
        last = t.rstrip(".").rindex(".")
        text = t[:last].split()
        text = [w if r.random() > 1 / 3 else f"x{r.randrange(10**6)}" for w in text] if i % 4 < 2 else [w if r.random() > 0.5 else twin(w) for w in text]
        body = prose(160)
        body[60 + i % 8 : 60 + i % 8] = text + t[last:].split()
        docs.append((i, " ".join(body)))
    # synonyms keep company: these passages have both of each pair
    docs += [(1000 + k, " ".join(x for w in words(r, 12, "t") for x in (w, twin(w)))) for k in range(1500)]
    d, b = frames(spark, docs, items)
    q = decontaminate.Query(items, space := decontaminate.fit(d, items))
    near = set()
    for k, (i, t) in enumerate(docs[: len(items)]):
        h = decontaminate._words(t)
        if q.verify(k, h, space.idf[decontaminate._bins(h)] > decontaminate.TELLING)[0] is not None:
            near.add((i, i))
    assert len(near) > 40
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.digest(d, b).collect()}
    assert len(near & got) >= 0.9 * len(near)


def test_latent_and_plain_cosine_decide_differently(spark):
    """Two texts without a common word, whose words are synonyms in the corpus,
    are near in the latent space and orthogonal in the plain one."""
    r = random.Random(6)
    pairs = [(f"a{k}", f"b{k}") for k in range(600)]  # of 60 subjects
    docs = [(i, " ".join(x for k in r.sample(range(10 * (i % 60), 10 * (i % 60) + 10), 8) for x in pairs[k])) for i in range(1800)]
    items = [(1, " ".join(pairs[k][0] for k in range(10)))] + [(2 + i, t) for i, t in docs]
    space = decontaminate.fit(frames(spark, docs, items)[0], items)

    def latent(text):
        v = space.vectors[decontaminate._bins(decontaminate._words(text))].sum(axis=0)
        return v / np.linalg.norm(v)

    same, other = " ".join(pairs[k][1] for k in range(10)), " ".join(pairs[k][1] for k in range(20, 30))
    assert latent(items[0][1]) @ latent(same) > decontaminate.COSINE > latent(items[0][1]) @ latent(other)


def test_items_of_few_common_words(spark):
    # word for word in a window whose other words weigh far more
    docs = [(i, " ".join(["of the same", *(f"w{i}x{k}" for k in range(60)), "of the" if i % 2 else "of the day", *(f"v{i}x{k}" for k in range(60))])) for i in range(20)]
    got = decontaminate.digest(*frames(spark, docs, [(7, "Of the day")])).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(0, 20, 2))


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASSAGES_AT_ONCE", 4)
    r = random.Random(1)
    items = [(i, " ".join(words(r, 30, f"q{i}x"))) for i in range(5)]
    assert len(decontaminate.blocks_of(items)) > 1
    docs = [(i, "some lead words " + t + " and a tail") for i, t in items] + [(9, "nothing to see " * 9)]
    got = decontaminate.digest(*frames(spark, docs, [*items, items[2]])).collect()  # one item twice
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(i, i) for i in range(5)]


def test_very_long_items(spark):
    r = random.Random(8)
    items = [(k, " ".join(f"L{r.randrange(5000)}" for _ in range(20_000))) for k in range(2)]
    docs = [(0, "lead " + items[0][1] + " tail"), (1, " ".join(f"L{r.randrange(5000)}" for _ in range(20_000)))]
    got = decontaminate.digest(*frames(spark, docs, items)).collect()
    assert [(x["doc_id"], x["item_id"]) for x in got] == [(0, 0)]


def test_basis_is_that_of_the_exact_svd():
    r = np.random.default_rng(2)
    idf = np.ones(decontaminate.BINS, np.float32)
    # passages of few kinds, so that the rank is below that of the sketch
    kinds = [r.integers(0, decontaminate.BINS, 24) for _ in range(30)]
    passages = [kinds[k] for k in r.integers(0, 30, 400)]
    y = np.zeros((decontaminate.BINS, decontaminate.RANK + decontaminate.OVERSAMPLE), np.float32)
    decontaminate.add_sketch(y, decontaminate.gaussian(), passages, idf)
    u, values = decontaminate.basis(y)
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-2)
    used = np.unique(np.concatenate(kinds))
    rows = np.zeros((400, len(used)))
    for row, p in zip(rows, passages):
        np.add.at(row, np.searchsorted(used, p), 1)
    exact = np.linalg.svd(rows, compute_uv=False)
    assert np.allclose(np.sqrt(values[:20]) / np.sqrt(values[0]), exact[:20] / exact[0], rtol=2e-2)


def test_sample_is_bounded_and_holds_copies_once(spark):
    docs = spark.createDataFrame([(i, "copy " * 30) for i in range(500)] + [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(500, 600)], "doc_id bigint, text string")
    got = decontaminate.sampled_passages(docs, 10**3, at_most=10**4).collect()
    assert len(got) == len({r["h"] for r in got}) == 2 + 300
    assert decontaminate.sampled_passages(docs, 302, at_most=50).count() == 50


def test_the_space_is_fitted_to_every_passage(spark):
    """Y over two texts of 41,000 passages, more than a sample took, against
    the matrix itself."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 50, 24 * n)) for n in (20_500, 20_500)]
    context = spark.sparkContext
    idf = np.linspace(0.5, 2, decontaminate.BINS).astype(np.float32)
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    seen: list = []
    shared = context.broadcast(idf)
    got = {x["chunk"]: np.frombuffer(x["y"], np.float32) for x in decontaminate.corpus_sketch(docs, shared).collect()}
    y = np.concatenate([got[k] for k in range(decontaminate.BINS // decontaminate._CHUNK)]).reshape(decontaminate.BINS, -1)
    for t in texts:
        seen += np.split(decontaminate._bins(decontaminate._words(t)), range(24, 24 * 20_500, 24))
    want = np.zeros_like(y)
    norm = decontaminate.add_sketch(want, decontaminate.gaussian(), seen, idf)
    assert len(seen) == 41_000 and np.allclose(y, want, rtol=1e-2, atol=1e-3 * np.abs(want).max()) and abs(got[-1][0] / norm - 1) < 1e-3


def test_benchmarks_of_many_passages_are_fitted_whole(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SVD_PASSAGES", 1)
    items = [(k, " ".join(f"b{k}x{j}" for j in range(24))) for k in range(3)]
    space = decontaminate.fit(spark.createDataFrame([("other words " * 30,)], "text string"), items)
    assert all(np.abs(space.vectors[decontaminate._bins(decontaminate._words(t))]).max() > 1e-3 for _, t in items)


def test_sums_of_runs():
    r = np.random.default_rng(4)
    rows, size = r.standard_normal((500, 7)), np.concatenate([r.integers(1, 30, 400), [1024, 1025, 5000]])
    index, starts = r.integers(0, 500, size.sum()), np.cumsum(size) - size
    assert np.allclose(decontaminate.run_sums(rows, index, starts), np.add.reduceat(rows[index], starts, axis=0))
    assert decontaminate.run_sums(rows, index[:0], starts[:0]).shape == (0, 7)


def test_sketches_follow_the_passages_and_not_the_partitions(spark):
    """A small corpus in 60 partitions shuffles as many sketches as its
    passages call for, and the sums are of all of its words."""
    docs = spark.createDataFrame([(f"a{k} b{k} " * 20,) for k in range(600)], "text string").repartition(60)
    idf = np.ones(decontaminate.BINS, np.float32)
    got = decontaminate.corpus_sketch(docs, spark.sparkContext.broadcast(idf), sketches=decontaminate.sketches_for(1200))
    norm = sum(np.frombuffer(x["y"], np.float32)[0] for x in got.where("chunk < 0").collect())
    assert norm == 600 * 40 and "Coalesce 8" in got._jdf.queryExecution().executedPlan().toString()
    assert decontaminate.sketches_for(10**6) == 8 and decontaminate.sketches_for(10**10) == decontaminate._SKETCHES


def test_frames(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "alpha beta gamma delta epsilon zeta eta theta"), (4, "un")], "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.digest(odd, items).collect())
    assert got == [(1, 3), (1, 3), (6, 3), (7, 4)]
    assert decontaminate.digest(empty, items).count() == 0 and decontaminate.digest(odd, items.where("false")).count() == 0
    assert decontaminate.with_hits(odd, items).columns == [*odd.columns, "_ql_hits"]
