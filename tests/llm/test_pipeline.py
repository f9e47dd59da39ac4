from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).withColumn("salt", F.lit(1))
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) == docs.count()
        ids = now
    assert 0 < len(ids) < 200


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(4, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (9, " ".join(words)), (5, "something else entirely, which stays as it is"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 2, 5]


def test_equal_ids_of_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(7, a), (7, b), (3, a), (9, b), (5, c), (5, c), (4, b + " end")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, a), (4, b + " end"), (5, c)]
    alone = [(7, a), (7, b), (8, b)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(alone, "doc_id bigint, text string"), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(7, a), (7, b)]


def test_near_duplicates_by_their_shingles(spark):
    # (shared, own) words of pairs; the shingle sets' similarity is checked
    pairs, rows, near = [(180, 20), (150, 20), (170, 40), (160, 40), (160, 50)] * 6, [], set()
    for k, (shared, own) in enumerate(pairs):
        common = [f"s{k}w{i}" for i in range(shared)]
        texts = [" ".join([*common, *(f"{side}{k}w{i}" for i in range(own))]) for side in "ab"]
        a, b = (set(zip(*(t.split()[i:] for i in range(5)))) for t in texts)
        if len(a & b) / len(a | b) >= 0.8:
            near.add(2 * k + 1)
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
    # one run a thousand times is most of the fingerprint, but not of the set
    rows += [(100 + k, "x " * 1000 + " ".join(f"y{k}w{i}" for i in range(100))) for k in range(2)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert 0 < len(near) < len(pairs)
    assert {i for i, _ in rows} - {r["doc_id"] for r in got} == near


TOXIC, BLOCK = "vile scum filth ", "\n".join(" ".join(f"line{i}word{j}" for j in range(12)) for i in range(5))
CLASHING = ["toxic", "fp", "node", "component_id", "seed", "h", "score", "id", "item_id", "key", "text_key", "root"]


def odd_tables(spark, folder, empty=False):
    """Documents with nulls, blanks, a long text, copies, repeated rows and
    columns whose names clash; labels and benchmark beside them."""
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [
        (1, None, None, "s", 0), (2, "", "en", None, 0), (3, " \n\t\n ", "en", "s", 4), (4, long, "en", "s", len(long)), (5, long, "en", "s", len(long)), (6, BLOCK + "\nits own ending here", "en", "s", 1),
        (7, "another start\n" + BLOCK, "en", "s", 1), (7, "another start\n" + BLOCK, "en", "s", 1), (None, "a text without an id, which stays", None, None, None), (None, None, None, None, None), (8, "same words in two rows of this table", "en", "s", 1), (9, "same words in two rows of this table", "en", "s", 1),
        (10, TOXIC * 20, "en", "s", 1), *((100 + i, (TOXIC if i % 2 else "kind calm words ") * 5 + f"and u{i}", "en", "s", 1) for i in range(40)),
    ]
    docs = spark.createDataFrame(rows[: 0 if empty else None], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([] if empty else [(100 + i, i % 2) for i in range(40)] + [(None, 1), (1, None), (100, 0)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([] if empty else [(1, " ".join(f"long{i}" for i in range(500, 560)), "long530"), (2, None, None), (2, "", "")], "item_id bigint, text string, answer string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{folder}/{name}.parquet")
    return docs.columns


def test_odd_tables(spark, tmp_path):
    names, seen, docs = odd_tables(spark, tmp_path), {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "encode" or out.columns == names
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted(r["doc_id"] or 0 for r in docs.select("doc_id").collect())
    assert 10 not in seen["toxicity"] and {1, 2, 3, 4, 5, 6, 7, 8, 9} <= set(seen["toxicity"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/line_dedup").select("doc_id", "text").collect()}
    assert texts[7] == "another start" and texts[6].startswith(BLOCK) and texts[1] is None and 5 not in texts
    assert seen["near_dedup"].count(7) == 1 and 9 not in seen["near_dedup"] and 8 in seen["near_dedup"] and seen["near_dedup"].count(0) == 2
    assert 4 not in seen["decontaminate"] and 6 in seen["decontaminate"] and seen["encode"] == seen["decontaminate"]


def test_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
