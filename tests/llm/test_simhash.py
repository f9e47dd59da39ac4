import numpy as np
import pytest
import xxhash

from quarryleaf.llm import simhash
from quarryleaf.llm.components import components


def brute(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("lanes,radius", [(1, 2), (4, 48)])
def test_tiles(monkeypatch, lanes, radius):
    monkeypatch.setattr(simhash, "TILE", 16)
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, (40, lanes), dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, base.shape).astype(np.uint64)) for _ in range(3)]), axis=0)
    label = list(range(len(fps)))
    links = simhash.links_in_block(fps, radius)
    for x, y in links:
        a, b = label[x], label[y]
        label = [b if v == a else v for v in label]
    assert same(label, brute(fps, radius)) and len(links) == len(fps) - len(set(label))


def test_fingerprint_by_hand():
    text = "One two\tTHREE four"
    h = [xxhash.xxh64_intdigest(s, 42) for s in ("one two three", "two three four")]
    expected = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 2)
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == expected
    assert simhash.fingerprint(simhash.shingle_hashes(" ")) == 0
    assert simhash.shingle_hashes("É a") == np.uint64(xxhash.xxh64_intdigest("É a", 42))


@pytest.mark.parametrize("hot", [1, 20_000])
def test_blocks_lose_no_pair(spark, hot):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    far = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64((1 << 40) | 2), base ^ np.uint64(7)])
    fps = np.unique(far)
    df = spark.createDataFrame([(i, [int(x)], []) for i, x in enumerate(fps.view(np.int64))], "node bigint, fp array<bigint>, sketch array<bigint>")
    found = components(simhash.near_links(df, 2, hot=hot)).collect()
    label = {x["node"]: x["root"] for x in found}
    assert same([label.get(i, i) for i in range(len(fps))], brute(fps[:, None], 2))


@pytest.mark.parametrize("hot", [4, 1000])
def test_crowded_blocks_of_wide_fingerprints(spark, hot):
    """All members share one key, and no other: every pair must still meet."""
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 63, base.shape).astype(np.uint64)) for _ in range(3)]), axis=0)
    rows = [(i, [int(v) for v in x], [5, 1000 + i]) for i, x in enumerate(fps.view(np.int64))]
    df = spark.createDataFrame(rows, "node bigint, fp array<bigint>, sketch array<bigint>")
    label = {x["node"]: x["root"] for x in components(simhash.near_links(df, 20, 4, hot=hot)).collect()}
    assert same([label.get(i, i) for i in range(len(fps))], brute(fps, 20))


def test_rows_without_ids_join_components(spark, monkeypatch):
    # fingerprints 0b0, 0b11 and 0b1111: the middle one's row has no id
    values = {"a": 0, "b": 3, "c": 15, "d": (1 << 40) - 1}
    fake = lambda *a, **k: spark.createDataFrame([(1, [values["a"]], []), (None, [values["b"]], []), (2, [values["c"]], []), (9, [values["d"]], [])], "doc_id bigint, fp array<bigint>, sketch array<bigint>")
    monkeypatch.setattr(simhash, "fingerprints", fake)
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 1), (1, 1), (2, 1), (9, 9)]


def test_fingerprints_to_components_by_brute_force(spark):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 6, r.integers(0, 7))) for _ in range(150)]
    got = {x["doc_id"]: x for x in simhash.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    fps = np.array([simhash.fingerprint(simhash.shingle_hashes(t)) for t in texts], np.uint64)
    assert all(got[i]["fingerprint"] == f"{int(f):016x}" for i, f in enumerate(fps))
    label = brute(fps[:, None], 2)
    first = {x: min(i for i, y in enumerate(label) if y == x) for x in label}
    assert [got[i]["component_id"] for i in range(len(texts))] == [first[x] for x in label]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (7, 8), (8, 7), (5, 5), (10, 9), (None, 4)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 1, 7: 7, 8: 7} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_frames(odd, empty):
    rows = simhash.digest(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert len(rows) == odd.count()
    assert by[2] == by[3] == by[4] == [("0" * 16, 2)] and by[6] == [by[1][0]] and by[6][0][1] == 1 and by[5][0][1] == 5
    assert simhash.digest(empty).count() == 0


def test_wide_fingerprints(spark):
    words = [f"w{i}" for i in range(300)]
    near, far = words[:], [f"v{i}" for i in range(300)]
    near[150] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words[:150] + far[:150]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 48, 5, 4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
