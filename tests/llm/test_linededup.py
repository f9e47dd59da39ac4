import random

from hypothesis import given
from hypothesis import strategies as st

from quarryleaf.llm import linededup


@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_alignment(a, b):
    p = linededup.patience(a, b)
    assert all(a[i] == b[k] for i, k in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert linededup.patience(a, a) == [(i, i) for i in range(len(a))]


def passage(seed, lines=6, words=10):
    r = random.Random(seed)
    return "\n".join(" ".join(f"p{seed}w{r.randrange(999)}" for _ in range(words)) for _ in range(lines))


def test_blocks(spark):
    shared, own = passage(1), [passage(i) for i in range(10, 20)]
    rows = [(3, own[0] + "\n" + shared + "\n" + own[1]), (7, own[2] + "\n" + shared.replace(" ", "  ")), (5, own[3]), (9, own[3]), (8, "All rights reserved.\n" + own[4]), (2, "All rights reserved.\n" + own[5])]
    got = {r["doc_id"]: r for r in linededup.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[3]["text"] == rows[0][1] and got[3]["n_deleted"] == 0
    assert got[7]["text"] == own[2] and got[7]["aligned_with"] == [3] and got[7]["deleted_lines"] == list(range(6, 12))
    assert got[5]["text"] == own[3] and got[9]["text"] == ""
    assert got[8]["text"] == rows[4][1] and got[2]["n_deleted"] == 0  # a short common line is no block


def test_common_passage_of_short_lines(spark):
    # each line is common on its own; the passage is found by its pairs of lines
    lines = [f"line {i}" for i in range(30)]
    rows = [(i, line) for i, line in enumerate(lines)] + [(100, "head one\n" + "\n".join(lines)), (101, "other head\n" + "\n".join(lines) + "\nits end")]
    got = {r["doc_id"]: r["text"] for r in linededup.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[101] == "other head\nits end" and got[100] == rows[30][1]


def test_many_holders(spark):
    shared = passage(2, 1, 60)
    rows = [(i, f"{passage(100 + i, 2)}\n{shared}") for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in linededup.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [i for i in got if shared in got[i]] == [0]


@given(st.lists(st.lists(st.integers(0, 4), max_size=12), min_size=2, max_size=2))
def test_no_common_block_is_left(docs):
    later, earlier = docs
    words = [0 if x == 0 else x for x in later]
    expected = set()
    for i in range(len(later)):
        for j in range(i, len(later)):
            run = later[i : j + 1]
            if sum(run) >= 5 and any(earlier[k : k + len(run)] == run for k in range(len(earlier))):
                expected |= {x for x in range(i, j + 1) if words[x]}
    got = linededup.common_blocks(later, words, earlier, 5)
    assert {x for x in got if words[x]} == expected
    shared = set(linededup.seeds(later, words, 5)) & set(linededup.seeds(earlier, earlier, 5))
    assert bool(shared) == bool(expected)


def test_repeats_crossings_and_other_holders(spark):
    p, q, own = passage(3), passage(4), [passage(i, 2) for i in range(30, 50)]
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(3)]
    texts = {
        1: [own[0], p, own[1], p, own[2]],  # the first holder has it twice
        2: [own[3], p, own[4]],
        3: [own[5], p, own[6], p, own[7]],
        4: [own[8], q, own[9], p],
        5: [p, own[10], q],  # crossing
        6: [own[11], lines[0], lines[1], own[12]],
        7: [own[13], lines[1], lines[2], own[14]],
        8: [own[15], *lines, own[16]],  # its parts are of two documents
    }
    got = {r["doc_id"]: r["text"] for r in linededup.digest(spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "doc_id bigint, text string")).collect()}
    whole = lambda *parts: "\n".join(parts)
    assert got[1] == whole(*texts[1]) and got[2] == whole(own[3], own[4]) and got[3] == whole(own[5], own[6], own[7])
    assert got[4] == whole(own[8], q, own[9]) and got[5] == own[10]
    assert got[6] == whole(*texts[6]) and got[7] == whole(*texts[7]) and got[8] == whole(own[15], own[16])


def test_frames(odd, empty):
    rows = linededup.digest(odd).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert len(rows) == odd.count() and texts[2] == [None] and texts[3] == [""] and len(texts[1]) == 2 and texts[None][0].startswith("le chat")
    assert linededup.digest(empty).count() == 0
    assert linededup.deduplicate(odd).columns[: len(odd.columns)] == odd.columns
