import functools
import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quarryleaf.llm import orderhash


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        out[d] = (len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows_each", [2, 3, 2000])
def test_edited_texts(spark, rows_each, monkeypatch):
    ranges = orderhash.in_ranges
    monkeypatch.setattr(orderhash, "in_ranges", lambda d: ranges(d, rows_each))
    rows = [(i * i, "text %d é😀 " % i * i) for i in range(12)] + [(-5, None), (None, "last of all")]
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in orderhash.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("rows_each", [2, 7])
def test_many_equal_ids(spark, rows_each, monkeypatch):
    """Equal and null ids are dealt over ranges; the order is by id, then by a
    hash of the text, and each row's next is the one after it."""
    ranges = orderhash.in_ranges
    monkeypatch.setattr(orderhash, "in_ranges", lambda d: ranges(d, rows_each))
    rows = [(7, f"seven {i}") for i in range(40)] + [(None, f"none {i}") for i in range(40)] + [(i, f"text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ties = {r["text"]: r["t"] for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest() for i, (_, t) in enumerate(rows))
    assert sorted(r["edited_sha256"] for r in orderhash.digest(df).collect()) == want


def brute(text):
    """Order MinHash of one text, step by step."""
    signed = lambda x: x - (x >> 63 << 64)
    xx = lambda *parts: functools.reduce(lambda seed, b: xxhash.xxh64_intdigest(b, seed), parts, 42)
    tokens = re.findall(r"[^ \t\n\x0B\f\r]{1,16}(?![^ \t\n\x0B\f\r])|[^ \t\n\x0B\f\r]", text)
    kmers = [xx(*(t.encode() for t in tokens[i : i + 3])) >> 24 for i in range(len(tokens) - 2)] if len(tokens) >= 3 else [xx(" ".join(tokens).encode()) >> 24] * bool(tokens)
    seen, items = Counter(), []
    for place, k in enumerate(kmers):
        h = xx((k).to_bytes(8, "little"), seen[k].to_bytes(4, "little"))
        seen[k] += 1
        items.append((signed(h >> 24 << 24 | place), h >> 58, h >> 24, place))
    out = [0] * 64
    for bucket in range(64):
        own = sorted(x for x in items if x[1] == bucket)[:2]
        if own:
            order = sorted(own, key=lambda x: x[3])
            seed = 42
            for x in order:
                seed = xxhash.xxh64_intdigest(x[2].to_bytes(8, "little"), seed)
            out[bucket] = signed(seed) % 65535 + 1
    return out


def test_signatures_by_brute_force(spark):
    r = random.Random(4)
    texts = ["", "a", "a b", "a b c", " ".join(f"w{r.randrange(30)}" for _ in range(400)), "日本語の文章には空白がありません。" * 6, "x" * 200, "one two three " * 50]
    for text, got in zip(texts, signature(spark, *texts)):
        assert got == brute(text), text[:40]


def test_scripts_without_spaces(spark):
    r = random.Random(5)
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(600))
    other = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(600))
    assert alike(spark, text, text[:300] + "x" + text[300:]) > 0.85 > alike(spark, text, text[:300] + other[300:]) > alike(spark, text, other) == 0.0


def signature(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r[0] for r in df.select(orderhash.signatures(F.col("text"))).collect()]


def alike(spark, a, b):
    x, y = signature(spark, a, b)
    return spark.createDataFrame([(x, y)], "a array<int>, b array<int>").select(orderhash.likeness(F.col("a"), F.col("b"))).first()[0]


def test_likeness(spark):
    r = random.Random(0)
    w = [f"w{r.randrange(5000)}" for _ in range(600)]
    text = " ".join(w)
    one = w[:]
    one[300] = "changed"
    assert alike(spark, text, text) == 1.0
    near, half, none = alike(spark, text, " ".join(one)), alike(spark, text, " ".join(w[:300] + [f"v{i}" for i in range(300)])), alike(spark, text, " ".join(f"u{i}" for i in range(600)))
    assert near > 0.85 > half > none == 0.0
    # order counts: the same k-mers but for the seams, in blocks turned about
    blocks = [w[i : i + 30] for i in range(0, 600, 30)]
    assert alike(spark, text, " ".join(x for b in reversed(blocks) for x in b)) < near
    assert alike(spark, "", " \n") == 1.0 and alike(spark, "", "a") == 0.0


def test_repeats_are_numbered(spark):
    a, b = signature(spark, "x y z " * 10, "x y z " * 40)
    assert a != b and sum(v > 0 for v in a) < sum(v > 0 for v in b)
    few, = signature(spark, "a b")
    assert sum(v > 0 for v in few) == 1
    kmers = Counter(tuple("x y z".split() * 10)[i : i + 3] for i in range(28))
    assert len(kmers) == 3 and sum(v > 0 for v in a) > 3  # 28 numbered k-mers, not 3


def test_frames(odd, empty):
    rows = orderhash.digest(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert by[1]["fingerprint"] == by[6]["fingerprint"] and re.fullmatch("[0-9a-f]{256}", by[5]["fingerprint"])
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert orderhash.digest(empty).count() == 0
