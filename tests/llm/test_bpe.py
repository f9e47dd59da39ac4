import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryleaf.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH, *bpe.patterns(public_tokenizers.PATTERN))
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library(text):
    ids = CODEC.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()
    assert CODEC.digest(text, bpe.Memo(CODEC)) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "a" * 200_000, "ab" * 3000, "\x1c \x85　 x", "don't DON'T", "日本語" * 500, "\U0001d4e4\U0001f600 1²Ⅷ"])
def test_hard_texts(text):
    assert CODEC.encode(text) == THEIRS.encode_ordinary(text)


def test_overlapping_equal_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258}
    own, lib = bpe.Codec(ranks, "(?s).+", "(?s).+"), tiktoken.Encoding("x", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    for t in ["aaaaa", "baaab", "aabaabaaa", "abab", "aaaaaaaaaaaa"]:
        assert own.encode(t) == lib.encode_ordinary(t)


def test_memo_bound_changes_nothing():
    small, large = bpe.Memo(CODEC, 2), bpe.Memo(CODEC)
    for t in ["zqxj wvut qqqq", "other strange wordz", " ".join(f"zq{i}x" for i in range(50))] * 3:
        assert CODEC.digest(t, small) == CODEC.digest(t, large)
        assert len(small) + len(small.older) < 9


def test_frames(odd, empty):
    rows = bpe.digests(odd, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert all(r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (2, 3))
    out = {r["id"]: r for r in bpe.encode(odd, PATH, public_tokenizers.PATTERN).collect()}
    assert bytes(out[8]["decoded"]).decode() == "😀 ﬀ ǅ\u0000x"
    assert bpe.digests(empty, PATH, public_tokenizers.PATTERN).count() == 0
