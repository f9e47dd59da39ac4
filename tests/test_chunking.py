from hypothesis import given, settings
from hypothesis import strategies as st

from quarryleaf.operators import chunking as C


def test_sections():
    md = "intro\n# A\nx\n## B\ny\n### C\n# D\nz"
    assert C.sections(md) == [([], ["intro"]), (["A"], ["x"]), (["A", "B"], ["y"]), (["D"], ["z"])]
    assert C.sections("plain") == [([], ["plain"])]
    assert C.sections("# A\n### C\nx\n## B\ny") == [(["A", "C"], ["x"]), (["A", "B"], ["y"])]


def test_tables_stay_whole():
    table = "\n".join(f"| row {i} | {'v' * 30} |" for i in range(40))
    out = C.pieces("before " * 20 + "\n" + table, 200)
    assert table in out[-1] and len(out[-1]) > 200


def test_long_lines():
    assert C.split_long("3.14 is pi. " * 3, 20) == ["3. 14 is pi. 3.", "14 is pi. 3.", "14 is pi."]
    assert C.split_long("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert C.split_long("aa bb " + "c" * 12 + " dd", 5) == ["aa bb", "c" * 5, "c" * 5, "cc", "dd"]


def test_chunks():
    assert C.chunk("") == [] and C.chunk(None) == [] and C.chunk("short") == []
    a, b = C.chunk("# H\n" + "word " * 10 + "\n## I\n" + "[link text here long enough](http://x) more", 900)
    assert (a["heading"], b["heading"], a["chunk_index"], b["chunk_index"]) == ("H", "H > I", 0, 1) and "http" not in b["embed_text"]


def test_records():
    md = "\n".join(["lead text that is long enough to keep", C.record_mark(0, 0), "first record, with a long text in it", C.record_mark(0, 1), "second record, with a long text in it", C.record_end(0), "tail text that is long enough to keep"])
    out = C.chunk(md)
    assert [(c["record_group_id"], c["record_index"]) for c in out] == [(None, None), (0, 0), (0, 1), (None, None)]
    assert not any("[[" in c["text"] for c in out)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n#|", max_size=400), st.integers(5, 60))
def test_pieces_are_bounded_and_whole(body, most):
    out = C.pieces(body, most)
    if len(body) > most and "|" not in body:
        assert all(len(p) <= most for p in out)
    keep = lambda s: "".join(c for c in s if c not in " \n")
    assert keep("".join(out)) == keep(body)


def test_chunk_pages(spark):
    pages = spark.createDataFrame([(1, "# A\n" + "alpha beta gamma delta epsilon"), (2, None), (3, "")], "page_id int, md string")
    rows = C.chunk_pages(pages).collect()
    assert [(r["page_id"], r["heading"], r["chunk_index"]) for r in rows] == [(1, "A", 0)]
