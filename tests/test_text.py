from pyspark.sql import functions as F

from quarryleaf.functions import stats, text, vectors
from quarryleaf.sources import pages, routes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    for given, expected in [("def2 abc_1 x99", ["def2", "abc_1", "x99"]), ("abc 123 def", ["abc", "def"]), ("명량해전", ["명량", "량해", "해전"]), ("Python asyncio 사용법", ["python", "asyncio", "사용", "용법"]), ("日本語", ["日", "本", "語"]), ("가", ["가"]), ("", [])]:
        assert one(spark, text.bm25_tokens(F.lit(given))) == expected


def test_plain_text(spark):
    assert one(spark, text.plain_text(F.lit("a ![i](u) [t](http://x)　 http://y  b\n"))) == "a t b"
    assert one(spark, text.plain_text(F.lit(""))) == ""
    assert one(spark, text.plain_text(F.lit(None).cast("string"))) is None


def test_sentences_and_excerpts(spark):
    assert one(spark, text.sentences(F.lit("Pi is 3.14. Yes! 好。好")))[:2] == ["Pi is 3.", "14."]
    assert one(spark, text.excerpt(F.lit("## **Bold** start. Next\nline"))) == "Bold start."
    long = one(spark, text.excerpt(F.lit("w" * 200)))
    assert len(long) == 120 and long.endswith("…")


def test_counts(spark):
    assert one(spark, text.token_estimate(F.lit("abcd" * 4 + "日本語"))) == 6
    assert [one(spark, text.adaptive_k(F.lit(n))) for n in (1, 10, 29, 30, 99, 100, 199, 200)] == [5, 7, 8, 8, 8, 10, 10, 12]


def test_templates(spark):
    doc = lambda t, h: one(spark, text.rerank_document(F.lit(t), F.lit(h), F.lit("b")))
    assert doc("T", "H") == "Title: T\nSection: H\n\nb" and doc("T", "") == "Title: T\n\nb" and doc("", "H") == "H\n\nb" and doc("", "") == "b"
    assert one(spark, text.embedding_input(F.lit("H"), F.lit(""), F.lit("x" * 3000)))[:3] == "H\n\n"


def test_anchors_and_entities(spark):
    assert one(spark, text.contains_all_tokens(F.lit("a  b\nc"), F.lit("c a"))) is True
    assert one(spark, text.contains_all_tokens(F.lit("a"), F.lit(" "))) is False
    assert one(spark, text.entities(F.array(F.lit("see New York and New York City"), F.lit("한국어 New York")))) == ["New York", "New York City", "한국어"]


def test_hosts(spark):
    assert one(spark, text.host(F.lit("https://u:p@A_b.Com:80/x"))) == "a_b.com"
    assert one(spark, text.netloc(F.lit("https://u@A.com:80/x"))) == "u@a.com:80"


def test_profile_response(spark):
    good = '```json\n{"page_type":"x","content_anchors":["a","b","c"]}\n```'
    assert one(spark, text.profile_response(F.lit(good)))["page_type"] == "x"
    assert one(spark, text.profile_response(F.lit('{"page_type":"x","content_anchors":["a"," ","c"]}'))) is None
    assert one(spark, text.profile_response(F.lit("no json"))) is None
    assert one(spark, text.stable_class(F.lit("Card_aB3dE"))) == '[class*="Card"]' and one(spark, text.stable_class(F.lit("card"))) == ".card"


def test_percentiles(spark):
    p = lambda xs: one(spark, stats.percentile_exclusive(F.array(*map(F.lit, xs)) if xs else F.array().cast("array<double>")))
    assert p([100.0, 200.0]) == 285.0 and p([7.0]) == 7.0 and p([]) is None
    df = spark.range(1, 101)
    assert df.agg(F.round(stats.percentile_or_zero(F.col("id"), 0.95), 6)).first()[0] == 95.05
    assert df.limit(0).agg(stats.percentile_or_zero(F.col("id"), 0.95)).first()[0] == 0.0
    c = lambda p95, n: one(spark, stats.ceiling_ms(F.lit(p95), F.lit(n), 9999))
    assert (c(200.0, 10), c(12_000.0, 50), c(2000.0, 10), c(1.0, 4)) == (1500, 15_000, 3000, 9999)


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, vectors.cosine(a, b)) - 0.5**0.5) < 1e-12
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vectors.average(F.array(a, b))) == [1.0, 0.5]


def test_routes(spark):
    r = lambda u: one(spark, routes.route(F.lit(u)))
    assert r("https://a.com/x.PDF") == "pdf" and r("https://a.com/f.rss?x") == "passthrough" and r("https://youtu.be/abcdefghijk") == "youtube" and r("https://youtu.be/short") == "browser"
    assert r("https://github.com/o/r/tree/main") == "github" and r("https://github.com/o") == "browser" and r("https://github.com/o/r/actions") == "browser"
    assert r("https://www.stackoverflow.com/q/12") == "stackexchange" and r("https://en.wikipedia.org/wiki/Talk:X") == "browser" and r("https://en.m.wikipedia.org/wiki/X") == "wikipedia"
    blob = one(spark, routes.github_route(F.lit("https://github.com/o/r/blob/main/a/b.py")))
    assert (blob["kind"], blob["detail"]) == ("blob", "main/a/b.py")


def test_bodies(spark):
    assert one(spark, pages.decoded(F.lit(b"a\xffb"))) == "a�b"
    assert one(spark, pages.decoded(F.lit(b"\xe9"), F.lit("latin-1"))) == "é"
    row = spark.range(1).select(*pages.truncated_body(F.lit(b"abcdef"), 4)).first()
    assert bytes(row["body"]) == b"abcd" and row["truncated"] and row["error"] is None
    assert one(spark, pages.pdf_text(F.array(F.lit(" a "), F.lit(" "), F.lit("b")))) == "a\n\nb"
