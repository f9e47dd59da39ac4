from __future__ import annotations

import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blank and very long texts, repeated rows, and extra columns whose
    names clash with those that the operators use."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en"), (1, "alpha beta gamma delta epsilon zeta eta theta", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t ", "fr"), (5, LONG, "en"),
        (6, "alpha beta gamma delta epsilon zeta eta theta", None), (7, "un", "fr"), (None, "le chat est sur la table avec une souris", "fr"), (8, "😀 ﬀ ǅ\u0000x", "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return df.selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) + 0L as n_chars", "1 as score", "2 as salt", "3 as fp", "4 as key", "5 as node", "6 as a", "7 as d", "8 as h", "9 as seed", "10 as bin", "11 as row", "12 as toxic")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
