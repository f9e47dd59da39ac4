"""Text functions, all Column to Column and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as an explicit class: \s alone is ASCII in Java and RE2.
SPACE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def squeeze(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    return _replace(_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def plain_text(md: Column) -> Column:
    """Markdown without images, link targets and bare URLs, squeezed."""
    out = _replace(md, r"!\[[^\]]*\]\([^)]*\)", "")
    out = _replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return squeeze(_replace(out, r"https?://\S+", ""))


def bm25_tokens(text: Column) -> Column:
    """Latin words, then Hangul bigrams, then single kana and CJK characters."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9_]*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("[가-힣]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    cjk = F.regexp_extract_all(low, F.lit("[぀-ヿ㐀-鿿]"), F.lit(0))
    return F.concat(latin, F.flatten(pairs), cjk)


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A token for 4 characters, or for 1.5 CJK ones; truncated."""
    cjk = F.length(text) - F.length(_replace(text, "[一-鿿가-힯぀-ヿ]", ""))
    return ((F.length(text) - cjk) / F.lit(4.0) + cjk / F.lit(1.5)).cast("long")


def crude_tokens(n_chars: Column) -> Column:
    return F.floor(n_chars / 3).cast("long")


def sentences(text: Column) -> Column:
    """Cut after sentence marks, the white space there dropped (there may be
    none, as within 3.14)."""
    return F.split(text, "(?<=[.!?。！？])\\s*")


def excerpt(text: Column, cap: int = 120) -> Column:
    """The first sentence of the first line without markdown marks; beyond the
    cap it ends in an ellipsis."""
    out = _replace(text, r"(?s)```.*?```", "")
    out = _replace(out, r"(?m)^#{1,6}[ \t]+", "")
    out = _replace(out, r"\*{1,2}([^*\n]+)\*{1,2}", "$1")
    out = _replace(out, r"`([^`\n]+)`", "$1")
    line = strip(F.element_at(F.split(strip(out), "\n"), 1))
    first = F.element_at(F.split(line, "(?<=[.!?。！？])\\s+"), 1)
    return F.when(F.length(first) > cap, F.concat(_replace(F.left(first, F.lit(cap - 1)), f"{SPACE}+$", ""), F.lit("…"))).otherwise(first)


def embedding_input(heading: Column, embed_text: Column, body: Column, cap: int = 1800) -> Column:
    """Heading and the text to embed, cut to the cap in code points."""
    main = F.coalesce(F.nullif(embed_text, F.lit("")), body)
    return F.left(F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit("\n\n"), main)).otherwise(main), F.lit(cap))


def rerank_document(title: Column, heading: Column, body: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(has(title) & has(heading), F.concat(F.lit("Title: "), title, F.lit("\nSection: "), heading, F.lit("\n\n"), body))
        .when(has(title), F.concat(F.lit("Title: "), title, F.lit("\n\n"), body))
        .when(has(heading), F.concat(heading, F.lit("\n\n"), body))
        .otherwise(body)
    )


def adaptive_k(n: Column) -> Column:
    """How many chunks to return of n."""
    return F.when(n < 30, F.least(F.lit(8), F.greatest(F.lit(5), F.floor(n / 2) + 2))).when(n < 100, 8).when(n < 200, 10).otherwise(12).cast("long")


def max_chunk_chars(md: Column) -> Column:
    return F.when(F.length(md) < 20_000, 900).otherwise(450).cast("long")


def contains_all_tokens(text: Column, anchor: Column) -> Column:
    """Every white-space token of the anchor is in the text; false of none."""
    tokens = F.filter(F.split(squeeze(anchor), " "), lambda t: t != "")
    norm = squeeze(text)
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(norm, t))


def fresh_anchors(text: Column) -> Column:
    """The first three lines of 5 to 50 characters."""
    return F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x).between(5, 50)), 1, 3)


def snippet_hits(output: Column, snippets: Column) -> Column:
    """How many non-empty snippets the output has, whatever their case."""
    return F.when(F.coalesce(output, F.lit("")) == "", 0).otherwise(F.size(F.filter(snippets, lambda s: (s != "") & F.contains(F.lower(output), F.lower(s))))).cast("long")


def entities(sources: Column, cap: int = 20) -> Column:
    """Names in titles and headings: runs of capitalised words, then Hangul
    words, of each source in turn; the first mention of each counts."""
    english = r"[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)+"
    found = F.transform(sources, lambda s: F.concat(F.regexp_extract_all(s, F.lit(english), F.lit(0)), F.regexp_extract_all(s, F.lit("[가-힣]{2,}"), F.lit(0))))
    return F.slice(F.array_distinct(F.flatten(found)), 1, cap)


def rank1_signature(heading: Column, text: Column) -> Column:
    """What tells one first hit from another."""
    return F.left(F.sha1(F.concat(heading, F.lit("||"), strip(F.left(text, F.lit(80)))).cast("binary")), F.lit(12))


def url_hash(url: Column) -> Column:
    return F.left(F.sha1(url.cast("binary")), F.lit(12))


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def query_hash(query: Column) -> Column:
    return F.left(F.sha1(query.cast("binary")), F.lit(16))


def authority(url: Column) -> Column:
    """What is between // and the next slash, as written."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def netloc(url: Column) -> Column:
    return F.lower(authority(url))


def host(url: Column) -> Column:
    """Lower-cased, without user and port."""
    return F.lower(_replace(_replace(authority(url), r"^.*@", ""), r":\d*$", ""))


def strip_code_fence(text: Column) -> Column:
    return strip(_replace(_replace(strip(text), r"^```[A-Za-z]*\n?", ""), r"\n?```$", ""))


def profile_response(raw: Column) -> Column:
    """A model's JSON answer as a struct, null unless it has a page type and
    three anchors or more that are not empty."""
    parsed = F.from_json(strip_code_fence(raw), "page_type string, description string, content_anchors array<string>, noise_labels array<string>")
    anchors = parsed["content_anchors"]
    good = parsed["page_type"].isNotNull() & (F.size(anchors) >= 3) & F.forall(anchors, lambda a: F.coalesce(F.trim(a), F.lit("")) != "")
    return F.when(good, parsed)


def stable_class(name: Column) -> Column:
    """A CSS class without a build's hash suffix, as a selector part."""
    base, tail = F.regexp_extract(name, r"^(.*?)([_-]{1,2})([A-Za-z0-9]{5,})$", 1), F.regexp_extract(name, r"^(.*?)([_-]{1,2})([A-Za-z0-9]{5,})$", 3)
    hashed = (F.length(base) >= 3) & ((F.rlike(tail, F.lit("[a-z]")) & F.rlike(tail, F.lit("[A-Z]"))) | (F.length(tail) >= 7))
    return F.when(hashed, F.concat(F.lit('[class*="'), base, F.lit('"]'))).otherwise(F.concat(F.lit("."), name))
