"""Secret scanning with multipart credential linking, in DataFrame functions.

A scan finds spans of six kinds. assign, access and hex stand on their own;
ident, secret and endpoint are weak: a user name, a mixed-case token or a URL
is no finding until a complementary part lies in its scope, which is ``scope``
code points before or after it. Roles complement each other so: an identifier
(access, ident) or an endpoint with a secret (assign, hex, secret).

Linking is an interval join: spans are dealt by row and scope-wide bucket, and
a weak span is kept if a complementary one in the same or a neighbouring bucket
is near enough (a semi join, so no pairs are made).

Null text counts as empty, an empty table gives no rows. Rows with equal doc_id
and text are scanned once and each returned; columns other than the id and the
text are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.llm.common import cut

KINDS = ["assign", "access", "hex", "ident", "secret", "endpoint"]
ROLES = ["secret", "id", "secret", "id", "secret", "endpoint"]
SCOPE = 256

#: kind: (pattern, group whose length counts, least length, a cheap sign that no match is without)
PATTERNS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 8, r"(?i:password|passwd|secret|token|api_?key)"),
    "access": (r"AKIA[A-Z0-9]+", 2, 16, r"AKIA"),
    "hex": (r"[0-9a-f]+", 2, 32, r"[0-9a-f]{32}"),
    "ident": (r"""(?:(?i:username|user|login|client_?id|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 3, 3, r"(?i:username|user|login|client_?id|account|access_?key_?id)"),
    "secret": (r"[A-Za-z0-9+/_-]{20,}", 2, 20, r"[A-Za-z0-9+/_-]{20}"),
    "endpoint": (r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+""", 2, 8, r"://"),
}


def _spans(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, len, ok>> of a kind's matches, leftmost and not
    overlapping: gap is the length of what lies between a match and the one
    before. Matches that fail a length remain, with ok false: a later match's
    place is counted from them."""
    pattern, group, least, sign = PATTERNS[kind]
    if kind == "hex":  # a run that is too short cannot hold a longer one
        pattern = r"[0-9a-f]{32,}"
    # (.*?) takes what lies before a match, so that lengths add up to places;
    # \G holds each search to where the last match ended, so that a tail
    # without a match is scanned once.
    whole = rf"(?s)\G(.*?)({pattern})"
    gap, match, counted = (F.regexp_extract_all(text, F.lit(whole), F.lit(g)) for g in (1, 2, group))
    ok = lambda m, c: F.length(c) >= least
    if kind == "secret":  # of upper case, lower case and digits
        ok = lambda m, c: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    zipped = F.arrays_zip(gap.alias("g"), match.alias("m"), counted.alias("c"))
    spans = F.transform(zipped, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), ok(x["m"], x["c"]).alias("ok")))
    return F.when(text.rlike(sign), spans).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean>>"))


def spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: all spans reported, as structs of start,
    kind (place in KINDS) and end, ordered by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = found.select("doc_id", F.sha2(text, 256).alias("row"), F.concat(*(_spans(text, k) for k in KINDS)).alias("found"))
    found = cut(found)  # the texts are scanned once; what is kept has no secret in it
    key = ["doc_id", "row"]
    each = found.where(F.size("found") > 0).dropDuplicates(key).select(*key, F.posexplode("found").alias("n", "x")).select(*key, "n", "x.*")
    before = Window.partitionBy(*key, "kind").orderBy("n")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).where("ok")
    each = each.select(*key, "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    each = each.withColumn("role", F.array(*map(F.lit, ROLES))[F.col("kind")])

    anchors = F.explode(F.array("start", "end")).alias("at")
    parts = each.select(*key, F.col("role").alias("part"), anchors)
    parts = parts.select(*key, "part", "at", F.explode(F.expr(f"array(at div {scope} - 1, at div {scope}, at div {scope} + 1)")).alias("bucket"))
    weak = each.where(F.col("kind") >= 3).select("*", anchors).withColumn("bucket", F.expr(f"at div {scope}"))
    a, b = weak.alias("a"), parts.alias("b")
    near = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.bucket") == F.col("b.bucket"))
    near &= (F.abs(F.col("a.at") - F.col("b.at")) <= scope) & ((F.col("a.role") == "secret") != (F.col("b.part") == "secret"))
    linked = a.join(b, near, "left_semi").select(*key, "kind", "start", "end").distinct()

    kept = each.where("kind < 3").select(*key, "kind", "start", "end").union(linked)
    rows = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    a, b = found.select(*key).alias("a"), rows.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row"))
    return a.join(b, same, "left").select("a.doc_id", F.coalesce("b.spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""
    found = spans(docs)
    name = F.array(*map(F.lit, KINDS))
    written = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", name[x["kind"]], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
