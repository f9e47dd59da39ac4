"""Order MinHash fingerprints, in DataFrame functions.

A text's tokens are runs of characters that are not ASCII white space; what a
run has before its last ``LONGEST`` characters is cut into single ones, which
serves scripts without spaces. Each run of ``K`` tokens is a k-mer, numbered by its occurrence so that repeats are
distinct. The numbered k-mers' hashes fall into ``BUCKETS`` permutation buckets
(one-permutation hashing); from each bucket the ``PER_BUCKET`` minimal are
selected, put back into text order, and the tuple is hashed to 16 bits. Two texts
agree on a bucket if they have the same minimal k-mers in the same order, so
the share of buckets that agree falls with the edit distance of the tokens and,
unlike MinHash, with reordered passages.

Everything happens within a row: hash and place of a k-mer are packed into one
long (40 and 24 bits), a primitive array sort brings equal k-mers together, and
occurrence numbers come from doubling steps over the sorted array, as many as
the logarithm of the longest run of equal k-mers.

Texts of fewer than K tokens have one k-mer, all their tokens; texts without a
token have none, and are like one another only (likeness 1). An empty table
gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.llm.common import cut, shuffle_partitions

K = 3
LONGEST = 16  # characters of a token
BUCKETS = 64  # a power of two
PER_BUCKET = 2
_PLACE_BITS = 24  # places beyond wrap; only the order within a tuple is then less sure
_PLACE = (1 << _PLACE_BITS) - 1
_BUCKET_BITS = BUCKETS.bit_length() - 1


def signatures(text: Column, k: int = K) -> Column:
    """array<int> of BUCKETS numbers: 1 to 65535, or 0 of an empty bucket."""
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates value once
    gap = r"[^ \t\n\x0B\f\r]"
    tokens = F.regexp_extract_all(text, F.lit(rf"{gap}{{1,{LONGEST}}}(?!{gap})|{gap}"), F.lit(0))

    def packed_kmers(t):
        n = F.size(t)
        one = F.array(F.xxhash64(F.array_join(t, " ")).bitwiseAND(F.lit(~_PLACE)))
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(t, i + j) for j in range(k))).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_PLACE))))
        return F.when(n == 0, F.array().cast("array<long>")).when(n < k, one).otherwise(many)

    def numbered(s):
        # first: for each entry of the sorted array the place of the first of its k-mer
        same = lambda i: F.shiftrightunsigned(F.get(s, i), _PLACE_BITS) == F.shiftrightunsigned(F.get(s, i - 1), _PLACE_BITS)
        step = F.transform(s, lambda _, i: F.when((i > 0) & same(i), i - 1).otherwise(i))
        first = F.aggregate(
            F.sequence(F.lit(1), F.lit(_PLACE_BITS)),
            step,
            lambda at, _: F.when(F.exists(at, lambda x: F.get(at, x) != x), F.transform(at, lambda x: F.get(at, x))).otherwise(at),
        )
        repeats = F.exists(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.shiftrightunsigned(a, _PLACE_BITS) == F.shiftrightunsigned(b, _PLACE_BITS)), lambda x: F.coalesce(x, F.lit(False)))
        item = lambda x, n: F.xxhash64(F.shiftrightunsigned(x, _PLACE_BITS), n).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))
        plain = F.transform(s, lambda x: item(x, F.lit(0)))
        with_repeats = let(first, lambda f: F.transform(s, lambda x, i: item(x, i - F.get(f, i))))
        return F.when(repeats, with_repeats).otherwise(plain)

    bucket = lambda x: F.shiftrightunsigned(x, 64 - _BUCKET_BITS)

    def selected(u):
        return F.filter(u, lambda x, i: (i < PER_BUCKET) | (bucket(F.get(u, i - PER_BUCKET)) != bucket(x)))

    def tuples(u):
        # An entry that begins a bucket makes its tuple: the entries of that
        # bucket by their places in the text.
        begins = lambda x, i: (i == 0) | (bucket(F.get(u, i - 1)) != bucket(x))
        by_place = lambda x: F.shiftleft(x, 64 - _PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, _PLACE_BITS))

        def made(x, i):
            own = F.filter(F.slice(u, i + 1, PER_BUCKET), lambda y: bucket(y) == bucket(x))
            order = F.sort_array(F.transform(own, by_place))
            hashed = F.xxhash64(F.transform(order, lambda y: y.bitwiseAND(F.lit((1 << 64 - _PLACE_BITS) - 1))))
            return F.when(begins(x, i), F.struct(bucket(x).cast("int").alias("b"), (F.pmod(hashed, F.lit(65535)) + 1).cast("int").alias("v")))

        return F.filter(F.transform(u, made), lambda x: x.isNotNull())

    def spread(pairs):
        by = F.map_from_entries(pairs)
        return let(by, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(m[b], F.lit(0))))

    out = let(tokens, lambda t: let(F.sort_array(packed_kmers(t)), lambda s: let(F.sort_array(numbered(s)), lambda u: let(selected(u), lambda v: let(tuples(v), spread)))))
    return out


def written(signature: Column) -> Column:
    """Four hex digits for each bucket."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the buckets used by either signature on which both agree;
    1 if neither has any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] != 0) & (p["a"] == p["b"])))
    return F.when(used == 0, F.lit(1.0)).otherwise(equal.cast("double") / used)


def in_ranges(docs: DataFrame, rows_each: int = 2000, most: int = 1 << 16) -> DataFrame:
    """docs (doc_id, _tie) with _range, ascending as doc_id descends (nulls
    last) and then as _tie ascends: about ``rows_each`` rows to a range.

    The bounds are quantiles of doc_id, at most ``most`` numbers on the driver.
    Rows whose id is a bound, and those without one, have ranges of their own
    and are dealt over ranges of _tie, since there may be any number of them.
    """
    n = max(1, min(most, -(-docs.count() // rows_each)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"] if n > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)
    place, at_bound = F.lit(0), F.lit(False)
    if bounds:  # binary search for how many bounds are above doc_id
        q = F.array(*map(F.lit, bounds)) if len(bounds) < 64 else F.expr(f"from_json('{bounds}', 'array<bigint>')")
        steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))
        place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(q, at + s - 1) > F.col("doc_id")), at + s).otherwise(at))
        at_bound = F.coalesce(F.get(q, place) == F.col("doc_id"), F.lit(False))
    null = F.col("doc_id").isNull()
    # Of each bound: what is above it, then its own rows; nulls come after all.
    place = F.when(null, F.lit(2 * len(bounds) + 2)).otherwise(2 * place + F.when(at_bound, 1).otherwise(0))
    sub = F.when(null | at_bound, F.floor(F.col("_tie") / F.lit(float(1 << 58))) + 32).otherwise(F.lit(0))
    return docs.withColumn("_range", (64 * place.cast("long") + sub).cast("long"))


def with_next(rows: DataFrame, column: str) -> DataFrame:
    """rows, dealt by _range, with _next: the column of the next row by
    descending doc_id (ties by _tie; after the last comes the first).

    Within a range it is a window; for the last row of each range it is the
    first row of the next range in use. Those rows, one for each range, are
    named first by their ids and then read from the source, so that the column
    is shuffled once.
    """
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("d"), F.col("_tie").alias("t"))
    firsts = rows.groupBy("_range").agg(F.min(place).alias("_first"))
    heads = rows.join(F.broadcast(firsts), "_range").where(place.eqNullSafe(F.col("_first"))).groupBy("_range").agg(F.first(F.struct(F.col(column).alias("v"))).alias("head"))
    turned = firsts.agg(F.array_sort(F.collect_list("_range")).alias("all"))
    turned = turned.select(F.explode(F.zip_with("all", F.concat(F.slice("all", 2, 1 << 30), F.slice("all", 1, 1)), lambda a, b: F.struct(a.alias("_range"), b.alias("following")))).alias("x")).select("x.*")
    following = turned.join(heads.withColumnRenamed("_range", "following"), "following").select("_range", "head")
    within = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("_tie"))
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "_range")
    marked = dealt.withColumn("_next", F.lead(F.struct(F.col(column).alias("v"))).over(within))
    return marked.join(following, "_range", "left").withColumn("_next", F.coalesce(F.col("_next")["v"], F.col("head")["v"])).drop("head")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by as many first ones
    of the following text, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def digest(docs: DataFrame) -> DataFrame:
    """The fingerprint of every whole text and of its edited text, and their
    likeness. A null text counts as empty; rows of equal doc_id come by a hash
    of the text, a null doc_id last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_ranges(rows.withColumn("_tie", F.xxhash64("text")))
    pairs = with_next(rows, "text").withColumn("_edited", edited(F.col("text"), F.col("_next")))
    done = pairs.select("_range", "_tie", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"), signatures(F.col("_edited")).alias("of_edited"))
    done = with_next(cut(done), "own")  # used twice and made once
    return done.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("of_edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("of_edited")).alias("near_edited"), likeness(F.col("own"), F.col("_next")).alias("near_next"))
