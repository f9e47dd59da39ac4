"""Line deduplication by pairwise alignment.

Documents that share a block are found through the hashes of windows: the
shortest run of lines that has ``block_words`` words, from each line on and up
to each line. Every line of a common block of enough words lies in a window
that the block holds, and equal blocks have equal windows. For each window
every later document is paired with the first that has it, so a block that a
third of all documents have gives as many pairs, never their square, and loses
no later document. Each pair is aligned by patience diff over the line hashes,
and every aligned common block of at least ``block_words`` words is deleted
from the later document; so are windows that the earlier document has and the
alignment left, where blocks are repeated or cross. Thus a line with words
stays only if no earlier document has a block of enough words around it.
Alignments use the texts as they came; the first document with a block keeps
it, since only an earlier one could take it.

Order is by doc_id, then by a hash of the text. Rows with equal doc_id and text
are one document and each returned. Rows with a null doc_id or null text are
returned unchanged, an empty table gives no rows. Lines end at \\n and compare
with white space collapsed. Other columns are kept whatever their names, but
for _ql_deleted and _ql_from, which are made here.

Frequent lines need no bound: however many documents share a window, each is
paired with one holder of it, so pairs grow with the windows and rarity is no
condition of a seed.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import cut, give_back

BLOCK_WORDS = 20
_SALTS = 16


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Signed 64-bit hash and word count of each line; 0 and 0 of a blank one."""
    hashes, words = [], []
    for line in text.split("\n"):
        w = line.split()
        h = xxhash.xxh64_intdigest(" ".join(w)) if w else 0
        hashes.append(h - (h >> 63 << 64))
        words.append(len(w))
    return hashes, words


def windows(words: list[int], block_words: int) -> set[tuple[int, int]]:
    """(first, last) line of the shortest runs of at least ``block_words`` words
    from each line with words on, and up to each. No run has a negative count."""
    out, i, total, back = set(), 0, 0, None
    for j, n in enumerate(words):
        if n < 0:
            i, total, back = j + 1, 0, None
            continue
        total += n
        while i <= j and (not words[i] or total >= block_words):
            if words[i]:
                out.add((i, j))
                back = i
            total -= words[i]
            i += 1
        if n and back is not None:
            out.add((back, j))
    return out


def seeds(hashes: list[int], words: list[int], block_words: int = BLOCK_WORDS) -> list[int]:
    """Signed hashes of the windows."""
    lines = array("q", hashes).tobytes()
    out = {xxhash.xxh64_intdigest(lines[8 * i : 8 * j + 8], 1) for i, j in windows(words, block_words)}
    return [h - (h >> 63 << 64) for h in out]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of aligned equal elements, ascending in both: ends that agree,
    then the longest ascending chain of elements that are unique in both, and
    so on between those."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: p for p, x in enumerate(b[k:m], k) if once_b[x] == 1}
        common = [(p, place[x]) for p, x in enumerate(a[i:j], i) if once_a[x] == 1 and x in place]
        tails, ends, back = [], [], []
        for n, (_, q) in enumerate(common):
            at = bisect_left(tails, q)
            tails[at : at + 1], ends[at : at + 1] = [q], [n]
            back.append(ends[at - 1] if at else -1)
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(common[n])
            n = back[n]
        out += chain
        p, q = i, k
        for x, y in [*reversed(chain), (j, m)] if chain else []:
            todo.append((p, x, q, y))
            p, q = x + 1, y + 1
    return sorted(out)


def common_blocks(later: list[int], words: list[int], earlier: list[int], block_words: int) -> list[int]:
    """Places of later's lines in aligned blocks of enough words, and in windows
    that earlier has anywhere."""
    out, block = set(), []
    for i, k in [*patience(later, earlier), (-1, -1)]:
        if block and (i, k) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[x] for x, _ in block) >= block_words:
                out.update(x for x, _ in block)
            block = []
        block.append((i, k))
    common = set(earlier)
    left = [(i, j) for i, j in windows(words, block_words) if common.issuperset(later[i : j + 1]) and not out.issuperset(range(i, j + 1))]
    if left:
        count = dict(zip(later, words))
        has = {tuple(earlier[i : j + 1]) for i, j in windows([count.get(x, -1) for x in earlier], block_words)}
        for i, j in left:
            if tuple(later[i : j + 1]) in has:
                out.update(range(i, j + 1))
    return sorted(out)


def _without(text: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for t, gone in zip(text, lines):
        if (t := t.as_py()) is not None:
            gone = set(gone.as_py())
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append(t)
    return pa.array(out, pa.string())


def deduplicate(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with common blocks deleted from later documents' texts, and
    _ql_deleted (places of the lines deleted, ascending, null if none) and
    _ql_from (ids of the documents that they were aligned with)."""
    kind = dict(docs.dtypes)[id_col]
    key = F.xxhash64(F.lit("line"), text_col)

    @give_back
    def run(batches):
        for b in batches:
            found = [line_hashes(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.int32())), pa.array([seeds(*x, block_words) for x in found], pa.list_(pa.int64()))], ["d", "h", "lines", "words", "seeds"]
            )

    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("d"), key.alias("h"), F.col(text_col).alias("t"))
    # Cut once they are distinct: the joins below then read plain exchanges,
    # which adaptive execution can split where one document has many partners.
    lines = cut(texts.mapInArrow(run, f"d {kind}, h long, lines array<long>, words array<int>, seeds array<long>").dropDuplicates(["d", "h"]))
    seeded = lines.select(F.explode("seeds").alias("seed"), "d", "h")
    first = seeded.groupBy("seed").agg(F.min(F.struct("d", "h")).alias("first"), F.max(F.struct("d", "h")).alias("last")).where("first <> last")
    # A seed may have a third of all documents: they are dealt over salts.
    first = first.select("seed", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = seeded.withColumn("salt", F.pmod("h", F.lit(_SALTS)).cast("int"))
    pairs = salted.join(first, ["seed", "salt"]).select("d", "h", F.col("first.d").alias("d0"), F.col("first.h").alias("h0")).where("d <> d0 or h <> h0").distinct()
    earlier = lines.select(F.col("d").alias("d0"), F.col("h").alias("h0"), F.col("lines").alias("lines0"))
    both = pairs.join(lines.select("d", "h", "lines", "words"), ["d", "h"]).join(earlier, ["d0", "h0"]).select("d", "h", "d0", "lines", "words", "lines0")

    @give_back
    def align(batches):
        for b in batches:
            gone = [common_blocks(x.as_py(), w.as_py(), y.as_py(), block_words) for x, w, y in zip(b.column(3), b.column(4), b.column(5))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(gone, pa.list_(pa.int32()))], ["d", "h", "d0", "gone"])

    aligned = both.mapInArrow(align, f"d {kind}, h long, d0 {kind}, gone array<int>").where(F.size("gone") > 0)
    gone = aligned.groupBy(F.col("d").alias("_ql_d"), F.col("h").alias("_ql_h")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("_ql_deleted"), F.array_sort(F.collect_set("d0")).alias("_ql_from"))
    without = F.arrow_udf(_without, "string")
    out = docs.withColumn("_ql_key", key).join(gone.hint("merge"), (F.col(id_col) == F.col("_ql_d")) & (F.col("_ql_key") == F.col("_ql_h")), "left").drop("_ql_d", "_ql_h", "_ql_key")
    return out.withColumn(text_col, F.coalesce(without(F.when(F.col("_ql_deleted").isNotNull(), F.col(text_col)), F.coalesce("_ql_deleted", F.array().cast("array<int>"))), F.col(text_col)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_deleted, deleted_lines and aligned_with as lists, and the text
    that is left, for every document."""
    out = deduplicate(docs.select("doc_id", "text"))
    kind, deleted = dict(docs.dtypes)["doc_id"], F.coalesce("_ql_deleted", F.array().cast("array<int>"))
    return out.select("doc_id", F.size(deleted).cast("long").alias("n_deleted"), deleted.alias("deleted_lines"), F.coalesce("_ql_from", F.array().cast(f"array<{kind}>")).alias("aligned_with"), "text")
