"""SimHash fingerprints, and near duplicates by tiled exact comparison.

Fingerprints are compared by numpy exclusive-or and bit counts, a tile of
fingerprints against another at a time; the members of a block are sorted by
population count, and a pair of tiles whose counts differ by more than the
radius is skipped. Comparing every tile of a corpus with every other would
cost its square, so tiles are cut within blocks that lose no pair:

* ``pieces`` (64-bit fingerprints, small radius): a fingerprint is cut into
  radius + 2 pieces; two within the radius agree on two pieces at least, so
  each choice of two pieces is a block key. A block of over ``hot`` members is
  replaced by finer blocks (radius + 4 pieces, four agree), which loses no
  pair either.
* ``sketch`` (wider fingerprints, any radius): the block key is a minimal
  shingle hash under one of eight permutations. Two texts of similarity J
  share one with probability 1 - (1-J)**8, at J = 0.8 all but 3 in a million.
  A block of over ``hot`` members is dealt to groups, and each pair of groups
  is a block of its own, so that every pair of members still meets.

Equal fingerprints are one member, so copies are never paired. Within a block
only a spanning forest of the links is kept.

With a ``similarity``, fingerprints are of the set of shingles, a member is a
set, and the radius only selects candidates: a link counts if the Jaccard
similarity of the two sets themselves is so high. Sets travel to the blocks of
members that have a candidate, of no others.

Null and empty texts have no shingles and the fingerprint zero, and are linked
like any other; an empty table gives no rows. Repeated rows share a component.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import cut, give_back, mix64, shuffle_partitions
from quarryleaf.llm.components import components

SEED = 42
TILE = 1024
SKETCH = 8
_AT_ONCE = 1 << 15  # shingles whose bits are counted at once


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each run of so many words of the text with A-Z lower-cased,
    repeats included; of all its words if they are fewer; none of none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([h(b" ".join(w), SEED)], np.uint64)
    return np.fromiter((h(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words))))), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = hashes[i : i + _AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def set_hash(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of ascending shingle hashes."""
    h = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return h - (h >> 63 << 64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(set, shingles): the distinct shingle hashes of each distinct set."""

    @give_back
    def run(batches):
        for b in batches:
            for t in b.column(0):
                h = np.unique(shingle_hashes(t.as_py(), words))
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(h)], pa.int64()), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], ["set", "shingles"])

    return docs.select("text").mapInArrow(run, "set long, shingles array<long>").dropDuplicates(["set"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Jaccard similarity of two sets, as ascending arrays, is so high."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, fp, sketch, and with ``sets`` set, a hash of the set of
    shingles, each of which then counts once, and text_key, one of the text): fp has ``lanes`` longs of 64 bits, the first of the
    hashes themselves and others of the hashes remixed; sketch has the minimal
    hashes under eight permutations (empty without words). A null text counts
    as empty."""

    @give_back
    def run(batches):
        seeds = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64))
        for b in batches:
            fps, sketches, hashes = [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), words)
                if sets:
                    h = np.unique(h)
                    hashes.append(set_hash(h))
                fps.append([fingerprint(h if not k else mix64(h + np.uint64(k))) for k in range(lanes)])
                sketches.append([int(mix64(h ^ s).min()) for s in seeds] if lanes > 1 and len(h) else [])
            flat = np.array(fps, np.uint64).reshape(-1).view(np.int64)
            offsets = np.arange(0, len(flat) + 1, lanes, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([np.array(s, np.uint64).view(np.int64) for s in sketches], pa.list_(pa.int64())), *([pa.array(hashes, pa.int64()), b.column(2)] if sets else [])],
                ["doc_id", "fp", "sketch", *(["set", "text_key"] if sets else [])],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.xxhash64(text_col).alias("text_key")] if sets else [])).mapInArrow(run, f"doc_id {kind}, fp array<long>, sketch array<long>" + (", set long, text_key long" if sets else ""))


def _piece_keys(fp, pieces: int, agree: int):
    """Block keys of a 64-bit fingerprint column: for each choice of ``agree``
    of the pieces a hash of the choice and the pieces' bits."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    bits = [F.shiftrightunsigned(F.shiftleft(fp, 64 - b), 64 - (b - a)) for a, b in zip(edges, edges[1:])]
    return F.array(*(F.xxhash64(F.lit(k + 100 * pieces), *(bits[i] for i in chosen)) for k, chosen in enumerate(combinations(range(pieces), agree))))


def links_in_block(fps: np.ndarray, radius: int, same=None) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block, as pairs of places.

    fps: distinct fingerprints as rows of 64-bit words; same: whether the
    members at two places are linked, if the radius does not say.
    """
    n = len(fps)
    if n < 2:
        return []
    ones = np.bitwise_count(fps).sum(axis=1, dtype=np.int32)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order]
    root = np.arange(n)
    members = {}
    out = []
    for i in range(0, n, TILE):
        a = fps[i : i + TILE]
        for j in range(i, n, TILE):
            if ones[j] - ones[min(i + TILE, n) - 1] > radius:
                break  # this tile and those after it differ too much
            b = fps[j : j + TILE]
            far = np.zeros((len(a), len(b)), np.uint16)
            for lane in range(fps.shape[1]):
                far += np.bitwise_count(a[:, lane, None] ^ b[None, :, lane])
            x, y = np.nonzero(far <= radius)
            x, y = x + i, y + j
            while len(x := x[keep := root[x] != root[y]]):
                y = y[keep]
                if same:  # on to the first pair that is linked
                    at = next((k for k, (p, q) in enumerate(zip(order[x].tolist(), order[y].tolist())) if same(p, q)), None)
                    if at is None:
                        break
                    x, y = x[at:], y[at:]
                p, q = int(root[x[0]]), int(root[y[0]])
                out.append((int(order[x[0]]), int(order[y[0]])))
                mp, mq = members.pop(p, [p]), members.pop(q, [q])
                if len(mp) < len(mq):
                    p, mp, mq = q, mq, mp
                root[mq] = p
                members[p] = mp + mq
    return out


def near_links(fps: DataFrame, radius: int, lanes: int = 1, hot: int = 20_000, similarity: float | None = None) -> DataFrame:
    """(a, b): nodes of a spanning forest of all links within each block.

    fps: node, fp (distinct; arrays of ``lanes`` longs) and sketch; with a
    similarity, of sketches only, also shingles.
    """
    held = ["node", "fp"] + (["shingles"] if similarity is not None else [])
    if lanes == 1:
        one = F.col("fp")[0]
        keyed = fps.select("node", "fp", F.explode(_piece_keys(one, radius + 2, 2)).alias("key"))
        crowded = keyed.groupBy("key").count().where(F.col("count") > hot).select("key")
        finer = keyed.join(crowded, "key", "left_semi").select("node", "fp").distinct().select("node", "fp", F.explode(_piece_keys(F.col("fp")[0], radius + 4, 4)).alias("key"))
        keyed = keyed.join(crowded, "key", "left_anti").select("node", "fp", "key").union(finer)
    else:
        keyed = fps.select(*held, F.posexplode("sketch").alias("k", "m")).withColumn("key", F.xxhash64("k", "m")).drop("k", "m")
        crowded = keyed.groupBy("key").count().where(F.col("count") > hot).select("key")
        # As many groups as make two of them about a block of the size allowed.
        groups = keyed.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(2 * F.col("count") / hot).cast("int").alias("g"))
        dealt = keyed.join(groups, "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        dealt = dealt.select(*held, "key", "p", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("q"))
        keyed = keyed.join(crowded, "key", "left_anti").select(*held, "key").union(dealt.select(*held, F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("key")))
    blocks = keyed.repartition(shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key", "node").select("key", *held)

    @give_back
    def run(batches):
        rest = None
        for b in batches:
            part = pa.Table.from_batches([b])
            part = part if rest is None else pa.concat_tables([rest, part])
            key = part.column("key").to_numpy()
            last = int(np.searchsorted(key == key[-1], True)) if len(key) else 0  # the last block may go on
            yield from linked(part.slice(0, last), key[:last])
            rest = part.slice(last)
        if rest is not None:
            yield from linked(rest, rest.column("key").to_numpy())

    def linked(part, key):
        if not len(key):
            return
        node = part.column("node").to_numpy()
        fp = pa.concat_arrays(part.column("fp").chunks).flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        a, c = [], []
        sets = part.column("shingles").combine_chunks() if similarity is not None else None
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            same = sets and (lambda x, y, s=s: alike(sets[int(s) + x].values.to_numpy().view(np.uint64), sets[int(s) + y].values.to_numpy().view(np.uint64), similarity))
            for x, y in links_in_block(fp[s:e], radius, same):
                a.append(node[s + x])
                c.append(node[s + y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id, group, and with a similarity text_key), a row
    for each row of docs.

    Fingerprints within ``radius`` bits are linked, with a similarity only if
    the shingle sets have it (needs lanes > 1), and a component is all that
    links reach; its id is the smallest doc_id in it. Documents without words
    have the fingerprint zero, linked like any other. Repeated rows share their
    component. A row with a null doc_id is linked like any other and may join
    two components; it counts for no component's id, and if all ids of a
    component are null, so is the component's. ``group`` tells components apart
    also where ids repeat over different texts, whose hash is ``text_key``.
    """
    exact = similarity is not None
    member = ["fp", "set"] if exact else ["fp"]
    fps = cut(fingerprints(docs, words, lanes, id_col, text_col, exact).withColumn("doc_id", F.col("doc_id").cast("long")))
    # A node is what members are distinct by.
    node = F.col("set") if exact else F.col("fp")[0] if lanes == 1 else F.xxhash64("fp")
    distinct = cut(fps.groupBy(*member).agg(F.min("doc_id").alias("least"), F.min("sketch").alias("sketch")).withColumn("node", node))
    links = near_links(distinct, radius, lanes)
    if exact:
        links = cut(links)  # some link of every member that has any
        some = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        chosen = distinct.join(some, "node", "left_semi")
        ids = chosen.select("least").where("least is not null").distinct()
        whole = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).alias("text"))
        texts = whole.join(ids, "least", "left_semi").union(whole.where("least is null"))
        chosen = chosen.join(shingle_sets(texts, words), "set")
        links = near_links(chosen, radius, lanes, hot=4000, similarity=similarity)
    linked = components(links)
    least = linked.join(distinct.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("reached"))
    linked = linked.join(least, "root").select("node", "root", "reached")
    roots = distinct.select(*member, "node", "least").join(linked, "node", "left").select(*member, F.when(F.col("root").isNotNull(), F.col("reached")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "node").alias("group"))
    # A fingerprint may have a third of all rows: its rows are dealt over salts.
    n = 8
    own = ["doc_id", "text_key"] if exact else ["doc_id"]
    salted = fps.select(*own, *member, F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("salt"))
    spread = roots.select(*member, "component_id", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("salt"))
    return salted.join(spread, [*member, "salt"]).select(*own, "fp", "component_id", "group")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
