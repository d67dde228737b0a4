"""Near-duplicates by SimHash fingerprints, found through a vantage-point partition.

Fingerprints are deduplicated, then a vantage-point tree, fitted on a bounded
sample, deals them over shards: at each node those within the median distance
of the vantage point go inside, the others outside. Each fingerprint lives in
one shard. By the triangle inequality a partner across a node's border must lie
within the radius of it, so only fingerprints that close to the border also
visit the other side; the visitors of a shard meet its residents there. Every
pair within the radius therefore meets in a shard, and no other pruning is
done. A shard returns a spanning forest of its links, not its pairs.

A radius of 4 is as wide as the spread of the distances of unlike fingerprints,
so one tree over 64 bits sends many of them across each border. There are
therefore four trees, each over 16 of the bits: fingerprints that differ in 4
bits or fewer differ in one bit or none of at least one part, and only have to
meet there. 16 bits can't tell more than 65,536 groups apart, so beyond
``WIDE_FROM`` fingerprints there are ten trees instead, each over two of five
parts: of five parts with 4 differing bits or fewer, two together hold at most
one. Both forms are exact; they only differ in work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import checked, column_texts, mix64, share_of_hash, small_batches, table
from wiremill.llm.components import connected
from wiremill.session import written

#: A node of the tree: (vantage point, median distance, inside, outside); a leaf is its shard's number.
Tree = tuple | int


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text: each bit is the majority over all shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4) -> DataFrame:
    """``key, fp`` (signed 64 bits); a null or wordless text has fingerprint 0."""
    kind = docs.schema[key].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, size) for t in column_texts(batch.column("t"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found.view(np.int64))], ["k", "fp"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(hashed, f"k {kind}, fp bigint").withColumnRenamed("k", key)


def distances(many: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(many ^ one)


#: The bits that each tree looks at, for few and for many fingerprints, and how far apart the fingerprints of a link are in one of them.
VIEWS = tuple(0xFFFF << (16 * k) for k in range(4))
_PARTS = [sum(1 << b for b in range(64 * k // 5, 64 * (k + 1) // 5)) for k in range(5)]
WIDE_VIEWS = tuple(a | b for a, b in combinations(_PARTS, 2))
WIDE_FROM = 1 << 25


def fit_tree(sample: np.ndarray, shards: int, first: int = 0) -> tuple[Tree, int]:
    """Tree over a sample with about ``shards`` leaves, numbered from ``first``, and the next free number.

    Of some candidates, the vantage point with the widest distances is taken.
    """
    made = first

    def grow(part: np.ndarray, want: int) -> Tree:
        nonlocal made
        if want > 1 and len(part) > 1:
            tried = part[:: max(1, len(part) // 16)][:16]
            point = max(tried, key=lambda p: float(distances(part, p).std()))
            far = distances(part, point)
            mid = int(np.median(far))
            if 0 < (far <= mid).sum() < len(part):
                inside = grow(part[far <= mid], (want + 1) // 2)
                return (int(point), mid, inside, grow(part[far > mid], want // 2))
        made += 1
        return made - 1

    return grow(np.sort(sample), shards), made


def deal(tree: Tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(shard, whether the fingerprints live there, indices of ``fps``)."""

    def go(node: Tree, at: np.ndarray, home: bool) -> Iterator[tuple[int, bool, np.ndarray]]:
        if not len(at):
            return
        if not isinstance(node, tuple):
            yield node, home, at
            return
        point, mid, inside, outside = node
        far = distances(fps[at], np.uint64(point)).astype(np.int64)
        if home:  # residents near the border on its inner side visit the outer side
            yield from go(inside, at[far <= mid], True)
            yield from go(outside, at[far > mid], True)
            yield from go(outside, at[(far <= mid) & (far + radius > mid)], False)
        else:
            yield from go(inside, at[far - radius <= mid], False)
            yield from go(outside, at[far + radius > mid], False)

    yield from go(tree, np.arange(len(fps)), True)


def shard_forest(fps: np.ndarray, home: np.ndarray, radius: int, view: int, view_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between residents, and between visitors and residents, as (member, root).

    Pairs that differ in more than ``view_radius`` bits of ``view`` may be left to another view.
    """
    far = distances(fps & np.uint64(view), fps[0] & np.uint64(view)).astype(np.int64)
    order = np.argsort(far, kind="stable")
    fps, home, far = fps[order], home[order], far[order]
    parent = np.arange(len(fps))
    lows, highs = np.searchsorted(far, far - view_radius), np.searchsorted(far, far + view_radius, side="right")
    for i in np.flatnonzero(home):
        lo, hi = lows[i], highs[i]
        near = lo + np.flatnonzero(distances(fps[lo:hi], fps[i]) <= radius)
        if len(near) > 1:
            roots = parent[near]
            while (up := parent[roots] != roots).any():
                roots = np.where(up, parent[roots], roots)
            parent[roots] = roots.min()
            parent[near] = roots.min()
    while (parent[parent] != parent).any():
        parent = parent[parent]
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[linked], fps[parent[linked]]


def links(fps: DataFrame, radius: int = 4, shard_rows: int = 8192, most_sampled: int = 1 << 20, wide_from: int = WIDE_FROM) -> DataFrame:
    """``u, v``: links between different fingerprints of column ``fp`` that connect all pairs within ``radius``.

    The trees are fitted on a sample of fingerprints, 16 a shard and about
    ``most_sampled`` at most, and have about one shard per ``shard_rows`` of
    them; every fingerprint is dealt by each tree. ``radius`` is 4 or less from
    ``wide_from`` fingerprints on.
    """
    spark = fps.sparkSession
    n = fps.count()
    shards_wanted = min(max(1, -(-n // shard_rows)), most_sampled // 16)
    views, near = (WIDE_VIEWS, radius * 2 // 5) if n >= wide_from else (VIEWS, radius // len(VIEWS))
    sample = fps.where(share_of_hash(F.col("fp")) < F.lit(min(1.0, max(4096, 16 * shards_wanted) / max(1, n)))).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees, shards, view_of = [], 0, {}
    for view in views:
        tree, end = fit_tree(sample & np.uint64(view), shards_wanted, shards)
        trees.append(tree)
        view_of |= dict.fromkeys(range(shards, end), view)
        shards = end
    held = spark.sparkContext.broadcast((trees, view_of))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for view, tree in zip(views, held.value[0], strict=True):
                for shard, home, at in deal(tree, own.view(np.uint64) & np.uint64(view), near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), home)), pa.array(own[at])], ["shard", "home", "fp"])

    def met(group: pa.Table) -> pa.Table:
        view = held.value[1][group.column("shard")[0].as_py()]
        u, v = shard_forest(group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy(), radius, view, near)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, 4096))
    return fps.mapInArrow(dealt, "shard int, home boolean, fp bigint").repartition(parts, "shard").groupBy("shard").applyInArrow(met, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, size: int = 4) -> DataFrame:
    """``key, fingerprint, component_id, n_copies`` of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest ``key`` that links lead to (null where all
    keys of a component are null). Null, empty and wordless texts have
    fingerprint 0 and are linked like any other; texts of any length are taken
    whole. Repeated rows stay and share their component; rows with a null key
    are linked like others, but name no component. An empty table gives an
    empty table; other columns are not looked at. ``n_copies`` is the number of
    documents with the same fingerprint.
    """
    rows = written(fingerprints(docs, text, key, size), "fingerprints")
    kinds = written(rows.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n_copies")), "fingerprint-kinds")
    roots = connected(links(kinds.select("fp"), radius))
    of = kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id", "n_copies")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(key, shown.alias("fingerprint"), "component_id", "n_copies")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; cases as of :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Hashes of a text's word shingles, repeated ones repeated; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in spans), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def prefix(own: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first entries of a set of hashes, rare ones first: sets that are similar enough share one of these.

    The order is that of the ``ranks`` of ``common`` hashes (all others come
    before them), then that of the hashes. A set that shares none of its
    first n - ceil(similarity * n) + 1 shares too few of the rest.
    """
    n = len(own)
    if not n:
        return own
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def common_shingles(docs: DataFrame, text: str, size: int, most_docs: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in three or more of a sample of texts, and how many have them.

    About ``most_docs`` different texts are taken. The sample only serves to
    order shingles: any order finds all similar sets, a good one with less work.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(t, size)) for t in column_texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["s"])

    share = F.lit(min(1.0, most_docs / max(1, docs.count())))
    sample = docs.where(share_of_hash(F.col(text)) < share).select(F.col(text).alias("t")).distinct()
    often = sample.mapInArrow(found, "s bigint").groupBy("s").agg(F.count("*").alias("n")).where("n > 2").toPandas()
    order = np.argsort(often["s"].to_numpy(np.int64).view(np.uint64))
    return often["s"].to_numpy(np.int64).view(np.uint64)[order], often["n"].to_numpy(np.int64)[order]


#: Sketches: words of 64 bits, differing bits that a candidate may have, and sizes from which they are looked at.
#: At a similarity of 0.8, 256 bits differ in 39 on average, with a standard deviation of 5.7: one pair in 10^12 is beyond 80.
_MIXES, _FAR, _SKETCHED = (0x0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), 80, 16


def sketch(own: np.ndarray) -> list[int]:
    """SimHash bits of a set under several mixes of its hashes."""
    return [int(np.uint64(majority(mix64(own ^ np.uint64(m)))).view(np.int64)) for m in _MIXES]


def similar_sets(docs: DataFrame, kinds: DataFrame, size: int, similarity: float, base: DataFrame) -> DataFrame:
    """``node, root`` of the components that ``base`` (``u, v``) and all pairs of sets of at least ``similarity`` make.

    ``kinds`` has ``x`` (a set), its size ``s``, the hash ``h`` of a text with
    it, its ``sketch`` and its prefix ``keys``; ``docs`` has texts ``t`` by
    ``h``. Two sets are candidates if they share a key and, by their sizes, the
    key's places and their sketches, can be similar; candidates are checked by
    their whole sets. In two rounds each key's sets are compared with one of
    them, that whose keys are the most common (an original rather than an
    edited copy), then any. What these rounds leave apart is then compared
    pair by pair; pairs that are connected already are not.
    """
    step = (1 + similarity) / similarity

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([np.unique(shingles(t, size)).tobytes() for t in column_texts(batch.column("t"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("x"), found], ["x", "own"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    spread = kinds.select("x", F.posexplode_outer("keys").alias("i", "key"))
    again = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(spread.join(again, "key"), "shared-keys")
    weight = met.groupBy("x").agg(F.sum("n").alias("w")).join(kinds.select("x", "s", "sketch", F.size("keys").alias("m")), "x")
    shared = met.join(weight.select("x", "s", "sketch", (F.col("w") / F.col("m")).alias("w")), "x").select("key", "x", "s", "sketch", "w", (step * (F.col("s") - F.col("i")) - F.col("s") + 1e-6).alias("reach"))
    least = shared.groupBy("key").agg(F.min("s").alias("least"))
    shared = written(shared.join(least, "key").where("least <= reach").drop("least"), "possible-keys")  # no set beyond its reach can be similar if this key is the first in common

    def alike(pairs: DataFrame) -> DataFrame:
        bits = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("y_sketch", F.lit(k)))) for k in range(len(_MIXES))), F.lit(0))
        near = (F.least("s", "y_s") < _SKETCHED) | (bits <= _FAR)
        by_size = (F.col("y_s") <= F.col("reach")) & (F.col("s") <= F.col("y_reach")) & (F.least("s", "y_s") >= F.greatest("s", "y_s") * (similarity - 1e-9))
        pairs = written(pairs.where((F.col("x") != F.col("y")) & by_size & near).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "candidates")
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("x")).distinct().join(kinds.select("x", "h"), "x")
        own = written(docs.join(checked(written(wanted, "wanted-texts")), "h").select("x", "t").mapInArrow(sets, "x bigint, own binary").groupBy("x").agg(F.first("own").alias("own")), "shingle-sets")
        both = pairs.join(own.select(F.col("x").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("x").alias("v"), F.col("own").alias("b")), "v")
        return both.select("u", "v", "a", "b").mapInArrow(verified, "u bigint, v bigint")

    members, forest = shared.withColumn("root", F.col("x")), base
    for final in (False, False, True):
        if final:
            heads = members
        else:
            top = members.groupBy("key").agg(F.max(F.struct("w", "x", "s", "reach", "root", "sketch")).alias("y"))
            heads = top.select("key", "y.x", "y.s", "y.reach", "y.root", "y.sketch")
        pairs = members.join(heads.select("key", F.col("x").alias("y"), *[F.col(c).alias(f"y_{c}") for c in ("s", "reach", "root", "sketch")]), "key")
        found = alike(pairs.where("root < y_root" if final else "root != y_root"))
        roots = connected(forest.unionByName(found))
        forest = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        members = shared.join(roots, F.col("x") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "x"))
        apart = written(members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key"), "open-keys")
        if final or apart.first() is None:
            break
        members = written(members.join(apart, "key", "left_semi").withColumn("w", F.xxhash64("key", "x").cast("double")), "open-members")
    return roots


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """``docs`` without all but the first (by ``key``) of each group of near copies.

    Linked are documents whose SimHash fingerprints differ in at most
    ``radius`` bits, and documents whose shingle sets have a Jaccard similarity
    of ``similarity`` or more. Fingerprints of 64 bits differ in up to 13 bits
    at a similarity of 0.8, where no vantage point prunes; links of this second
    kind are therefore found by :func:`similar_sets`. No link is lost.

    All texts without words (null, empty) are one group. Rows with a null key
    stay, and rows that share a key stay or go together. Texts are taken whole;
    an empty table gives an empty table; all columns are passed through.
    """
    small_batches(docs)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, size))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, ranks = held.value
        for batch in batches:
            fps, sizes, kinds, sketches, keys = [], [], [], [], []
            for t in column_texts(batch.column("t")):
                all_of = shingles(t, size)
                own = np.unique(all_of)
                fps.append(majority(all_of))
                sizes.append(len(own))
                kinds.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                sketches.append(sketch(own))
                keys.append(prefix(own, common, ranks, similarity).view(np.int64))
            fps, kinds = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, kinds))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), fps, kinds, pa.array(sizes, pa.int32()), pa.array(sketches, longs), pa.array(keys, longs)], ["k", "h", "fp", "x", "s", "sketch", "keys"])

    rows = written(rows.mapInArrow(hashed, f"k {kind}, h bigint, fp bigint, x bigint, s int, sketch array<bigint>, keys array<bigint>"), "shingle-prefixes")
    kinds = written(rows.groupBy("x").agg(F.min("h").alias("h"), *[F.first(c).alias(c) for c in ("s", "sketch", "keys")]), "different-sets")
    of = written(rows.groupBy("fp").agg(F.min("x").alias("head")), "heads")
    same = rows.select("fp", "x").distinct().join(of, "fp").where("x != head").select(F.col("x").alias("u"), F.col("head").alias("v"))
    near = links(of.select("fp"), radius).join(of.select(F.col("fp").alias("u"), F.col("head").alias("hu")), "u").join(of.select(F.col("fp").alias("v"), F.col("head").alias("hv")), "v")
    base = written(same.union(near.select("hu", "hv")), "fingerprint-links")
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))
    roots = similar_sets(texts, kinds, size, similarity, base)
    grouped = rows.where("k is not null").groupBy("x").agg(F.min("k").alias("first")).join(roots, F.col("x") == F.col("node"), "left").withColumn("root", F.coalesce("root", "x"))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("first"))
    of_x = grouped.drop("first").join(firsts, "root").select("x", "first")
    gone = rows.where("k is not null").select("k", "x").join(of_x, "x").where("k != first").select(F.col("k").alias("__gone")).distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")
