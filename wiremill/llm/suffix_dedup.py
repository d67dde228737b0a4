"""Exact substring dedup with enhanced suffix arrays over content-defined shards.

Every window of ``length`` bytes has a minimizer: the leftmost of its ``_GRAM``-byte
pieces with the least hash. Equal windows have equal minimizers at equal places,
so all copies of a window meet where their minimizer is sent. The bytes of the
windows that a minimizer owns are one context.

What is folded before the suffix arrays: whole copies of a text, and equal
contexts of equal minimizers (by 64-bit hashes). The earliest of each class
stands for it. This leaves the groups as they are: the bytes of each later
member lie in windows that start earlier in the class's first member, so they
are covered as a whole, and no later member can be the first occurrence of any
window. Only different contexts that share a minimizer enter a suffix array. A
stack scan over its common prefixes gives the intervals of suffixes that share
``length`` bytes or more; those whose members differ in the byte to their left
are the maximal repeats, each with all its occurrences. Bytes of all
occurrences but the first are removed. Repeats are maximal inside their
contexts; a longer one is the union of those of neighbouring contexts.

A minimizer with more than ``MOST_CONTEXTS`` different contexts (a passage of a
third of all documents has two, where it meets each document's own text) is
split, exactly: windows that hold the minimizer in a narrow range of places all
share the bytes around it, so each range goes on under a hash of these bytes.
Ranges get narrower until the parts are small; at the narrowest, a range is one
window and equal ones are folded. No task holds more than one part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wiremill.llm.common import checked, join_skewed, mix64, small_batches, table
from wiremill.session import written

LENGTH = 100
_GRAM = 16
#: Bits of a window key that hold a place; longer texts are taken in pieces.
_PLACE_BITS = 20
#: Different contexts of one minimizer (or part of it) that a suffix array takes.
MOST_CONTEXTS = 2000
#: How many places of the minimizer in the window go together, from the first split on.
_RANGES = (17, 4, 1)


def minimizers(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each minimizer of a text, in order of position.

    Windows are named by where they start; the ranges of windows are disjoint
    and cover all windows. A text shorter than ``length`` has none.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    h = data.astype(np.uint64) + np.uint64(1)
    for k, m in zip((1, 2, 4, 8), odd, strict=True):
        h = h[:-k] * m + h[k:]
    h = mix64(h)
    width, mask = length - _GRAM + 1, np.uint64((1 << _PLACE_BITS) - 1)
    n, step, parts = len(h) - width + 1, (1 << _PLACE_BITS) - width, []
    for lo in range(0, n, step):  # the least key of a window names the place of its leftmost least hash
        own = h[lo : lo + step + width - 1]
        key, reach = (own & ~mask) | np.arange(len(own), dtype=np.uint64), 1
        while reach < width:
            more = min(reach, width - reach)
            key = np.minimum(key[:-more], key[more:])
            reach += more
        parts.append((key & mask).astype(np.int64) + lo)
    at = np.concatenate(parts)
    place, first = np.unique(at, return_index=True)
    return h[place].view(np.int64), place, first, np.append(first[1:], len(at)) - 1


def suffix_array(flat: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """``starts`` sorted by ``depth`` bytes or more from them on, and ranks of all pieces of 8, 16, 32, .. bytes.

    Ranks double: a piece is the pair of its halves.
    """
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    key = np.zeros(len(flat), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(flat)].astype(np.uint64)
    ranks, size = {}, 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    ranks[8] = rank
    while size * 2 < depth:
        shifted = np.concatenate([rank[size:], np.zeros(size, np.int64)])
        rank = np.unique((rank << 32) | shifted, return_inverse=True)[1].astype(np.int64)
        size *= 2
        ranks[size] = rank
    key = (rank[starts] << 32) | rank[np.minimum(starts + size, len(rank) - 1)]
    return starts[np.argsort(key, kind="stable")], ranks


def common_prefixes(flat: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and at ``b``, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    for size in sorted(ranks, reverse=True):
        again = True
        while again:
            x, y = np.minimum(a + out, len(flat) - 1), np.minimum(b + out, len(flat) - 1)
            same = (out + size <= most) & (ranks[size][x] == ranks[size][y])
            out += size * same
            again = bool(same.any()) and size == max(ranks)
    for _ in range(7):
        x, y = np.minimum(a + out, len(flat) - 1), np.minimum(b + out, len(flat) - 1)
        out += (out < most) & (flat[x] == flat[y])
    return out


def common_prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of a suffix array; ``lcp[i]`` is between its entries i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def window_hashes(flat: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on, put together from those of 1, 2, 4, .. bytes."""
    n, size, offset = len(flat) - length + 1, 1, 0
    out, h = np.zeros(max(n, 0), np.uint64), flat.astype(np.uint64) + np.uint64(1)
    if n <= 0:
        return out
    odd = np.uint64(0x9E3779B97F4A7C15)
    while size <= length:
        if length & size:
            out = (out + h[offset : offset + n]) * odd
            offset += size
        h = mix64(h[:-size] * odd + h[size:])
        size *= 2
    return out


def with_repeats(texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Indices of the texts that may share a substring of ``length`` bytes with another or have one twice: those of which a window's hash occurs again."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    begins = np.cumsum(sizes) - sizes
    at = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(at):
        return at
    own = window_hashes(np.frombuffer(b"".join(texts), np.uint8), length)[at]
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return np.unique(owner[again])


def maximal_repeats(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of bytes, [(text, offset), ..]) of each group of equal substrings that can't be extended to either side.

    Texts are UTF-8, so that a byte 255 can end each of them in the suffix array.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    flat = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    if len(owner) < 2:
        return
    order, ranks = suffix_array(flat, begins[owner] + offset, int(sizes.max()))
    who = np.searchsorted(begins, order, side="right") - 1
    at = order - begins[who]
    room = sizes[who] - at
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefixes(flat, ranks, order[:-1], order[1:], np.minimum(room[:-1], room[1:]))
    left = np.where(at > 0, flat[order - 1].astype(np.int64), -1 - np.arange(len(order)))
    runs = np.flatnonzero(np.concatenate(([True], lcp[1:] < length)))
    for lo, hi in zip(runs.tolist(), np.append(runs[1:], len(order)).tolist(), strict=True):
        if hi - lo < 2 or (left[lo:hi] == left[lo]).all():  # alone, or extended to the left by all
            continue
        for depth, a, b in common_prefix_intervals([0, *lcp[lo + 1 : hi].tolist()], length):
            own = left[lo + a : lo + b + 1]
            if (own != own[0]).any():
                yield depth, list(zip(who[lo + a : lo + b + 1].tolist(), at[lo + a : lo + b + 1].tolist(), strict=True))


def _ordered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``rid, k, t``: ``rid`` grows with the key. Where keys repeat or are null, it numbers the sorted rows (null first, ties by text)."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n, known = docs.agg(F.count("*"), F.count_distinct(F.col(key))).first()
    if n == known and dict(rows.dtypes)["k"] in ("bigint", "int"):
        return rows.select(F.col("k").cast("bigint").alias("rid"), "k", "t")
    return written(rows.orderBy("k", "t").select(F.monotonically_increasing_id().alias("rid"), "k", "t"), "ordered")


def whole_copies(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rid, stop``: texts of ``length`` bytes or more that equal an earlier one (by MD5 and size), to be removed as a whole."""
    sized = rows.select("rid", F.unhex(F.md5("t")).alias("m"), F.octet_length("t").alias("stop")).where(F.col("stop") >= length)
    firsts = sized.groupBy("m", "stop").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1")
    return written(join_skewed(sized, written(firsts, "first-copies"), ["m", "stop"]).where("rid != first").select("rid", "stop"), "whole-copies")


CONTEXT = "h bigint, x bigint, rid bigint, start int, size int, place int, again array<struct<start:int,stop:int>>"
PIECE = "h bigint, bytes binary, rid bigint, start int, place int"


def contexts_of(data: bytes, length: int = LENGTH) -> tuple[list[np.ndarray], list[list[dict] | None]]:
    """Minimizer, hash, start, size and place of the minimizer of each different context, and ranges of its later copies in the text."""
    h, at, first, last = minimizers(np.frombuffer(data, np.uint8), length)
    x = np.fromiter((xxh64_intdigest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(h)).view(np.int64)
    columns, again = [h, x, first, last - first + length, at - first], [None] * len(h)
    own, of = np.unique(x ^ h, return_index=True, return_inverse=True)[1:]
    if len(own) < len(h):  # copies that overlap or touch are one range, as in a run of one byte
        ranges: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(own[of] != np.arange(len(h))).tolist():
            a, b = int(first[i]), int(last[i]) + length
            held = ranges.setdefault(int(own[of[i]]), [])
            if held and a <= held[-1][1]:
                held[-1] = (held[-1][0], b)
            else:
                held.append((a, b))
        keep = np.sort(own)
        columns = [c[keep] for c in columns]
        again = [[{"start": i, "stop": j} for i, j in ranges[k]] if k in ranges else None for k in keep.tolist()]
    return columns, again


def split(data: bytes, h: int, start: int, place: int, width: int, length: int = LENGTH) -> Iterator[tuple[int, bytes, int, int]]:
    """A context's windows by the place of the minimizer in them, ``width`` places together: (key, bytes, start, place)."""
    least, most = place - (len(data) - length), place
    for part in range(least // width, most // width + 1):
        low, high = part * width, part * width + width - 1
        shared = data[max(0, place - low) : place - high + length]  # in all windows of the range
        a, b = place - min(high, most), place - max(low, least) + length
        key = xxh64_intdigest(h.to_bytes(8, "little", signed=True) + shared, low * 128 + high)
        yield key - (1 << 64 if key >> 63 else 0), data[a:b], start + a, place - a


def duplicate_ranges(rows: DataFrame, length: int = LENGTH, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """``rid, start, stop``: byte ranges of ``t`` covered by ``length``-byte strings that also start earlier."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            found = [contexts_of(text.encode("utf-8", "surrogatepass"), length) for text in batch.column("t").to_pylist()]
            of = np.repeat(batch.column("rid").to_numpy(), [len(again) for _, again in found])
            h, x, start, size, place = (pa.array(np.concatenate([np.zeros(0, np.int64), *(columns[i] for columns, _ in found)]), kind) for i, kind in enumerate(kinds))
            again = pa.array([ranges for _, own in found for ranges in own], spans)
            yield pa.RecordBatch.from_arrays([h, x, pa.array(of), start, size, place, again], ["h", "x", "rid", "start", "size", "place", "again"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("rid", "t", "cuts")), strict=True):
                if cuts:
                    data = text.encode("utf-8", "surrogatepass")
                    yield pieces([(c["h"], data[c["start"] : c["start"] + c["size"]], rid, c["start"], c["place"]) for c in cuts])

    def pieces(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], ["h", "bytes", "rid", "start", "place"])

    def parts(width: int) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(k, data, rid, a, p) for h, data, rid, start, place in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, data, a, p in split(data, h, start, place, width, length)]
                if found:
                    yield pieces(found)

        return run

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``h``; each suffix array takes some whole groups."""

        def ranges(part: pa.Table) -> pa.RecordBatch:
            held = with_repeats(part.column("bytes").to_pylist(), length)  # the others can't take part in any repeat
            part = part.take(pa.array(held))
            rid, start = part.column("rid").to_numpy(), part.column("start").to_numpy()
            covered: dict[int, list[tuple[int, int]]] = {}
            for size, members in maximal_repeats(part.column("bytes").to_pylist(), length):
                first = min(members, key=lambda m: (rid[m[0]], start[m[0]] + m[1]))
                for i, k in members:
                    if (i, k) != first:
                        covered.setdefault(i, []).append((k, k + size))
            out = [(int(rid[i]), int(start[i]) + x, int(start[i]) + y) for i, own in covered.items() for x, y in joined(own)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], ["rid", "start", "stop"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            h = part.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if end:
                yield ranges(part.slice(0, end))
            held = part.slice(end).to_batches()
        if held:
            yield ranges(pa.Table.from_batches(held))

    copies = whole_copies(rows, length)
    places = rows.select("rid", "t").join(checked(copies), "rid", "left_anti").mapInArrow(anchors, CONTEXT)
    twice = places.groupBy("h").agg(F.sum(F.when(F.col("again").isNull(), 1).otherwise(2)).alias("n")).where("n > 1").select("h")
    cuts = written(places.join(twice, "h", "left_semi"), "contexts")
    firsts = cuts.groupBy("h", "x", "size").agg(F.min(F.struct("rid", "start", "place")).alias("f"), F.count("*").alias("n"))
    firsts = written(firsts.select("h", "x", "size", "n", F.col("f.rid").alias("rid0"), F.col("f.start").alias("start0"), F.col("f.place").alias("place")), "first-contexts")
    later = join_skewed(cuts.select("h", "x", "size", "rid", "start"), firsts.where("n > 1").drop("place"), ["h", "x", "size"]).where("rid != rid0 or start != start0")
    found = [later.select("rid", "start", (F.col("start") + F.col("size")).alias("stop")), copies.select("rid", F.lit(0), "stop"), cuts.select("rid", F.explode("again").alias("r")).select("rid", "r.start", "r.stop")]
    several = written(firsts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several-contexts")
    wanted = firsts.join(several, "h", "left_semi").groupBy(F.col("rid0").alias("rid")).agg(F.collect_list(F.struct("h", F.col("start0").alias("start"), "size", "place")).alias("cuts"))
    # A left join, as in drop_repeats, so that the texts are shuffled once for both.
    met = rows.join(wanted, "rid", "left").select("rid", "k", "t", "cuts").mapInArrow(fetched, PIECE)
    hot = several.where(F.col("kinds") > most_contexts).select("h")
    if hot.first() is not None:
        met = written(met, "context-bytes")
        small, large = [met.join(checked(hot), "h", "left_anti")], met.join(checked(hot), "h", "left_semi")
        for width in _RANGES:
            cut = written(large.mapInArrow(parts(width), PIECE).withColumn("x", F.xxhash64("bytes")), "context-parts")
            least = cut.groupBy("h", "x").agg(F.min(F.struct("rid", "start", "place", "bytes")).alias("f"), F.count("*").alias("n"))
            least = written(least.select("h", "x", "n", F.col("f.rid").alias("rid0"), F.col("f.start").alias("start0"), "f.bytes", "f.place"), "first-parts")
            later = join_skewed(cut.select("h", "x", "rid", "start", F.length("bytes").alias("size")), least.where("n > 1").drop("bytes", "place"), ["h", "x"])
            found.append(later.where("rid != rid0 or start != start0").select("rid", "start", (F.col("start") + F.col("size")).alias("stop")))
            kinds = written(least.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several-parts")
            piece = least.select("h", "bytes", F.col("rid0").alias("rid"), F.col("start0").alias("start"), "place")
            small.append(piece.join(kinds.where(F.col("kinds") <= most_contexts), "h", "left_semi"))
            large = piece.join(kinds.where(F.col("kinds") > most_contexts), "h", "left_semi")
            if kinds.where(F.col("kinds") > most_contexts).first() is None:
                break
        met = small[0]
        for more in small[1:]:
            met = met.unionByName(more)
    found.append(met.repartition("h").sortWithinPartitions("h").select("h", "bytes", "rid", "start").mapInArrow(repeats, "rid bigint, start int, stop int"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def removed(data: bytes, starts: list[int], stops: list[int]) -> tuple[bytes, int, int]:
    """What is left of a text without some byte ranges, how many bytes go, and in how many runs."""
    if not starts:
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.array(starts), 1)
    np.add.at(edge, np.array(stops), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every document, and with ``with_text`` the bytes left as ``kept``.

    Texts are taken as UTF-8 of any length, null as empty; a text shorter than
    ``length`` loses nothing; an empty table gives an empty table. Documents
    are ordered by ``key``; where keys repeat or are null, rows are numbered in
    the order of key (null first) and text, so that of repeated rows the first
    stays and every row has a result. Of equal strings the one that starts
    first stays; there are no ties. Other columns are not looked at.
    """
    small_batches(docs)
    rows = _ordered(docs, text, key)
    spans = duplicate_ranges(rows, length).groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(spans, "rid", "left").select("k", "t", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("t").to_pylist()]
            found = [removed(t, a or [], b or []) for t, a, b in zip(texts, batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True)]
            columns = [batch.column("k"), *(pa.array(x, pa.int64()) for x in (map(len, texts), (f[1] for f in found), (f[2] for f in found))), pa.array([sha256(f[0]).hexdigest() for f in found], pa.string())]
            if with_text:
                columns.append(pa.array([f[0] for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return joined.mapInArrow(cut, f"k {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{', kept binary' * with_text}").withColumnRenamed("k", key)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when each 100-byte string that starts earlier too is removed; cases as of :func:`drop_repeats`."""
    return drop_repeats(table(spark, sf_dir, "documents"))
