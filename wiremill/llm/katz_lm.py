"""Language-model scoring with Katz backoff.

All n-grams of the training documents are counted by Spark, of every order and
however rare, and texts are scored where the n-grams are counted.

    P(w | h) = d(c) * c(h w) / (c(h) + 1)     if h w was seen c times
             = a(h) * P(w | h less its first word)     else

``d`` is the Good-Turing discount of the count; one more use is added to each
history, so that something is left for unseen words even where all counts are
too high for a discount. ``a(h)`` is exact: what the seen words leave, over
what they leave of the lower order, so the probabilities after any history add
up to 1. Nothing depends on the size of the corpus. Words are told apart by
64-bit hashes.

One exchange brings each n-gram, with the documents it is in, to the task of
the word before its last one. That task has all n-grams after any history that
ends in this word, so it counts and normalises all orders from 2 on by itself.
Histories of a frequent last word are dealt out by two words, and so on; what
is then shared by tasks, as single words always are, is asked for: tasks send
their counts to the task of the word, which adds them up and answers. Sums over
a frequent history come from there as well. N-grams travel as packed columns
for each stretch of texts and task, and the exchange is read twice, to ask and
to score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import byte_words, column_texts, crc_of, mix64, small_batches, table

#: Among the hashes of words: no word (before a text's start), a text's start and its end.
NONE, START, END = 0, 0x57A27, 0x5EED
#: Tokens of a stretch of texts; tokens of a task's turn, about; histories with over 1 in so many of a turn's tokens are frequent.
_CHUNK, _TURN, _OFTEN = 2_500_000, 700_000, 2
_SENT = ("part", "chunk", "turn", "body", "docs", "at", "size")


def tokens(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, and the end."""
    words = byte_words(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def grams(flat: np.ndarray, sizes: np.ndarray, order: int, none: int = NONE, start: int = START) -> tuple[list[np.ndarray], np.ndarray]:
    """For all tokens of texts laid end to end: the token itself, its predecessor and so on up to ``order`` columns; and which text each is of."""
    lead = order - 1
    ends = np.cumsum(sizes + lead)
    padded = np.full(int(ends[-1]) if len(ends) else 0, none, flat.dtype)
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) + (of + 1) * lead
    padded[at] = flat
    if lead:
        padded[ends - sizes - 1] = start
    return [padded[at - k] for k in range(order)], of


def good_turing(of: np.ndarray, most: int = 5) -> np.ndarray:
    """Discounts for the counts 0 to ``most`` + 1 and above, from the numbers ``of[r]`` of types seen r times.

    Where the numbers give no discount between 0 and 1, the count stays as it is.
    """
    out = np.ones(most + 2)
    if of[1] > 0:
        beyond = (most + 1) * of[most + 1] / of[1]
        for r in range(1, most + 1):
            if of[r] > 0 and beyond < 1:
                d = ((r + 1) * of[r + 1] / (r * of[r]) - beyond) / (1 - beyond)
                out[r] = d if 0 < d < 1 else 1.0
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers (or doubles, by their bits): each in as many bytes as its greatest needs, low bytes first, compressed."""
    head, bodies = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a).view(np.uint64) if a.dtype.kind == "f" else np.ascontiguousarray(a, np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8)[:, :width].T)
        bodies.append(pa.compress(planes.tobytes(), "zstd", asbytes=True))
        head += [len(a), width, len(bodies[-1])]
    return np.array(head, np.int64).tobytes() + b"".join(bodies)


def unpacked(body: bytes) -> list[np.ndarray]:
    """The arrays of :func:`packed`, as unsigned 64-bit integers."""
    count = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 3 * count, 8).reshape(count, 3)
    out, at = [], 8 + 24 * count
    for n, width, size in head.tolist():
        planes = np.frombuffer(pa.decompress(body[at : at + size], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = planes.T
        out.append(whole.view(np.uint64).ravel())
        at += size
    return out


def _sorted(by: list[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The (stable) order by columns of places below ``most``, and where in it the first column changes, the first two, and so on."""
    bits = max(1, (most - 1).bit_length())
    if bits * len(by) <= 63:
        key = by[0].astype(np.int64)
        for c in by[1:]:
            key <<= bits
            key |= c
        sort = np.argsort(key, kind="stable")
        del key
    else:
        sort = np.lexsort(by[::-1])
    out = []
    for c in by:
        new = out[-1].copy() if out else np.arange(len(sort)) == 0
        c = c[sort]
        new[1:] |= c[1:] != c[:-1]
        out.append(new)
    return sort, out


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each different pair, and the number of each row's pair."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(a * (int(b.max()) + 1) + b, return_index=True, return_inverse=True)[1:]


@dataclass(frozen=True)
class Layout:
    """How n-grams are dealt out: ``parts`` tasks with the key ``keys[i]`` each, in ``subs`` turns; hashes of frequent histories in ascending order, their lengths, and each one's place (from 1, 0: the empty one) without its first word."""

    order: int
    keys: np.ndarray
    subs: int
    often: np.ndarray
    lengths: np.ndarray
    parents: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.keys)

    def histories(self, words: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Hashes of the last word before each, of the last two, and so on."""
        h = np.zeros(len(words[0]), np.uint64)
        for w in words[1:]:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(1))
            yield h

    def levels(self, words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Per order, the place of an n-gram's history if that is frequent (else -1); and the hash that decides where the n-gram goes."""
        f = np.zeros(len(words[0]), np.int64)
        out, home = [f], np.zeros(len(f), np.uint64)
        for h in self.histories(words):
            home = np.where(f >= 0, h, home)
            at = np.searchsorted(self.often, h)
            hit = self.often[np.minimum(at, len(self.often) - 1)] == h if len(self.often) else np.zeros(len(h), bool)
            f = np.where((f >= 0) & hit, at + 1, -1)
            out.append(f)
        return out, home


def _layout(docs: DataFrame, order: int) -> Layout:
    """Tasks by the session's setting, turns and frequent histories by a sample of texts, which decides where work is done and no result."""
    spark = docs.sparkSession
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(given, 12), given // 2)
    share = min(1.0, (1000 + 20 * parts) / max(1, docs.count()))
    bare = Layout(order, np.zeros(0, np.int64), 1, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [tokens(t) for t in column_texts(batch.column("t"))]
            words, _ = grams(np.concatenate(texts) if texts else np.zeros(0, np.uint64), np.array([len(t) for t in texts], np.int64), order)
            size = len(words[0])
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([0]), pa.array([size])], ["l", "h", "p", "n"])
            parent = np.zeros(size, np.uint64)
            for length, h in enumerate(bare.histories(words), 1):
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                first, n = first[n * 64 * parts >= size], n[n * 64 * parts >= size]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), length)), pa.array(h[first].view(np.int64)), pa.array(parent[first].view(np.int64)), pa.array(n)], ["l", "h", "p", "n"])
                parent = h

    found = docs.where(F.rand(7) < share).select("t").mapInArrow(count, "l bigint, h bigint, p bigint, n bigint").groupBy("l", "h", "p").agg(F.sum("n").alias("n"))
    size = found.where("l = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    subs = max(1, math.ceil(size / share / parts / _TURN))
    rows = found.where((F.col("l") > 0) & (F.col("n") * _OFTEN * parts * subs > size)).collect()
    own = {(r["l"], np.int64(r["h"]).astype(np.uint64).item()): np.int64(r["p"]).astype(np.uint64).item() for r in rows}
    kept: dict[int, tuple[int, int]] = {}
    for (length, h), p in sorted(own.items()):
        if length == 1 or p in kept:
            kept[h] = (length, p)
    often = np.array(sorted(kept), np.uint64)
    places = {h: i for i, h in enumerate(often.tolist(), 1)} | {0: 0}
    lengths = np.array([kept[h][0] for h in often.tolist()], np.int64)
    parents = np.array([places[kept[h][1]] if kept[h][0] > 1 else 0 for h in often.tolist()], np.int64)
    dealt = spark.range(parts * 40).select("id", F.expr(f"pmod(hash(id), {parts})").alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()
    keys = {r["at"]: r["id"] for r in dealt}
    return Layout(order, np.array([keys.get(i, i) for i in range(parts)], np.int64), subs, often, lengths, parents)


def _spread(layout: Layout, kept: list[str]):
    """The function that cuts texts into n-grams and packs them for the task each goes to.

    Of a stretch of texts (``chunk``) a task gets a row with the words that occur
    in its share (``turn`` -1), a row per turn, and rows of documents (-2). A turn has
    its different n-grams with their uses in training (``body``), and the
    documents that each is in (``docs``).
    """
    order = layout.order

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        aside: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rest = pa.Table.from_batches(aside).combine_chunks()
            learn, ask = (np.asarray(rest.column(c).to_numpy(), bool) for c in ("__learn", "__ask"))
            chunk = rest.column("__row")[0].as_py()
            sizes = np.array([len(t) for t in held], np.int64)
            words, flat = np.unique(np.concatenate([np.array([NONE, START], np.uint64), *held]), return_inverse=True)
            held.clear()
            cols, of = grams(flat[2:].astype(np.int32), sizes, order, flat[0], flat[1])
            of = of.astype(np.int32)
            del flat
            sort, new = _sorted([*cols[1:], cols[0]], len(words))
            of, at = of[sort], np.flatnonzero(new[-1])
            gram = np.cumsum(new[-1]) - 1
            by = [c[sort[at]] for c in (*cols[1:], cols[0])]
            del cols, sort
            entry = new[-1]
            entry[1:] |= of[1:] != of[:-1]
            entries = np.flatnonzero(entry)
            n = np.diff(np.append(entries, len(of)))
            gram, of = gram[entries], of[entries]
            del entry, entries, new
            uses = np.bincount(gram, weights=n * learn[of], minlength=len(at)).astype(np.int64)
            asked = ask[of]
            gram, of, n = gram[asked], of[asked], n[asked]
            per = np.bincount(gram, minlength=len(at))
            hashes = [words[c] for c in (by[-1], *by[:-1])]
            fs, home = layout.levels(hashes)
            home = np.where(fs[-1] >= 0, mix64(home + hashes[0] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(chunk & (1 << 64) - 1)), home)
            del fs, hashes, gram, asked
            slot = (home % np.uint64(layout.parts)).astype(np.int64) * layout.subs + (home // np.uint64(layout.parts) % np.uint64(layout.subs)).astype(np.int64)
            sort = np.argsort(slot.astype(np.uint16) if layout.parts * layout.subs < 1 << 16 else slot, kind="stable")
            starts = (np.cumsum(per) - per)[sort]
            slot, by, uses, per = slot[sort], [c[sort] for c in by], uses[sort], per[sort]
            below = np.append(0, np.cumsum(per))
            moved = np.repeat(starts - below[:-1], per) + np.arange(below[-1])
            of, n = of[moved], n[moved]
            del home, sort, starts, moved
            bounds = np.searchsorted(slot, np.arange(layout.parts * layout.subs + 1))
            heads, rows = packed(ask), []
            for part in range(layout.parts):
                lo, hi = bounds[part * layout.subs], bounds[(part + 1) * layout.subs]
                if lo == hi:
                    continue
                used = np.zeros(len(words), bool)
                for c in by:
                    used[c[lo:hi]] = True
                local = np.cumsum(used) - 1
                rows.append((part, -1, packed(words[used]), heads))
                for turn in range(layout.subs):
                    a, b = bounds[part * layout.subs + turn], bounds[part * layout.subs + turn + 1]
                    if a < b:
                        own = [local[c[a:b]] for c in by]
                        own[0] = np.diff(own[0], prepend=0) if order > 1 else own[0]
                        rows.append((part, turn, packed(*own, uses[a:b]), packed(per[a:b], of[below[a] : below[b]], n[below[a] : below[b]])))
            for lo in range(0, len(rows), 16):
                some = rows[lo : lo + 16]
                nothing = [pa.nulls(len(some), f.type) for f in rest.schema if f.name in kept]
                yield pa.RecordBatch.from_arrays([pa.array(layout.keys[[r[0] for r in some]]), pa.array([chunk] * len(some), pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.binary()), pa.array([r[3] for r in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), *nothing], [*_SENT, *kept])
            at, there = np.flatnonzero(ask), np.unique([r[0] for r in rows])
            if len(at):
                carried = [rest.column(c).take(pa.array(at)).combine_chunks() for c in kept]
                nothing = pa.nulls(len(at), pa.binary())
                whole = pa.Table.from_arrays([pa.array(layout.keys[there[at % len(there)]]), pa.array(np.full(len(at), chunk)), pa.array(np.full(len(at), -2)), nothing, nothing, pa.array(at), pa.array(sizes[at]), *carried], names=[*_SENT, *kept])
                yield from whole.to_batches(max_chunksize=10_000)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                one = batch.slice(lo, 64)
                held += [tokens(t) for t in column_texts(one.column("t"))]
                size += sum(map(len, held[-one.num_rows :]))
                aside.append(one.drop_columns(["t"]))
                if size > _CHUNK:
                    yield from out()
                    held, aside, size = [], [], 0
        if held:
            yield from out()

    return spread


class _Turn:
    """The n-grams of one turn of a task, of all texts: each different one's words (places in ``words``), uses and the ids of its histories and lower orders."""

    def __init__(self, layout: Layout, words: np.ndarray, blocks: list[tuple[np.ndarray, bytes]]) -> None:
        order = layout.order
        columns: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        for local, body in blocks:
            own = [a.view(np.int64) for a in unpacked(body)]
            own[0] = np.cumsum(own[0]) if order > 1 else own[0]
            for held, a in zip(columns, [*(local[a] for a in own[:-1]), own[-1]], strict=True):
                held.append(a)
        self.sizes = [len(a) for a in columns[0]]
        *by, uses = (np.concatenate(c) for c in columns)
        del columns
        sort, new = _sorted(by, len(words))
        at = np.flatnonzero(new[-1])
        self.of = np.empty(len(sort), np.int64)
        self.of[sort] = np.cumsum(new[-1]) - 1
        self.uses = np.add.reduceat(uses[sort], at) if len(at) else uses
        by = [w[sort[at]] for w in by]
        self.words, self.by = words, [by[-1], *by[:-1]]
        #: Ids of the histories: of no word, the one before, the two before and so on.
        self.history = [np.zeros(len(at), np.int64), *(np.cumsum(x[at]) - 1 for x in new[:-1])]
        del sort, new, uses
        self.hashes = [words[w] for w in self.by]
        self.asked = layout.levels(self.hashes)[0]
        #: Per order: whether the n-gram has all words, its id, a row with that id, its uses.
        self.full = [np.ones(len(at), bool), *(h != NONE for h in self.hashes[1:])]
        self.ids, self.firsts, self.counts = [], [], []
        for k in range(order):
            if k == order - 1:
                firsts = ids = np.arange(len(at))
            elif k:
                firsts, ids = _numbered(self.ids[-1], self.by[k])
            else:
                used = np.zeros(len(words), bool)
                used[self.by[0]] = True
                ids = (np.cumsum(used) - 1)[self.by[0]]
                firsts = np.empty(int(used.sum()), np.int64)
                firsts[ids] = np.arange(len(at))
            self.ids.append(ids)
            self.firsts.append(firsts)
            self.counts.append(np.bincount(ids, weights=self.uses, minlength=len(firsts)).astype(np.int64))


def _turns(layout: Layout, group: pa.Table) -> Iterator[tuple[_Turn, list[tuple[int, bytes]]]]:
    """The turns of a task one after another, with each text stretch's packed documents."""
    chunks, turns = group.column("chunk").to_pylist(), group.column("turn").to_pylist()
    bodies, docs = group.column("body"), group.column("docs")
    own = {c: unpacked(bodies[i].as_py())[0] for i, (c, t) in enumerate(zip(chunks, turns, strict=True)) if t == -1}
    if own:
        words = np.unique(np.concatenate(list(own.values())))
        places = {c: np.searchsorted(words, w) for c, w in own.items()}
        del own
    for turn in sorted({t for t in turns if t >= 0}):
        at = [i for i, t in enumerate(turns) if t == turn]
        yield _Turn(layout, words, [(places[chunks[i]], bodies[i].as_py()) for i in at]), [(chunks[i], docs[i].as_py()) for i in at]


def _summed(words: np.ndarray, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of word and place, by word and place, with their sums."""
    sort = np.lexsort((f, words))
    words, f, n = words[sort], f[sort], n[sort]
    new = np.ones(len(f), bool)
    new[1:] = (words[1:] != words[:-1]) | (f[1:] != f[:-1])
    at = np.flatnonzero(new)
    return words[at], f[at], np.add.reduceat(n, at) if len(at) else n


def _pairs(words: np.ndarray, f: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in the order of :func:`_summed`, packed."""
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    return packed(words[first], np.diff(np.append(first, len(words))), f, n)


def _unpaired(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, per, f, n = unpacked(body)
    return np.repeat(words, per.view(np.int64)), f.view(np.int64), n.view(np.int64)


def _ask(layout: Layout):
    """The function by which a task asks for the uses of what it shares with others, one row per task ``q`` that will know, and counts its own counts (rows with ``f`` below 0: minus the order)."""

    def ask(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        asks, of = [], np.zeros((layout.order + 1, 7), np.int64)
        for turn, _ in _turns(layout, group):
            for k in range(layout.order):
                at = turn.firsts[k]
                asked, full, c = turn.asked[k][at], turn.full[k][at], turn.counts[k]
                home = full & (asked < 0)
                of[k + 1] += np.bincount(np.minimum(c[home], 7), minlength=8)[:7]
                shared = full & (asked >= 0)
                asks.append(_summed(turn.hashes[0][at][shared], asked[shared], c[shared]))
            asks = [_summed(*(np.concatenate(x) for x in zip(*asks, strict=True)))]
        rows = []
        if asks:
            words, f, n = asks[0]
            q = (mix64(words ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(layout.parts)).astype(np.int64)
            for k in np.unique(q).tolist():
                own = q == k
                rows.append((int(layout.keys[k]), part, _pairs(words[own], f[own], n[own]), None, None, None))
        rows += [(int(layout.keys[part % layout.parts]), None, None, -k, r, int(of[k, r])) for k in range(1, layout.order + 1) for r in range(1, 7) if of[k, r]]
        return _table(rows, ("q", "part", "body", "f", "field", "n"))

    return ask


def _answer(layout: Layout):
    """The function that adds up what tasks ask for and answers each; of frequent histories (``f``) it gives sums, by ``field``.

    0: uses; 1 to 6: words used so often after it; 7: words; 11 to 15: words whose
    n-gram without the first word is used 1 to 5 times; 16: the uses of the others of these.
    """

    def answer(group: pa.Table) -> pa.Table:
        rows = [(None, None, f, field, n) for f, field, n in zip(*(group.column(c).to_pylist() for c in ("f", "field", "n")), strict=True) if f is not None]
        asks = [(p, *_unpaired(b)) for p, b in zip(group.column("part").to_pylist(), group.column("body").to_pylist(), strict=True) if b is not None]
        if asks:
            words, f, n = _summed(*(np.concatenate([a[k] for a in asks]) for k in (1, 2, 3)))
            names = np.unique(words)
            wide = len(layout.often) + 1
            key = np.searchsorted(names, words) * wide + f
            for part, w, g, _ in asks:
                rows.append((part, _pairs(w, g, n[np.searchsorted(key, np.searchsorted(names, w) * wide + g)]), None, None, None))
            parents = np.append(0, layout.parents)
            lower = np.where(f > 0, n[np.minimum(np.searchsorted(key, key - f + parents[f]), len(n) - 1)], 0)
            seen = n > 0
            f, n, lower = f[seen], n[seen], lower[seen]
            sums = np.zeros((17, wide), np.int64)
            for field, mask, x in ((0, n > 0, n), *((r, n == r, n * 0 + 1) for r in range(1, 7)), (7, n > 0, n * 0 + 1), *((10 + r, lower == r, n * 0 + 1) for r in range(1, 6)), (16, lower > 5, lower)):
                sums[field] = np.bincount(f[mask], weights=x[mask], minlength=wide)
            rows += [(None, None, int(g), int(field), int(sums[field, g])) for field, g in zip(*np.nonzero(sums), strict=True)]
        return _table(rows, ("part", "body", "f", "field", "n"))

    return answer


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"body": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds.get(n, pa.int64())) for i, n in enumerate(names)})


class _Totals:
    """What holds for the whole corpus: tokens, words, discounts per order, and of frequent histories their uses and backoff weights (log10)."""

    def __init__(self, layout: Layout, fields: list[dict]) -> None:
        wide = len(layout.often) + 1
        sums, of = np.zeros((17, wide)), np.zeros((layout.order + 1, 7))
        for x in fields:
            if x["f"] < 0:
                of[-x["f"], x["field"]] += x["n"]
            else:
                sums[x["field"], x["f"]] += x["n"]
        lengths, parents = np.append(0, layout.lengths), np.append(0, layout.parents)
        for k in range(1, layout.order + 1):
            of[k, 1:] += sums[1:7, lengths == k - 1].sum(axis=1)
        self.discounts = [np.ones(7), *(good_turing(of[k]) for k in range(1, layout.order + 1))]
        self.total, self.types = int(sums[0, 0]), int(sums[7, 0])
        r = np.arange(1, 6)
        d = self.discounts[1][1:6]
        kept = 1.0 - float(((1 - d) * r * of[1, 1:6]).sum()) / self.total if self.total else 0.0
        self.unseen = max(1.0 - kept, 1.0 / (self.total + 1))
        self.scale = (1.0 - self.unseen) / kept / self.total if kept else 0.0
        self.uses, self.weights = sums[0], np.zeros(wide)
        for f in range(1, wide):
            k = lengths[f] + 1
            seen = ((self.discounts[k][1:6] - 1) * r * sums[1:6, f]).sum() + sums[0, f]
            below = (self.discounts[k - 1][1:6] * r * sums[11:16, f]).sum() + sums[16, f]
            self.weights[f] = _weight(seen / (sums[0, f] + 1), below * self.scale if k == 2 else below / (sums[0, parents[f]] + 1))


def _weight(seen: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(1 - seen, 1e-12)) - np.log10(np.maximum(1 - below, 1e-12))


def _levels(turn: _Turn, totals: _Totals, known: tuple[np.ndarray, np.ndarray, np.ndarray], wide: int) -> list[tuple[np.ndarray, ...]]:
    """Per order and n-gram of a turn: its uses, its probability if used, its history's uses and backoff weight."""
    names, key, n = known
    word = np.searchsorted(names, turn.words)[turn.by[0]]
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(len(turn.by)):
        asked, full = turn.asked[k], turn.full[k]
        c = np.where(full, turn.counts[k][turn.ids[k]], 0)
        shared = full & (asked >= 0)
        c[shared] = n[np.searchsorted(key, word[shared] * wide + asked[shared])]
        d = totals.discounts[k + 1][np.minimum(c, 6)]
        if k == 0:
            out.append((c, d * c * totals.scale, c, np.zeros(len(c))))
            continue
        history = turn.history[k]
        size = int(history.max()) + 1 if len(history) else 0
        uses = np.bincount(history, weights=turn.uses * full, minlength=size)[history]
        uses = np.where(asked >= 0, totals.uses[asked], uses)
        p = d * c / (uses + 1)
        at = turn.firsts[k]
        at = at[c[at] > 0]
        seen, below = (np.bincount(history[at], weights=x[at], minlength=size)[history] for x in (p, out[-1][1]))
        out.append((c, p, uses, np.where(asked >= 0, totals.weights[asked], _weight(seen, below))))
    return out


def _told(group: pa.Table, layout: Layout) -> tuple[_Totals, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What a task was answered: the totals, and the uses of what it asked for."""
    fields = next(x for x in group.column("fields").to_pylist() if x is not None)
    told = [_unpaired(b) for b in group.column("body").to_pylist() if b is not None]
    words, f, n = _summed(*(np.concatenate(x) for x in zip(*told, strict=True))) if told else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    names = np.unique(words)
    return _Totals(layout, fields), (names, np.searchsorted(names, words) * (len(layout.often) + 1) + f, n)


def _score(layout: Layout, kept: list[str]):
    """The function by which a task scores its n-grams, summed by document (a row per stretch of texts); rows of documents pass."""

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        turns = np.array(group.column("turn").to_pylist() if group.num_rows else [], np.int64)
        passed = group.filter(pa.array(turns == -2)).select(["chunk", "at", "size", *kept])
        if not group.num_rows:
            return _sums([], passed, kept, 0)
        totals, known = _told(answers, layout)
        asks = {c: len(unpacked(b)[0]) for c, t, b in zip(group.column("chunk").to_pylist(), turns, group.column("docs").to_pylist(), strict=True) if t == -1}
        sums = {c: np.zeros((3, n)) for c, n in asks.items()}
        width = totals.total + 0.1 * (totals.types + 1)
        for turn, blocks in _turns(layout, group):
            levels = _levels(turn, totals, known, len(layout.often) + 1)
            p, found = np.zeros(len(turn.uses)), np.zeros(len(turn.uses), bool)
            for k in range(layout.order - 1, -1, -1):
                c, own, uses, weight = levels[k]
                own = np.where(c > 0, own, totals.unseen if k == 0 else 1.0)
                step = np.where((c > 0) | (k == 0), np.log10(own), np.where(turn.full[k] & (uses > 0), weight, 0.0))
                p += np.where(found, 0.0, step)
                found |= c > 0
            c = levels[0][0]
            values = (p, np.log10((c + 0.1) / width), (c > 0).astype(float))
            lo = 0
            for (chunk, docs), size in zip(blocks, turn.sizes, strict=True):
                per, of, n = (a.view(np.int64) for a in unpacked(docs))
                gram = np.repeat(turn.of[lo : lo + size], per)
                for s, v in zip(sums[chunk], values, strict=True):
                    s += np.bincount(of, weights=v[gram] * n, minlength=len(s))
                lo += size
        return _sums(list(sums.items()), passed, kept, totals.total)

    return score


def _sums(sums: list[tuple[int, np.ndarray]], passed: pa.Table, kept: list[str], total: int) -> pa.Table:
    """Rows of documents, and a packed row of the documents that have a sum for each stretch of texts."""
    rows = []
    for chunk, (p, base, n) in sums:
        at = np.flatnonzero((p != 0) | (base != 0) | (n != 0))
        if len(at):
            rows.append((chunk, packed(np.diff(at, prepend=0), p[at], base[at], n[at].astype(np.int64))))
    nothing = pa.nulls(len(rows), pa.int64())
    first = {"chunk": pa.array([r[0] for r in rows], pa.int64()), "at": nothing, "size": nothing, "total": nothing, "body": pa.array([r[1] for r in rows], pa.binary())}
    own = {"chunk": passed.column("chunk"), "at": passed.column("at"), "size": passed.column("size"), "total": pa.array(np.full(passed.num_rows, total)), "body": pa.nulls(passed.num_rows, pa.binary())}
    return pa.concat_tables([pa.table(own | {c: passed.column(c) for c in kept}), pa.table(first | {c: pa.nulls(len(rows), passed.schema.field(c).type) for c in kept})])


def _added(kept: list[str]):
    """The function that adds up the sums of a stretch of texts and gives a row per document."""

    def added(group: pa.Table) -> pa.Table:
        docs = group.filter(group.column("at").is_valid())
        at = docs.column("at").to_numpy()
        sums = np.zeros((3, int(at.max()) + 1 if len(at) else 0))
        for body in group.column("body").to_pylist():
            if body is not None:
                of, p, base, n = unpacked(body)
                of = np.cumsum(of.view(np.int64))
                sums[:, of] += np.stack([p.view(np.float64), base.view(np.float64), n.view(np.int64).astype(float)])
        p, base, n = sums[:, at]
        own = {c: docs.column(c) for c in kept} | {"n_tokens": docs.column("size"), "n_known": pa.array(n.astype(np.int64)), "train_tokens": docs.column("total"), "base_score": pa.array(base), "score": pa.array(p)}
        return pa.table(own)

    return added


def _dealt(rows: DataFrame, order: int, kept: list[str], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """N-grams of ``rows`` (columns ``__row, __learn, __ask, t`` and ``kept``) at their tasks, and what these are answered, with the totals."""
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    dealt = rows.mapInArrow(_spread(layout, kept), "part bigint, chunk bigint, turn bigint, body binary, docs binary, at bigint, size bigint" + kinds).repartition(layout.parts, "part")
    asked = dealt.groupBy("part").applyInArrow(_ask(layout), "q bigint, part bigint, body binary, f bigint, field bigint, n bigint")
    known = asked.repartition(layout.parts, "q").groupBy("q").applyInArrow(_answer(layout), "part bigint, body binary, f bigint, field bigint, n bigint")
    totals = known.where("f is not null").groupBy("f", "field").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("f", "field", "n")).alias("fields"))
    everywhere = totals.select(F.explode(F.array(*[F.lit(int(k)) for k in layout.keys]).cast("array<bigint>")).alias("part"), F.lit(None).cast("binary").alias("body"), "fields")
    told = known.where("body is not null").select("part", "body", F.lit(None).cast(everywhere.schema["fields"].dataType).alias("fields"))
    return dealt, told.unionByName(everywhere).repartition(layout.parts, "part")


def _scored(rows: DataFrame, order: int, kept: list[str]) -> DataFrame:
    small_batches(rows)
    layout = _layout(rows, order)
    dealt, told = _dealt(rows, order, kept, layout)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    sums = dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_score(layout, kept), "chunk bigint, at bigint, size bigint, total bigint, body binary" + kinds)
    return sums.groupBy("chunk").applyInArrow(_added(kept), kinds[2:] + ", " * bool(kept) + "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


@dataclass(frozen=True)
class KatzModel:
    """The training texts (column ``t``) and the order. N-grams are counted where they are used: by :func:`score` beside the texts it scores, and for ``grams``."""

    order: int
    docs: DataFrame

    @property
    def grams(self) -> dict[int, DataFrame]:
        """Per order all n-grams: hashes of their words, the first one first, their count ``__c`` and probability ``__p``."""
        return {k: self._grams(k) for k in range(1, self.order + 1)}

    def _grams(self, order: int) -> DataFrame:
        rows = self.docs.select(F.monotonically_increasing_id().alias("__row"), F.lit(True).alias("__learn"), F.lit(False).alias("__ask"), "t")
        small_batches(rows)
        layout = _layout(rows, order)
        dealt, told = _dealt(rows, order, [], layout)
        names = [*(f"__w{k}" for k in range(order, 0, -1)), "__c", "__p"]

        def seen(group: pa.Table, answers: pa.Table) -> pa.Table:
            totals, known = _told(answers, layout)
            out = [[np.zeros(0, np.int64)] * (order + 1) + [np.zeros(0)]]
            for turn, _ in _turns(layout, group) if group.num_rows else ():
                c, p = _levels(turn, totals, known, len(layout.often) + 1)[-1][:2]
                out.append([*(h[c > 0].view(np.int64) for h in turn.hashes[::-1]), c[c > 0], p[c > 0]])
            return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(names, zip(*out, strict=True), strict=True)})

        kinds = ", ".join(f"`{n}` {'double' if n == '__p' else 'bigint'}" for n in names)
        found = dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(seen, kinds)
        return found.dropDuplicates(names[:order])  # n-grams of frequent histories are at several tasks


def fit(docs: DataFrame, text: str = "text", order: int = 3) -> KatzModel:
    """A model of ``docs``. Null texts count as empty (an end only); repeated rows each count."""
    return KatzModel(order, docs.select(F.col(text).alias("t")))


def _keeping(docs: DataFrame, text: str, keep: dict[str, str | Column], learn: Column) -> DataFrame:
    own = [(F.col(c) if isinstance(c, str) else c).alias(f"__k{i}") for i, c in enumerate(keep.values())]
    return docs.select(F.monotonically_increasing_id().alias("__row"), learn.alias("__learn"), F.lit(True).alias("__ask"), *own, F.col(text).alias("t"))


def score(docs: DataFrame, model: KatzModel, text: str = "text", keep: dict[str, str | Column] | None = None) -> DataFrame:
    """The columns ``keep``, then ``n_tokens, n_known, train_tokens, base_score, score`` of each document.

    A null or empty text has one token, its end. Repeated rows are scored one
    by one; null keys are columns like others; an empty table gives an empty
    table, and with no training text each token has the probability of an
    unseen word. Texts of any length are taken whole; the names of columns
    that are kept can't clash with others.
    """
    keep = keep or {}
    rows = _keeping(docs, text, keep, F.lit(False))
    learnt = model.docs.select((-1 - F.monotonically_increasing_id()).alias("__row"), F.lit(True).alias("__learn"), F.lit(False).alias("__ask"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name.startswith("__k")], "t")
    return _named(_scored(rows.unionByName(learnt), model.order, [f"__k{i}" for i in range(len(keep))]), keep)


def fit_and_score(docs: DataFrame, learn: Column, text: str = "text", order: int = 3, keep: dict[str, str | Column] | None = None) -> DataFrame:
    """As :func:`score` of all ``docs`` by the model of those where ``learn`` holds; texts are cut into n-grams once."""
    keep = keep or {}
    return _named(_scored(_keeping(docs, text, keep, learn), order, [f"__k{i}" for i in range(len(keep))]), keep)


def _named(scored: DataFrame, keep: dict[str, str | Column]) -> DataFrame:
    return scored.toDF(*keep, *scored.columns[len(keep) :])


def op7_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those with crc32(doc_id) mod 10 other than 0; cases as of :func:`score`."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of("doc_id") % 10 == 0, F.lit(False))
    return fit_and_score(docs, ~held_out, keep={"doc_id": "doc_id", "held_out": held_out})
