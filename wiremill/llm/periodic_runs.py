"""Maximal runs of repeating words in each text, by a suffix automaton with link-cut access.

The automaton of a word sequence has a state per class of substrings that end at
the same places; suffix links make a tree of the states. Each word of the
sequence is appended in turn: the path from its prefix's state to the root holds
all substrings that end there, and the end is recorded on all of them. Paths are
kept as in a link-cut tree, as splay trees of stretches with one last end each,
so an access meets a few stretches instead of all states. A stretch with last
end ``f`` whose deepest substring has ``m`` words says that the ``m`` words
before ``f`` and before the new end ``e`` are equal: if ``e - f <= m``, the
``m + e - f`` words up to ``e`` are a repetition with that period, a square at
least. The last end makes the period the smallest, the deepest substring makes
the start maximal, and the last ``e`` that reports a start and period is the
run's end.

Texts are first narrowed down in numpy, exactly: in a run of three periods and
``least_words`` words or more, every sequence of ``_GRAM`` words recurs within a
third of the run. Stretches of such places are all that enters an automaton;
hashes stand for words there only, where a clash adds a stretch but loses none.

Nulls, empty and very long texts, ties, repeats: a null or empty text has no
runs; a text is taken whole by one task (its memory follows the longest stretch
that may repeat); of equally strong runs the first by start, then by period,
counts as strongest; repeated rows are judged one by one; an empty table gives
an empty table; columns that are kept can't clash with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import crc_of, mix64, native_words, small_batches, table

#: Words per sequence that recurs in a run: at most ``least_words - 2 q + 1`` or ``q + 1`` for every period ``q``.
_GRAM = 8
_CHUNK_WORDS = 1 << 20
_BUCKETS = 22


class Automaton:
    """Suffix automaton of a sequence of small integers: ``length`` and ``link`` of each state, state 0 the root."""

    def __init__(self, word_ids: list[int]) -> None:
        self.length, self.link = [0], [-1]
        self.prefixes: list[int] = []
        moves: list[dict[int, int]] = [{}]
        length, link = self.length, self.link
        last = 0
        for w in word_ids:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            at = last
            while at >= 0 and w not in moves[at]:
                moves[at][w] = new
                at = link[at]
            if at >= 0:
                target = moves[at][w]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    split = len(length)
                    length.append(length[at] + 1)
                    link.append(link[target])
                    moves.append(moves[target].copy())
                    link[target] = link[new] = split
                    while at >= 0 and moves[at].get(w) == target:
                        moves[at][w] = split
                        at = link[at]
            last = new
            self.prefixes.append(new)


class LastEnds:
    """Paths of a rooted tree as splay trees, each with the one end that was last recorded on it.

    ``up`` is a node's parent in its splay tree, or where it is a splay root
    the tree parent of its path's top. ``end`` is held by splay roots only.
    """

    def __init__(self, parents: list[int]) -> None:
        self.up = list(parents)
        self.low, self.high = [-1] * len(parents), [-1] * len(parents)
        self.end = [-1] * len(parents)

    def _is_root(self, x: int) -> bool:
        p = self.up[x]
        return p < 0 or (self.low[p] != x and self.high[p] != x)

    def _rotate(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        p = up[x]
        g = up[p]
        if low[p] == x:
            inner = low[p] = high[x]
            high[x] = p
        else:
            inner = high[p] = low[x]
            low[x] = p
        if inner >= 0:
            up[inner] = p
        up[p], up[x] = x, g
        if g >= 0:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x

    def splay(self, x: int) -> None:
        up, low = self.up, self.low
        top = x
        while not self._is_root(top):
            top = up[top]
        end = self.end[top]
        while not self._is_root(x):
            p = up[x]
            if not self._is_root(p):
                self._rotate(p if (low[up[p]] == p) == (low[p] == x) else x)
            self._rotate(x)
        self.end[x] = end

    def access(self, x: int, end: int) -> list[tuple[int, int]]:
        """Record ``end`` on the path from ``x`` to the root; the stretches met, as (deepest node, end before), deepest first."""
        met, below, at = [], -1, x
        while at >= 0:
            self.splay(at)
            if self.end[at] >= 0:
                met.append((at, self.end[at]))
            rest = self.high[at]
            if rest >= 0:
                self.end[rest] = self.end[at]
            self.high[at] = below
            below = at
            at = self.up[at]
        self.splay(x)
        self.end[x] = end
        return met


def repetitions(words: list[bytes], least_words: int = 24, least_periods: int = 3) -> list[tuple[int, int, int]]:
    """Runs of a sequence as (start, length, period), by start, then period."""
    ids: dict[bytes, int] = {}
    automaton = Automaton([ids.setdefault(w, len(ids)) for w in words])
    length = automaton.length
    paths = LastEnds(automaton.link)
    ends: dict[tuple[int, int], int] = {}
    for e, state in enumerate(automaton.prefixes, 1):
        for node, before in paths.access(state, e):
            period, equal = e - before, length[node]
            if (least_periods - 1) * period <= equal and equal + period >= least_words:
                ends[e - equal - period, period] = e
    return sorted((start, e - start, period) for (start, period), e in ends.items())


def _nearest(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each place the distance to the nearest equal sequence of ``_GRAM`` words in the same text; a huge number if none."""
    far = np.full(len(hashes), np.iinfo(np.int64).max)
    m = len(hashes) - _GRAM + 1
    if m < 2:
        return far
    g, step = hashes.view(np.uint64), 1
    with np.errstate(over="ignore"):
        while step < _GRAM:
            g = mix64(g[:-step] * np.uint64(0x9E3779B97F4A7C15) + g[step:])
            step *= 2
        g = mix64(g + of[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    inside = of[:m] == of[_GRAM - 1 :]
    bucket = (g >> np.uint64(64 - _BUCKETS)).view(np.int64)
    places = np.flatnonzero(inside & (np.bincount(bucket[inside], minlength=1 << _BUCKETS)[bucket] > 1))  # the others are alone
    places = places[np.argsort(g[places], kind="stable")]
    same = g[places[1:]] == g[places[:-1]]
    gap = np.where(same, places[1:] - places[:-1], far[0])
    far[places[:-1]] = gap
    far[places[1:]] = np.minimum(far[places[1:]], gap)
    return far


def candidates(hashes: np.ndarray, of: np.ndarray, least_words: int, least_periods: int) -> list[tuple[int, int]]:
    """Ranges of places that hold all runs, found by recurring sequences; no run crosses a border."""
    near = _nearest(hashes, of)
    places = np.flatnonzero(near <= len(hashes) // least_periods)
    while len(places):
        cut = np.flatnonzero((np.diff(places) > 1) | (of[places[1:]] != of[places[:-1]])) + 1
        bounds = np.concatenate([[0], cut, [len(places)]])
        sizes = np.diff(bounds)
        n_words = np.repeat(sizes + _GRAM - 1, sizes)
        good = (n_words >= least_words) & (near[places] * least_periods <= n_words)
        if good.all():
            return [(int(places[a]), int(places[b - 1]) + _GRAM) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        places = places[good]
    return []


def runs_of(texts: list[list[bytes]], least_words: int = 24, least_periods: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, narrowed down together first."""
    if least_periods < 3 or least_words < 3 * _GRAM:
        return [repetitions(t, least_words, least_periods) for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= least_words]
    if not long:
        return out
    hashes = np.concatenate([np.fromiter(map(hash, texts[i]), np.int64, len(texts[i])) for i in long])
    sizes = np.array([len(texts[i]) for i in long])
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(long)), sizes)
    for a, b in candidates(hashes, of, least_words, least_periods):
        i, first = long[of[a]], a - int(starts[of[a]])
        out[i] += [(first + s, n, q) for s, n, q in repetitions(texts[i][first : first + b - a], least_words, least_periods)]
    return out


def strongest(runs: list[tuple[int, int, int]]) -> int | None:
    """Index of the run with most periods, exactly compared; the first by start, then period, of equals."""
    best = None
    for i, (_, n, q) in enumerate(runs):
        if best is None or n * runs[best][2] > runs[best][1] * q:
            best = i
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single spaces, of each run its first period only."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, n, q in runs:
        keep[start + q : start + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _grouped(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _CHUNK_WORDS:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def periodic_runs(docs: DataFrame, text: str = "text", least_words: int = 24, least_periods: int = 3, keep: dict[str, str | Column] | None = None) -> DataFrame:
    """The columns ``keep``, then ``runs`` (start, length, period in words, by start and period), ``strongest`` (one of them or null) and ``collapsed`` (the text with the first period of each run).

    Words are ``[^\\x20\\x09-\\x0D]+``; cases as of the module.
    """
    keep = keep or {}
    small_batches(docs)
    kept = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in zip(kept, keep.values(), strict=True)], F.col(text).cast("binary").alias("t"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    spelt = "struct<start: bigint, length: bigint, period: bigint>"
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    names = ["start", "length", "period"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column("t").to_pylist()]
            for a, b in _grouped(texts):
                found = runs_of(texts[a:b], least_words, least_periods)
                best = [strongest(r) for r in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(a, b - a).columns[:-1],
                        pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in found], pa.list_(run)),
                        pa.array([None if i is None else dict(zip(names, r[i], strict=True)) for r, i in zip(found, best, strict=True)], run),
                        pa.array([collapsed(t, r) for t, r in zip(texts[a:b], found, strict=True)], pa.binary()),
                    ],
                    [*kept, "runs", "strongest", "collapsed"],
                )

    found = rows.mapInArrow(find, ", ".join([*kinds, f"runs array<{spelt}>", f"strongest {spelt}", "collapsed binary"]))
    return found.select(*[F.col(k).alias(n) for k, n in zip(kept, keep, strict=True)], "runs", "strongest", F.col("collapsed").cast("string").alias("collapsed"))


def with_planted_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every tenth text (by its key's CRC-32) repeating a stretch of its words up to its end, as the query's contract has it; a null key plants nothing."""
    h = crc_of(key)
    words = native_words(F.col(text))
    n = F.size("__w")
    g = F.floor(h / 10)
    rows = docs.withColumn("__w", F.when(h % 10 == 0, words))
    a = (g % n).cast("int")
    p = 1 + F.floor((n - F.col("__a")) / (3 + g % 8)).cast("int")
    rows = rows.withColumn("__a", F.when(n > 0, a)).withColumn("__p", p)
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil((n - F.col("__a")) / F.col("__p")).cast("int"))), 1, n - F.col("__a"))
    planted = F.concat_ws(" ", F.slice("__w", 1, F.col("__a")), tail)
    return rows.withColumn(text, F.when(F.col("__a").isNotNull(), planted).otherwise(F.col(text))).select(*docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents after every tenth was planted with one: digests of :func:`periodic_runs`; a null text has no words and no runs."""
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs, keep={"doc_id": "doc_id"})
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
