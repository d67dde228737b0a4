"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

The benchmark is the query set; it is taken in blocks of a bounded number of
words, and each block meets all documents: in a first pass to count in how many
documents each of its words occurs, in a second one to find candidates and to
align them.

No candidate is lost. An alignment that reaches the least score matches at
least a certain number of an item's words, so it matches some of the item's
rarest ones: as many as all of them that it cannot do without. Documents
with that many are looked at word by word (:meth:`Group.windows`), and the ranges
that can reach the score at all are aligned. Words that occur in no document
can be among the rare ones, as the number needed allows for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import column_texts, native_words, small_batches, table

#: Items of fewer words match nothing; items that are looked up at once, and words of documents.
LEAST_WORDS, GROUP_ITEMS, CHUNK_WORDS = 3, 256, 1 << 14
_STRIP = ".,;:!?\"'()[]«»"
HIT = "array<struct<item_id:{item},score:double,start_word:int,end_word:int,passage:string>>"


def words_of(text: str) -> list[str]:
    """Lower-case words without the punctuation around them."""
    return [w.strip(_STRIP) for w in text.lower().split()]


class Group:
    """Some items of a block: which of them each word leads to, and what a passage of them needs at least."""

    def __init__(self, block: Block, seen: np.ndarray, first: int, last: int, least_score: float) -> None:
        self.first, self.size = first, last - first
        entries, rare, self.least, self.hits = [], [], [], []
        for i, words in enumerate(block.words[first:last]):
            n = len(words)
            least = max(1, math.ceil(least_score * 2 * n - 1e-9))
            matches = -(-least // 2)
            hits = -(-matches // 2)
            own = np.unique(words)
            entries.append(own * self.size + i)
            rare.append(np.unique(words[np.argsort(seen[words], kind="stable")[: n - matches + hits]]) * self.size + i)
            self.least.append(least)
            self.hits.append(hits)
        ids, at, few = np.arange(len(block.vocabulary) + 1) * self.size, np.sort(np.concatenate(entries)), np.sort(np.concatenate(rare))
        self.items, self.starts = at % self.size, np.searchsorted(at, ids)
        self.rare, self.rare_starts = few % self.size, np.searchsorted(few, ids)
        self.least, self.hits = np.array(self.least), np.array(self.hits)

    def entries(self, words: np.ndarray, doc: np.ndarray, at: np.ndarray, starts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the words at ``at`` and each item that they lead to: the place, and one number for document and item."""
        begin = starts[words[at]]
        n = starts[words[at] + 1] - begin
        entry = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        return np.repeat(at, n), np.repeat(doc[at] * self.size, n) + items[entry]

    def windows(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, begin and end of all ranges of ``words`` in which an item may reach its least score.

        ``doc`` has the document of each word. No alignment scores more than
        the sum of 2 for each word that the item has and -1 for each other
        one, so it lies where the best such sum stays above 0.
        """
        docs, bits = int(doc[-1]) + 1 if len(doc) else 0, len(words).bit_length()
        at = np.flatnonzero(words >= 0)
        where, pair = self.entries(words, doc, at, self.rare_starts, self.rare)
        may = np.bincount(pair, minlength=docs * self.size) >= np.tile(self.hits, docs)
        where, pair = self.entries(words, doc, at[may.reshape(docs, self.size).any(1)[doc[at]]], self.starts, self.items)
        kept = may[pair]
        order = np.sort((pair[kept] << bits) | where[kept])
        pair, where = order >> bits, order & ((1 << bits) - 1)
        if not len(pair):
            return pair, pair, pair
        changed = np.concatenate(([False], pair[1:] != pair[:-1]))
        sums = 3 * np.arange(len(pair)) - where - np.cumsum(changed) * (4 * (len(pair) + len(words)))
        low = np.minimum.accumulate(sums)
        starts = np.flatnonzero(np.concatenate(([True], low[1:] < low[:-1])))
        item = pair[starts] % self.size
        good = np.maximum.reduceat(sums - low + 2, starts) >= self.least[item]
        ends = np.append(starts[1:], len(pair)) - 1
        return self.first + item[good], where[starts[good]], where[ends[good]] + 1


class Block:
    """Items of a benchmark as word numbers."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.keys, self.words = [], []
        for key, text in items:
            words = words_of(text or "")
            if len(words) >= LEAST_WORDS:
                self.keys.append(key)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def groups(self, seen: np.ndarray, least_score: float) -> list[Group]:
        """The items by ``GROUP_ITEMS``; ``seen`` has the number of documents with each word."""
        return [Group(self, seen, i, min(i + GROUP_ITEMS, len(self.words)), least_score) for i in range(0, len(self.words), GROUP_ITEMS)]


def align(item: np.ndarray, words: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and where in ``words`` it ends (exclusive)."""
    at = np.arange(len(words) + 1, dtype=np.int64) * -gap
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for w in item:
        now = np.maximum(row + gap, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(words == w, match, mismatch))
        row = np.maximum.accumulate(now + at) - at  # gaps along the document
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def best_scores(item: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman score of an item with each of the ranges of ``words`` that begin at ``starts``."""
    item, words = item.astype(np.int32), words.astype(np.int32)
    apart = np.zeros(len(words), np.int32)
    apart[starts] = 2 * len(item) + 2
    at = np.arange(len(words), dtype=np.int32) + np.cumsum(apart, dtype=np.int32)  # gaps never reach another range
    row, best, before = (np.zeros(len(words), np.int32) for _ in range(3))
    for w in item:
        before[1:] = row[:-1]
        before[starts] = 0
        now = np.maximum(np.maximum(row - 1, 0), before + np.where(words == w, np.int32(2), np.int32(-1)))
        row = np.maximum.accumulate(now + at) - at
        np.maximum(best, row, out=best)
    return np.maximum.reduceat(best, starts)


def hits_of(block: Block, groups: list[Group], texts: list[str], least_score: float) -> list[list[dict]]:
    """For each text the items whose best alignment with a passage of it reaches ``least_score`` of a perfect one."""
    numbers = [block.numbers(t) for t in texts]
    places: dict[int, list[tuple[int, int, int]]] = {}
    lo = 0
    while lo < len(numbers):
        hi, size = lo + 1, len(numbers[lo])
        while hi < len(numbers) and size + len(numbers[hi]) <= CHUNK_WORDS:
            size += len(numbers[hi])
            hi += 1
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in numbers[lo:hi]])))
        words, doc = np.concatenate(numbers[lo:hi]), np.repeat(np.arange(hi - lo), np.diff(offsets))
        for group in groups:
            items, begin, end = group.windows(words, doc)
            own = doc[begin]
            for i, d, a, b in zip(items.tolist(), (own + lo).tolist(), (begin - offsets[own]).tolist(), (end - offsets[own]).tolist(), strict=True):
                places.setdefault(i, []).append((d, a, b))
        lo = hi
    out: list[list[dict]] = [[] for _ in texts]
    for i, ranges in places.items():
        item, best = block.words[i], {}
        starts = np.cumsum([0, *[b - a for _, a, b in ranges[:-1]]])
        scores = best_scores(item, np.concatenate([numbers[d][a:b] for d, a, b in ranges]), starts) / (2 * len(item))
        for (d, a, b), share in zip(ranges, scores.tolist(), strict=True):
            if share >= least_score and share > best.get(d, (0.0,))[0]:
                best[d] = (share, a, b)
        for d, (share, a, b) in best.items():
            _, end = align(item, numbers[d][a:b])
            _, back = align(item[::-1], numbers[d][a : a + end][::-1])
            start, end = a + end - back, a + end
            out[d].append({"item_id": block.keys[i], "score": share, "start_word": start, "end_word": end, "passage": " ".join(texts[d].split()[start:end])})
    return [sorted(found, key=lambda h: (-h["score"], str(h["item_id"]))) for found in out]


def blocks(benchmark: DataFrame, text: str, item: str, block_words: int) -> Iterator[Block]:
    """The benchmark in parts of about ``block_words`` words at most."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.size(native_words(F.col("t"))))).first()[0] or 0
    parts = -(-total // block_words)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        yield Block(sorted(((r["i"], r["t"]) for r in own.distinct().collect()), key=lambda r: (str(r[0]), r[1])))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: dict[str, str | Column] | None = None, bench_text: str = "text", item: str = "item_id", least_score: float = 0.5, block_words: int = 1_000_000, text_as: str | None = None) -> DataFrame:
    """The columns ``keep`` (name: column) of every document, its text as ``text_as`` if that is given, and ``hits``.

    ``hits`` lists the benchmark items found, best first: item, share of the
    perfect alignment score, the passage's words (``[start_word, end_word)``)
    and its text. A null or empty text has none; an item of fewer than three
    words, or null, matches nothing; repeated rows of an item count once.
    """
    keep = keep or {}
    kind = benchmark.schema[item].dataType.simpleString()
    rows = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    small_batches(docs)
    rows = rows.withColumn("hits", F.array().cast(HIT.format(item=kind)))
    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark, bench_text, item, block_words):
        held = sc.broadcast((block.vocabulary, block.keys, block.words))

        def counted(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = _unpacked(held.value)
            total = np.zeros(len(own.vocabulary) + 1, np.int64)
            for batch in batches:
                for t in column_texts(batch.column("t")):
                    total[np.unique(own.numbers(t))] += 1  # the last one: words of no item
            at = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["s", "n"])

        found = docs.select(F.col(text).alias("t")).mapInArrow(counted, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
        seen = np.zeros(len(block.vocabulary), np.int64)
        seen[found["s"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        groups = sc.broadcast([vars(g) for g in block.groups(seen, least_score)])
        schema = rows.schema

        def matched(batches: Iterator[pa.RecordBatch], held=held, groups=groups) -> Iterator[pa.RecordBatch]:
            own, parts = _unpacked(held.value), []
            for made in groups.value:
                parts.append(Group.__new__(Group))
                vars(parts[-1]).update(made)
            for batch in batches:
                old = batch.column("hits")
                found = hits_of(own, parts, column_texts(batch.column("__text")), least_score)
                if len(old.flatten()):  # of earlier blocks
                    found = [[*x, *y] for x, y in zip(old.to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, old.type)], schema=batch.schema)

        rows = rows.mapInArrow(matched, schema)
    return rows.drop("__text") if text_as is None else rows.withColumnRenamed("__text", text_as)


def _unpacked(held: tuple) -> Block:
    block = Block([])
    block.vocabulary, block.keys, block.words = held
    return block


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it; cases as of :func:`contamination`. Repeated documents each have their rows."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep={"doc_id": "doc_id"})
    hit = found.select("doc_id", F.explode("hits").alias("h"))
    return hit.select("doc_id", "h.item_id", F.round("h.score", 6).alias("score"), "h.start_word", "h.end_word", "h.passage")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark passage; the columns, whatever their names, stay as they are.

    Null and empty texts stay; without any item everything stays; repeated rows
    stay or go together.
    """
    names = docs.columns
    rows = contamination(docs, benchmark, keep={f"c{i}": F.col(f"`{c}`") for i, c in enumerate(names) if c != "text"}, text_as=f"c{names.index('text')}")
    return rows.where(F.size("hits") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
