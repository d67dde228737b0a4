"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature in turn gets one shallow tree,
fitted to the present residuals over the feature's bins. The trees of a feature
add up to one lookup table. When the features are done, the pairs whose
two-way tables explain most of what is left are boosted the same way. A score
is a sum of table entries, so scoring is a few vectorised lookups per row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import checked, column_texts, crc_of, share_of_hash, small_batches, table

FEATURES = ("log_bytes", "log_words", "word_length", "letters", "upper", "digits", "symbols", "stops", "shouts", "beyond_ascii", "distinct_words", "top_word", "dup_lines", "log_line_words")
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:", b"!?"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 7


def features(text: str) -> list[float]:
    """Statistics of one whole text, all 0 for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    of = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)
    held, n = len(data), len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        np.log1p(held),
        np.log1p(n),
        sum(map(len, words)) / n,
        (of[1] + of[2] + of[7]) / held,
        of[2] / held,
        of[3] / held,
        of[4] / held,
        of[5] / n,
        of[6] / n,
        of[7] / held,
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    ]


@dataclass(frozen=True)
class AdditiveModel:
    """``edges[f]``: bin borders; ``tables[f]``: value per bin; ``pairs``: (f, g, table over coarse bins)."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (borders, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(borders, x[:, f], side="right")]
        for f, g, values in self.pairs:
            total += values[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1.0 / (1.0 + np.exp(-total))


def _borders(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _cut(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[int, float]:
    """Best border of a histogram by Newton gain: bins below it go left; gain 0: none."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
    if not len(gain):
        return 0, 0.0
    at = int(gain.argmax())
    return at + 1, max(0.0, float(gain[at]))


def shallow_tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree over ordered bins, as one value per bin."""
    at, gain = _cut(grad, hess, ridge) if depth else (0, 0.0)
    if gain <= 1e-12:
        return np.full(len(grad), grad.sum() / (hess.sum() + ridge))
    return np.concatenate([shallow_tree(grad[:at], hess[:at], depth - 1, ridge), shallow_tree(grad[at:], hess[at:], depth - 1, ridge)])


def pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of depth two over a two-way histogram: a cut of one feature, then one of the other on each side."""
    best, out = -1.0, np.zeros_like(grad)
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        for at in range(1, g.shape[0]):
            parts, gain = [], 0.0
            for lo, hi in ((0, at), (at, g.shape[0])):
                gs, hs = g[lo:hi].sum(0), h[lo:hi].sum(0)
                cut, more = _cut(gs, hs, ridge)
                gain += more + gs.sum() ** 2 / (hs.sum() + ridge)
                cut = cut or g.shape[1]
                row = np.concatenate([np.full(e - s, gs[s:e].sum() / (hs[s:e].sum() + ridge)) for s, e in ((0, cut), (cut, g.shape[1])) if e > s])
                parts.append(np.tile(row, (hi - lo, 1)))
            if gain > best:
                best, out = gain, np.vstack(parts).T if turned else np.vstack(parts)
    return out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 50, most_pairs: int = 6, rate: float = 0.15, depth: int = 2, ridge: float = 1.0) -> AdditiveModel:
    """Boost the tables on rows ``x`` with 0/1 labels ``y`` (no row: score 0.5 for all)."""
    width = len(FEATURES)
    if not len(y):
        return AdditiveModel(0.0, (np.zeros(0),) * width, (np.zeros(1),) * width, (np.zeros(0),) * width, ())
    mean = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(mean / (1 - mean)))
    edges = tuple(_borders(x[:, f], bins) for f in range(x.shape[1]))
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)
    for _ in range(rounds):
        for f, where in enumerate(at):
            p = 1.0 / (1.0 + np.exp(-total))
            grad, hess = (np.bincount(where, weights=w, minlength=len(tables[f])) for w in (y - p, p * (1 - p)))
            step = rate * shallow_tree(grad, hess, depth, ridge)
            tables[f] += step
            total += step[where]
    coarse = tuple(_borders(x[:, f], coarse_bins) for f in range(x.shape[1]))
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    shapes = {(f, g): (len(coarse[f]) + 1, len(coarse[g]) + 1) for f, g in combinations(range(x.shape[1]), 2)}

    def histograms(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        where = low[f] * shapes[f, g][1] + low[g]
        a, b = (np.bincount(where, weights=w, minlength=shapes[f, g][0] * shapes[f, g][1]).reshape(shapes[f, g]) for w in (y - p, p * (1 - p)))
        return a, b

    gains = {}
    for f, g in shapes:
        grad, hess = histograms(f, g)
        gains[f, g] = float((grad**2 / (hess + ridge)).sum())
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:most_pairs]
    values = {k: np.zeros(shapes[k]) for k in chosen}
    for _ in range(pair_rounds):
        for f, g in chosen:
            step = rate * pair_tree(*histograms(f, g), ridge)
            values[f, g] += step
            total += step[low[f], low[g]]
    return AdditiveModel(intercept, edges, tuple(tables), coarse, tuple((f, g, values[f, g]) for f, g in chosen))


def _feature_rows(column: pa.Array) -> np.ndarray:
    rows = [features(t) for t in column_texts(column)]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most_rows: int = 20_000) -> AdditiveModel:
    """Fit on about ``most_rows`` labelled documents at most, picked by a hash of ``key``.

    Rows whose key or label is null teach nothing; repeated labels each count;
    without any label all scores are 0.5. The driver gets that many short
    feature vectors, not texts.
    """
    small_batches(docs)
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where("k is not null and y is not null")
    share = min(1.0, most_rows / max(1, marked.count()))
    marked = marked.where(share_of_hash(F.col("k")) < F.lit(share))
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(checked(marked), "k").select("t", "y").repartition(8)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _feature_rows(batch.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    found = known.mapInArrow(measured, "x array<double>, y double").toPandas()
    order = sorted(range(len(found)), key=lambda i: (found["y"][i], tuple(found["x"][i])))  # as rows come in any order
    x = np.array([found["x"][i] for i in order], float).reshape(len(found), len(FEATURES))
    return fit_additive(x, found["y"].to_numpy()[order])


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", keep: dict[str, str | Column] | None = None) -> DataFrame:
    """The columns ``keep`` (name: column) and ``score`` of each document.

    A null text counts as empty; an empty one has all features 0 and a score
    like any other; texts of any length are taken whole; repeated rows and null
    keys are rows like others; an empty table gives an empty table; other
    columns are not looked at.
    """
    keep = keep or {}
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast((model.intercept, model.edges, model.tables, model.coarse, model.pairs))
    rows = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in keep.items()], F.col(text).alias("__text"))
    names = [*keep, "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AdditiveModel(*held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.scores(_feature_rows(batch.column("__text"))), pa.float64())], names)

    return rows.mapInArrow(scored, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"]))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of those with crc32(doc_id) mod 5 = 0 are held out (a null id is not). Cases as of :func:`score`."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_of("doc_id") % 5 != 0))
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    scored = score(docs, model, keep={"doc_id": "doc_id", "held_out": held_out})
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
