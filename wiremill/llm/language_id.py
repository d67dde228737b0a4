"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import chunks, column_texts, crc_of, share_of_hash, small_batches, table

UNKNOWN = "und"
_CHUNK = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """``log_probs[l, b]``: log P(bucket b | language l); the last bucket stands for "no n-gram"."""

    langs: tuple[str, ...]
    log_priors: np.ndarray
    log_probs: np.ndarray
    orders: tuple[int, ...]
    bits: int


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one run of code points, each ended by a 0, and where each starts."""
    flat = np.frombuffer("".join(t.lower() + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    return flat, np.concatenate(([0], np.cumsum(sizes)[:-1]))


def buckets(flat: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram at each position, 2**bits where it would reach over a text's end."""
    n = len(flat) - order + 1
    out = np.full(len(flat), 1 << bits, np.uint32)
    if n <= 0:
        return out
    hashed, ended = np.full(n, order, np.uint32), np.zeros(n, bool)
    for k in range(order):
        part = flat[k : k + n]
        hashed = (hashed ^ part) * np.uint32(0x01000193)
        hashed ^= hashed >> np.uint32(15)
        ended |= part == 0
    hashed = (hashed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    out[:n] = np.where(ended, np.uint32(1 << bits), hashed)
    return out


def log_likelihoods(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Row per text, column per language."""
    flat, starts = code_points(texts)
    out = np.tile(model.log_priors, (len(texts), 1))
    for order in model.orders:
        at = buckets(flat, order, model.bits)
        for k in range(len(model.langs)):
            out[:, k] += np.add.reduceat(model.log_probs[k].take(at).astype(np.float64), starts)
    return out


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and their posterior probabilities; ``und`` and 0 where a text has no letter."""
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo, hi in chunks(texts, _CHUNK):
        x = log_likelihoods(model, texts[lo:hi])
        best[lo:hi] = x.argmax(1)
        score[lo:hi] = 1.0 / np.exp(x - x.max(1, keepdims=True)).sum(1)
    known = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 16,
    docs_per_language: int = 4000,
    smoothing: float = 0.1,
) -> LanguageModel:
    """Learn from ``text`` and ``lang``; rows without a language or a text teach nothing.

    A language gives about ``docs_per_language`` documents at most, picked by a
    hash of ``key`` (which is used for nothing else); the priors come from all
    rows. What reaches the driver are counts, at most 2**bits a language. With
    no labelled row at all the model has no language and predicts ``und``.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).where("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return LanguageModel((), np.zeros(0), np.zeros((0, (1 << bits) + 1), np.float32), orders, bits)
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, docs_per_language / sizes[name]))])
    sample = rows.where(share_of_hash(F.col("k")) < share[F.col("l")]).select("l", "t").repartition(8)
    where = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = column_texts(batch.column("t")), batch.column("l").to_pylist()
            for name in set(names):
                own = [t for t, x in zip(texts, names, strict=True) if x == name]
                total = held.setdefault(name, np.zeros((1 << bits) + 1, np.int64))
                for lo, hi in chunks(own, _CHUNK):
                    flat, _ = code_points(own[lo:hi])
                    for order in orders:
                        total += np.bincount(buckets(flat, order, bits), minlength=len(total))
        for name, total in held.items():
            at = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([where[name]] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["l", "b", "n"])

    counts = np.full((len(langs), (1 << bits) + 1), float(smoothing))
    found = sample.mapInArrow(count, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts[found["l"], found["b"]] += found["n"]
    log_probs = np.log(counts / counts[:, :-1].sum(1, keepdims=True))
    log_probs[:, -1] = 0.0
    total = sum(sizes.values())
    return LanguageModel(langs, np.log([sizes[x] / total for x in langs]), log_probs.astype(np.float32), orders, bits)


def classify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: dict[str, str | Column] | None = None, text_as: str | None = None) -> DataFrame:
    """One row per document: the columns ``keep`` (name: column), the text as ``text_as`` if that is given, ``lang_pred``, ``score``.

    A null or empty text, or one without a letter, is ``und`` with score 0;
    texts of any length are taken whole; repeated rows and null keys are rows
    like others; of equally likely languages the first by name counts; an
    empty table gives an empty table; other columns are not looked at. The
    model goes to the executors as a broadcast of at most
    languages x 2**bits floats.
    """
    keep = keep or {}
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_priors, model.log_probs, model.orders, model.bits))
    rows = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in keep.items()], F.col(text).alias("__text"))

    small_batches(docs)
    shown = len(keep) + (text_as is not None)
    names = [*keep, *[text_as] * (text_as is not None), "lang_pred", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*held.value)
        for batch in batches:
            texts = column_texts(batch.column("__text"))
            if own.langs:
                langs, scores = predict(own, texts)
            else:
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:shown], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    fields = ", ".join(f"`{name}` {f.dataType.simpleString()}" for name, f in zip(names, rows.schema.fields[:shown], strict=False))
    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double" if fields else "lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learns from those with crc32(doc_id) mod 5 other than 0 (a null id is not held out). Cases as of :func:`classify`."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    return classify(docs, fit(docs.where(~held_out)), keep={"doc_id": "doc_id", "held_out": held_out})


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents with a language that the model is sure of; the columns stay as they are.

    Learns from all rows with a language; where there are none, all go.
    Documents without a letter (null and empty texts too), and those whose best
    language has a posterior below ``least``, go; repeated rows go or stay
    together. Other columns, whatever their names, are passed through.
    """
    names = docs.columns
    scored = classify(docs, fit(docs), keep={f"c{i}": F.col(f"`{c}`") for i, c in enumerate(names) if c != "text"}, text_as=f"c{names.index('text')}")
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.lit(float(least))))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


