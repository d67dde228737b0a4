"""Packing: optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiremill.llm.common import native_words, table
from wiremill.session import written


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges with the least total padding.

    Dynamic programming over ascending distinct ``lengths``: ``best[k][j]`` is
    the least number of slots when the first j lengths fill k buckets, the last
    one padded to length j. The best last cut never moves back as j grows, so
    each row takes a divide and conquer of O(m log m) instead of O(m^2).
    """
    m = len(lengths)
    if not m:
        return []
    before = np.concatenate(([0], np.cumsum(counts.astype(np.float64))))
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, m)):
        now, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        now[0] = 0.0
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + (before[j] - before[i]) * lengths[j - 1]
            at = int(i[cost.argmin()])
            now[j], cut[j] = cost.min(), at
            if lo < j:
                todo.append((lo, j - 1, first, at))
            if j < hi:
                todo.append((j + 1, hi, at, last))
        cuts.append(cut)
        best = now
    out, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = 16, token_budget: int = 16_384, shard_tokens: int = 1 << 24, tokens: Column | None = None) -> DataFrame:
    """``key, n_tokens, bucket, padded_to, shard, batch, slot`` of each document.

    ``n_tokens`` are words unless ``tokens`` says otherwise; a null or empty
    text has none and is padded to one. The global histogram of lengths (a row
    per different length, however many documents there are) goes to the driver,
    which finds the bucket boundaries. Inside a bucket, documents are dealt
    over shards by a hash of ``key`` (of their place in the table where the key
    is null), so that no task gets a whole bucket; a shard's documents, in
    order of length, form batches of token_budget // padded_to documents. A
    document longer than the budget is a batch of its own. Every document, also
    each of repeated rows, is in one batch; ties go by key. An empty table
    gives an empty table; other columns are not looked at.
    """
    counted = tokens if tokens is not None else F.size(native_words(F.col(text))).cast("bigint")
    rows = written(docs.select(F.col(key).alias("k"), counted.alias("n"), F.monotonically_increasing_id().alias("id")), "lengths")
    held = F.greatest(F.col("n"), F.lit(1))
    found = rows.groupBy(held.alias("length")).agg(F.count("*").alias("c")).orderBy("length").toPandas()
    lengths, counts = found["length"].to_numpy(np.int64), found["c"].to_numpy(np.int64)
    bounds = optimal_boundaries(lengths, counts, buckets)
    shards = max(1, -(-int((lengths * counts).sum()) // shard_tokens))
    bucket = sum(((held > b).cast("int") for b in bounds[:-1]), F.lit(0))
    padded = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds or [1]]), F.col("bucket") + 1)
    dealt = F.when(F.col("k").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("k"))
    rows = rows.withColumn("bucket", bucket).withColumn("padded_to", padded).withColumn("shard", F.pmod(dealt, F.lit(shards)).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n", "k", "id")) - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("padded_to"))).cast("bigint")
    rows = rows.withColumn("place", place).withColumn("fits", fits)
    return rows.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), "bucket", "padded_to", "shard", F.floor(F.col("place") / F.col("fits")).alias("batch"), (F.col("place") % F.col("fits")).cast("int").alias("slot"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document; cases as of :func:`pack`."""
    return pack(table(spark, sf_dir, "documents"))
