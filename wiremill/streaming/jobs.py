"""Structured Streaming forms: ingest in micro-batches, sliding counts, and the state of each feed.

Each job has a folder: its checkpoint, and a table with a version per
micro-batch, named by the batch's number. A batch reads the version before its
own and writes its own anew, so a batch that runs again after a failure writes
the same, and a later run with the same folder goes on from the last version
with the files that landed since.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from wiremill.functions.text import normalize_title
from wiremill.operators.upsert import match_articles, upsert_articles
from wiremill.session import shared_dir
from wiremill.streaming.tables import Tables, last_batch


def stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet file or folder of files as a stream; only files that were not read before make a batch.

    The path goes in as a pattern, since a stream takes no single file by name.
    """
    return spark.readStream.schema(spark.read.parquet(f"{path}*").schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def _folder(spark: SparkSession, name: str, state: str | None) -> str:
    return state or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _drain(rows: DataFrame, mode: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame], at: str, table: str = "table") -> DataFrame:
    """Run a stream over what has landed; ``fold(batch, last version)`` gives the next version of the table, the newest of which is returned."""
    spark = rows.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{at}/{table}/version={number - 1}") if number else None
        fold(batch, before).write.mode("overwrite").parquet(f"{at}/{table}/version={number}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{at}/{table}").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{at}/{table}/version={last}")


def ingest(spark: SparkSession, path: str, state: str | None = None, files_per_batch: int = 64, buckets: int = 16) -> DataFrame:
    """Title hashes of landed documents with the lowest id that had each and their number, kept up to date batch by batch.

    A batch reads and writes the buckets that its titles fall into.
    """
    at, schemas = _folder(spark, "ingest", state), {"titles": "title_hash string, first_id bigint, n bigint"}

    def sink(batch: DataFrame, number: int) -> None:
        tables = Tables(batch.sparkSession, at, number, schemas, buckets)
        new = batch.groupBy(F.sha2(normalize_title(F.substring_index("text", "\n", 1), entities=False), 256).alias("title_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
        touched = tables.buckets_of(new.select("title_hash"))
        rows = new.unionByName(tables.read("titles", touched)).groupBy("title_hash").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
        tables.write("titles", rows, "title_hash", touched)
        tables.commit()

    stream(spark, path, files_per_batch).writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return Tables(spark, at, last_batch(spark, at) + 1, schemas, buckets).read("titles")


def ingest_articles(spark: SparkSession, path: str, to_entries: Callable[[DataFrame], DataFrame], general: str, state: str | None = None, files_per_batch: int = 64, hours: int = 48) -> DataFrame:
    """Articles from landed rows: each batch's entries meet stored articles by URL, or by title within ``hours`` of publication either way, and are merged in.

    ``to_entries`` makes entries with the columns of articles from a batch.
    Entries of one batch that share a URL or title become one article.
    ``batch`` of an article is the batch that inserted it, so that the number
    of new ones of a batch, of which readers are told, can be read off the table
    (:func:`new_counts`). A late entry still meets its article, as the window
    is on the time of publication.
    """

    def fold(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        entries = to_entries(batch)
        old = before if before is not None else entries.limit(0).withColumn("batch", F.lit(0))
        number = old.agg(F.coalesce(F.max("batch") + 1, F.lit(0)).alias("next_batch")) if before is not None else None
        known = old.select(F.col("id").alias("article_id"), (F.col("source_name") == general).alias("from_general"))
        out = upsert_articles(old, entries, match_articles(entries, old, known, general, hours), general)
        if number is None:
            return out.withColumn("batch", F.coalesce("batch", F.lit(0)))
        return out.crossJoin(F.broadcast(number)).withColumn("batch", F.coalesce("batch", "next_batch")).drop("next_batch")  # one row

    return _drain(stream(spark, path, files_per_batch), "append", fold, _folder(spark, "articles", state))


def new_counts(articles: DataFrame) -> DataFrame:
    """``batch, inserted``: how many new articles each batch brought."""
    return articles.groupBy("batch").agg(F.count("*").alias("inserted"))


def sliding_outcomes(spark: SparkSession, path: str, state: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """Events per type in windows of 15 minutes every 5 that are closed: that ended an hour or longer before the newest event.

    Closed windows are appended and leave the state, so that it holds an hour of
    windows and no more; events later than that count for nothing.
    """
    at = _folder(spark, "outcomes", state)
    rows = stream(spark, path, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    counts = rows.groupBy(F.window("ts", "15 minutes", "5 minutes"), "event_type").agg(F.count("*").alias("n"))
    closed = counts.select(F.col("window.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/windows/batch={number}")

    closed.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{at}/windows").select(*closed.columns)


def feed_health(spark: SparkSession, path: str, state: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """``user_id, failure_count`` after all landed events: errors since the last success.

    The table holds a row per user with the time of its last success, and a row
    per error after it. Neither order nor number of the batches matters, and no
    task holds a user's events.
    """

    def fold(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        at = F.struct("ts", "event_id")
        rows = batch.select("user_id", F.when(F.col("event_type").isin("view", "click", "purchase"), at).alias("ok"), F.when(F.col("event_type") == "error", at).alias("failed"))
        every = rows if before is None else rows.unionByName(before)
        last = every.groupBy("user_id").agg(F.max("ok").alias("ok"))
        failed = every.where("failed is not null").select("user_id", "failed").join(last, "user_id").where("ok is null or failed > ok")
        return last.select("user_id", "ok", F.lit(None).cast(rows.schema["failed"].dataType).alias("failed")).unionByName(failed.select("user_id", F.lit(None).cast(rows.schema["ok"].dataType).alias("ok"), "failed"))

    rows = stream(spark, path, files_per_batch).select("user_id", "event_id", "event_type", "ts")
    table = _drain(rows, "append", fold, _folder(spark, "health", state))
    return table.groupBy("user_id").agg(F.count("failed").cast("int").alias("failure_count"))


ATTEMPT = "feed_url string, at timestamp, failed boolean, hint_s double"
POLL = "feed_url string, at timestamp, status string, failure_count int, backoff_until timestamp"


def polls(spark: SparkSession, attempts: DataFrame, state: str | None = None, base: float = 30.0, cap: float = 3600.0) -> DataFrame:
    """What became of each attempt of a stream (``ATTEMPT``) to read a feed, as ``POLL``, feed by feed in order of time.

    Keyed state holds a feed's failures in a row, and until when it is left
    alone. An attempt inside that time is skipped and changes nothing; a failure
    doubles it, from ``base`` up to ``cap`` seconds, a server's hint being a
    floor; a success ends it. The split into batches doesn't matter as long as a
    feed's attempts arrive in order. A feed without attempts for a day beyond
    its time loses its state, which says no more by then than a new one's, but
    for its failures, which are forgotten.
    """
    at = _folder(spark, "polls", state)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        failures, until = held.get if held.exists else (0, 0)  # until: in microseconds
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        out = []
        for when, failed, hint in zip(rows["at"], rows["failed"], rows["hint_s"], strict=True):
            now = when.value // 1000
            if now < until:
                status = "skipped_backoff"
            elif failed:
                failures += 1
                wait = min(base * 2.0 ** min(failures - 1, 64), cap) if base > 0 and cap > 0 else 0.0
                if hint > 0:  # a missing hint is not
                    wait = min(max(wait, hint), cap)
                status, until = "failed", now + int(wait * 1_000_000)
            else:
                status, failures, until = "success", 0, 0
            out.append((key[0], when, status, failures, pd.Timestamp(until, unit="us") if until else pd.NaT))
        held.update((failures, until))
        held.setTimeoutTimestamp(max(until // 1000, now // 1000, held.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame(out, columns=["feed_url", "at", "status", "failure_count", "backoff_until"])

    rows = attempts.withWatermark("at", "1 hour").groupBy("feed_url").applyInPandasWithState(follow, POLL, "failures int, until bigint", "append", "EventTimeTimeout")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/polls/batch={number}")

    rows.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/polls").select(*rows.columns)
