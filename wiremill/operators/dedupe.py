"""Removing duplicate articles: variants of one URL, and one title within a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiremill.functions.text import article_url, canonicalize_url, host_is


def _ranked(articles: DataFrame, mappings: DataFrame) -> DataFrame:
    """Articles with what ranks them: number of symbols and length of the summary (``n_chars``, given in place of the summary where no text is asked for)."""
    n = mappings.groupBy(F.col("article_id").alias("n_id")).agg(F.count("*").alias("n_tickers"))
    rows = articles.withColumn("n_chars", F.length(F.coalesce("summary", F.lit("")))) if "summary" in articles.columns else articles
    rows = rows.join(n, F.col("id") == F.col("n_id"), "left").drop("n_id")
    return rows.withColumn("n_tickers", F.coalesce("n_tickers", F.lit(0)))


def _merged(rows: DataFrame, keys: list[str], rank: Column, tie: Column) -> DataFrame:
    """One row per group of two or more: the winner's id, and what the merge leaves it with. ``tie`` orders equally long summaries (largest first)."""
    alerted = [F.min("first_alert_sent_at").alias("first_alert_sent_at")] if "first_alert_sent_at" in rows.columns else []
    longest = [F.max_by("summary", F.struct(F.col("n_chars"), tie)).alias("summary")] if "summary" in rows.columns else []
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_members"), F.max_by("id", rank).alias("winner"), *longest, F.max("published_at").alias("published_at"), F.min(F.coalesce("first_seen_at", "created_at")).alias("first_seen_at"), *alerted,
    )
    return out.where("n_members > 1")


def url_groups(articles: DataFrame, mappings: DataFrame, host: str) -> DataFrame:
    """Merge plan for articles of ``host`` whose URLs differ in the query only; the winner prefers an already bare URL."""
    rows = _ranked(articles.where(host_is(F.col("canonical_url"), host)), mappings)
    rows = rows.withColumn("url", article_url(canonicalize_url(F.col("canonical_url"))))
    rank = F.struct(F.col("canonical_url") == F.col("url"), F.col("n_tickers"), F.col("n_chars"), F.col("published_at"), F.col("id"))
    return _merged(rows, ["url"], rank, -F.col("id"))


def url_members(articles: DataFrame, host: str) -> DataFrame:
    """``id, url`` of the articles that :func:`url_groups` looks at."""
    return articles.where(host_is(F.col("canonical_url"), host)).select("id", article_url(canonicalize_url(F.col("canonical_url"))).alias("url"))


def anchors(times: DataFrame, key: str, ts: str, hours: int = 48) -> DataFrame:
    """``key, anchors``: where clusters of a key start, so that each row is within ``hours`` of the first of its cluster.

    The fold runs over a key's distinct seconds, not its rows, and takes a step
    per hour that has any: clusters start at least ``hours`` apart, so at most
    one starts in an hour.
    """
    t = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    by_hour = times.select(key, t.alias("t")).groupBy(key, F.floor(F.col("t") / 3600).alias("hour")).agg(F.sort_array(F.collect_set("t")).alias("ts"))
    sets = by_hour.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hour", "ts"))).alias("hours"))
    state = F.struct(F.array().cast("array<bigint>").alias("a"), F.lit(-(1 << 60)).cast("bigint").alias("last"))

    def step(s: Column, h: Column) -> Column:
        start = F.array_min(F.filter(h["ts"], lambda x: x > s["last"] + hours * 3600))
        return F.when(start.isNull(), s).otherwise(F.struct(F.array_append(s["a"], start).alias("a"), start.alias("last")))

    return sets.select(key, F.aggregate("hours", state, step, lambda s: s["a"]).alias("anchors"))


def clusters(articles: DataFrame, hours: int = 48) -> DataFrame:
    """Articles whose title occurs more than once, with ``cluster``: the time in seconds at which their cluster starts."""
    twice = articles.groupBy("title_hash").agg(F.count("*").alias("n")).where("n > 1").select("title_hash")
    rows = articles.join(twice, "title_hash", "left_semi")
    t = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("published_at"))
    joined = rows.join(anchors(rows, "title_hash", "published_at", hours), "title_hash").withColumn("t", t)
    return joined.withColumn("cluster", F.array_max(F.filter("anchors", lambda a: a <= F.col("t")))).drop("anchors", "t")


def title_groups(articles: DataFrame, mappings: DataFrame, raw_items: DataFrame, general_source: int, hours: int = 48) -> DataFrame:
    """Merge plan for one title within ``hours``; clusters with a member without raw items, or with one of the general source, are left alone."""
    facts = raw_items.where("article_id is not null").groupBy(F.col("article_id").alias("r_id")).agg(F.bool_or(F.col("source_id") == general_source).alias("general"))
    rows = clusters(_ranked(articles, mappings), hours).join(facts, F.col("id") == F.col("r_id"), "left")
    blocked = rows.groupBy("title_hash", "cluster").agg(F.bool_or(F.coalesce("general", F.lit(True))).alias("blocked")).where("blocked").select("title_hash", "cluster")
    rows = rows.join(blocked, ["title_hash", "cluster"], "left_anti")
    rank = F.struct("n_tickers", "n_chars", "published_at", "id")
    return _merged(rows, ["title_hash", "cluster"], rank, F.struct(-F.unix_timestamp(F.col("published_at").cast("timestamp")), -F.col("id")))


def members(articles: DataFrame, hours: int = 48) -> DataFrame:
    return clusters(articles, hours).select("id", "title_hash", "cluster")


def merge_links(mappings: DataFrame, losers: DataFrame) -> DataFrame:
    """Mappings after articles were merged: each symbol of a winner keeps its best confidence. ``losers``: ``id, winner``."""
    moved = mappings.join(losers.select(F.col("id").alias("l_id"), "winner"), F.col("article_id") == F.col("l_id"), "left")
    moved = moved.withColumn("article_id", F.coalesce("winner", "article_id"))
    own = F.when(F.col("l_id").isNull(), 1).otherwise(0)
    top = moved.groupBy("article_id", "ticker_id").agg(F.max_by(F.struct("match_type", "confidence"), F.struct("confidence", own, -F.coalesce("l_id", F.lit(0)))).alias("b"))
    return top.select("article_id", "ticker_id", "b.match_type", "b.confidence")


def relink(raw_items: DataFrame, losers: DataFrame) -> DataFrame:
    """Raw items of merged articles point to the winner."""
    rows = raw_items.join(losers.select(F.col("id").alias("l_id"), "winner"), F.col("article_id") == F.col("l_id"), "left")
    return rows.withColumn("article_id", F.coalesce("winner", "article_id")).drop("l_id", "winner")


def losers(groups: DataFrame, member_rows: DataFrame, keys: list[str]) -> DataFrame:
    return member_rows.join(groups.select(*keys, "winner"), keys).where("id != winner").select("id", "winner")


def merged_articles(articles: DataFrame, groups: DataFrame, losers: DataFrame) -> DataFrame:
    """Articles after a merge, all columns kept: losers are gone, winners have what the plan leaves them with, with a plan by URL also that URL and its hash."""
    names = [c for c in ("summary", "published_at", "first_seen_at", "first_alert_sent_at") if c in groups.columns and c in articles.columns]
    plan = groups.select(F.col("winner").alias("w_id"), *[F.col(c).alias(f"w_{c}") for c in names], *([F.col("url").alias("w_url")] if "url" in groups.columns else []))
    rows = articles.join(losers.select("id"), "id", "left_anti").join(plan, F.col("id") == F.col("w_id"), "left")
    won = F.col("w_id").isNotNull()
    pick = {c: F.when(won, F.col(f"w_{c}")).otherwise(F.col(c)) for c in names}
    if "url" in groups.columns:
        pick |= {"canonical_url": F.coalesce("w_url", "canonical_url"), "canonical_url_hash": F.when(won, F.sha2("w_url", 256)).otherwise(F.col("canonical_url_hash"))}
    return rows.select(*[pick.get(c, F.col(c)).alias(c) for c in articles.columns])


def statistics(groups: DataFrame, losers: DataFrame, raw_items: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row of counts: articles in groups, groups, articles merged, raw items moved, and mappings moved, raised and deleted."""
    gone = losers.select(F.col("id").alias("article_id"), "winner")
    plan = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n_members"), F.lit(0)).alias("scanned"), F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0)).alias("merged"))
    items = raw_items.join(gone, "article_id", "left_semi").agg(F.count("*").alias("raw_items_relinked"))
    moved = mappings.join(gone, "article_id").groupBy("winner", "ticker_id").agg(F.count("*").alias("n"))
    own = mappings.select(F.col("article_id").alias("winner"), "ticker_id", F.lit(True).alias("held"))
    moved = moved.join(own, ["winner", "ticker_id"], "left").withColumn("first", F.when(F.col("held").isNull(), 1).otherwise(0))
    links = moved.agg(F.coalesce(F.sum("first"), F.lit(0)).cast("bigint").alias("mappings_relinked"), F.coalesce(F.sum(F.col("n") - F.col("first")), F.lit(0)).alias("mappings_deleted"))
    raised = rises(mappings, losers).agg(F.coalesce(F.sum("updated"), F.lit(0)).alias("mappings_updated"))
    return plan.crossJoin(items).crossJoin(links).crossJoin(raised)  # one row each


def rises(mappings: DataFrame, losers: DataFrame) -> DataFrame:
    """Per winner and symbol, how often the confidence rises strictly as losers are merged in order of id."""
    moved = mappings.join(losers.select(F.col("id").alias("l_id"), "winner"), F.col("article_id") == F.col("l_id"), "left")
    rows = moved.select(F.coalesce("winner", "article_id").alias("winner"), "ticker_id", "confidence", F.coalesce("l_id", F.lit(-1)).alias("at"))
    w = Window.partitionBy("winner", "ticker_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    up = rows.withColumn("before", F.max("confidence").over(w)).where("at >= 0 and confidence > before")
    return up.groupBy("winner").agg(F.count("*").alias("updated"))
