"""Landed feeds, symbol files and pages, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.functions import text as T

#: Fields of a feed's items.
ITEM = "guid string, id string, title string, link string, description string, summary string, pubDate string, published string, updated string, language string, source string"
#: (source code, feed URL, policy, label); general_allowed stores entries without a symbol as well.
REGISTRY = (
    ("src0", "feed/src0", "general_allowed", "General wire"),
    ("src1", "feed/src1", "validated_mapping_required", "First wire"),
    ("src2", "feed/src2", "scoped_context_required", "Scoped wire"),
)


def scan_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files, with the file they come from."""
    return spark.read.schema(ITEM).option("rowTag", "item").format("xml").load(path).withColumn("feed_file", F.col("_metadata.file_path"))


def scan_channels(spark: SparkSession, path: str) -> DataFrame:
    """``feed_file, feed_title`` of landed RSS files."""
    rows = spark.read.schema("title string").option("rowTag", "channel").format("xml").load(path)
    return rows.select(F.col("_metadata.file_path").alias("feed_file"), T.clean_summary(F.col("title")).alias("feed_title"))


def scan_channel_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files with ``feed_file`` and the ``feed_title`` of the channel that each stands in, in one pass over the files."""
    rows = spark.read.schema(f"title string, item array<struct<{ITEM.replace(' string', ': string')}>>").option("rowTag", "channel").format("xml").load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("feed_file"), T.clean_summary(F.col("title")).alias("feed_title"), "item")  # once a channel, not once an item
    return rows.select("feed_file", "feed_title", F.explode("item").alias("item")).select("item.*", "feed_file", "feed_title")


def source_label(code: Column, feed_title: Column, label: Column) -> Column:
    """What a feed's entries are labelled with: its own title, but the configured label for the general and the scoped source, or without a title."""
    configured = code.isin(*(c for c, _, policy, _ in REGISTRY if policy != "validated_mapping_required"))
    return T.label(F.when(configured | feed_title.isNull(), label).otherwise(feed_title))


def parse_items(rows: DataFrame, column: str) -> DataFrame:
    """Items that stand as XML texts in a column, beside the other columns."""
    return rows.withColumn("item", F.from_xml(F.col(column), ITEM)).select(*[c for c in rows.columns if c != column], "item.*")


def item_language(link: Column, language: Column) -> Column:
    """Language of an item: its own, else the first path segment, or the one after ``news-release``, if that is a code."""
    parts = F.filter(F.split(T.url_part(link, "path"), "/"), lambda p: p != "")
    first, after = F.get(parts, F.lit(0)), F.get(parts, F.array_position(parts, F.lit("news-release")).cast("int"))
    code = lambda c: F.when(c.rlike("^[a-z]{2}([-_][A-Za-z]{2})?$"), c)
    return T.primary_language(F.coalesce(F.nullif(F.trim(language), F.lit("")), code(first), code(after)))


def prepare(items: DataFrame, now: str, english_only: bool = False, english_source: str | None = None, exact_host: str | None = None) -> DataFrame:
    """Entries of items: clean title and link (none without them), date (published, else updated, else now), guid, provider, article URL, language.

    ``english_only`` drops items of another known language, with
    ``english_source`` only those of that source (column ``source_code``);
    unknown languages stay. ``exact`` says whether a link stands on
    ``exact_host``.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    date = F.coalesce(T.parse_date(F.coalesce("pubDate", "published")), T.parse_date(F.col("updated")))
    out = items.select(
        *[c for c in items.columns if c not in {f.split()[0] for f in ITEM.split(", ")}],
        blank(T.clean_summary(F.col("title"))).alias("title"), T.canonicalize_url(blank(F.col("link"))).alias("link"), T.clean_summary(F.coalesce("summary", "description")).alias("summary"),
        date.alias("raw_pub_date"), F.coalesce(date, F.lit(now).cast("timestamp")).alias("published_at"), F.coalesce(blank(F.col("id")), blank(F.col("guid"))).alias("raw_guid"),
        T.label(F.coalesce(blank(F.col("source")), F.lit("unknown"))).alias("provider"), item_language(F.col("link"), F.col("language")).alias("lang"),
    )
    out = out.where("title is not null and link is not null")
    out = out.withColumns({"article_url": T.article_url(F.col("link")), "exact": T.host_is(F.col("link"), exact_host) if exact_host else F.lit(False)})
    if not english_only:
        return out
    bound = F.lit(True) if english_source is None else F.col("source_code") == english_source
    return out.where(~bound | F.col("lang").isNull() | (F.col("lang") == "en"))


def scan_tickers(spark: SparkSession, path: str) -> DataFrame:
    """The symbol file: header in any case, symbols upper-cased, blanks null, active unless 0, false, no or n; later columns may be absent."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = raw.toDF(*[c.replace("﻿", "").strip().lower() for c in raw.columns])
    if "ticker" not in rows.columns:
        raise ValueError("the symbol file has no column ticker")
    of = lambda c: F.nullif(F.trim(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    active = ~F.coalesce(F.lower(of("active")).isin("0", "false", "no", "n"), F.lit(False))
    return rows.select(F.upper(of("ticker")).alias("symbol"), of("fund_name").alias("fund_name"), of("sponsor").alias("sponsor"), active.alias("active"), of("validation_keywords").alias("validation_keywords")).where("symbol is not null")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "code string, feed_url string, policy string, label string")


def resolve_policy(entries: DataFrame, feeds: DataFrame, override: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Policy of each entry: an override, else its feed's, else its source's (``sources``: ``source_code, source_policy``), else that mappings are required."""
    rows = entries.join(feeds.select("feed_url", F.col("policy").alias("p")), "feed_url", "left")
    tried = [F.col("p")]
    if sources is not None:
        rows = rows.join(sources.select("source_code", F.col("source_policy").alias("sp")), "source_code", "left")
        tried.append(F.col("sp"))
    own = F.lit(override) if override else F.coalesce(*tried, F.lit("validated_mapping_required"))
    return rows.withColumn("policy", own).drop("p", "sp")


def strict_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.where("policy <> 'general_allowed'")


def fetch_url(link: Column, host: str, secure: bool = False) -> Column:
    """Where an article's page stands: its link without query, if that is on ``host``; null else.

    With ``secure``, trade marks (also as escapes) are cut out of the path and the scheme is https.
    """
    own = T.article_url(link)
    if secure:
        own = F.concat(F.lit("https://"), T.url_part(link, "host"), F.regexp_replace(T.url_part(link, "path"), "(?i)%C2%AE|%E2%84%A2|\u00ae|\u2122", ""))
    return F.when(T.host_is(link, host), own)


def with_pages(entries: DataFrame, pages: DataFrame, host: str, secure: bool = False) -> DataFrame:
    """Entries with ``html`` of their landed page (null without one), found by :func:`fetch_url`.

    Of several pages of one URL the newest counts: by ``fetched_at`` if there
    is such a column, then by ``page_id``.
    """
    order = F.struct(*[c for c in ("fetched_at", "page_id") if c in pages.columns])
    held = pages.groupBy(T.article_url(F.col("url")).alias("page_url")).agg(F.max_by("html", order).alias("html"))
    rows = entries.withColumn("fetch_url", fetch_url(F.col("link"), host, secure))
    return rows.join(held, F.col("fetch_url") == F.col("page_url"), "left").drop("page_url")


def run_log(entries: DataFrame, now: str, feeds: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """One row per feed run: items seen and stored, status and error text, appended to ``log`` if that is given.

    ``feeds``: ``feed_url, skipped, error`` of all feeds that were due; one with
    an error has failed, one still in its backoff was skipped; without
    ``feeds``, the feeds of the entries succeeded.
    """
    by = entries.groupBy("feed_url").agg(F.count("*").alias("items_seen"), F.count_if("stored").alias("items_inserted"))
    if feeds is None:
        rows = by.withColumns({"status": F.lit("success"), "error_text": F.lit(None).cast("string")})
    else:
        rows = feeds.join(by, "feed_url", "left")
        status = F.when(F.col("skipped"), "skipped_backoff").when(F.col("error").isNotNull(), "failed").otherwise("success")
        rows = rows.select("feed_url", F.coalesce("items_seen", F.lit(0)).alias("items_seen"), F.coalesce("items_inserted", F.lit(0)).alias("items_inserted"), status.alias("status"), F.when(~F.col("skipped"), F.col("error")).alias("error_text"))
    rows = rows.withColumn("started_at", F.lit(now).cast("timestamp_ntz"))
    return rows if log is None else log.unionByName(rows, allowMissingColumns=True)
