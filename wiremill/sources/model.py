"""The news model over the driver's tables, one DataFrame per table of the model.

Every table is derived by column expressions from tables that may be large;
only the symbol universe is a short literal list.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.functions.text import normal_start, normalize_title
from wiremill.operators.upsert import content_hash

GENERAL_SOURCE = "src0"
GENERAL_HOST = "wire.example"
#: (symbol, override keywords, fund name, sponsor): tokens that occur in the texts, and one symbol each of the classes that need more support.
SYMBOLS = (
    ("DE", "der,und", None, None), ("LA", "los,con", None, None), ("DER", "", None, None), ("ER", "the,of", None, None), ("WAS", "was,the", None, None), ("EN", "", None, None), ("QUE", "qui,que", None, None),
    ("ERHE", "er,the", None, None), ("OU", "ou,le", None, None), ("LE", "", None, None), ("ST", "th,st", None, None), ("THAT", "that", None, None), ("THE", "the", None, None), ("OF", "of", None, None), ("TO", "to", None, None),
    ("IDE", "", "Harbor Ridge Real Idea Fund", "Harbor Ridge Advisors"), ("EST", "", "Stone Peak Estate Trust", "Stone Peak"), ("FUND", "", "Golden Meadow Trust", "Golden Meadow"), ("HRO", "", "Harbor Ridge Global Opps Fd, Inc.", "Harbor Ridge Advisors"),
)
#: Symbols that stand as whole words: a capital is looked for first, so other words are passed over. Behind a word two places are looked at, as one letter may take two.
WORDS = r"(?=[A-Z])(?<![\p{L}\p{N}_]{1,2})(?:" + "|".join(s[0] for s in SYMBOLS) + r")(?![\p{L}\p{N}_])"
#: What titles of every n-th article end with.
ENDINGS = (
    (11, " (LA)"), (13, " NYSE: QUE"), (17, " Harbor Ridge idea dividend IDE"), (19, " Stone Peak estate call at 10:30 a.m. EST"), (23, " FUND (FUND)"), (29, " Stone Peak estate EST"), (31, " noon (EST)"),
    (37, " monthly IDE"), (41, " The Harbor Ridge Global Opportunities Fund"),
)

#: What watchlists of a text only look for.
TEXTS = ("tion", "hr", "Est ", "no such text", "a")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after(hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(read(spark, sf_dir, "documents"))


def as_articles(documents: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    title = F.concat(F.substring_index("text", "\n", 1), *[F.when(i % n == 0, end).otherwise("") for n, end in ENDINGS])
    url = F.concat(F.lit(f"https://www.{GENERAL_HOST}/news/"), F.floor(i / 2).cast("string"), F.when(i % 2 == 1, "?feedref=x").otherwise(""))
    out = documents.select(
        i.alias("id"), title.alias("title"), F.col("text").alias("summary"), after((i * 37) % 720).alias("published_at"), after((i * 37) % 720 + 1).alias("created_at"),
        F.col("source").alias("source_name"), F.concat(F.lit("Wire "), F.col("source")).alias("provider_name"), url.alias("canonical_url"),
    )
    out = out.withColumn("own", F.sha2(normalize_title(F.col("title"), entities=False), 256))  # made once, of all that is below
    content = content_hash(F.col("own"), normal_start(F.col("summary"), 300))
    keys = {"canonical_url_hash": F.sha2("canonical_url", 256), "title_hash": F.col("own"), "cluster_key": F.col("own"), "content_hash": content}
    return out.withColumns(keys | {"first_seen_at": F.col("created_at"), "first_alert_sent_at": F.when(F.col("id") % 4 == 0, F.col("published_at"))}).drop("own")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read(spark, sf_dir, "documents").select("source").distinct()
    return codes.select(F.substring("source", 4, 10).cast("int").alias("id"), F.col("source").alias("code"), F.concat(F.lit("Wire "), F.col("source")).alias("name"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attached items of all articles but every ninth, and items of pages, of which every seventh is detached."""
    own = articles(spark, sf_dir).where("id % 9 != 0").select(
        "id", F.substring("source_name", 4, 10).cast("int").alias("source_id"), F.col("id").alias("article_id"), F.concat(F.lit("feed/"), F.col("source_name")).alias("feed_url"),
        F.concat(F.lit("g"), F.col("id").cast("string")).alias("raw_guid"), F.col("title").alias("raw_title"), F.col("canonical_url").alias("raw_link"), F.col("published_at").alias("raw_pub_date"),
        F.timestamp_add("HOUR", F.lit(2), "published_at").alias("fetched_at"),
    )
    p = F.col("page_id")
    pages = read(spark, sf_dir, "pages").select(
        (p + 100_000_000).alias("id"), (p % 20).cast("int").alias("source_id"), F.when(p % 7 != 0, p).alias("article_id"), F.concat(F.lit("feed/p"), (p % 4).cast("string")).alias("feed_url"),
        F.when(p % 3 != 0, F.concat(F.lit("p"), F.floor(p / 2).cast("string"))).alias("raw_guid"), F.col("url").alias("raw_title"), F.substring_index("url", "?", 1).alias("raw_link"),
        F.when(p % 5 != 0, after(p % 48)).alias("raw_pub_date"), after(p % 720).alias("fetched_at"),
    )
    return own.unionByName(pages)


def tickers(spark: SparkSession) -> DataFrame:
    """The symbols as a relation whose size the planner knows, so that it broadcasts them instead of texts or words that meet them."""
    names = ("symbol", "validation_keywords", "fund_name", "sponsor")
    columns = {"id": pa.array(range(1, len(SYMBOLS) + 1), pa.int32())} | {n: pa.array([s[k] for s in SYMBOLS], pa.string()) for k, n in enumerate(names)}
    return spark.createDataFrame(pa.table(columns | {"active": pa.array([i % 5 != 0 for i in range(1, len(SYMBOLS) + 1)])}))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored links of articles to symbols: upper-case words of the summary that are symbols, with a confidence by symbol and article.

    Every sixth article is linked to inactive symbols only.
    """
    words = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))).alias("symbol"))
    known = tickers(spark).select(F.col("id").alias("ticker_id"), "symbol", "active")
    out = words.join(known, "symbol").where("article_id % 6 <> 5 or not active")
    kind = F.when(F.col("ticker_id") % 3 == 0, "token").when(F.col("ticker_id") % 3 == 1, "paren").otherwise("exchange")
    percent = F.when(F.col("ticker_id") % 3 == 0, 62).when(F.col("ticker_id") % 3 == 1, 75).otherwise(88) + F.col("article_id") % 3
    confidence = percent.cast("double") / 100
    return out.select("article_id", "ticker_id", kind.alias("match_type"), confidence.alias("confidence"), (10 - F.col("article_id") % 4 % 2).cast("int").alias("extraction_version"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id")
    running = (kind == "purchase") & (i % 10 == 0)
    status = F.when(kind == "error", "failed").when(kind == "signup", "skipped_backoff").when(running, "running").otherwise("success")
    return read(spark, sf_dir, "events").select(
        i.alias("id"), F.concat(F.lit("feed/"), F.col("user_id").cast("string")).alias("feed_url"), (F.col("user_id") % 20).cast("int").alias("source_id"), F.col("ts").alias("started_at"),
        F.when(~running, F.timestamp_add("SECOND", (i % 600).cast("int"), "ts")).alias("finished_at"), status.alias("status"), F.floor("value").cast("bigint").alias("items_inserted"), (F.floor("value") * 2).cast("bigint").alias("items_seen"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("duration_ms"), "ts")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per customer, ``id, scope, tickers, provider, q, mark``, with a scope of the kind that the market segment says and for furniture a second one, of all news."""
    c, kind = F.col("c_custkey"), F.col("c_mktsegment")
    symbol = F.element_at(F.array(*[F.lit(s[0]) for s in SYMBOLS]), (c % len(SYMBOLS)).cast("int") + 1)
    other = F.element_at(F.array(*[F.lit(s[0]) for s in SYMBOLS]), (c % 7).cast("int") + 1)
    text_only = c % 4 == 1
    text = F.when((kind == "HOUSEHOLD") & (c % 3 == 0), "er").when((kind == "MACHINERY") & text_only, F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (c % len(TEXTS)).cast("int") + 1))
    rows = read(spark, sf_dir, "customer").select(
        c.alias("id"), kind.alias("kind"), F.when(kind.isin("FURNITURE", "BUILDING"), F.array_distinct(F.array(symbol, other))).when(kind == "HOUSEHOLD", F.array(symbol)).alias("tickers"),
        F.when((kind == "BUILDING") | ((kind == "MACHINERY") & ~text_only), F.concat(F.lit("wire SRC"), (c % 20).cast("string"))).alias("provider"), text.alias("q"), (c % 500).alias("mark"),
    )
    listed = rows.where("tickers is not null or provider is not null or q is not null").select("id", F.lit("watchlist:w1").alias("scope"), "tickers", "provider", "q", "mark")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("tickers", "array<string>"), ("provider", "string"), ("q", "string"))]
    everything = rows.where("kind in ('AUTOMOBILE', 'FURNITURE')").select("id", F.lit("all").alias("scope"), *nothing, "mark")
    return listed.unionByName(everything)
