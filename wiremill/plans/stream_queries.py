"""Queries on landed files (feeds, symbol lists, pages) and streams, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.functions import text as T
from wiremill.operators import alerts as A
from wiremill.operators import extract as E
from wiremill.plans.oracle_model import MODEL, NORMAL, slot
from wiremill.plans.pipeline_queries import _stand_ins
from wiremill.session import shared_dir, written
from wiremill.sources import feeds as S
from wiremill.sources import model as M
from wiremill.streaming import cycle as C
from wiremill.streaming import jobs as J

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _landed(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query lands and scans."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_TITLE = "trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_LINK = "'https://www.wire.example/' || lang || '/news/' || doc_id"
_AT = "CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(doc_id % 28 AS INT)) END"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as RSS items in XML."""
    i = F.col("doc_id")
    day = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    xml = F.concat(
        F.lit("<item><title>"), _escaped(F.substring_index("text", "\n", 1)), F.lit("</title><link>HTTPS://www.wire.example:443/"), F.col("lang"), F.lit("/news/"), i.cast("string"), F.lit("/?utm_source=rss</link>"),
        F.when(i % 3 != 0, F.concat(F.lit("<guid>g"), i.cast("string"), F.lit("</guid>"))).otherwise(""), F.when(i % 5 != 0, F.concat(F.lit("<pubDate>"), day, F.lit(" Jan 2024 10:00:00 +0000</pubDate>"))).otherwise(""),
        F.lit("<source>"), F.col("source"), F.lit("</source></item>"),
    )
    return M.read(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", F.col("source").alias("source_code"), xml.alias("xml"))


@query(
    f"""SELECT doc_id, {_TITLE} AS title, {_LINK} AS link, {_LINK} AS article_url, CASE WHEN doc_id % 3 <> 0 THEN 'g' || doc_id END AS raw_guid, {_AT} AS published_at, source AS provider, lang, true AS exact
    FROM documents WHERE {_TITLE} <> '' AND (lang = 'en' OR source <> 'src0')"""
)
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Items parsed from a column of XML and prepared; the general source is held to English."""
    items = S.parse_items(_items(spark, d), "xml")
    out = S.prepare(items, "2024-02-01 00:00:00", english_only=True, english_source=M.GENERAL_SOURCE, exact_host=M.GENERAL_HOST)
    return out.select("doc_id", "title", "link", "article_url", "raw_guid", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "provider", "lang", "exact")


@query(
    f"""SELECT {_LINK} AS link, {_TITLE} AS title, CASE source WHEN 'src0' THEN 'General wire' WHEN 'src2' THEN 'Scoped wire' ELSE 'Channel ' || source END AS label
    FROM documents WHERE {_TITLE} <> '' AND source IN ('src0', 'src1', 'src2')"""
)
def feed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents landed as RSS files of up to 100 items, a folder a source, scanned again with the title of the channel that each item stands in."""
    path = _landed(spark, "feeds")
    rows = _items(spark, d).where(F.col("source_code").isin("src0", "src1", "src2"))
    files = rows.groupBy("source_code", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.array_join(F.collect_list(F.regexp_replace("xml", "[\\r\\n]", " ")), "").alias("items"))
    rss = F.concat(F.lit("<rss><channel><title>Channel "), F.col("source_code"), F.lit("</title>"), F.col("items"), F.lit("</channel></rss>"))
    files.select("source_code", rss.alias("value")).write.partitionBy("source_code").option("maxRecordsPerFile", 1).text(path)  # a file a feed, no folder of its own
    items = S.scan_channel_items(spark, path)
    code = F.regexp_extract("feed_file", "source_code=([^/]+)", 1)
    labels = S.registry(spark).select(F.col("code").alias("c"), "label")
    out = S.prepare(items.withColumn("code", code), "2024-02-01 00:00:00").join(labels, F.col("code") == F.col("c"))
    return out.select("link", "title", S.source_label(F.col("code"), F.col("feed_title"), F.col("label")).alias("label"))


@query(
    """SELECT upper(p_brand) || p_partkey AS symbol, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS fund_name, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS sponsor, p_partkey % 5 NOT IN (1, 2) AS active, CAST(NULL AS VARCHAR) AS validation_keywords FROM part"""
)
def ticker_csv(spark: SparkSession, d: str) -> DataFrame:
    """Parts landed as a symbol file with a header of its own spelling and scanned again."""
    path = _landed(spark, "symbols")
    i = F.col("p_partkey")
    active = F.when(i % 5 == 1, "No").when(i % 5 == 2, " 0 ").when(i % 5 == 3, "").otherwise("yes")
    rows = M.read(spark, d, "part").select(
        F.concat(F.lit(" "), F.lower("p_brand"), i.cast("string"), F.lit(" ")).alias(" Ticker"), F.when(i % 3 != 0, F.col("p_name")).otherwise(" ").alias("FUND_NAME "), F.when(i % 4 != 0, F.col("p_type")).alias("Sponsor"), active.alias("active")
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.scan_tickers(spark, path)


@query(
    """WITH p AS (SELECT page_id AS id, url AS link FROM pages), own AS (SELECT regexp_extract(url, '^[^?#]*') AS u, arg_max(html, page_id) AS html FROM pages GROUP BY 1)
    SELECT id, CASE WHEN regexp_extract(link, '://([^/?#]*)', 1) LIKE '%.example.com' THEN length(html) ELSE 0 END AS n_html FROM p LEFT JOIN own ON u = regexp_extract(link, '^[^?#]*')"""
)
def landed_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = M.read(spark, d, "pages")
    out = S.with_pages(pages.select(F.col("page_id").alias("id"), F.col("url").alias("link")), pages, "example.com")
    return out.select("id", F.coalesce(F.length("html"), F.lit(0)).cast("bigint").alias("n_html"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '://([^/?#]*)', 1) LIKE '%.example.com' THEN 'https://' || regexp_extract(url, '://([^?#]*)', 1) || '/x' ELSE '' END AS fetch_url FROM pages")
def fetch_urls(spark: SparkSession, d: str) -> DataFrame:
    """Where the pages of links with trade marks stand."""
    link = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.when(F.col("page_id") % 2 == 0, "/x%C2%AE?q=1").otherwise("/®x™%e2%84%a2#f"))
    return M.read(spark, d, "pages").select("page_id", F.coalesce(S.fetch_url(link, "example.com", secure=True), F.lit("")).alias("fetch_url"))


@query(
    """WITH f AS (SELECT DISTINCT 'feed/' || user_id AS feed_url, user_id % 7 = 0 AS skipped, CASE WHEN user_id % 5 = 0 THEN 'timeout' END AS error FROM events),
    n AS (SELECT 'feed/' || user_id AS feed_url, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS ins FROM events WHERE user_id % 3 <> 0 GROUP BY 1)
    SELECT f.feed_url, coalesce(seen, 0) AS items_seen, coalesce(ins, 0) AS items_inserted, CASE WHEN skipped THEN 'skipped_backoff' WHEN error IS NOT NULL THEN 'failed' ELSE 'success' END AS status, coalesce(CASE WHEN NOT skipped THEN error END, '') AS error_text, TIMESTAMP '2024-02-01' AS started_at FROM f LEFT JOIN n USING (feed_url)
    UNION ALL SELECT 'feed/old', 3, 1, 'success', '', TIMESTAMP '2024-01-31'"""
)
def run_log_append(spark: SparkSession, d: str) -> DataFrame:
    """The log of a cycle in which some feeds failed and some were still in their backoff, after an older run."""
    u, url = F.col("user_id"), F.concat(F.lit("feed/"), F.col("user_id").cast("string")).alias("feed_url")
    events = M.read(spark, d, "events")
    feeds = events.select(url, (u % 7 == 0).alias("skipped"), F.when(u % 5 == 0, "timeout").alias("error")).distinct()
    rows = events.where("user_id % 3 <> 0").select(url, (F.col("event_type") == "purchase").alias("stored"))
    old = events.limit(1).select(F.lit("feed/old").alias("feed_url"), F.lit(3).cast("bigint").alias("items_seen"), F.lit(1).cast("bigint").alias("items_inserted"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_text"), F.lit("2024-01-31").cast("timestamp_ntz").alias("started_at"))
    return S.run_log(rows, "2024-02-01", feeds, old).withColumn("error_text", F.coalesce("error_text", F.lit("")))


@query(f"{MODEL} SELECT id, title, source_name AS source, CASE WHEN id % 2 = 0 THEN canonical_url END AS link FROM articles")
def raw_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The stored form of entries, read back from its JSON; null fields are left out of it."""
    rows = M.articles(spark, d)
    link = F.when(F.col("id") % 2 == 0, F.col("canonical_url"))
    nothing = F.lit(None).cast("string")
    made = rows.select("id", T.payload(F.col("title"), link, F.col("published_at"), nothing, F.col("source_name"), nothing, F.array(F.lit("feed/a"))).alias("json"))
    parsed = F.from_json("json", "title string, source string, link string")
    return made.where("json not like '%\"language\"%'").select("id", parsed.alias("p")).select("id", "p.title", "p.source", "p.link")


@query(
    """SELECT c_custkey AS id, 'all' AS scope, CAST(NULL AS VARCHAR) AS tickers, CAST(NULL AS VARCHAR) AS provider FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, 'watchlist:w' || c_nationkey, 'LA,DE', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END FROM customer"""
)
def alert_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes out of JSON: lists without an id and repeated ids go, symbols are upper-cased, blanks are null."""
    c = F.col("c_custkey")
    first = F.struct(F.concat(F.lit(" w"), F.col("c_nationkey").cast("string")).alias("id"), F.lit("x").alias("name"), F.lit(" la, de,,LA").alias("tickers"), F.when(c % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("provider"), F.lit("").alias("q"))
    again = F.struct(F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("id"), F.lit("y").alias("name"), F.lit("st").alias("tickers"), F.lit("p").alias("provider"), F.lit("q").alias("q"))
    blank = F.struct(F.lit("  ").alias("id"), F.lit("z").alias("name"), F.lit("st").alias("tickers"), F.lit("p").alias("provider"), F.lit("q").alias("q"))
    json = F.to_json(F.struct(F.when(c % 3 == 0, False).otherwise(F.when(c % 3 == 1, True)).alias("include_all_news"), F.array(blank, first, again).alias("watchlists")))
    out = A.read_scopes(M.read(spark, d, "customer").select(c.alias("id"), json.alias("alert_scopes")))
    return out.select("id", "scope", F.array_join("tickers", ",").alias("tickers"), "provider")


@query("SELECT c_custkey AS id, 'w' || c_nationkey AS scope, c_custkey + 1 AS mark FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'all', 7 FROM customer")
def alert_marks_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Marks that are positive whole numbers, of a map that also has others."""
    c = F.col("c_custkey")
    own = F.when(c % 4 == 0, F.concat(F.lit("-"), c.cast("string"))).otherwise((c + 1).cast("string"))
    marks = F.create_map(F.concat(F.lit("w"), F.col("c_nationkey").cast("string")), own, F.lit("all"), F.lit("7"), F.lit("odd"), F.lit("x1"), F.lit("none"), F.lit(None).cast("string"))
    return M.read(spark, d, "customer").select(c.alias("id"), F.explode(A.clean_marks(marks)).alias("scope", "mark"))


@query(f"SELECT sha256({NORMAL.format('split_part(text, chr(10), 1)')}) AS title_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    return J.ingest(spark, f"{d}/documents.parquet")


def _stream_articles(spark: SparkSession, d: str) -> DataFrame:
    return J.ingest_articles(spark, f"{d}/documents.parquet", M.as_articles, M.GENERAL_SOURCE)


_ARRIVED = f"{MODEL}, {_stand_ins('articles')}"


@query(f"{_ARRIVED}, more AS (SELECT first, max(published_at) AS m_at FROM articles JOIN stands USING (id) GROUP BY first) SELECT id, title, m_at AS published_at FROM articles JOIN more ON first = id")
def stream_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles from a stream of documents, one per URL, and one per title within 48 hours."""
    return _stream_articles(spark, d).select("id", "title", "published_at")


@query(f"{_ARRIVED} SELECT 0 AS batch, count(DISTINCT first) AS inserted FROM stands")
def stream_new_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.new_counts(_stream_articles(spark, d))


@query(f"SELECT * FROM (SELECT {slot('ts', 5)} + to_minutes(k * 5) AS window_end, event_type, count(*) AS n FROM (SELECT *, unnest(generate_series(1, 3)) AS k FROM events) GROUP BY ALL) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return J.sliding_outcomes(spark, f"{d}/events.parquet")


@query(
    """WITH l AS (SELECT user_id, max(row(ts, event_id)) FILTER (event_type IN ('view', 'click', 'purchase')) AS ok FROM events GROUP BY 1)
    SELECT user_id, CAST(count(*) FILTER (event_type = 'error' AND (ok IS NULL OR row(ts, event_id) > ok)) AS INT) AS failure_count FROM events JOIN l USING (user_id) GROUP BY 1"""
)
def stream_feed_health(spark: SparkSession, d: str) -> DataFrame:
    return J.feed_health(spark, f"{d}/events.parquet")


@query(
    """WITH RECURSIVE a AS (SELECT 'feed/' || user_id AS feed_url, ts, event_type = 'error' AS failed, CASE WHEN event_id % 7 = 0 THEN 5400.0 END AS hint, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error') AS k FROM events),
    p AS (
      SELECT feed_url, k, ts, CASE WHEN failed THEN 'failed' ELSE 'success' END AS status, CAST(failed AS INT) AS failure_count,
        CASE WHEN failed THEN ts + to_microseconds(CAST(1000000 * least(greatest(600.0, coalesce(hint, 0)), 36000.0) AS BIGINT)) END AS backoff_until FROM a WHERE k = 1
      UNION ALL
      SELECT a.feed_url, a.k, a.ts, CASE WHEN a.ts < p.backoff_until THEN 'skipped_backoff' WHEN failed THEN 'failed' ELSE 'success' END, CASE WHEN a.ts < p.backoff_until THEN p.failure_count WHEN failed THEN p.failure_count + 1 ELSE 0 END,
        CASE WHEN a.ts < p.backoff_until THEN p.backoff_until WHEN failed THEN a.ts + to_microseconds(CAST(1000000 * least(greatest(600.0 * pow(2, least(p.failure_count, 64)), coalesce(hint, 0)), 36000.0) AS BIGINT)) END
      FROM p JOIN a ON a.feed_url = p.feed_url AND a.k = p.k + 1)
    SELECT feed_url, ts AS at, status, failure_count, backoff_until FROM p"""
)
def stream_polls(spark: SparkSession, d: str) -> DataFrame:
    """Polls of feeds under backoff, with a server's hint for every seventh attempt."""
    rows = J.stream(spark, f"{d}/events.parquet")
    hint = F.when(F.col("event_id") % 7 == 0, F.lit(5400.0))
    attempts = rows.select(F.concat(F.lit("feed/"), F.col("user_id").cast("string")).alias("feed_url"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("failed"), hint.alias("hint_s"))
    out = J.polls(spark, attempts, base=600.0, cap=36000.0)
    return out.select("feed_url", F.col("at").cast("timestamp_ntz").alias("at"), "status", "failure_count", F.col("backoff_until").cast("timestamp_ntz").alias("backoff_until"))


#: Feeds of 5000 documents each; every 50th item is broken, and two items in a row share a URL.
_FEED = "'feed/' || source || '/' || (doc_id // 5000)"
_CYCLES = f"""WITH e AS (SELECT doc_id, source, doc_id % 2 AS c, {_FEED} AS feed_url, doc_id // 2 AS u, lower({_TITLE}) || ' no ' || doc_id || CASE WHEN doc_id % 13 = 0 THEN ' NYSE: QUE' ELSE '' END AS title, doc_id % 50 = 7 AS broken, source = 'src0' OR doc_id % 13 = 0 AS sure,
  TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(doc_id % 28 AS INT)) AS pub FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
good AS (SELECT a.*, a.sure OR coalesce(b.sure AND b.c < a.c, false) AS stored, coalesce(b.sure AND b.c < a.c, false) AS there FROM e a LEFT JOIN e b ON b.u = a.u AND b.doc_id <> a.doc_id AND NOT b.broken WHERE NOT a.broken)"""


def _land_cycle(spark: SparkSession, d: str, path: str, number: int, of: int) -> None:
    """Land the feeds of one cycle: documents whose id leaves ``of`` by 2, a file a feed. A title is HTML inside XML, so plain text is escaped for both."""
    i = F.col("doc_id")
    rows = M.read(spark, d, "documents").where((i % 2 == of) & F.col("source").isNotNull() & F.col("text").isNotNull())
    title = F.concat(_escaped(_escaped(F.lower(F.substring_index("text", "\n", 1)))), F.lit(" no "), i.cast("string"), F.when(i % 13 == 0, " NYSE: QUE").otherwise(""))
    date = F.concat(F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 10:00:00 +0000"))
    good = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>https://www.wire.example/news/"), F.floor(i / 2).cast("string"), F.lit("/?utm_source=rss</link><guid>g"), i.cast("string"), F.lit("</guid><pubDate>"), date, F.lit("</pubDate></item>")
    )
    item = F.regexp_replace(F.when(i % 50 == 7, "<item><title>broken<b></title></item>").otherwise(good), "[\r\n]", " ")
    files = rows.groupBy("source", F.floor(i / 5000).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    rss = F.concat(F.lit("<rss><channel><title>Channel</title>"), F.col("items"), F.lit("</channel></rss>"))
    files.select("source", "part", rss.alias("value")).write.partitionBy("source", "part").text(f"{path}/landed/poll={number}")


def _ingested(spark: SparkSession, d: str) -> C.Tables:
    """Two cycles over documents landed as feeds, and a third in which the last polls come again byte by byte."""
    path = _landed(spark, "cycles")
    source = M.read(spark, d, "documents").where("source is not null")
    feeds = source.select(F.concat(F.lit("feed/"), "source", F.lit("/"), F.floor(F.col("doc_id") / 5000).cast("string")).alias("feed_url"), F.col("source").alias("code"), F.substring("source", 4, 10).cast("bigint").alias("source_id")).distinct()
    feeds = feeds.join(S.registry(spark).drop("feed_url"), "code", "left").select("feed_url", F.col("code").alias("source_code"), "source_id", F.coalesce("policy", F.lit("validated_mapping_required")).alias("policy"), F.coalesce("label", F.lit("Wire")).alias("label"))
    known = M.tickers(spark).where("active").select("symbol", F.col("id").alias("ticker_id"))
    feed_of = lambda p: F.concat_ws("/", F.lit("feed"), F.regexp_extract(p, "source=([^/]+)", 1), F.regexp_extract(p, "part=([0-9]+)", 1))
    cycle = C.Cycle(written(feeds, "feeds"), known, E.profiles(M.tickers(spark)), feed_of, M.GENERAL_SOURCE, "General wire", M.GENERAL_HOST, "2024-02-01 00:00:00")
    for number, of in enumerate((0, 1, 1)):
        _land_cycle(spark, d, path, number, of)
        C.run_cycles(spark, f"{path}/landed", f"{path}/tables", cycle, buckets=16)
    return C.committed(spark, f"{path}/tables", buckets=16)


@query(
    f"""{_CYCLES} SELECT 'https://www.wire.example/news/' || u AS url, arg_max(title, c) AS title, max(pub) AS published_at, count(*) AS n_items, CAST(bool_or(doc_id % 13 = 0) AS INT) AS n_symbols
    FROM good WHERE stored GROUP BY u"""
)
def ingest_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Articles after three cycles, with their raw items and mappings."""
    tables = _ingested(spark, d)
    items = tables.read("raw_items").groupBy("article_id").agg(F.count("*").alias("n_items"))
    symbols = tables.read("mappings").groupBy("article_id").agg(F.count("*").cast("int").alias("n_symbols"))
    rows = tables.read("articles").join(items, F.col("id") == items["article_id"], "left").drop("article_id").join(symbols, F.col("id") == symbols["article_id"], "left")
    return rows.select(F.col("canonical_url").alias("url"), "title", "published_at", "n_items", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


@query(
    f"""{_CYCLES}, seen AS (SELECT feed_url, c, count(*) AS items_seen, count(*) FILTER (broken) AS n_bad FROM e GROUP BY ALL), made AS (SELECT feed_url, c, count(*) FILTER (stored AND NOT there) AS n FROM good GROUP BY ALL)
    SELECT CAST(c AS INT) AS batch, s.feed_url, 'success' AS status, items_seen, coalesce(n, 0) AS items_inserted, CASE WHEN n_bad = 1 THEN 'Skipped 1 malformed entry.' WHEN n_bad > 1 THEN 'Skipped ' || n_bad || ' malformed entries.' ELSE '' END AS error_text FROM seen s LEFT JOIN made m USING (feed_url, c)
    UNION ALL SELECT 2, feed_url, 'success', 0, 0, '' FROM seen WHERE c = 1"""
)
def ingest_run_log(spark: SparkSession, d: str) -> DataFrame:
    """What each poll of each feed brought; a poll of the same bytes brings nothing."""
    return _ingested(spark, d).log("runs").select("batch", "feed_url", "status", "items_seen", "items_inserted", F.coalesce("error_text", F.lit("")).alias("error_text"))
