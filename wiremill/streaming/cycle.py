"""The ingest cycle as one stream: landed feed files in, articles, raw items, mappings, run log and quarantine out.

Each micro-batch is a cycle. A file is one poll of a feed. One whose bytes are
those of the feed's poll before is a successful run without items; otherwise
its items are parsed, malformed ones are set aside with file and reason, entries
are linked, gated by their feed's policy, matched with stored articles and
merged. All tables are :class:`~wiremill.streaming.tables.Tables`: a batch reads
and writes the buckets that its keys fall into. Keys of articles (URL, title)
and of raw items (guid, link) are tables of their own, so that what an entry may
match is found without reading what it can't.

New articles and raw items get ids that are hashes of what identifies them, so a
batch that runs again makes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.functions import text as T
from wiremill.operators import extract as E
from wiremill.operators import upsert as U
from wiremill.session import written
from wiremill.sources import feeds as S
from wiremill.streaming.tables import Tables, last_batch

ARTICLE = (
    "id bigint, title string, summary string, published_at timestamp_ntz, created_at timestamp_ntz, source_name string, provider_name string, canonical_url string, "
    "canonical_url_hash string, title_hash string, cluster_key string, content_hash string"
)
RAW = "id bigint, source_id bigint, article_id bigint, feed_url string, raw_guid string, raw_title string, raw_link string, raw_pub_date timestamp_ntz, fetched_at timestamp_ntz, alt_feeds string"
SCHEMAS = {
    "articles": ARTICLE,
    "article_keys": "key string, kind string, id bigint, title_hash string, canonical_url_hash string, published_at timestamp_ntz, source_id bigint",
    "raw_items": RAW,
    "raw_keys": "key string, id bigint, article_id bigint",
    "mappings": "article_id bigint, ticker_id int, match_type string, confidence double, extraction_version int",
    "ledger": "feed_url string, digest string",
    "runs": "feed_url string, file string, status string, items_seen bigint, items_inserted bigint, error_text string, started_at timestamp_ntz",
    "quarantine": "feed_url string, file string, place int, reason string, item string",
}


@dataclass(frozen=True)
class Cycle:
    """What a cycle needs to know beside the files.

    ``feeds``: ``feed_url, source_code, source_id, policy, label``; ``known``:
    ``symbol, ticker_id`` of active symbols; ``general``: code of the source
    whose articles titles don't match, and its label; ``profile`` as of
    :func:`~wiremill.operators.extract.profiles`; ``feed_of``: a file's feed by
    its path.
    """

    feeds: DataFrame
    known: DataFrame
    profile: DataFrame
    feed_of: Callable[[Column], Column]
    general: str
    general_label: str
    exact_host: str
    now: str
    hours: int = 48
    version: int = 10


def changed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """``files`` (feed_url, file, at, digest) with ``fresh``: whether the bytes differ from the feed's poll before, in this batch or the ledger's last."""
    order = F.struct("at", "file")
    before = files.groupBy("feed_url").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "digest"))).alias("polls"))  # the polls of one feed in one batch
    rows = files.join(before, "feed_url").join(ledger.withColumnRenamed("digest", "held"), "feed_url", "left")
    earlier = F.filter("polls", lambda p: p["o"] < order)
    last = F.coalesce(F.try_element_at(earlier, F.lit(-1))["digest"], F.col("held"))
    return rows.withColumn("fresh", ~F.col("digest").eqNullSafe(last)).drop("polls", "held")


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of ``files`` (with ``content``), and those that are malformed as ``feed_url, file, place, reason, item``; parsed once and written, as several tables need them.

    A file's items and title are cut out of it before it is dealt into items,
    so no item's row carries its whole file.
    """
    text = F.decode("content", "UTF-8")
    items = F.regexp_extract_all(text, F.lit(r"(?s)<item\b[^>]*>.*?(?:</item\s*>|(?=<item\b)|(?=</channel\b)|$)"), F.lit(0))
    title = F.regexp_extract(F.substring_index(text, "<item", 1), r"(?s)<title[^>]*>(.*?)</title", 1)
    own = [c for c in files.columns if c != "content"]
    rows = files.select(*own, title.alias("head"), items.alias("items")).select(*own, "head", F.posexplode_outer("items").alias("place", "item"))  # outer: else items are cut out again for a filter
    rows = rows.where("item is not null").select(*own, T.clean_summary(F.col("head")).alias("feed_title"), "place", "item")
    made = rows.withColumn("x", F.from_xml("item", f"{S.ITEM}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    broken = F.col("x").isNull() | F.col("x._broken").isNotNull()
    made = written(made.withColumns({"bad": broken, "item": F.when(broken, F.col("item"))}), "parsed-items")
    bad = made.where("bad").select("feed_url", "file", "place", F.lit("not well-formed").alias("reason"), "item")
    return made.where("not bad").select(*[c for c in rows.columns if c != "item"], *[f"x.{f.split()[0]}" for f in S.ITEM.split(", ")]), bad


def entries_of(items: DataFrame, cycle: Cycle) -> DataFrame:
    """Prepared entries with the columns of articles and raw items."""
    out = S.prepare(items, cycle.now, english_only=True, english_source=cycle.general, exact_host=cycle.exact_host)
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    own = F.sha2(T.normalize_title(F.col("title"), entities=False), 256)
    out = out.withColumns({"title_hash": own, "canonical_url_hash": F.sha2("article_url", 256), "published_at": ntz("published_at"), "raw_pub_date": ntz("raw_pub_date")})
    out = out.withColumns({
        "content_hash": U.content_hash(own, T.normalize_title(F.col("summary"), entities=False)), "cluster_key": own, "source_name": S.source_label(F.col("source_code"), F.col("feed_title"), F.col("label")),
        "provider_name": F.col("provider"), "canonical_url": F.col("article_url"), "created_at": F.lit(cycle.now).cast("timestamp_ntz"), "fetched_at": F.lit(cycle.now).cast("timestamp_ntz"),
        "id": F.xxhash64("source_code", F.coalesce("raw_guid", F.lit("")), "link", F.coalesce(F.col("raw_pub_date").cast("string"), F.lit(""))),
    })
    return out.dropDuplicates(["id"])


def keys_of(items: DataFrame) -> DataFrame:
    """``key`` and the other columns, a row per guid and link by which a raw item is found inside its source."""
    key = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat_ws("|", F.col("source_id").cast("string"), F.lit(kind), c))
    keys = F.filter(F.array(key("g", "raw_guid"), key("l", "raw_link")), lambda k: k.isNotNull())
    return items.select(F.explode(keys).alias("key"), *[c for c in ("id", "article_id") if c in items.columns])


def run_batch(files: DataFrame, number: int, root: str, cycle: Cycle, buckets: int = 64, stop_after: str | None = None) -> None:
    """One cycle over ``files`` (``path, modificationTime, content``) as batch ``number``; ``stop_after`` breaks off behind a table, for tests."""
    spark = files.sparkSession
    tables = Tables(spark, root, number, SCHEMAS, buckets)

    def put(name: str, rows: DataFrame, key: str, touched: list[int]) -> DataFrame:
        out = tables.write(name, rows, key, touched)
        if stop_after == name:
            raise RuntimeError(f"stopped behind {name}")
        return out

    contents = files.select(F.col("path").alias("file"), "content")
    polls = files.select(cycle.feed_of(F.col("path")).alias("feed_url"), F.col("path").alias("file"), F.col("modificationTime").alias("at"), F.sha2("content", 256).alias("digest"))
    touched = tables.buckets_of(polls.select("feed_url"))
    ledger = tables.read("ledger", touched)
    # Without their contents; those of fresh polls are read once more and are neither dealt nor written.
    polls = written(changed(polls, ledger).join(F.broadcast(cycle.feeds.select("feed_url", "source_code", "source_id", "policy", "label")), "feed_url"), "polls")
    newest = polls.groupBy("feed_url").agg(F.max_by("digest", F.struct("at", "file")).alias("digest"))
    put("ledger", ledger.join(newest, "feed_url", "left_anti").unionByName(newest), "feed_url", touched)

    items, bad = parsed(contents.join(polls.where("fresh"), "file"))
    tables.append("quarantine", bad)
    entries = written(entries_of(items, cycle), "entries")
    # Entries whose guid, or link and date, are recorded with an article are old news.
    raw_own = keys_of(entries.select("source_id", "raw_guid", F.col("link").alias("raw_link"))).select("key").distinct()
    raw_buckets = tables.buckets_of(raw_own)
    raw_keys = tables.read("raw_keys", raw_buckets)
    near_raw = written(raw_keys.join(raw_own, "key", "left_semi").select("id").distinct(), "near-items")
    near_items = tables.read("raw_items", tables.buckets_of(near_raw)).join(near_raw, "id", "left_semi")
    entries = written(U.unrecorded(entries.withColumn("raw_link", F.col("link")), near_items).drop("raw_link"), "new-entries")
    links = E.links(entries.select("id", "title", "summary", "link", "feed_url"), cycle.known, cycle.profile)
    links = written(links, "entry-links")

    # What entries may match: articles of their URL or title, raw items of their guid or link.
    own_keys = entries.select(F.explode(F.array(F.concat(F.lit("u:"), "canonical_url_hash"), F.concat(F.lit("t:"), "title_hash"))).alias("key")).distinct()
    key_buckets = tables.buckets_of(own_keys)
    article_keys = tables.read("article_keys", key_buckets)
    near = written(article_keys.join(own_keys, "key", "left_semi"), "near-articles")
    stored = near.groupBy("id").agg(F.first("title_hash").alias("title_hash"), F.first("canonical_url_hash").alias("canonical_url_hash"), F.max("published_at").alias("published_at"), F.first("source_id").alias("source_id"))
    general_id = cycle.feeds.where(F.col("source_code") == cycle.general).agg(F.max("source_id").alias("g"))
    with_items = stored.join(F.broadcast(general_id)).select(F.col("id").alias("article_id"), (F.col("source_id") == F.col("g")).alias("from_general"))  # one row
    known_urls = near.where("kind = 'u'").select(F.col("canonical_url_hash").alias("h")).distinct()
    exact = entries.where("exact").join(known_urls, F.col("canonical_url_hash") == F.col("h"), "left_semi").select("id")
    passed = written(E.gate(entries.withColumn("source_policy", F.col("policy")), links, exact, scoped=True), "gated-entries")
    matches = written(U.match_articles(passed, stored, with_items, cycle.general_label, cycle.hours), "matches")

    # An entry without a match stands for itself or for another of this batch.
    new = passed.join(matches.where("how = 'new'"), passed["id"] == F.col("entry_id"), "left_semi")
    stands = written(U.fold_new(new, cycle.general_label, cycle.hours), "stands")
    article_of = matches.join(stands, F.col("entry_id") == F.col("id"), "left").select("entry_id", F.coalesce("matched", "first").alias("article_id"), F.col("matched").isNotNull().alias("was_there"))
    article_of = written(article_of, "article-of")
    article_buckets = tables.buckets_of(article_of.select("article_id"))
    articles = tables.read("articles", article_buckets)
    articles = put("articles", U.upsert_articles(articles, passed, matches, cycle.general_label), "id", article_buckets)

    changed_ids = article_of.select(F.col("article_id").alias("id")).distinct()
    first_source = passed.join(article_of, passed["id"] == F.col("entry_id")).groupBy("article_id").agg(F.min_by("source_id", "entry_id").alias("source_id"))
    now_keys = articles.join(changed_ids, "id", "left_semi").join(first_source, F.col("id") == F.col("article_id"))
    fresh_keys = now_keys.select(
        F.explode(F.array(F.struct(F.concat(F.lit("u:"), "canonical_url_hash").alias("key"), F.lit("u").alias("kind")), F.struct(F.concat(F.lit("t:"), "title_hash").alias("key"), F.lit("t").alias("kind")))).alias("k"),
        "id", "title_hash", "canonical_url_hash", "published_at", "source_id",
    ).select("k.*", "id", "title_hash", "canonical_url_hash", "published_at", "source_id")
    # A key of an article that was there may lie in a bucket that no entry's key falls into.
    more = [b for b in tables.buckets_of(fresh_keys.select("key")) if b not in key_buckets]
    held = article_keys.unionByName(tables.read("article_keys", more)) if more else article_keys
    kept = held.join(fresh_keys.select("key", "id").withColumn("again", F.lit(True)), ["key", "id"], "left_anti")
    put("article_keys", kept.unionByName(fresh_keys), "key", key_buckets + more)

    raw = passed.join(article_of, passed["id"] == F.col("entry_id")).select("id", "source_id", "article_id", "feed_url", "raw_guid", F.col("title").alias("raw_title"), F.col("link").alias("raw_link"), "raw_pub_date", "fetched_at")
    raw = written(raw, "raw-batch")
    item_buckets = tables.buckets_of(near_raw.unionByName(raw.select("id")))
    items_before = tables.read("raw_items", item_buckets)
    items_now = put("raw_items", U.merge_raw(items_before, raw).drop("action"), "id", item_buckets)
    batch_items = items_now.join(raw.select("id").unionByName(near_raw).distinct(), "id", "left_semi")
    new_keys = keys_of(batch_items)
    extra = [b for b in tables.buckets_of(new_keys.select("key")) if b not in raw_buckets]
    held_raw = raw_keys.unionByName(tables.read("raw_keys", extra)) if extra else raw_keys
    put("raw_keys", held_raw.join(new_keys.select("key", "id"), ["key", "id"], "left_anti").unionByName(new_keys), "key", raw_buckets + extra)

    found = E.verified(links.join(passed.select("id", "policy"), "id"), F.col("policy")).join(F.broadcast(cycle.known.select("symbol", "ticker_id")), "symbol")
    found = found.join(article_of, F.col("id") == F.col("entry_id")).select("article_id", "ticker_id", "match_type", "confidence", F.lit(cycle.version).alias("extraction_version"))
    map_buckets = tables.buckets_of(article_of.select("article_id"))
    mappings = tables.read("mappings", map_buckets)
    hits = E.verified(links.join(passed.select("id", "policy"), "id"), F.col("policy")).select("id")
    prune = U.prunable(passed.select("id", "policy", "exact"), matches, hits)
    put("mappings", U.merge_mappings(mappings, found, prune=prune), "article_id", map_buckets)

    # One article that several entries of a batch made counts for the entry that stands for it.
    made = article_of.where("not was_there and entry_id = article_id").select(F.col("entry_id").alias("id"), F.lit(True).alias("made"))
    seen = items.select("file", "place").unionByName(bad.select("file", "place")).groupBy("file").agg(F.count("*").alias("items_seen"))
    inserted = passed.join(made, "id").groupBy("file").agg(F.count("*").alias("items_inserted"))
    skipped = bad.groupBy("file").agg(F.count("*").alias("n"))
    log = polls.select("feed_url", "file").join(seen, "file", "left").join(inserted, "file", "left").join(skipped, "file", "left")
    error = F.when(F.col("n") == 1, "Skipped 1 malformed entry.").when(F.col("n") > 1, F.concat(F.lit("Skipped "), F.col("n").cast("string"), F.lit(" malformed entries.")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    tables.append("runs", log.select("feed_url", "file", F.lit("success").alias("status"), zero("items_seen"), zero("items_inserted"), error.alias("error_text"), F.lit(cycle.now).alias("started_at")))
    tables.commit()


def run_cycles(spark: SparkSession, landing: str, root: str, cycle: Cycle, files_per_batch: int | None = None, buckets: int = 64) -> None:
    """Run cycles over the files that have landed since the last call; a batch that was not committed runs again first.

    All of them are one cycle, however many feeds there are, unless ``files_per_batch`` says how many go into one.
    """
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    rows = source.schema("path string, modificationTime timestamp, length bigint, content binary").load(landing)

    def sink(batch: DataFrame, number: int) -> None:
        run_batch(batch, number, root, cycle, buckets)

    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, root: str, buckets: int = 64) -> Tables:
    """The tables as the last committed batch left them."""
    return Tables(spark, root, last_batch(spark, root) + 1, SCHEMAS, buckets)
