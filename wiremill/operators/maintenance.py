"""Repair of mappings, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiremill.operators import extract
from wiremill.operators.upsert import merge_mappings
from wiremill.session import written

VERSION = 10
PERSIST, PRESERVE = 0.65, 0.70


def raw_contexts(raw_items: DataFrame, alternates: str | None = None) -> DataFrame:
    """``article_id, context_order, source_id, link, feed_url``: an article's raw items, newest first, and their other feeds."""
    feeds = F.array("feed_url") if alternates is None else F.array_union(F.array("feed_url"), F.coalesce(alternates, F.array().cast("array<string>")))
    return raw_items.where("article_id is not null").select("article_id", (-F.col("id")).alias("context_order"), "source_id", F.col("raw_link").alias("link"), F.explode(feeds).alias("feed_url"))


def stale_articles(mappings: DataFrame, version: int = VERSION, limit: int | None = None) -> DataFrame:
    """Articles with a mapping of an older extraction, newest first; ``limit`` is the size of a maintenance pass."""
    rows = mappings.where(F.col("extraction_version") < version).select("article_id").distinct()
    return rows if limit is None else rows.orderBy(F.desc("article_id")).limit(limit)


def preserved_mapping() -> Column:
    """Whether a mapping (with ``active`` of its symbol) is good enough to stay without a new look."""
    return (F.col("confidence") >= PRESERVE) & (F.col("match_type") != "token") & F.coalesce("active", F.lit(False))


def mapping_facts(mappings: DataFrame, tickers: DataFrame) -> DataFrame:
    """Per mapped article what a purge looks at."""
    rows = mappings.join(tickers.select(F.col("id").alias("ticker_id"), "active"), "ticker_id", "left")
    keep = preserved_mapping()
    return rows.groupBy("article_id").agg(
        F.max("confidence").alias("best"), F.bool_or(F.col("match_type") == "token").alias("has_token"), F.bool_or(F.col("extraction_version") < VERSION).alias("stale"),
        F.count("*").alias("n"), F.count_if(keep).alias("preserved"), F.count_if(~keep & (F.col("match_type") != "token")).alias("doubtful"),
    )


def suspects(mappings: DataFrame, tickers: DataFrame, raw_items: DataFrame, general_source: int) -> DataFrame:
    """Mapped articles that look wrong, with their :func:`mapping_facts`.

    These are those with raw items, none of the general source, whose best
    confidence is under the threshold, or with a token mapping, or a stale one.
    """
    items = raw_items.where("article_id is not null").groupBy("article_id").agg(F.bool_or(F.col("source_id") == general_source).alias("general"))
    return mapping_facts(mappings, tickers).where((F.col("best") < PERSIST) | F.col("has_token") | F.col("stale")).join(items.where("not general"), "article_id").drop("general")


def purge_plan(looked: DataFrame, fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """``article_id, action`` of the articles that :func:`suspects` found.

    ``fresh``: ``article_id`` with links by a new extraction; ``pages``:
    ``article_id`` with a landed page. In order: all doubtful ones are tokens
    beside preserved ones: keep those (``preserve``); new links: ``apply``;
    preserved ones but no page: ``stamp``; else ``clear``.
    """
    for name, ids in (("fresh", fresh), ("page", pages)):
        looked = looked.join(ids.select("article_id").distinct().withColumn(name, F.lit(True)), "article_id", "left")
    some = F.col("preserved") > 0
    action = F.when(some & (F.col("doubtful") == 0) & (F.col("preserved") < F.col("n")), "preserve").when(F.col("fresh"), "apply").when(some & F.col("page").isNull(), "stamp").otherwise("clear")
    return looked.select("article_id", action.alias("action"))


def stop_contexts(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hits of an article's contexts up to the first at which all its stored symbols are verified (a purge looks no further).

    ``hits``: ``article_id, context_order, symbol``; ``wanted``: ``article_id, symbol``.
    """
    first = hits.join(wanted, ["article_id", "symbol"]).groupBy("article_id", "symbol").agg(F.min("context_order").alias("at"))
    need = wanted.groupBy("article_id").agg(F.count("*").alias("need"))
    done = first.groupBy("article_id").agg(F.count("*").alias("n"), F.max("at").alias("stop")).join(need, "article_id").where("n = need").select("article_id", "stop")
    return hits.join(done, "article_id", "left").where("stop is null or context_order <= stop").drop("stop")


def revalidation_plan(articles: DataFrame, links: DataFrame, mappings: DataFrame, general_ids: DataFrame) -> DataFrame:
    """``id, action, added, dropped``: keep with the new links; without any, prune articles of the general source and delete others."""
    new = links.groupBy("id").agg(F.collect_set("ticker_id").alias("new"))
    old = mappings.groupBy(F.col("article_id").alias("o_id")).agg(F.collect_set("ticker_id").alias("old"))
    rows = articles.select("id").join(new, "id", "left").join(old, F.col("id") == F.col("o_id"), "left")
    rows = rows.join(general_ids.select(F.col("article_id").alias("g_id")).distinct(), F.col("id") == F.col("g_id"), "left")
    empty = F.array().cast("array<int>")
    a, b = F.coalesce("new", empty), F.coalesce("old", empty)
    action = F.when(F.size(a) > 0, "kept").when(F.col("g_id").isNotNull(), "pruned").otherwise("deleted")
    return rows.select("id", action.alias("action"), F.size(F.array_except(a, b)).cast("bigint").alias("added"), F.size(F.array_except(b, a)).cast("bigint").alias("dropped"))


def revalidate_stale(mappings: DataFrame, links: DataFrame, with_items: DataFrame) -> DataFrame:
    """Mappings after stale articles were looked at again: new links are added or replace old ones, all are stamped.

    Articles without raw items are only stamped; those without new links stay as they are.
    """
    old = stale_articles(mappings).join(with_items.select("article_id").distinct().withColumn("item", F.lit(True)), "article_id", "left")
    found = links.select("article_id").distinct().withColumn("found", F.lit(True))
    plan = old.join(found, "article_id", "left").withColumn("stamp", F.col("item").isNull() | F.col("found").isNotNull()).where("stamp").select("article_id", F.coalesce("item", F.lit(False)).alias("item"))
    new = links.join(plan.where("item"), "article_id", "left_semi").select("article_id", "ticker_id", F.col("match_type").alias("n_type"), F.col("confidence").alias("n_conf"))
    rows = mappings.join(new, ["article_id", "ticker_id"], "full_outer").join(plan.select("article_id", F.lit(True).alias("stamp")), "article_id", "left")
    version = F.when(F.col("stamp"), VERSION).otherwise(F.col("extraction_version")).cast("int")
    pick = {"match_type": F.coalesce("n_type", "match_type"), "confidence": F.coalesce("n_conf", "confidence"), "extraction_version": version}
    return rows.select(*[pick.get(c, F.col(c)).alias(c) for c in mappings.columns])


def reextracted(contexts: DataFrame, articles: DataFrame, known: DataFrame, profile: DataFrame, pages: DataFrame | None = None, policies: DataFrame | None = None, wanted: DataFrame | None = None, table_type: str = "table") -> DataFrame:
    """``article_id, symbol, match_type, confidence``: links of articles found anew in their raw contexts.

    ``contexts`` as of :func:`raw_contexts`, looked at from the newest on: first
    an article's own texts with the context's link and feed, then the landed
    page of the link (``pages``: ``link, html``), both verified by the policy
    of the context's source (``policies``: ``source_id, policy``). The highest
    confidence counts, of equal ones the first. With ``wanted`` (``article_id,
    symbol``), an article's later contexts don't count once all of its wanted
    symbols are verified, as in a purge.
    """
    rows = contexts.join(articles.select(F.col("id").alias("article_id"), "title", "summary", "canonical_url"), "article_id")
    rows = rows.select(F.struct("article_id", "context_order", "feed_url").alias("id"), "source_id", "title", "summary", F.coalesce("link", "canonical_url").alias("link"), "feed_url")
    found = extract.decided(rows, known, profile).withColumn("step", F.lit(0))
    if pages is not None:
        found = found.unionByName(extract.page_evidence(rows.join(pages, "link"), known, profile, table_type).withColumn("step", F.lit(1)))
    found = found.join(rows.select("id", "source_id"), "id")
    if policies is not None:
        found = found.join(policies, "source_id", "left")
        found = extract.verified(found, F.coalesce("policy", F.lit("validated_mapping_required")))
    else:
        found = extract.verified(found)
    hits = found.select("id.article_id", (2 * F.col("id.context_order") + F.col("step")).alias("context_order"), "symbol", "match_type", "confidence")
    if wanted is not None:
        hits = stop_contexts(written(hits, "context-hits"), wanted)
    top = hits.groupBy("article_id", "symbol").agg(F.max_by(F.struct("match_type", "confidence"), F.struct("confidence", -F.col("context_order"), F.col("match_type"))).alias("b"))
    return top.select("article_id", "symbol", "b.match_type", "b.confidence")


def applied(articles: DataFrame, mappings: DataFrame, raw_items: DataFrame, actions: DataFrame, links: DataFrame, prune: bool = True, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The next articles, mappings and raw items after a revalidation, and its counts.

    ``actions``: ``article_id, action``: ``kept`` takes over ``links``
    (``article_id, ticker_id, match_type, confidence``) and with ``prune`` loses
    mappings that these lack; ``pruned`` loses its mappings; ``deleted`` also
    goes itself, and its raw items are detached. Other articles stay as they are.
    """
    of = lambda what: actions.where(F.col("action") == what).select("article_id")
    gone = actions.where(F.col("action").isin("pruned", "deleted")).select("article_id")
    new = links.join(of("kept"), "article_id", "left_semi").withColumn("extraction_version", F.lit(VERSION))
    left = mappings.join(gone, "article_id", "left_anti")
    next_mappings = merge_mappings(left, new, force=force, prune=of("kept") if prune else None)
    dead = of("deleted").withColumnRenamed("article_id", "d_id")
    next_articles = articles.join(dead, F.col("id") == F.col("d_id"), "left_anti")
    items = raw_items.join(dead, F.col("article_id") == F.col("d_id"), "left")
    next_items = items.select(*[F.when(F.col("d_id").isNull(), F.col("article_id")).alias("article_id") if c == "article_id" else F.col(c) for c in raw_items.columns])
    keys = ["article_id", "ticker_id"]
    counts = actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("kept", "pruned", "deleted")])
    counts = counts.crossJoin(mappings.join(next_mappings.select(*keys), keys, "left_anti").agg(F.count("*").alias("mappings_deleted")))
    counts = counts.crossJoin(raw_items.join(dead, F.col("article_id") == F.col("d_id"), "left_semi").agg(F.count("*").alias("raw_items_detached")))  # one row each
    return next_articles, next_mappings, next_items, counts


def purged(articles: DataFrame, mappings: DataFrame, raw_items: DataFrame, tickers: DataFrame, plan: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The next tables after a :func:`purge_plan`, and counts.

    ``preserve`` leaves an article with its good mappings only, ``apply`` with
    the new ``links``, both stamped with the present version; ``stamp`` stamps
    the good ones and leaves the rest for another look; ``clear`` deletes the
    article and detaches its raw items.
    """
    good = mappings.join(tickers.select(F.col("id").alias("ticker_id"), "active"), "ticker_id", "left").where(preserved_mapping()).select(*mappings.columns)
    of = lambda *what: plan.where(F.col("action").isin(*what)).select("article_id")
    kept = good.join(of("preserve"), "article_id", "left_semi").select("article_id", "ticker_id", "match_type", "confidence")
    new = links.join(of("apply"), "article_id", "left_semi").select("article_id", "ticker_id", "match_type", "confidence")
    action = F.when(F.col("action").isin("preserve", "apply"), "kept").when(F.col("action") == "clear", "deleted").otherwise("left")
    out = applied(articles, mappings, raw_items, plan.select("article_id", action.alias("action")), kept.unionByName(new))
    marks = good.join(of("stamp"), "article_id", "left_semi").union(out[1].select(*mappings.columns).join(of("preserve", "apply"), "article_id", "left_semi")).select("article_id", "ticker_id").distinct().withColumn("stamp", F.lit(True))
    rows = out[1].join(marks, ["article_id", "ticker_id"], "left")
    version = F.when(F.col("stamp"), F.greatest("extraction_version", F.lit(VERSION))).otherwise(F.col("extraction_version")).cast("int")
    next_mappings = rows.select(*[version.alias(c) if c == "extraction_version" else F.col(c) for c in mappings.columns])
    return out[0], next_mappings, out[2], out[3]


def remapped(mappings: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mappings after the articles in ``chosen`` (``article_id``) were looked at anew: links are added or raised; an article without any stays as it is."""
    new = links.join(chosen.select("article_id").distinct(), "article_id", "left_semi").withColumn("extraction_version", F.lit(VERSION))
    return merge_mappings(mappings, new)


def remap_candidates(articles: DataFrame, raw_items: DataFrame, mappings: DataFrame, source_id: int, only_unmapped: bool = True, limit: int = 500) -> DataFrame:
    """The newest articles of a source (``limit`` is the size of a pass), optionally unmapped ones only."""
    own = raw_items.where(F.col("source_id") == source_id)
    rows = articles.join(own, articles["id"] == own["article_id"], "left_semi")
    if only_unmapped:
        rows = rows.join(mappings, rows["id"] == mappings["article_id"], "left_anti")
    return rows.orderBy(F.desc("published_at"), F.desc("id")).limit(limit)


def retained(raw_items: DataFrame, now: str, days: int = 30, most: int = 25_000) -> DataFrame:
    """Raw items after a pass of retention: detached ones fetched over ``days`` ago go, the lowest ids first, ``most`` at most in a pass."""
    old = raw_items.where(F.col("article_id").isNull() & (F.col("fetched_at") < F.timestamp_add("DAY", F.lit(-days), F.lit(now).cast("timestamp_ntz"))))
    return raw_items.join(old.orderBy("id").limit(most).select("id"), "id", "left_anti")


def mark_alerted(articles: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Set the first alert time of the given articles once."""
    wanted = ids.select(F.col("id").alias("w_id")).distinct()
    rows = articles.join(wanted, F.col("id") == F.col("w_id"), "left")
    at: Column = F.when(F.col("w_id").isNotNull(), F.coalesce("first_alert_sent_at", F.lit(now).cast("timestamp_ntz"))).otherwise(F.col("first_alert_sent_at"))
    return rows.withColumn("first_alert_sent_at", at).drop("w_id")


def alert_counts(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """``requested, marked``: different ids given, and those among them that :func:`mark_alerted` marks."""
    wanted = ids.select("id").distinct()
    new = articles.where("first_alert_sent_at is null").join(wanted, "id", "left_semi")
    return wanted.agg(F.count("*").alias("requested")).crossJoin(new.agg(F.count("*").alias("marked")))  # one row each


def newest_read_keys(reads: DataFrame, most: int = 20_000) -> DataFrame:
    """Each reader's last ``most`` keys by time of reading (the limit is the feature).

    Days are added up from the newest on first; only a day's reads are put in
    order, so no task holds a reader's history.
    """
    rows = reads.withColumn("day", F.to_date("ts"))
    newer = F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = rows.groupBy("user_id", "day").agg(F.count("*").alias("n")).withColumn("newer", newer).where(F.col("newer") < most).drop("n")
    place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.join(days, ["user_id", "day"]).withColumn("place", place).where(F.col("newer") + F.col("place") <= most).drop("day", "newer", "place")
