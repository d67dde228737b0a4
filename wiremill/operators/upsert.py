"""Merges of a batch into a stored table; each returns the new table, to be written as its next version.

Columns of the stored table that a merge says nothing about stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiremill.operators.dedupe import anchors


def raw_key() -> Column:
    """Identity of a raw item inside its source: the guid, else link and date, else the link."""
    date = F.col("raw_pub_date").cast("string")
    by_link = F.when(F.col("raw_pub_date").isNotNull(), F.concat(F.lit("d:"), "raw_link", F.lit("|"), date)).otherwise(F.concat(F.lit("l:"), "raw_link"))
    return F.concat_ws("|", F.col("source_id").cast("string"), F.when(F.col("raw_guid").isNotNull(), F.concat(F.lit("g:"), "raw_guid")).otherwise(by_link))


def _age() -> Column:
    """What orders raw items: the time of fetching (none comes first), then the id."""
    return F.struct(F.coalesce("fetched_at", F.lit("1900-01-01").cast("timestamp_ntz")), "id")


def _feeds(items: DataFrame) -> DataFrame:
    """Raw items with ``feeds``: all feeds that they were seen in."""
    own = F.array("feed_url")
    return items.withColumn("feeds", F.array_union(own, F.split("alt_feeds", ",")) if "alt_feeds" in items.columns else own)


def _alternates(feeds: Column, own: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(feeds, lambda f: (f != own) & (f != "")))), ",")


def _survivors(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the newest; the newest article id there is; all feeds."""
    out = items.groupBy(*keys).agg(
        F.max_by(F.struct(*items.columns), _age()).alias("r"), F.max_by("article_id", F.when(F.col("article_id").isNotNull(), _age())).alias("a"), F.flatten(F.collect_set("feeds")).alias("all")
    )
    return out.select(*[{"article_id": F.col("a"), "feeds": F.array_distinct("all")}.get(c, F.col(f"r.{c}")).alias(c) for c in items.columns])


def dedupe_raw(items: DataFrame) -> DataFrame:
    """Raw items after three passes, each over what the one before left: one item per guid, per link and date, and per link of those with neither.

    The survivor is the newest; it has an article if any of them had one, and
    ``alt_feeds``, the other feeds that they were seen in.
    """
    rows = _feeds(items)
    for keys, has in (
        (["source_id", "raw_guid"], F.col("raw_guid").isNotNull()),
        (["source_id", "raw_link", "raw_pub_date"], F.col("raw_link").isNotNull() & F.col("raw_pub_date").isNotNull()),
        (["source_id", "raw_link"], F.col("raw_link").isNotNull() & F.col("raw_guid").isNull() & F.col("raw_pub_date").isNull()),
    ):
        rows = _survivors(rows.where(has), keys).unionByName(rows.where(~has))
    return rows.withColumn("alt_feeds", _alternates(F.col("feeds"), F.col("feed_url"))).drop("feeds")


def stored_item(entries: DataFrame, items: DataFrame, attached: bool | None = None) -> DataFrame:
    """``entry_id, item_id``: the stored raw item of each entry, null without one.

    Rules in order, inside a source: same guid; same link and both undated;
    same link and neither has a guid (undated entries without one only); same
    link and date; same link, the item having neither guid nor date (not with
    ``attached``). Of several items, one with an article comes first, then the
    highest id. ``attached`` restricts items to those with or without an
    article. Items are folded per key first, so no entry meets more than one
    row a rule.
    """
    if attached is not None:
        items = items.where(F.col("article_id").isNotNull() if attached else F.col("article_id").isNull())
    undated = F.col("raw_pub_date").isNull()
    bare = F.col("raw_guid").isNull()
    rules = [
        (["raw_guid"], ~bare, ~bare),
        (["raw_link"], undated, undated),
        (["raw_link"], bare, undated & bare),
        (["raw_link", "raw_pub_date"], ~undated, ~undated),
        *([(["raw_link"], bare & undated, F.lit(True))] if attached is not True else []),
    ]
    top = F.max(F.struct(F.col("article_id").isNotNull(), F.col("id")))["id"]
    rows = entries.select(F.col("id").alias("entry_id"), "source_id", "raw_guid", "raw_link", "raw_pub_date")
    for i, (keys, of_item, of_entry) in enumerate(rules):
        held = items.where(of_item).groupBy("source_id", *keys).agg(top.alias(f"r{i}"))
        held = held.select(f"r{i}", *[F.col(k).alias(f"k_{k}") for k in ("source_id", *keys)])
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"k_{k}") for k in ("source_id", *keys)])
        rows = rows.join(held, same & of_entry, "left").drop(*[f"k_{k}" for k in ("source_id", *keys)])
    return rows.select("entry_id", F.coalesce(*[F.col(f"r{i}") for i in range(len(rules))]).alias("item_id"))


def merge_raw(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored items with a batch merged in, each entry into its :func:`stored_item`.

    New feed, title, link and further columns replace old ones; article, guid
    and date only fill or replace with values; the newest of several entries
    counts. Entries without a stored item are folded by :func:`raw_key` and
    inserted. ``action`` says what became of each row.
    """
    old, new = _feeds(target), _feeds(batch)
    met = new.join(stored_item(batch, target), new["id"] == F.col("entry_id")).drop("entry_id")
    filled = ("article_id", "raw_guid", "raw_pub_date")
    names = [c for c in new.columns if c not in ("id", "feeds", "source_id")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), _age())).alias(f"n_{c}") for c in filled]
    news = met.where("item_id is not null").groupBy("item_id").agg(F.max_by(F.struct(*names), _age()).alias("n"), *last, F.array_distinct(F.flatten(F.collect_set("feeds"))).alias("n_feeds"))
    rows = old.join(news, old["id"] == news["item_id"], "left")
    fresh = F.col("item_id").isNotNull()
    pick = {c: F.coalesce(f"n_{c}", c) if c in filled else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(c)) for c in names if c in old.columns}
    pick["feeds"] = F.array_union("feeds", F.coalesce("n_feeds", F.array().cast("array<string>")))
    kept = rows.select(*[pick.get(c, F.col(c)).alias(c) for c in old.columns], F.when(fresh, "updated").otherwise("kept").alias("action"))
    added = met.where("item_id is null").drop("item_id").withColumn("key", raw_key())
    added = _survivors(added, ["key"]).withColumn("action", F.lit("inserted"))
    out = kept.unionByName(added.select(*[c for c in kept.columns if c in added.columns]), allowMissingColumns=True)
    return out.withColumn("alt_feeds", _alternates(F.col("feeds"), F.col("feed_url"))).drop("feeds")


def unrecorded(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Entries without an attached stored item by guid, link and date, or bare link.

    An entry with neither guid nor date whose URL is exact (column ``exact``,
    if there is one) may refresh its article and always stays.
    """
    known = stored_item(entries, items, attached=True).where("item_id is not null").select("entry_id")
    gone = entries.join(known, entries["id"] == known["entry_id"], "left_anti")
    if "exact" not in entries.columns:
        return gone
    free = F.coalesce("exact", F.lit(False)) & F.col("raw_guid").isNull() & F.col("raw_pub_date").isNull()
    return gone.where(~free).unionByName(entries.where(free))


def detached_repeats(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Entries that equal a detached item in every stored field: only its fetch time has to be refreshed."""
    same = ("source_id", "feed_url", "raw_guid", "raw_title", "raw_link", "raw_pub_date")
    held = items.where("article_id is null").select(*[F.col(c).alias(f"h_{c}") for c in same])
    return entries.join(held, F.expr(" and ".join(f"{c} <=> h_{c}" for c in same)), "left_semi")


def refresh_detached(items: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """Stored items, detached ones that entries repeat in every stored field fetched ``now``; nothing else of them changes."""
    same = ("source_id", "feed_url", "raw_guid", "raw_title", "raw_link", "raw_pub_date")
    again = entries.select(*[F.col(c).alias(f"a_{c}") for c in same]).distinct().withColumn("again", F.lit(True))
    rows = items.join(again, F.col("article_id").isNull() & F.expr(" and ".join(f"{c} <=> a_{c}" for c in same)), "left")
    at = F.when(F.col("again"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("fetched_at"))
    return rows.select(*[at.alias(c) if c == "fetched_at" else F.col(c) for c in items.columns])


def content_hash(title_hash: Column, normal_summary: Column) -> Column:
    """Hash of a title's hash and the first 300 letters of the summary in its normal form."""
    return F.sha2(F.concat(title_hash, F.lit("|"), F.substring(F.coalesce(normal_summary, F.lit("")), 1, 300)), 256)


def match_articles(entries: DataFrame, articles: DataFrame, with_items: DataFrame, general: str, hours: int = 48) -> DataFrame:
    """``entry_id, matched, how``: the stored article of each entry, by URL hash, else by title hash within ``hours`` (ends included), the highest id.

    For entries of the ``general`` source a title match needs an article that
    has raw items, none of them from that source. ``with_items``: ``article_id,
    from_general`` of articles with raw items. All joins are on hashes; titles
    also meet by slots of ``hours`` and their neighbours, so that a frequent
    title is dealt by time.
    """
    by_url = articles.select(F.col("canonical_url_hash"), F.col("id").alias("u_id")).groupBy("canonical_url_hash").agg(F.max("u_id").alias("u_id"))
    second = lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    slot = lambda c: F.floor(second(c) / (hours * 3600))
    other = articles.select("title_hash", F.col("id").alias("t_id"), F.col("published_at").alias("t_at")).join(with_items, F.col("t_id") == F.col("article_id"), "left").drop("article_id")
    own = entries.select("title_hash", F.col("id").alias("e_id"), "published_at", "source_name", F.explode(F.sequence(slot("published_at") - 1, slot("published_at") + 1)).alias("slot"))
    near = F.abs(F.timestamp_diff("SECOND", F.col("published_at"), F.col("t_at"))) <= hours * 3600
    allowed = (F.col("source_name") != general) | ~F.coalesce("from_general", F.lit(True))
    by_title = own.join(other.withColumn("slot", slot("t_at")), ["title_hash", "slot"]).where(near & allowed).groupBy("e_id").agg(F.max("t_id").alias("t_id"))
    rows = entries.join(by_url, "canonical_url_hash", "left").join(by_title, F.col("id") == F.col("e_id"), "left")
    how = F.when(F.col("u_id").isNotNull(), "url").when(F.col("t_id").isNotNull(), "title").otherwise("new")
    return rows.select(F.col("id").alias("entry_id"), F.coalesce("u_id", "t_id").alias("matched"), how.alias("how"))


def fold_new(entries: DataFrame, general: str, hours: int = 48) -> DataFrame:
    """``id, first``: which entry of a batch stands for each new one, so that no two new articles share a URL, or a title within ``hours``.

    Entries of one URL stand for the lowest id. Of these, entries of one title
    form clusters by time, anchored at their first; the lowest id stands for a
    cluster. Those of the ``general`` source only share URLs.
    """
    by_url = entries.groupBy("canonical_url_hash").agg(F.min("id").alias("u"))
    rows = entries.join(by_url, "canonical_url_hash").select("id", "u")
    heads = entries.join(rows.where("id = u").select("id"), "id", "left_semi").where(F.col("source_name") != general)
    t = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("published_at"))
    placed = heads.join(anchors(heads, "title_hash", "published_at", hours), "title_hash").withColumn("t", t)
    placed = placed.select("id", "title_hash", F.array_max(F.filter("anchors", lambda a: a <= F.col("t"))).alias("cluster"))
    firsts = placed.groupBy("title_hash", "cluster").agg(F.min("id").alias("first"))
    of = placed.join(firsts, ["title_hash", "cluster"]).select(F.col("id").alias("h"), "first")
    return rows.join(of, F.col("u") == F.col("h"), "left").select("id", F.coalesce("first", "u").alias("first"))


def upsert_articles(articles: DataFrame, entries: DataFrame, matches: DataFrame, general: str = "") -> DataFrame:
    """Stored articles after a batch, all columns kept.

    A URL match replaces title, labels, content hash, cluster and a summary
    that is not empty, if the entry's URL is exact (column ``exact``; all are
    without one), and does nothing else. A title match brings a longer summary.
    Both move the date forward only. Of several entries for one article the
    newest (then the highest id) counts for the first, the longest for the
    second kind. New entries are appended, those that stand for others
    (:func:`fold_new`) with the longest summary and the last date of these.
    """
    exact = F.coalesce("exact", F.lit(False)) if "exact" in entries.columns else F.lit(True)
    rows = entries.withColumn("is_exact", exact).join(matches, F.col("id") == F.col("entry_id"))
    order = F.struct("published_at", "id")
    url, title = (F.col("how") == "url") & F.col("is_exact"), F.col("how") == "title"
    own = F.nullif(F.col("summary"), F.lit(""))
    taken = [c for c in ("title", "source_name", "provider_name", "content_hash", "cluster_key") if c in articles.columns and c in entries.columns]
    longest = lambda what: F.max_by("summary", F.when(what, F.struct(F.length("summary"), -F.col("id"))))
    news = rows.where("matched is not null").groupBy("matched").agg(
        *[F.max_by(c, F.when(url, order)).alias(f"n_{c}") for c in taken], F.max_by(own, F.when(url & own.isNotNull(), order)).alias("n_summary"), longest(title).alias("t_summary"),
        F.max(F.when(url | title, F.col("published_at"))).alias("n_at"),
    )
    out = articles.join(news, F.col("id") == F.col("matched"), "left")
    summary = F.coalesce("n_summary", F.when(F.length("t_summary") > F.length(F.coalesce("summary", F.lit(""))), F.col("t_summary")).otherwise(F.col("summary")))
    pick = {c: F.coalesce(f"n_{c}", c) for c in taken} | {"summary": summary, "published_at": F.greatest("published_at", "n_at")}
    kept = out.select(*[pick.get(c, F.col(c)).alias(c) for c in articles.columns])
    new = rows.where("how = 'new'").drop("entry_id", "matched", "how", "is_exact")
    stands = fold_new(new, general).withColumnRenamed("id", "member")
    more = new.select(F.col("id").alias("member"), "summary", "published_at").join(stands, "member").groupBy("first").agg(F.max_by("summary", F.struct(F.length("summary"), -F.col("member"))).alias("m_summary"), F.max("published_at").alias("m_at"))
    added = new.join(more, new["id"] == more["first"])
    pick = {"summary": F.when(F.length("m_summary") > F.length(F.coalesce("summary", F.lit(""))), F.col("m_summary")).otherwise(F.col("summary")), "published_at": F.col("m_at")}
    added = added.select(*[pick.get(c, F.col(c)).alias(c) for c in articles.columns if c in new.columns])
    return kept.unionByName(added, allowMissingColumns=True)


def merge_mappings(target: DataFrame, batch: DataFrame, force: bool = False, prune: DataFrame | None = None) -> DataFrame:
    """Stored mappings with a batch merged in: a higher confidence wins (any with ``force``).

    With ``prune`` (``article_id``), stored mappings of those articles that the batch lacks go.
    """
    fields = ("match_type", "confidence", "extraction_version")
    new = batch.groupBy("article_id", "ticker_id").agg(F.max_by(F.struct(*fields), "confidence").alias("n"))
    rows = target.join(new, ["article_id", "ticker_id"], "full_outer")
    wins = F.col("n").isNotNull() & (F.col("confidence").isNull() | F.lit(force) | (F.col("n.confidence") > F.col("confidence")))
    rows = rows.select(*[F.when(wins, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns], "n")
    if prune is not None:
        gone = prune.select(F.col("article_id").alias("p_id")).distinct()
        rows = rows.join(gone, F.col("article_id") == F.col("p_id"), "left").where("p_id is null or n is not null").drop("p_id")
    return rows.drop("n")


def prunable(entries: DataFrame, matches: DataFrame, hits: DataFrame) -> DataFrame:
    """``article_id`` of stored articles whose missing mappings a batch prunes: of an exact URL match from a feed that isn't general, with at least one verified hit.

    ``entries``: ``id, policy, exact``; ``hits``: ``id`` of entries with verified links.
    """
    rows = entries.where((F.col("policy") != "general_allowed") & F.coalesce("exact", F.lit(False))).join(hits.select("id").distinct(), "id", "left_semi")
    return rows.join(matches.where("how = 'url'"), F.col("id") == F.col("entry_id")).select(F.col("matched").alias("article_id")).distinct()


def merge_dimension(target: DataFrame, batch: DataFrame, key: str, order: str, attributes: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """A dimension after a load, all columns kept: the last row of a key counts; keys that the load lacks stay as they are.

    ``action`` says what became of each; ``defaults`` are values of further columns for created ones.
    """
    new = batch.groupBy(key).agg(F.max_by(F.struct(*attributes), order).alias("n"))
    rows = target.withColumn("known", F.lit(True)).join(new, key, "full_outer")
    same = F.expr(" and ".join(f"(n.{a} <=> {a})" for a in attributes))
    action = F.when(F.col("n").isNull(), "absent").when(F.col("known").isNull(), "created").when(same, "unchanged").otherwise("updated")
    given = {c: F.when(F.col("known").isNull(), F.lit(v)).otherwise(F.col(c)) for c, v in (defaults or {}).items()}
    pick = {a: F.when(F.col("n").isNotNull(), F.col(f"n.{a}")).otherwise(F.col(a)) for a in attributes} | given
    return rows.select(*[pick.get(c, F.col(c)).alias(c) for c in target.columns], action.alias("action"))


def load_counts(target: DataFrame, batch: DataFrame, key: str, order: str, attributes: list[str]) -> DataFrame:
    """``loaded, created, updated, unchanged``: how each row of a load compares with what its key held before it, earlier rows of the load included."""
    before = F.lag(F.struct(*attributes)).over(Window.partitionBy(key).orderBy(order))
    rows = batch.select(key, F.struct(*attributes).alias("now"), before.alias("before"))
    held = target.select(key, F.struct(*attributes).alias("held"))
    rows = rows.join(held, key, "left").withColumn("old", F.coalesce("before", "held"))
    return rows.agg(
        F.count("*").alias("loaded"), F.count_if(F.col("old").isNull()).alias("created"), F.count_if(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("now"))).alias("updated"),
        F.count_if(F.col("old").eqNullSafe(F.col("now"))).alias("unchanged"),
    )
