"""Plans: what may be broadcast. News operators on empty tables, null keys and columns of other names."""

import re

import pytest
from pyspark.sql import functions as F

from wiremill.operators import alerts as A
from wiremill.operators import dedupe as D
from wiremill.operators import extract as E
from wiremill.operators import health as H
from wiremill.operators import maintenance as R
from wiremill.operators import news as N
from wiremill.operators import upsert as U
from wiremill.plans import pipeline_queries as P
from wiremill.sources import model as M

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, symbol string, active string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    docs = [(i, f"Title {i} LA and THE\nThe DER rest of {i}.", "en", f"src{i % 3}", 9, "clash", "x") for i in range(40)] + [(None, None, None, None, None, None, None)]
    pages = [(i, f"https://www.example.com/p/{i}", "<p>x</p>") for i in range(10)] + [(None, None, None)]
    events = [(i, i % 4, ("view", "error", "signup", "purchase")[i % 4], i * 1.5, f"2024-01-01 0{i % 9}:00:00") for i in range(40)]
    customers = [(i, "c", i % 5, ("AUTOMOBILE", "FURNITURE", "BUILDING", "MACHINERY", "HOUSEHOLD")[i % 5]) for i in range(30)]
    for name, full in (("some", True), ("none", False)):
        path = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(docs if full else [], DOC).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(pages if full else [], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
        rows = spark.createDataFrame(events if full else [], "event_id bigint, user_id bigint, event_type string, value double, t string")
        rows.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").write.parquet(f"{path}/events.parquet")
        spark.createDataFrame(customers if full else [], "c_custkey bigint, c_name string, c_nationkey bigint, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
        out[name] = path
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_parts(plan):
    """The lines of each broadcast and what stands below it."""
    lines = plan.split("\n")
    depth = lambda line: len(re.match(r"[ :+*|-]*", line).group())
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[i + 1 :]]
            stop = next((k for k, x in enumerate(below) if x.strip() and depth(x) <= depth(line)), len(below))
            yield "\n".join(below[:stop])


@pytest.mark.parametrize("build", [M.mappings, P.links], ids=["mappings", "links"])
def test_symbols_are_what_is_broadcast(spark, tables, build):
    plan = plan_of(build(spark, tables["some"]))
    parts = list(broadcast_parts(plan))
    assert parts
    assert all("FileScan" not in p and "LocalTableScan" in p for p in parts)
    assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[symbol", plan)


def test_watchlists_meet_no_article_one_by_one(spark, tables):
    f = N.Feed(M.articles(spark, tables["some"]), M.raw_items(spark, tables["some"]), M.sources(spark, tables["some"]), M.mappings(spark, tables["some"]), M.tickers(spark))
    own = N.active_mappings(f).groupBy("article_id").agg(F.sort_array(F.collect_list("symbol")).alias("tickers"))
    scopes = M.subscriptions(spark, tables["some"])
    found = N.watchlist_match(f.articles.join(own, F.col("id") == F.col("article_id")), scopes.where("scope <> 'all'").withColumnRenamed("id", "scope_id"))
    reach = A.query_matches(A.with_query(scopes), f.articles, N.active_mappings(f), N.raw_facts(f), f.sources)
    for plan in (plan_of(found), plan_of(reach)):
        assert "NestedLoopJoin" not in plan
        assert "CartesianProduct" not in plan


@pytest.mark.parametrize("kind", ["some", "none"])
def test_news_operators_on_odd_tables(spark, tables, kind):
    d = tables[kind]
    f = N.Feed(M.articles(spark, d), M.raw_items(spark, d), M.sources(spark, d), M.mappings(spark, d), M.tickers(spark))
    entries = P.entries(spark, d)
    links = E.links(entries, f.tickers.where("active"), E.profiles(f.tickers))
    looked = R.suspects(f.mappings, f.tickers, f.raw_items, 0)
    known = f.raw_items.select("article_id", F.lit(False).alias("from_general")).distinct()
    matches = U.match_articles(f.articles, f.articles, known, M.GENERAL_SOURCE)
    made = [
        N.enriched(N.page(N.select_articles(f, include_unmapped=True), 5), f), N.watchlist_match(f.articles.withColumn("tickers", F.array(F.lit("LA"))), M.subscriptions(spark, d).withColumnRenamed("id", "scope_id")), links, E.gate(entries.withColumn("policy", F.lit("general_allowed")), links),
        R.purge_plan(looked, looked, M.read(spark, d, "pages").select(F.col("page_id").alias("article_id"))), matches, U.upsert_articles(f.articles, f.articles, matches), U.merge_raw(f.raw_items, f.raw_items), U.dedupe_raw(f.raw_items),
        U.merge_mappings(f.mappings, f.mappings), D.anchors(f.articles, "title_hash", "published_at", 48), H.feed_backoff(M.runs(spark, d)), H.cycle_quantiles(M.runs(spark, d)), H.route_latency(M.requests(spark, d)), H.stalled(M.runs(spark, d), "2024-02-01"),
        H.alert_periods(H.failing_without_recovery(M.runs(spark, d)), ["source_id"], 5, 5), R.newest_read_keys(M.read(spark, d, "events"), 3),
    ]
    counts = [df.count() for df in made]
    assert all(n == 0 for n in counts) if kind == "none" else counts[0] == 5
    if kind == "some":
        assert counts[3] == 41  # an entry with a null id is an entry like others
