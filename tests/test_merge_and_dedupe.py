import datetime as dt

from wiremill.operators import alerts as A
from wiremill.operators import dedupe as D
from wiremill.operators import maintenance as R
from wiremill.operators import upsert as U

T0 = dt.datetime(2026, 1, 1)
RAW = "id bigint, source_id int, article_id bigint, feed_url string, raw_guid string, raw_title string, raw_link string, raw_pub_date timestamp_ntz, fetched_at timestamp_ntz"
ARTICLE = "id bigint, title string, summary string, published_at timestamp_ntz, created_at timestamp_ntz, first_seen_at timestamp_ntz, canonical_url string, title_hash string"
LINK = "article_id bigint, ticker_id int, match_type string, confidence double"


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_raw_items_meet_by_priority(spark):
    old = spark.createDataFrame(
        [(1, 1, 7, "f1", "g", "t", "l", T0, T0), (2, 1, None, "f1", None, "t", "m", None, T0), (3, 1, 8, "f1", "h", "t", "m", None, T0), (4, 1, 9, "f1", "k", "t", "n", T0, T0), (5, 2, 9, "f1", "g", "t", "l", T0, T0)], RAW
    )
    new = spark.createDataFrame(
        [(11, 1, None, "f2", "g", "t2", "other", None, hours(1)), (12, 1, None, "f2", None, "u", "m", None, None), (13, 1, None, "f2", "new", "u", "n", T0, T0), (14, 1, None, "f2", "new", "u", "m", hours(5), T0), (15, 1, None, "f2", None, "v", "z", None, T0), (16, 1, 6, "f3", None, "w", "z", None, hours(2))], RAW
    )
    found = {r["entry_id"]: r["item_id"] for r in U.stored_item(new, old).collect()}
    assert found == {11: 1, 12: 3, 13: 4, 14: 2, 15: None, 16: None}
    assert {r["entry_id"]: r["item_id"] for r in U.stored_item(new, old, attached=True).collect()} == found | {14: None}
    assert sorted(r["id"] for r in U.unrecorded(new, old).collect()) == [14, 15, 16]
    got = {r["id"]: r for r in U.merge_raw(old, new).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 16]
    r = got[1]
    assert (r["article_id"], r["feed_url"], r["raw_title"], r["raw_pub_date"], r["alt_feeds"], r["action"]) == (7, "f2", "t2", T0, "f1", "updated")
    assert (got[2]["raw_guid"], got[5]["action"], got[16]["action"], got[16]["alt_feeds"]) == ("new", "kept", "inserted", "f2")
    assert U.dedupe_raw(spark.createDataFrame([], RAW)).count() == 0


def test_raw_items_are_deduped_in_three_passes(spark):
    rows = [(1, 1, 5, "f1", "g", "t", "l", T0, T0), (2, 1, None, "f2", "g", "t", "l2", T0, hours(1)), (3, 1, 6, "f3", "h", "t", "l2", T0, hours(2)), (4, 1, None, "f4", None, "t", "z", None, T0), (5, 1, None, "f5", None, "t", "z", None, None), (6, 1, None, "f5", "q", "t", "z", None, None)]
    got = {r["id"]: (r["article_id"], r["alt_feeds"]) for r in U.dedupe_raw(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {3: (6, "f1,f2"), 4: (None, "f5"), 6: (None, "")}


def test_articles_are_merged_by_exact_urls_and_titles(spark):
    kind = "id bigint, title string, summary string, published_at timestamp_ntz, canonical_url_hash string, title_hash string, cluster_key string, source_name string, provider_name string, content_hash string, note string"
    old = spark.createDataFrame([(1, "a", "s", hours(5), "u1", "t1", "t1", "w", "W", "c", "keep"), (2, "b", "long summary", hours(0), "u2", "t2", "t2", "w", "W", "c", "keep")], kind)
    rows = [
        (11, "A new", "", hours(3), "u1", "x", "x", "v", "V", "d", True), (12, "B", "short", hours(9), "u9", "t2", "t2", "v", "V", "d", True), (13, "C", "c", hours(1), "u3", "t3", "t3", "v", "V", "d", True), (14, "C", "longer c", hours(40), "u4", "t3", "t3", "v", "V", "d", True),
        (15, "C", "c", hours(60), "u5", "t3", "t3", "v", "V", "d", True), (16, "D", "d", hours(1), "u3", "t4", "t4", "v", "V", "d", True), (17, "Z", "z", hours(99), "u2", "y", "y", "v", "V", "d", False), (18, "C", "general", hours(1), "u8", "t3", "t3", "gen", "V", "d", True),
    ]
    new = spark.createDataFrame(rows, kind.replace("note string", "exact boolean"))
    facts = spark.createDataFrame([(1, False), (2, False)], "article_id bigint, from_general boolean")
    matches = U.match_articles(new, old, facts, "gen")
    assert {r["entry_id"]: (r["matched"], r["how"]) for r in matches.collect()} == {11: (1, "url"), 12: (2, "title"), 17: (2, "url"), **{i: (None, "new") for i in (13, 14, 15, 16, 18)}}
    got = {r["id"]: r for r in U.upsert_articles(old, new, matches, "gen").collect()}
    assert sorted(got) == [1, 2, 13, 15, 18]
    r = got[1]
    assert (r["title"], r["summary"], r["published_at"], r["source_name"], r["content_hash"], r["cluster_key"], r["title_hash"], r["note"]) == ("A new", "s", hours(5), "v", "d", "x", "t1", "keep")
    assert (got[2]["title"], got[2]["summary"], got[2]["published_at"], got[2]["source_name"]) == ("b", "long summary", hours(9), "w")
    assert (got[13]["summary"], got[13]["published_at"]) == ("longer c", hours(40))
    rules = spark.createDataFrame([(11, "v", True), (17, "v", False), (12, "v", True)], "id bigint, policy string, exact boolean")
    assert [r["article_id"] for r in U.prunable(rules, matches, rules.select("id")).collect()] == [1]


def test_anchored_clusters_include_the_border(spark):
    rows = [(i, "t", "", hours(h), hours(h), None, "u", "same") for i, h in enumerate((0, 40, 48, 49, 90, 97, 98))] + [(9, "x", "", T0, T0, None, "u", "alone")]
    got = {r["id"]: r["cluster"] for r in D.members(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert 9 not in got
    assert [(got[i] - got[0]) // 3600 for i in range(7)] == [0, 0, 0, 49, 49, 49, 98]


def test_title_merge_keeps_best_evidence(spark):
    rows = [(1, "Acme", "Short", T0, T0, None, "u1", "h"), (2, "Acme", "Longer summary with detail", T0 + dt.timedelta(minutes=5), T0, None, "u2", "h")]
    articles = spark.createDataFrame(rows, ARTICLE)
    links = spark.createDataFrame([(1, 5, "exchange", 0.88), (2, 5, "paren", 0.75)], LINK)
    raw = spark.createDataFrame([(1, 2, 1, "f", "a", "", "", T0, T0), (2, 3, 2, "f", "b", "", "", T0, T0)], RAW)
    groups = D.title_groups(articles, links, raw, general_source=0)
    assert [(r["winner"], r["summary"]) for r in groups.collect()] == [(2, "Longer summary with detail")]
    gone = D.losers(groups, D.members(articles), ["title_hash", "cluster"])
    assert [tuple(r) for r in D.merge_links(links, gone).collect()] == [(2, 5, "exchange", 0.88)]
    assert {r["article_id"] for r in D.relink(raw, gone).collect()} == {2}
    assert D.title_groups(articles, links, raw, general_source=3).count() == 0


def test_mapping_merge(spark):
    kind = LINK + ", extraction_version int"
    old = spark.createDataFrame([(1, 1, "token", 0.62, 9), (1, 2, "paren", 0.75, 9), (2, 1, "paren", 0.75, 9)], kind)
    new = spark.createDataFrame([(1, 1, "exchange", 0.88, 10), (2, 1, "token", 0.62, 10), (3, 1, "paren", 0.75, 10)], kind)
    got = {(r["article_id"], r["ticker_id"]): r["confidence"] for r in U.merge_mappings(old, new, prune=spark.createDataFrame([(1,)], "article_id bigint")).collect()}
    assert got == {(1, 1): 0.88, (2, 1): 0.75, (3, 1): 0.75}
    assert {r["confidence"] for r in U.merge_mappings(old, new, force=True).where("article_id = 2").collect()} == {0.62}


def test_dimension_merge(spark):
    old = spark.createDataFrame([("A", "a", 1), ("B", "b", 2), ("C", None, 3)], "symbol string, name string, other int")
    new = spark.createDataFrame([("B", "x", 1), ("B", "b", 2), ("C", "c", 3), ("D", None, 4)], "symbol string, name string, row int")
    got = {r["symbol"]: (r["action"], r["other"]) for r in U.merge_dimension(old, new, "symbol", "row", ["name"], {"other": 9}).collect()}
    assert got == {"A": ("absent", 1), "B": ("unchanged", 2), "C": ("updated", 3), "D": ("created", 9)}
    assert tuple(U.load_counts(old, new, "symbol", "row", ["name"]).first()) == (4, 1, 3, 0)


def test_merged_articles_and_counts(spark):
    kind = ARTICLE + ", canonical_url_hash string, first_alert_sent_at timestamp_ntz"
    rows = [(1, "x", "s", hours(1), T0, T0, "https://w.example/a?x=1", "h", "1", hours(9)), (2, "x", "longer", hours(0), T0, hours(-1), "https://w.example/a?y=2", "h", "2", hours(8)), (3, "y", "", T0, T0, T0, "https://w.example/b", "i", "3", None)]
    articles = spark.createDataFrame(rows, kind)
    links = spark.createDataFrame([(1, 5, "paren", 0.75), (2, 5, "exchange", 0.88), (2, 6, "paren", 0.75)], LINK)
    groups = D.url_groups(articles, links, "w.example")
    gone = D.losers(groups, D.url_members(articles, "w.example"), ["url"])
    got = {r["id"]: r for r in D.merged_articles(articles, groups, gone).collect()}
    r = got[2]
    assert (sorted(got), r["canonical_url"], r["summary"], r["published_at"], r["first_seen_at"], r["first_alert_sent_at"]) == ([2, 3], "https://w.example/a", "longer", hours(1), hours(-1), hours(8))
    raw = spark.createDataFrame([(1, 2, 1, "f", "a", "", "", T0, T0)], RAW)
    assert D.statistics(groups, gone, raw, links).first().asDict() == {"groups": 1, "scanned": 2, "merged": 1, "raw_items_relinked": 1, "mappings_relinked": 0, "mappings_deleted": 1, "mappings_updated": 0}


def test_retention_keeps_attached_items(spark):
    old = hours(-24 * 40)
    rows = [(1, 1, None, "f", "a", "", "", None, old), (2, 1, 5, "f", "b", "", "", None, old), (3, 1, None, "f", "c", "", "", None, T0)]
    assert {r["id"] for r in R.retained(spark.createDataFrame(rows, RAW), "2026-01-01 00:00:00").collect()} == {2, 3}


def test_purge_stops_once_all_symbols_are_verified(spark):
    hits = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "C"), (2, 1, "A"), (2, 5, "Z")], "article_id int, context_order int, symbol string")
    wanted = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "Q")], "article_id int, symbol string")
    assert {tuple(r) for r in R.stop_contexts(hits, wanted).select("article_id", "symbol").collect()} == {(1, "A"), (1, "B"), (2, "A"), (2, "Z")}


def test_alert_delta_takes_the_oldest_first(spark):
    links = spark.createDataFrame([(i, "ABC") for i in range(1, 7)], "article_id bigint, symbol string")
    articles = spark.createDataFrame([(i, f"Story {i}", "Wire A" if i % 2 else "Wire B") for i in range(1, 8)], "id bigint, title string, provider_name string")
    facts = spark.createDataFrame([(1, 1, None)], "article_id bigint, latest_source int, canonical_source int")
    sources = spark.createDataFrame([(1, "Wire Z"), (2, "Wire B")], "id int, name string")
    kind = "id int, scope string, tickers array<string>, provider string, q string, mark bigint"
    rows = [(1, "all", None, None, None, 1), (1, "watchlist:1", ["ABC", "DEF"], None, None, 1), (2, "all", None, None, None, 0), (3, "w", None, "wire", None, 1), (4, "w", ["ABC"], "Wire B", "STORY 4", 1), (5, "w", None, None, "ory 5", 1), (6, "w", None, "Wire Z", None, 1), (7, "w", None, "wire b", None, 1)]
    scopes = A.with_query(spark.createDataFrame(rows, kind))
    matches = A.query_matches(scopes, articles, links, facts, sources)
    got = {}
    for r in A.scope_hits(scopes, matches, per_scope=3).collect():
        got.setdefault((r["id"], r["scope"]), []).append(r["article_id"])
    assert {k: sorted(v) for k, v in got.items()} == {(1, "all"): [2, 3, 4], (1, "watchlist:1"): [2, 3, 4], (3, "w"): [2, 3, 4], (4, "w"): [4], (5, "w"): [5], (7, "w"): [2, 4, 6]}
    delivered = spark.createDataFrame([(1, True)], "id int, ok boolean")
    marks = A.advance(scopes, A.scope_hits(scopes, matches, per_scope=3), delivered, matches)
    now = {(r["id"], r["scope"]): r["mark"] for r in marks.collect()}
    assert (now[1, "all"], now[1, "watchlist:1"], now[2, "all"], now[3, "w"]) == (4, 4, 6, 1)
    again = A.scope_hits(marks, matches, per_scope=3).where("id = 1")
    assert sorted({r["article_id"] for r in again.collect()}) == [5, 6]


def test_scopes_and_marks(spark):
    raw = '{"watchlists": [{"id": " w ", "tickers": "gof, GOF,utf", "provider": " "}, {"id": "w", "tickers": "X"}, {"id": ""}]}'
    rows = A.read_scopes(spark.createDataFrame([(1, raw), (2, '{"include_all_news": false}'), (3, None)], "id int, alert_scopes string")).collect()
    assert {(r["id"], r["scope"]): r["tickers"] for r in rows} == {(1, "all"): None, (1, "watchlist:w"): ["GOF", "UTF"], (3, "all"): None}
    marks = spark.createDataFrame([({"a": "5", "b": "-1", "c": "x", "d": "0"},)], "m map<string,string>").select(A.clean_marks(A.F.col("m")).alias("m")).first()["m"]
    assert marks == {"a": 5}


def test_outcomes(spark):
    rows = [(1, 1, "error"), (1, 2, "ok"), (1, 3, "error"), (2, 1, "gone"), (3, 1, "ok")] + [(4, i, "error") for i in range(20)]
    got = {r["id"]: (r["failures"], r["active"]) for r in A.fold_outcomes(spark.createDataFrame(rows, "id int, at int, outcome string")).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (0, True), 4: (20, False)}
    state = spark.createDataFrame([(1, 4, True, None, "old"), (9, 7, True, 1, "kept"), (5, 19, True, None, "old")], "id int, failures bigint, active boolean, last_ok int, last_error string")
    more = spark.createDataFrame([(1, 5, "ok", None), (5, 6, "error", "x" * 900), (2, 7, "error", "e")], "id int, at int, outcome string, error string")
    after = A.fold_outcomes(more, state=state)
    got = {r["id"]: (r["failures"], r["active"], len(r["last_error"] or "")) for r in after.collect()}
    assert got == {1: (0, True, 0), 2: (1, True, 1), 5: (20, False, 500), 9: (7, True, 4)}
    scopes = spark.createDataFrame([(1,), (1,), (5,)], "id int")
    assert tuple(A.outcome_totals(scopes, more, state, after).first()) == (2, 1, 2, 1)


def test_purge_and_reextraction_are_applied(spark):
    kind = LINK + ", extraction_version int"
    articles = spark.createDataFrame([(i, "Reef (ABC)", "", T0, T0, T0, "u", "h") for i in range(1, 6)], ARTICLE)
    raw = spark.createDataFrame([(i, 2, i, "f", None, "", "l", None, T0) for i in range(1, 6)], RAW)
    links = spark.createDataFrame([(1, 1, "paren", 0.75, 9), (1, 2, "token", 0.62, 9), (2, 2, "token", 0.62, 9), (3, 2, "token", 0.62, 10), (4, 1, "paren", 0.75, 9), (4, 3, "paren", 0.66, 9), (5, 1, "exchange", 0.88, 10)], kind)
    tickers = spark.createDataFrame([(1, True), (2, True), (3, True)], "id int, active boolean")
    fresh = spark.createDataFrame([(2, 1, "exchange", 0.88)], LINK)
    pages = spark.createDataFrame([(3,)], "article_id bigint")
    plan = R.purge_plan(R.suspects(links, tickers, raw, 0), fresh, pages)
    assert {r["article_id"]: r["action"] for r in plan.collect()} == {1: "preserve", 2: "apply", 3: "clear", 4: "stamp"}
    arts, maps, items, counts = R.purged(articles, links, raw, tickers, plan, fresh)
    assert sorted(r["id"] for r in arts.collect()) == [1, 2, 4, 5]
    assert {(r["article_id"], r["ticker_id"]): (r["match_type"], r["extraction_version"]) for r in maps.collect()} == {(1, 1): ("paren", 10), (2, 1): ("exchange", 10), (4, 1): ("paren", 10), (4, 3): ("paren", 9), (5, 1): ("exchange", 10)}
    assert {r["id"]: r["article_id"] for r in items.collect()} == {1: 1, 2: 2, 3: None, 4: 4, 5: 5}
    assert counts.first().asDict() == {"kept": 2, "pruned": 0, "deleted": 1, "mappings_deleted": 3, "raw_items_detached": 1}


def test_reextraction_looks_at_pages_and_stops(spark):
    tickers = spark.createDataFrame([("ABC", "reef,atoll", True), ("DEF", None, True)], "symbol string, validation_keywords string, active boolean")
    articles = spark.createDataFrame([(1, "Reef", "", T0, T0, T0, "u", "h"), (2, "Atoll (ABC)", "reef", T0, T0, T0, "u2", "h")], ARTICLE)
    raw = spark.createDataFrame([(10, 3, 1, "f", None, "", "l1", None, T0), (11, 4, 1, "https://f.example/?s=def", None, "", "l2", None, T0), (12, 4, 2, "f", None, "", "l1", None, T0)], RAW)
    pages = spark.createDataFrame([("l1", "<p>The atoll and reef (ABC).</p>"), ("l2", "<p>(DEF)</p>")], "link string, html string")
    policies = spark.createDataFrame([(4, "scoped_context_required")], "source_id int, policy string")
    known, profile = tickers.select("symbol"), R.extract.profiles(tickers)

    def found(**more):
        out = R.reextracted(R.raw_contexts(raw), articles, known, profile, pages, policies, **more)
        return {(r["article_id"], r["symbol"]): (r["match_type"], r["confidence"]) for r in out.collect()}

    assert found() == {(1, "ABC"): ("paren", 0.75), (1, "DEF"): ("context", 0.93), (2, "ABC"): ("paren", 0.75)}
    wanted = spark.createDataFrame([(1, "DEF")], "article_id bigint, symbol string")
    assert found(wanted=wanted) == {(1, "DEF"): ("context", 0.93), (2, "ABC"): ("paren", 0.75)}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from wiremill.streaming import jobs as J

    kind = "user_id bigint, event_id bigint, event_type string, ts timestamp_ntz"
    land = lambda name, rows: spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}/{len(rows)}-{rows[0][1]}.parquet")
    rows = [(1, 1, "error", hours(1)), (1, 2, "view", hours(5)), (1, 3, "error", hours(9)), (2, 4, "error", hours(1)), (1, 5, "error", hours(2)), (3, 6, "view", hours(1))]
    for name, order in (("a", rows), ("b", rows[::-1])):
        for r in order[:4]:
            land(name, [r])
        J.feed_health(spark, f"{tmp_path}/{name}/", state=f"{tmp_path}/state-{name}", files_per_batch=1)
        for r in order[4:]:
            land(name, [r])
        out = J.feed_health(spark, f"{tmp_path}/{name}/", state=f"{tmp_path}/state-{name}", files_per_batch=1)
        assert {r["user_id"]: r["failure_count"] for r in out.collect()} == {1: 1, 2: 1, 3: 0}


def test_arriving_articles_meet_within_48_hours(spark, tmp_path):
    from wiremill.functions.text import normalize_title
    from wiremill.streaming import jobs as J

    kind = "id bigint, title string, summary string, published_at timestamp_ntz, canonical_url_hash string, source_name string"
    keyed = lambda batch: batch.withColumn("title_hash", A.F.sha2(normalize_title(A.F.col("title"), entities=False), 256)).withColumn("cluster_key", A.F.col("title_hash"))
    for n, rows in enumerate([[(1, "Reef", "a", hours(0), "u1", "w"), (2, "reef!", "longer", hours(10), "u2", "w")], [(3, "Reef", "b", hours(-30), "u3", "w"), (4, "Reef", "c", hours(70), "u4", "w")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
        out = J.ingest_articles(spark, f"{tmp_path}/in/", keyed, "gen", state=f"{tmp_path}/state")
    assert {r["id"]: (r["summary"], r["batch"]) for r in out.collect()} == {1: ("longer", 0), 4: ("c", 1)}
    assert {r["batch"]: r["inserted"] for r in J.new_counts(out).collect()} == {0: 1, 1: 1}
