"""Steps whose work grew faster than it had to, as found in the third round."""

from pyspark.sql import functions as F

from wiremill.functions import text as T
from wiremill.operators import alerts as A
from wiremill.operators import dedupe as D
from wiremill.operators import extract as E
from wiremill.operators import maintenance as R
from wiremill.operators.substrings import containing
from wiremill.plans import pipeline_queries as P
from wiremill.sources import feeds as S
from wiremill.sources import model as M

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_are_found_as_whole_words(spark):
    texts = ["LA, DE; LA", "LAX xLA LA1 _LA LA_ ÉLA LAÉ \U0001d400LA LA\U0001d400 la", "\U0001f600LA-THE(OF)·EST́", "DER ER ERHE THETHE", "LA ١DE DE١", "", None, "́TO 한TO TO"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    words = F.array_intersect(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array(*[F.lit(s[0]) for s in M.SYMBOLS]))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(M.WORDS), F.lit(0)))
    for r in rows.select(words.alias("words"), found.alias("found")).collect():
        assert r["found"] == r["words"]


def test_payloads_fold_hits_before_titles(spark):
    hits = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "a", 5), (2, "a", 3), (2, "a", 9), (3, "a", 4)], "id bigint, scope string, article_id bigint")
    articles = spark.createDataFrame([(3, "three"), (4, None), (5, "five")], "id bigint, title string")
    symbols = spark.createDataFrame([(3, "LA"), (5, "DE"), (5, "LA")], "article_id bigint, symbol string")
    out = A.payloads(hits, articles, symbols)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, "DE, LA", "five", 5), (2, 1, "LA", "three", 3), (3, 1, "General", None, 4)]
    assert "max_by(title" not in plan_of(out)


def test_alert_payload_reads_texts_for_links_once(spark):
    assert "regexp_extract_all(text" not in plan_of(P.alert_payload(spark, SMALL))


def test_alert_delta_reads_texts_for_links_once(spark, monkeypatch):
    met = []
    inner = A.query_matches
    monkeypatch.setattr(A, "query_matches", lambda scopes, articles, links, *rest: met.append(plan_of(links)) or inner(scopes, articles, links, *rest))
    P.alert_delta(spark, SMALL)
    assert len(met) == 1 and "regexp_extract_all" not in met[0]


def test_title_merge_needs_lengths_only(spark):
    rows = [(1, "t", "aa", "2024-01-01"), (2, "t", "aaa", "2024-01-01"), (3, "t", None, "2024-01-09"), (4, "u", "a", "2024-01-01"), (5, "u", "", "2024-01-02")]
    at = F.col("at").cast("timestamp_ntz")
    articles = spark.createDataFrame(rows, "id bigint, title_hash string, summary string, at string").select("id", "title_hash", "summary", at.alias("published_at"), at.alias("created_at"), at.alias("first_seen_at"))
    items = spark.createDataFrame([(i, 1) for i in range(1, 6)], "article_id bigint, source_id int")
    mappings = spark.createDataFrame([(5, 1, 0.7)], "article_id bigint, ticker_id int, confidence double")
    thin = articles.withColumn("n_chars", F.length(F.coalesce("summary", F.lit("")))).drop("summary")
    got, whole = (sorted(tuple(r) for r in D.title_groups(a, mappings, items, 0).select("title_hash", "n_members", "winner").collect()) for a in (thin, articles))
    assert got == whole == [("t", 2, 2), ("u", 2, 5)]


def test_dedupe_stats_reads_texts_for_links_once(spark):
    assert "regexp_extract_all(text" not in plan_of(P.dedupe_stats(spark, SMALL))


def test_items_get_the_title_of_their_own_channel_in_one_scan(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><title>A &amp;amp; a</title><item><title>one</title><link>l1</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel><title>B</title><item><title>two</title></item><item><guid>g</guid></item></channel><channel><item><title>three</title></item></channel></rss>")
    (tmp_path / "c.xml").write_text("<rss><channel><title>C</title></channel></rss>")
    found = S.scan_channel_items(spark, str(tmp_path))
    assert sorted((r["title"] or "", r["link"], r["guid"], r["feed_title"], r["feed_file"][-5:]) for r in found.collect()) == [("", None, "g", "B", "b.xml"), ("one", "l1", None, "A & a", "a.xml"), ("three", None, None, None, "b.xml"), ("two", None, None, "B", "b.xml")]


def test_the_start_of_a_normal_form_needs_the_start_of_a_text(spark):
    texts = ["a b " * 400, "A-" * 299 + "b" * 9, "é " * 900 + "end", " \t\n x y  z " * 90, "ab" * 150 + " " * 700 + "c", "a" * 299 + " - " + "b" * 400, "İKΣ x", "", None, "\U0001f600" * 600 + "k"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.lower("t"), r"(?U)\s+", " ")), "[^a-z0-9 ]", ""), " +", " "))
    for r in rows.select(T.normal_start(F.col("t"), 300).alias("start"), F.substring(whole, 1, 300).alias("cut"), T.normalize_title(F.col("t"), entities=False).alias("now"), whole.alias("then")).collect():
        assert r["start"] == r["cut"] and r["now"] == r["then"]


def test_reextracted_hits_are_found_once(spark, monkeypatch):
    met = []
    inner = R.stop_contexts
    monkeypatch.setattr(R, "stop_contexts", lambda hits, wanted: met.append(plan_of(hits)) or inner(hits, wanted))
    P.reextract(spark, SMALL)
    assert len(met) == 1 and "regexp_extract_all" not in met[0]


def test_alert_queries_read_articles_once(spark, monkeypatch):
    met = []
    inner = A.query_matches
    monkeypatch.setattr(A, "query_matches", lambda *tables: met.append(inner(*tables)) or met[0])
    P.alert_delta(spark, SMALL)
    plan = plan_of(met[0])
    assert "substring_index(text" not in plan and "c_custkey" not in plan


def test_grams_are_cut_once(spark):
    hays = spark.createDataFrame([(1, "a station"), (2, "hr"), (3, None)], "k int, h string")
    found = containing(spark.createDataFrame([("tion",), ("hr",), ("zz",)], "q string"), hays, "q", "k", "h")
    assert "regexp_extract_all(h" not in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [("hr", 2), ("tion", 1)]


def test_pages_are_cleaned_and_marked_once(spark, monkeypatch):
    made = []
    inner = getattr(E, "written", None)
    monkeypatch.setattr(E, "written", lambda df, label: made.append(plan_of(df)) or inner(df, label), raising=False)
    assert "nav|aside|footer" not in plan_of(P.page_fallback(spark, SMALL))
    assert [p.count("nav|aside|footer") for p in made] == [1]


def test_marks_stand_where_runs_begin_and_end(spark):
    texts = ["a", "Ab1 c-d", " x ", "é1é", "--", "", None, "a\nbǅc", "K1 İ2", "$0 \\1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    places = F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), "(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9])", "\x01")
    assert all(r["now"] == r["then"] for r in rows.select(E.marked(F.col("t")).alias("now"), places.alias("then")).collect())
