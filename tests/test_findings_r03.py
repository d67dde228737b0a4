"""Results that differed from the twins, or were less than the whole job, in the third round."""

from pyspark.sql import functions as F

from wiremill.functions import text as T
from wiremill.operators import health as H
from wiremill.operators import news as N
from wiremill.streaming import cycle as C


def test_max_over_time_rounds_to_seconds(spark):
    rows = [(1, 9, "2024-01-01 00:00:00.6"), (2, 4, "2024-01-01 06:00:01.4"), (3, 1, "2024-01-01 12:00:01.5"), (4, 0, "2024-01-01 18:00:02.500001")]
    runs = spark.createDataFrame(rows, "id int, items_inserted int, t string").select("id", F.lit(1).alias("source_id"), "items_inserted", F.col("t").cast("timestamp_ntz").alias("started_at"))
    assert {r["id"]: r["most"] for r in H.max_over_time(runs).collect()} == {1: 9, 2: 9, 3: 1, 4: 0}


def test_cycle_quantiles_are_exact(spark):
    rows = [(20 + s, "2024-01-01 00:00:00") for s in range(10)] + [(700, "2024-01-01 00:10:00"), (None, "2024-01-01 00:20:00"), (3, "2024-01-02 00:00:00")]
    runs = spark.createDataFrame(rows, "s int, t string").select(F.col("t").cast("timestamp_ntz").alias("started_at"), "s").withColumn("finished_at", F.timestamp_add("SECOND", "s", "started_at"))
    got = {r["day"].day: (r["n"], r["p50"], r["p95"], r["histogram_p95"], r["le_30"]) for r in H.cycle_quantiles(runs).collect()}
    assert got == {1: (11, 25.0, 364.5, 600.0, 10), 2: (1, 3.0, 3.0, 4.85, 1)}


def test_route_latency_is_exact_and_counts_every_request(spark):
    rows = [("a", 100.0 + s, "2024-01-01 00:00:00") for s in range(10)] + [("a", None, "2024-01-01 00:10:00"), ("b", None, "2024-01-01 01:00:00"), (None, 7.0, "2024-01-01 01:00:00")]
    requests = spark.createDataFrame(rows, "path string, duration_ms double, t string").select("path", "duration_ms", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = {(r["path"], r["slot"].hour): (r["n"], r["p95_ms"] and round(r["p95_ms"], 9), r["histogram_p95_ms"] and round(r["histogram_p95_ms"])) for r in H.route_latency(requests).collect()}
    assert got == {("a", 0): (11, 108.55, 242), ("b", 1): (1, None, None), (None, 1): (1, 7.0, 10)}


def test_page_text_leaves_entities_that_were_cut_off(spark):
    page = "<p>a &&amp b&amp;c &eacute;&eacute &#233;&#233 &ampx; &lt;i&gt; &nosuch;</p>"
    rows = spark.createDataFrame([(page,)], "x string").select(T.page_text(F.col("x"), ended=True).alias("cut"), T.page_text(F.col("x")).alias("all"))
    assert tuple(rows.first()) == ("a &&amp b&c é&eacute é&#233 &ampx; <i> &nosuch;", "a && b&c éé éé &x; <i> &nosuch;")


def test_landed_files_are_one_cycle_however_many(spark, tmp_path, monkeypatch):
    (tmp_path / "landed").mkdir()
    for n in range(300):
        (tmp_path / "landed" / f"a{n}.xml").write_text("<rss/>")
    batches = []
    monkeypatch.setattr(C, "run_batch", lambda files, number, *rest: batches.append((number, files.count())))
    C.run_cycles(spark, str(tmp_path / "landed"), str(tmp_path / "tables"), None)
    assert batches == [(0, 300)]


def test_watchlists_that_ask_for_the_same_are_matched_once(spark):
    articles = spark.createDataFrame([(1, "Alpha", "x", "s", "P", ["LA", "DE"]), (2, "beta", "y", "s", "Q", ["DE"]), (None, "alpha", None, "s", "P", ["LA"])], "id bigint, title string, summary string, source_name string, provider_name string, tickers array<string>")
    scopes = [(7, ["DE", "LA"], None, None), (8, ["LA", "DE"], None, ""), (9, ["LA"], "p", "ALPHA"), (9, None, "P", None), (10, None, None, "bet"), (11, [], None, None), (None, ["DE"], "q", None)]
    found = N.watchlist_match(articles, spark.createDataFrame(scopes, "scope_id bigint, tickers array<string>, provider string, q string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(7, 1), (7, 2), (7, None), (8, 1), (8, 2), (8, None), (9, 1), (9, None), (10, 2), (11, 1), (11, 2), (11, None), (None, 2)}
    assert found._jdf.queryExecution().analyzed().nodeName() == "Union"  # not all that scopes have is sorted out again
