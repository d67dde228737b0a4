"""Steps that took more disk than they had to, as found in the fourth round."""

from pyspark.sql import functions as F

from wiremill.operators import extract as E
from wiremill.operators import news as N
from wiremill.operators import substrings
from wiremill.plans import stream_queries as Q
from wiremill.sources import model as M
from wiremill.streaming import cycle as C


def feed(*titles):
    items = "".join(f"<item><title>{t} NYSE: QUE</title><link>https://www.wire.example/news/{t}</link><guid>g{t}</guid><pubDate>05 Jan 2024 10:00:00 +0000</pubDate></item>" for t in titles)
    return f"<rss><channel><title>A &amp; b</title>{items}</channel></rss>"


def test_items_leave_their_file_before_they_are_dealt(spark, monkeypatch):
    met = []
    inner = C.written
    monkeypatch.setattr(C, "written", lambda df, label: met.append(df._jdf.queryExecution().optimizedPlan().toString()) or inner(df, label))
    texts = [("f", "1", bytearray(feed("one", "two") + "<item>", "utf-8")), ("f", "2", bytearray(feed(), "utf-8")), ("f", "3", None)]
    items, bad = C.parsed(spark.createDataFrame(texts, "feed_url string, file string, content binary"))
    above = met[0].split("Generate ")[0]
    assert "content#" not in above and "ArrowEvalPython" in above
    assert sorted((r["file"], r["place"], r["feed_title"], r["title"]) for r in items.collect()) == [("1", 0, "A & b", "one NYSE: QUE"), ("1", 1, "A & b", "two NYSE: QUE")]
    assert [(r["file"], r["place"], r["item"]) for r in bad.collect()] == [("1", 2, "<item>")]


def test_contents_of_polls_are_neither_written_nor_parsed_again(spark, tmp_path, monkeypatch):
    made = {}
    inner = C.written
    monkeypatch.setattr(C, "written", lambda df, label: made.setdefault(label, df.columns) and inner(df, label))
    feeds = spark.createDataFrame([("feed/a", "a", 1, "validated_mapping_required", "A")], "feed_url string, source_code string, source_id bigint, policy string, label string")
    known = M.tickers(spark).where("active").select("symbol", F.col("id").alias("ticker_id"))
    cycle = C.Cycle(feeds, known, E.profiles(M.tickers(spark)), lambda p: F.lit("feed/a"), "src0", "General wire", "wire.example", "2024-02-01 00:00:00")
    (tmp_path / "landed").mkdir()
    for number, name in enumerate(("a1", "a2")):
        (tmp_path / "landed" / f"{name}.xml").write_text(feed("one", "two"))
        C.run_batch(spark.read.format("binaryFile").load(str(tmp_path / "landed" / f"{name}.xml")), number, str(tmp_path / "t"), cycle, buckets=2)
    assert "digest" in made["polls"] and not [label for label, columns in made.items() if "content" in columns]
    runs = C.committed(spark, str(tmp_path / "t"), 2).log("runs")
    assert sorted((r["batch"], r["items_seen"], r["items_inserted"]) for r in runs.collect()) == [(0, 2, 2), (1, 0, 0)]


def test_few_texts_are_looked_for_where_the_hays_are(spark, monkeypatch):
    hays = spark.createDataFrame([(1, "a station"), (2, "hr"), (3, None), (4, ""), (5, "e%\u0301_'x")], "k int, h string")
    asked = spark.createDataFrame([("tion",), ("hr",), ("zz",), ("",), (None,), ("a",), ("hr",), ("_'",)], "q string")
    found = substrings.containing(asked, hays, "q", "k", "h")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    few = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(substrings, "FEW", 2)
    many = substrings.containing(asked, hays, "q", "k", "h")
    assert "Exchange" in many._jdf.queryExecution().executedPlan().toString()
    assert few == sorted(tuple(r) for r in many.collect()) == [("_'", 5), ("a", 1), ("hr", 2), ("tion", 1)]
    assert substrings.containing(asked.where("q = ''"), hays, "q", "k", "h").collect() == []


def test_watchlists_find_the_same_without_texts_beside_symbols(spark):
    articles = [(1, "Alpha", "beta", "src1", "Wire one", ["LA"]), (2, None, None, None, None, ["DE", "LA"]), (3, "", None, None, None, ["DE"]), (4, "x", "y", "s", "Wire two", ["DE"]), (5, "Alpha", "beta", "src1", "Wire one", None)]
    rows = spark.createDataFrame(articles, "id bigint, title string, summary string, source_name string, provider_name string, tickers array<string>")
    asked = ["one la", " de", "de la", "alpha beta", "wire two de", "e", "WIRE one", "no"]
    scopes = [(i, None, None, q) for i, q in enumerate(asked)] + [(20, ["LA", "DE"], None, None), (21, ["DE"], "WIRE two", "x"), (22, None, "wire ONE", None), (22, ["LA"], None, None), (23, None, None, None), (None, ["LA"], None, None)]
    scopes = spark.createDataFrame(scopes, "scope_id bigint, tickers array<string>, provider string, q string")
    mapped = rows.where("tickers is not null")
    whole = sorted(N.watchlist_match(mapped, scopes).collect(), key=str)
    apart = sorted(N.watchlist_match(rows.drop("tickers"), scopes, mapped.select(F.col("id").alias("article_id"), "tickers")).collect(), key=str)
    assert [tuple(r) for r in apart] == [tuple(r) for r in whole]
    got = {(r["scope_id"], r["article_id"]) for r in apart}
    assert len(got) == len(apart)
    assert {a for s, a in got if s == 1} == {3, 4} and {a for s, a in got if s == 0} == {1} and {a for s, a in got if s == 22} == {1, 2} and {a for s, a in got if s == 23} == {1, 2, 3, 4} and {a for s, a in got if s is None} == {1, 2}


def test_values_of_a_frequent_key_come_in_bounded_arrays(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "often").otherwise("seldom").alias("key"), F.when(F.col("id") > 0, F.col("id")).alias("v"))
    made = N._slices(rows, "key", "v", 16).collect()
    assert max(len(r["vs"]) for r in made) == 16
    assert sorted(((r["key"], v) for r in made for v in r["vs"]), key=str) == sorted((("often" if i < 2900 else "seldom", i or None) for i in range(3000)), key=str)


def test_landed_titles_keep_what_looks_like_an_entity(spark, tmp_path):
    lines = {2: "Fish &amp; chips", 4: "a &copy 2 &lt;b&gt;", 6: "x <i>y</i> & z", 8: "R&D&&& &#65; &notes"}
    spark.createDataFrame([(i, f"{t}\nrest", "src1") for i, t in lines.items()], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    Q._land_cycle(spark, str(tmp_path), str(tmp_path / "c"), 0, 0)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "c"))
    items, bad = C.parsed(files.select(F.col("path").alias("file"), F.lit("f").alias("feed_url"), "content"))
    found = Q.S.prepare(items, "2024-02-01 00:00:00").select("raw_guid", "title")
    assert bad.count() == 0
    assert dict(tuple(r) for r in found.collect()) == {"g2": "fish &amp; chips no 2", "g4": "a &copy 2 &lt;b&gt; no 4", "g6": "x y & z no 6", "g8": "r&d&&& &#65; &notes no 8"}
