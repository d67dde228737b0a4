import pytest
from pyspark.sql import functions as F

from wiremill.functions import text as T


def one(spark, build, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://wire.example/story/9?ocid=feed&utm_medium=rss&page=3", "https://wire.example/story/9?page=3"),
        ("HTTPS://Wire.Example:443/x/y///?q=b&p=a&none=#here", "https://wire.example/x/y?p=a&q=b"),
        ("https://w.example/s?q=two%20words&r=%7Ea", "https://w.example/s?q=two+words&r=~a"),
        ("https://w.example/s?q=two+words&r=~a", "https://w.example/s?q=two+words&r=~a"),
        ("https://w.example/s?q=100%", "https://w.example/s?q=100%25"),
        ("//wire.example", "https://wire.example/"),
        (None, None),
    ],
)
def test_canonicalize_url(spark, url, want):
    assert one(spark, T.canonicalize_url, url) == want


@pytest.mark.parametrize(("title", "want"), [("  Rates   Hold, Again?  ", "rates hold again"), ("Salt &amp; Pepper", "salt pepper"), ("Salt & Pepper", "salt pepper"), ("na&iuml;ve", "nave"), ("", ""), (None, None)])
def test_normalize_title(spark, title, want):
    assert one(spark, T.normalize_title, title) == want


@pytest.mark.parametrize(("text", "want"), [("<div>OSLO&nbsp;Norway</div><p>Weekly <i>review</i></p>", "OSLO Norway Weekly review"), ("<hr>", None), (None, None)])
def test_clean_summary(spark, text, want):
    assert one(spark, T.clean_summary, text) == want


@pytest.mark.parametrize("depth", [1, 6, 50])
def test_side_bars_end_with_their_own_div(spark, depth):
    inner = "x" + "<div id=1>y" * depth + "</div>" * depth
    assert one(spark, T.page_text, f'<p>Start</p><div class="b sidebar">{inner}z</div>Story<DIV CLASS="sidebar">{inner}</DIV> body <div>stays</div>') == "Start Story body stays"
    assert one(spark, T.page_text, f'<div>Start</div></div><div class="sidebar">{inner} never closed <div class="sidebar">z</div>') == "Start"
    assert one(spark, T.page_text, '<p>no sidebar</p> 1 <> 2') == "no sidebar 1 <> 2"


def test_only_texts_with_rare_entities_reach_python(spark):
    rows = spark.createDataFrame([("a &amp; b",), ("na&iuml;ve &#8211; &amp;lt;",), ("plain",), (None,)], "x string")
    out = rows.select(T.decode_entities(F.col("x")).alias("y"))
    assert [r["y"] for r in out.collect()] == ["a & b", "na\u00efve \u2013 &lt;", "plain", None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [_unescape(CASE WHEN" in plan


def test_page_text(spark):
    page = "<nav>top</nav><h1>Harbour</h1><script>f()</script><p>Ships 3&gt;2</p><h2>Also from this source</h2><p>more</p><footer>end</footer>"
    assert one(spark, T.page_text, page) == "Harbour Ships 3>2"
    bar = '<p>a</p><div class="left sidebar"><div>x<div>y</div></div> z</div><p>b</p><DIV class="sidebar-2">open <div>w</div>'
    assert one(spark, T.page_text, bar) == "a b"
    assert one(spark, T.page_text, "<div>kept</div><p>Related weather</p>") == "kept Related weather"


@pytest.mark.parametrize(("text", "want"), [("Wed, 11 Feb 2026 08:30:00 +0200", "2026-02-11 06:30:00"), ("11 Feb 2026 08:30:00 GMT", "2026-02-11 08:30:00"), ("2026-02-11T00:00:00Z", "2026-02-11 00:00:00"), ("later", None), (None, None),
    ("2026-02-11 08:30", "2026-02-11 08:30:00"), ("2026-02-11", "2026-02-11 00:00:00"), ("2026-02-11T08:30:00+02:00", "2026-02-11 06:30:00"), ("Wednesday, February 11, 2026 8:30 a.m. EST", "2026-02-11 13:30:00"),
    ("Feb 11, 2026 at 8:30 PM", "2026-02-11 20:30:00"), ("February 11th, 2026", "2026-02-11 00:00:00"), ("11 February 2026 08:30", "2026-02-11 08:30:00"), ("2/11/2026 8:30pm", "2026-02-11 20:30:00"), ("Wed, 11 Feb 2026 08:30 EDT", "2026-02-11 12:30:00"), ("", None)])
def test_parse_date(spark, text, want):
    assert one(spark, lambda c: T.parse_date(c).cast("string"), text) == want


def test_backoff(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (60,)], "n int").select(T.backoff_seconds(F.col("n"), 30, 3600).alias("b")).collect()
    assert [r["b"] for r in rows] == [0, 30, 120, 3600]
    assert one(spark, lambda c: T.backoff_seconds(c, 30, 3600, F.lit(900)), 1, "int") == 900
    assert one(spark, lambda c: T.backoff_seconds(c, 0), 5, "int") == 0


def test_symbol_list(spark):
    assert one(spark, T.symbol_list, " abc, XYZ,,abc ") == ["ABC", "XYZ"]
