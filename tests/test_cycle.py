"""The ingest cycle as a stream: restart between tables, touched buckets, malformed items, unchanged polls."""

import pytest
from pyspark.sql import functions as F

from wiremill.operators import extract as E
from wiremill.sources import model as M
from wiremill.streaming import cycle as C
from wiremill.streaming.tables import names_in


def item(n, title=None):
    return f"<item><title>{title or f'Story number {n} NYSE: QUE'}</title><link>https://www.wire.example/news/{n}</link><guid>g{n}</guid><pubDate>0{n % 9 + 1} Jan 2024 10:00:00 +0000</pubDate></item>"


def poll(*items):
    return f"<rss><channel><title>Channel</title>{''.join(items)}</channel></rss>"


@pytest.fixture
def cycle(spark):
    feeds = spark.createDataFrame([("feed/a", "a", 1, "validated_mapping_required", "A"), ("feed/b", "src0", 0, "general_allowed", "General wire")], "feed_url string, source_code string, source_id bigint, policy string, label string")
    known = M.tickers(spark).where("active").select("symbol", F.col("id").alias("ticker_id"))
    return C.Cycle(feeds, known, E.profiles(M.tickers(spark)), lambda p: F.concat(F.lit("feed/"), F.regexp_extract(p, "/([ab])[^/]*$", 1)), "src0", "General wire", "wire.example", "2024-02-01 00:00:00")


def land(tmp_path, spark, name, text):
    (tmp_path / "landed").mkdir(exist_ok=True)
    (tmp_path / "landed" / name).write_text(text)
    return spark.read.format("binaryFile").load(str(tmp_path / "landed" / name))


def contents(tables):
    return {n: sorted(map(str, tables.read(n).collect())) for n in C.SCHEMAS if n not in ("runs", "quarantine")} | {n: sorted(map(str, tables.log(n).collect())) for n in ("runs", "quarantine")}


def test_a_batch_that_stops_changes_nothing_and_runs_again_to_the_same(spark, tmp_path, cycle):
    first = land(tmp_path, spark, "a1.xml", poll(item(1), "<item><title>bad<b></title></item>", item(2, "Nothing of note")))
    again = land(tmp_path, spark, "a2.xml", poll(item(1), item(3)))
    roots = [str(tmp_path / "whole"), str(tmp_path / "broken")]
    for root in roots:
        C.run_batch(first, 0, root, cycle, buckets=4)
    before = contents(C.committed(spark, roots[1], 4))
    with pytest.raises(RuntimeError):
        C.run_batch(again, 1, roots[1], cycle, buckets=4, stop_after="articles")
    after = C.committed(spark, roots[1], 4)
    assert {n: sorted(map(str, after.read(n).collect())) for n in ("articles", "raw_items", "ledger")} == {n: before[n] for n in ("articles", "raw_items", "ledger")}
    for root in roots:
        C.run_batch(again, 1, root, cycle, buckets=4)
    assert contents(C.committed(spark, roots[0], 4)) == contents(C.committed(spark, roots[1], 4))
    tables = C.committed(spark, roots[0], 4)
    assert sorted(r["raw_guid"] for r in tables.read("raw_items").collect()) == ["g1", "g3"]
    runs = {r["batch"]: (r["items_seen"], r["items_inserted"], r["error_text"]) for r in tables.log("runs").collect()}
    assert runs == {0: (3, 1, "Skipped 1 malformed entry."), 1: (2, 1, None)}
    assert [(r["reason"], r["file"].split("/")[-1]) for r in tables.log("quarantine").collect()] == [("not well-formed", "a1.xml")]


def test_a_batch_writes_what_it_touches_and_same_bytes_bring_nothing(spark, tmp_path, cycle):
    root = str(tmp_path / "t")
    C.run_batch(land(tmp_path, spark, "b1.xml", poll(*(item(n, f"Story {n}") for n in range(10, 40)))), 0, root, cycle, buckets=32)
    C.run_batch(land(tmp_path, spark, "b2.xml", poll(item(50, "One more"))), 1, root, cycle, buckets=32)
    touched = [len([n for n in names_in(spark, f"{root}/articles/batch={b}") if n.startswith("bucket=")]) for b in (0, 1)]
    assert touched[0] > 10
    assert touched[1] == 1
    assert C.committed(spark, root, 32).read("articles").count() == 31
    C.run_batch(land(tmp_path, spark, "b3.xml", poll(item(50, "One more"))), 2, root, cycle, buckets=32)
    tables = C.committed(spark, root, 32)
    assert tables.read("articles").count() == 31
    assert [(r["items_seen"], r["status"]) for r in tables.log("runs").where("batch = 2").collect()] == [(0, "success")]
