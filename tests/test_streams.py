"""Streams in several batches give what one batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from wiremill.operators import health as H
from wiremill.operators import maintenance as R
from wiremill.operators.substrings import containing
from wiremill.streaming import jobs as J
from wiremill.streaming.tables import names_in


def plain_polls(attempts, base, cap):
    held, out = {}, []
    for feed, at, failed, hint in sorted(attempts, key=lambda a: (a[0], a[1])):
        n, until = held.get(feed, (0, 0))
        if at < until:
            status = "skipped_backoff"
        elif failed:
            n += 1
            status, until = "failed", at + int(min(max(min(base * 2 ** (n - 1), cap), hint or 0), cap) if hint else min(base * 2 ** (n - 1), cap))
        else:
            status, n, until = "success", 0, 0
        held[feed] = (n, until)
        out.append((feed, at, status, n, until))
    return sorted(out)


def test_polls_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(5)
    attempts = sorted({(f"f{rng.randrange(4)}", 1_700_000_000 + rng.randrange(20_000), rng.random() < 0.6, rng.choice((None, 45.0, 900.0))) for _ in range(200)}, key=lambda a: a[1])
    attempts = [a for i, a in enumerate(attempts) if i == 0 or a[:2] != attempts[i - 1][:2]]
    for part in range(3):
        rows = spark.createDataFrame(attempts[part * 70 : (part + 1) * 70], "feed_url string, t bigint, failed boolean, hint_s double")
        rows.select("feed_url", F.timestamp_seconds("t").alias("at"), "failed", "hint_s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, files in (("one", 10), ("three", 1)):
        got = J.polls(spark, J.stream(spark, str(tmp_path / "in"), files), str(tmp_path / name), base=30.0, cap=600.0)
        rows = got.select("feed_url", F.unix_timestamp("at"), "status", "failure_count", F.coalesce(F.unix_timestamp("backoff_until"), F.lit(0))).collect()
        assert sorted(map(tuple, rows)) == plain_polls(attempts[:210], 30, 600)
    assert len([n for n in names_in(spark, str(tmp_path / "three" / "polls")) if n.startswith("batch=")]) >= 3


def test_ingest_rewrites_touched_buckets_only(spark, tmp_path):
    titles = [[(i, f"title {i % 40}\nrest") for i in range(200)], [(500, "title 3"), (-1, "title 3")]]
    for rows in titles:
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = J.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), buckets=32)
    assert {(r["first_id"], r["n"]) for r in got.collect()} == {(i, 5) for i in range(40) if i != 3} | {(-1, 7)}
    written = [len([n for n in names_in(spark, f"{tmp_path}/t/titles/batch={b}") if n.startswith("bucket=")]) for b in (0, 1)]
    assert written[0] > 15
    assert written[1] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_are_found_as_by_a_plain_search(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé .*%_") for _ in range(n))
    asked = [text(rng.choice((0, 1, 2, 3, 4, 6))) for _ in range(40)] + [None, "", "zzz"]
    hays = [(i, text(rng.randrange(40))) for i in range(60)] + [(100, None), (101, "")]
    found = containing(spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame(hays, "k int, h string"), "q", "k", "h")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, k) for a in asked if a for k, h in hays if h and a in h}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_bucket_quantiles_interpolate(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", s) for s in (0.05, 0.15, 0.2, 3.0, 9.0, 700.0, None)], "at string, s double").select(F.col("at").cast("timestamp_ntz").alias("at"), "s")
    counts = H.histogram(rows, F.col("s"), H.CYCLE_LIMITS, [], "at")
    got = H.rolled_up(counts, [], 60).select(H.bucket_quantile(H.CYCLE_LIMITS, 0.5).alias("a"), H.bucket_quantile(H.CYCLE_LIMITS, 0.99).alias("b"), H.bucket_quantile(H.CYCLE_LIMITS, 0.0).alias("c")).first()
    assert tuple(got) == (0.25, 600.0, 0.0)
    assert H.histogram(rows.limit(0), F.col("s"), H.CYCLE_LIMITS, [], "at").count() == 0


def test_alerts_hold_and_reads_are_trimmed(spark):
    active = [("a", m) for m in (0, 5, 10, 30, 40, 45)] + [("b", 0)]
    rows = spark.createDataFrame(active, "s string, m int").select("s", F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("window_end"))
    got = {(r["s"], r["pending_since"].minute, r["last_active"].minute, r["firing_since"] and r["firing_since"].minute) for r in H.alert_periods(rows, ["s"], 5, 5).collect()}
    assert got == {("a", 0, 10, 5), ("a", 30, 30, None), ("a", 40, 45, 45), ("b", 0, 0, None)}
    reads = [(u, e, f"2024-01-{1 + e // 7:02d} 0{e % 7}:00:00") for u, n in ((1, 60), (2, 5)) for e in range(n)]
    kept = R.newest_read_keys(spark.createDataFrame(reads, "user_id int, event_id int, t string").select("user_id", "event_id", F.col("t").cast("timestamp_ntz").alias("ts")), 20)
    assert {(r["user_id"], r["event_id"]) for r in kept.collect()} == {(1, e) for e in range(40, 60)} | {(2, e) for e in range(5)}
