"""Health of feeds and requests from run logs and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiremill.functions.text import backoff_seconds


def stale_runs(runs: DataFrame, now: str, timeout_s: int = 1800, reason: str = "run did not finish in time") -> DataFrame:
    """Runs that started ``timeout_s`` or longer ago and never finished become failed."""
    at = F.lit(now).cast("timestamp_ntz")
    stale = (F.col("status") == "running") & F.col("finished_at").isNull() & (F.col("started_at") <= F.timestamp_add("SECOND", F.lit(-timeout_s), at))
    out = runs.withColumn("stale", F.coalesce(stale, F.lit(False)))
    return out.withColumns({"status": F.when(F.col("stale"), "failed").otherwise(F.col("status")), "finished_at": F.when(F.col("stale"), at).otherwise(F.col("finished_at")), "error_text": F.when(F.col("stale"), reason)})


def run_status(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: runs, failures, totals and the newest finished run's figures."""
    by = runs.groupBy("source_id").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.sum("items_seen").alias("seen"), F.sum("items_inserted").alias("inserted"),
        F.bool_or(F.col("status") == "skipped_backoff").alias("any_skipped"), F.max_by("items_inserted", F.when(F.col("finished_at").isNotNull(), F.struct("finished_at", "id"))).alias("last_inserted"),
    )
    return by.join(sources.select(F.col("id").alias("source_id"), "code"), "source_id").select("code", "n_runs", "n_failed", "seen", "inserted", "any_skipped", "last_inserted")


def cycle_totals(runs: DataFrame) -> DataFrame:
    """One row: items seen and inserted, failed feeds, and whether any feed failed to notify of new items (``notified``, if there is such a column)."""
    failed = F.bool_or(~F.coalesce("notified", F.lit(True))) if "notified" in runs.columns else F.lit(False)
    return runs.agg(F.coalesce(F.sum("items_seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("items_inserted"), F.lit(0)).alias("inserted"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(failed, F.lit(False)).alias("notify_failed"))


def feed_results(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """A cycle's results per feed, in order of source and URL."""
    rows = runs.join(sources.select(F.col("id").alias("source_id"), "code"), "source_id")
    return rows.groupBy("code", "feed_url").agg(F.sum("items_seen").alias("seen"), F.sum("items_inserted").alias("inserted"), F.count_if(F.col("status") == "failed").alias("failed")).orderBy("code", "feed_url")


def last_cycle(runs: DataFrame, cycle: Column) -> DataFrame:
    """Gauges of the cycle that finished last: when, how long it took, items seen and inserted, failed feeds. ``cycle`` names a run's cycle."""
    by = runs.withColumn("cycle", cycle).groupBy("cycle").agg(
        F.min("started_at").alias("began"), F.max("finished_at").alias("finished_at"), F.sum("items_seen").alias("seen"), F.sum("items_inserted").alias("inserted"), F.count_if(F.col("status") == "failed").alias("failed_feeds")
    )
    done = by.where("finished_at is not null")
    top = done.agg(F.max_by(F.struct("cycle", "finished_at", F.timestamp_diff("SECOND", F.col("began"), F.col("finished_at")).alias("duration_s"), "seen", "inserted", "failed_feeds"), F.struct("finished_at", "cycle")).alias("t"))
    return top.where("t is not null").select("t.*")


def latest_runs(runs: DataFrame, sources: DataFrame, limit: int = 200, since: str | None = None) -> DataFrame:
    """The newest runs with their source's code (the limit is the feature)."""
    rows = runs if since is None else runs.where(F.col("started_at") >= F.lit(since).cast("timestamp_ntz"))
    top = rows.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    return top.join(sources.select(F.col("id").alias("source_id"), "code"), "source_id").select("id", "code", "feed_url", "started_at", "status")


def feed_backoff(runs: DataFrame, base: float = 30.0, cap: float = 3600.0) -> DataFrame:
    """Per feed: failures since the last success (skipped and unfinished runs count for nothing), the last one's time and the backoff.

    Counted with sums over each feed's runs against its last success, without ordering them.
    """
    done = runs.where(F.col("status").isin("success", "failed"))
    place = F.struct("started_at", "id")
    last = done.groupBy("feed_url").agg(F.max(F.when(F.col("status") == "success", place)).alias("last_ok"))
    since = done.join(last, "feed_url").where("status = 'failed' and (last_ok is null or struct(started_at, id) > last_ok)")
    fails = since.groupBy("feed_url").agg(F.count("*").alias("failure_count"), F.max("started_at").alias("last_failure_at"))
    out = runs.select("feed_url").distinct().join(fails, "feed_url", "left").withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))
    return out.withColumn("backoff_s", backoff_seconds(F.col("failure_count"), base, cap))


def seconds_between(start: str, end: str) -> Column:
    return F.timestamp_diff("SECOND", F.col(start), F.col(end))


#: Limits of the histograms of cycles and of requests, in seconds.
CYCLE_LIMITS = (0.1, 0.25, 0.5, 1, 2, 5, 10, 20, 30, 60, 120, 300, 600)
REQUEST_LIMITS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30)


def histogram(rows: DataFrame, seconds: Column, limits: tuple[float, ...], keys: list[str], ts: str, minutes: int = 5) -> DataFrame:
    """``keys, slot, c0 .. cn``: how many values of each slot lie up to each limit and above the one before (the last: above all).

    Histograms of slots can be added up to any window (:func:`rolled_up`), so
    no task ever needs the values themselves.
    """
    at = F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]), lambda x: x < seconds))
    found = rows.where(seconds.isNotNull()).withColumn("__at", at)
    return found.groupBy(*keys, slot(ts, minutes).alias("slot")).agg(*[F.count_if(F.col("__at") == i).alias(f"c{i}") for i in range(len(limits) + 1)])


def rolled_up(counts: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """Histograms of slots added up to windows of ``minutes``."""
    names = [c for c in counts.columns if c not in (*keys, "slot")]
    return counts.groupBy(*keys, slot("slot", minutes).alias("slot")).agg(*[F.sum(c).alias(c) for c in names])


def bucket_quantile(limits: tuple[float, ...], q: float) -> Column:
    """The ``q`` quantile of a histogram, taken as even inside a bucket; the last limit where it lies above all."""
    counts = [F.col(f"c{i}") for i in range(len(limits) + 1)]
    upto = [sum(counts[1 : i + 1], counts[0]) for i in range(len(counts))]
    rank = F.lit(q) * upto[-1]
    out = F.lit(float(limits[-1]))
    for i in reversed(range(len(limits))):
        low = float(limits[i - 1]) if i else 0.0
        before = upto[i - 1] if i else F.lit(0)
        out = F.when(upto[i] >= rank, F.lit(low) + F.lit(float(limits[i]) - low) * (rank - before) / counts[i]).otherwise(out)
    return F.when(upto[-1] > 0, out)


def exact_quantiles(rows: DataFrame, value: Column, keys: list[str], ts: str, minutes: int, **quantiles: float) -> DataFrame:
    """``keys, slot`` and the exact ``quantiles`` by name of each window; equal values are added up first, so that a window's task gets each value once."""
    counts = rows.where(value.isNotNull()).groupBy(*keys, slot(ts, minutes).alias("slot"), value.alias("__v")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys, "slot").agg(*[F.percentile("__v", q, F.col("__n")).alias(name) for name, q in quantiles.items()])


def with_exact(rows: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of windows with their exact quantiles; a null among ``keys`` is a key like others."""
    same = [rows[c].eqNullSafe(exact[c]) for c in (*keys, "slot")]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return rows.join(exact, on).drop(*[exact[c] for c in (*keys, "slot")])


def cycle_quantiles(runs: DataFrame, minutes: int = 1440) -> DataFrame:
    """Exact median and 95th percentile of the run time per window; the same by histograms of five minutes, as dashboards show them, and cumulative counts by limit."""
    took = F.when(F.col("finished_at").isNotNull(), seconds_between("started_at", "finished_at").cast("double"))
    rows = rolled_up(histogram(runs, took, CYCLE_LIMITS, [], "started_at"), [], minutes)
    rows = with_exact(rows, exact_quantiles(runs, took, [], "started_at", minutes, p50=0.5, p95=0.95), [])
    upto = [sum((F.col(f"c{j}") for j in range(1, i + 1)), F.col("c0")) for i in range(len(CYCLE_LIMITS) + 1)]
    shown = [n.alias(f"le_{str(x).replace('.', '_')}") for n, x in zip(upto, CYCLE_LIMITS, strict=False)]
    return rows.select(F.col("slot").alias("day"), upto[-1].alias("n"), "p50", "p95", bucket_quantile(CYCLE_LIMITS, 0.5).alias("histogram_p50"), bucket_quantile(CYCLE_LIMITS, 0.95).alias("histogram_p95"), *shown)


def slot(ts: str, minutes: int) -> Column:
    """Start of the time slot that ``ts`` falls into."""
    step = minutes * 60
    return F.timestamp_add("SECOND", (F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts)) / step) * step).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def outcome_rates(runs: DataFrame, minutes: int = 5) -> DataFrame:
    return runs.groupBy(slot("started_at", minutes).alias("slot"), "status").agg(F.count("*").alias("n"))


def route_latency(requests: DataFrame, minutes: int = 60) -> DataFrame:
    """Requests and exact 95th percentile of their time per route and window; the same by histograms of five minutes, as dashboards show it. Requests without a time count in ``n`` only."""
    known = rolled_up(histogram(requests, F.col("duration_ms") / 1000, REQUEST_LIMITS, ["path"], "ts"), ["path"], minutes)
    known = with_exact(known, exact_quantiles(requests, F.col("duration_ms"), ["path"], "ts", minutes, p95_ms=0.95), ["path"])
    rows = requests.groupBy("path", slot("ts", minutes).alias("slot")).agg(F.count("*").alias("n"))
    same = rows["path"].eqNullSafe(known["path"]) & rows["slot"].eqNullSafe(known["slot"])
    return rows.join(known, same, "left").select(rows["path"], rows["slot"], "n", "p95_ms", (bucket_quantile(REQUEST_LIMITS, 0.95) * 1000).alias("histogram_p95_ms"))


def sliding(rows: DataFrame, ts: str, minutes: int, step: int, keys: list[str], *sums: Column) -> DataFrame:
    """Sums over sliding windows; each row is added to the step it falls in first, then steps to the windows over them."""
    steps = rows.groupBy(*keys, slot(ts, step).alias("step")).agg(*sums)
    names = [c for c in steps.columns if c not in (*keys, "step")]
    spread = steps.withColumn("end", F.explode(F.transform(F.sequence(F.lit(1), F.lit(minutes // step)), lambda i: i.cast("int"))))
    end = F.timestamp_add("MINUTE", (F.col("end") * step).cast("int"), F.col("step"))
    return spread.withColumn("window_end", end).groupBy(*keys, "window_end").agg(*[F.sum(c).alias(c) for c in names])


def failing_without_recovery(runs: DataFrame, minutes: int = 15, step: int = 5) -> DataFrame:
    """Windows of a source with failures and no success."""
    n = sliding(runs, "started_at", minutes, step, ["source_id"], F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("ok"))
    return n.where("failed > 0 and ok = 0")


def high_error_rate(requests: DataFrame, minutes: int = 5, step: int = 5, share: float = 0.05, least_rate: float = 0.1, without: tuple[str, ...] = ("signup",)) -> DataFrame:
    """Windows with more than ``share`` server errors at ``least_rate`` requests a second or more."""
    rows = requests.where(~F.col("path").isin(*without))
    n = sliding(rows, "ts", minutes, step, [], F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("errors"))
    return n.where((F.col("errors") > share * F.col("n")) & (F.col("n") >= least_rate * minutes * 60))


def no_inserts(runs: DataFrame, hours: int = 6, step: int = 60) -> DataFrame:
    """Windows of a source with a success in which the most items inserted by any run is 0."""
    n = sliding(runs, "started_at", hours * 60, step, ["source_id"], F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("items_inserted") > 0).alias("inserting"))
    return n.where("ok > 0 and inserting = 0")


def stalled(runs: DataFrame, now: str, most_s: int = 600) -> DataFrame:
    """Per source, whether the last finished run is older than ``most_s``; where none ever finished, whether the first started longer ago."""
    by = runs.groupBy("source_id").agg(F.max("finished_at").alias("last_finished"), F.min("started_at").alias("began"))
    age = F.timestamp_diff("SECOND", F.coalesce("last_finished", "began"), F.lit(now).cast("timestamp_ntz"))
    return by.select("source_id", "last_finished", (age > most_s).alias("stalled"))


def alert_periods(active: DataFrame, keys: list[str], step: int, hold: int, at: str = "window_end") -> DataFrame:
    """``keys, pending_since, last_active, firing_since``: the periods in which an alert's condition held without a break.

    ``active``: the times of a grid of ``step`` minutes at which the condition
    held. An alert fires when it has held for ``hold`` minutes (null if it never
    did). Only where periods begin and end is put in order, which is found by
    joins on neighbouring times.
    """
    rows = active.select(*keys, F.col(at).alias("t")).distinct()
    moved = lambda by: rows.select(*keys, F.timestamp_add("MINUTE", F.lit(by), "t").alias("t"))
    edges = rows.join(moved(step), [*keys, "t"], "left_anti").withColumn("end", F.lit(0)).unionByName(rows.join(moved(-step), [*keys, "t"], "left_anti").withColumn("end", F.lit(1)))
    until = F.lead("t").over(Window.partitionBy(*keys).orderBy("t", "end"))
    due = F.timestamp_add("MINUTE", F.lit(hold), "pending_since")
    found = edges.withColumn("last_active", until).where("end = 0").withColumnRenamed("t", "pending_since")
    return found.select(*keys, "pending_since", "last_active", F.when(F.col("last_active") >= due, due).alias("firing_since"))


def max_over_time(runs: DataFrame, hours: int = 6) -> DataFrame:
    """Per run, the most items that any run of its source inserted in the hours before it.

    Times are rounded to seconds, halves to the even one. Windows run inside a source and day pair of two adjoining days, so that no task needs a source's whole history.
    """
    t = F.rint(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("started_at")) / 1e6).cast("bigint")
    rows = runs.select("id", "source_id", "items_inserted", t.alias("t")).withColumn("home", F.floor(F.col("t") / 86400))
    both = rows.withColumn("day", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    w = Window.partitionBy("source_id", "day").orderBy("t").rangeBetween(-hours * 3600, 0)
    out = both.where((F.col("day") == F.col("home")) | (F.col("t") >= F.col("day") * 86400 - hours * 3600)).withColumn("most", F.max("items_inserted").over(w))
    return out.where("day = home").select("id", "source_id", "most")
