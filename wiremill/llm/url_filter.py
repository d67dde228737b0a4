"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

Only SQL functions and Spark's own learners are used: the n-grams are built and
hashed by expressions, the weights of the fitted regression are one array of a
fixed size, and a score is a sum over array entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import share_of_hash, table

#: (verdict, host, start of the path): the rules that the contract states.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as ``host/path``) and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column, sizes: Sequence[int] = (3, 4, 5), bits: int = 11) -> Column:
    """Distinct buckets (from 0) of the character n-grams of host and path, ends marked; host and path don't mix."""
    def grams(part: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(part) - (n - 1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(part, i, F.lit(n))), F.lit(1 << bits)).cast("int"))

    parts = [F.concat(F.lit(mark), F.coalesce(text, F.lit("")), F.lit("$")) for mark, text in (("^", host), ("~", path))]
    return F.array_distinct(F.concat(*[grams(p, n) for p in parts for n in sizes]))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", sizes: Sequence[int] = (3, 4, 5), bits: int = 11, most_rows: int = 4000, regularisation: float = 0.01) -> tuple[float, list[float]]:
    """Intercept and weights from a small table of URLs with labels 1 (block) and 0 (allow).

    About ``most_rows`` distinct labelled URLs at most are used, picked by a
    hash of the URL. With fewer than two kinds of labels every weight is 0 and
    the intercept says which kind there is (allow where there is none).
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(url).alias("u")).agg(F.max(label).cast("double").alias("label"))
    share = min(1.0, most_rows / max(1, rows.count()))
    rows = rows.where(share_of_hash(F.col("u")) < F.lit(share))
    width = 1 << bits
    found = F.array_sort(gram_buckets(host_of(F.col("u")), path_of(F.col("u")), sizes, bits))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(F.col("g"), i).cast("double"))
    rows = rows.withColumn("g", found).orderBy("u").coalesce(2).select("label", array_to_vector(dense).alias("features")).cache()
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        rows.unpersist()
        return (5.0 if kinds == [1.0] else -5.0), [0.0] * width
    model = LogisticRegression(regParam=regularisation, maxIter=40, standardization=False, featuresCol="features", labelCol="label").fit(rows)
    rows.unpersist()
    return float(model.intercept), [float(w) for w in model.coefficients.toArray()]


def block_probability(host: Column, path: Column, intercept: float, weights: Sequence[float], sizes: Sequence[int] = (3, 4, 5), bits: int = 11) -> Column:
    held = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate(gram_buckets(host, path, sizes, bits), F.lit(intercept), lambda s, b: s + F.element_at(held, b + 1))
    return 1 / (1 + F.exp(-total))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the labelled table is the URLs that a rule decides. Cases as of :func:`judge`."""
    return judge(table(spark, sf_dir, "pages"), rules=RULES)


def judge(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of each row.

    A URL that a rule fits gets the rule's verdict; all others get that of the
    regression (block from a probability of 0.5). ``labelled`` is a small table
    ``url, label``; without one, the URLs that the rules decide are it. A null
    URL, or one without ``://``, has an empty host and path and is judged by
    the regression. Of rules of equal length the later one counts. Repeated
    rows get equal verdicts; null keys are rows like others; an empty table
    gives an empty table; other columns are not looked at.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("u")).withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    if labelled is None:
        labelled = rows.where("said is not null").select(F.col("u").alias("url"), (F.col("said") == "block").cast("int").alias("label"))
    intercept, weights = fit(labelled)
    rows = rows.withColumn("score", block_probability(F.col("host"), F.col("path"), intercept, weights))
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", learned).alias("verdict"), "score")
