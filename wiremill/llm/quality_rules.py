"""Quality rules: word statistics, two fixed rules and robust multivariate outliers.

Only DataFrame functions are used. Per language and source a minimum covariance
determinant estimate is sought from several starts at once: medians and median
absolute deviations, the mean and covariance of all rows, and those of small
subsets picked by a hash. Each start is refined by concentration steps
(distances of all rows from the present centre, the closest share of them,
their mean and covariance, and again), and per group the start whose covariance
has the least determinant is kept. Rows go through each step as map-side sums
per group and start, so a group may hold any share of the rows; what is kept of
a group is one row of parameters a start, which goes to the rows as a broadcast
behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import SPACES, checked, native_words, share_of_hash, table
from wiremill.session import written

#: The statistics of the vector and the least standard deviation that each is given.
VECTOR = {"x_length": 0.15, "x_word": 0.05, "x_symbol": 0.03, "x_upper": 0.05, "x_dup": 0.4, "x_distinct": 0.05}
_P = list(VECTOR)
#: Quantile of the chi-squared distribution with six degrees of freedom at 0.75 (fixed value).
_CHI2_75 = 7.841


def with_statistics(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """Add the word statistics of a whole text; a null text has none of anything.

    ``n_repeat_words`` counts the words inside windows of ``window`` words that
    occur twice or more in the text. Windows are compared by 64-bit hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.length(F.translate(t, SPACES, ""))
    rows = docs.withColumns({"__t": t, "__words": native_words(F.col(text))})
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": bare.cast("bigint"),
            "n_symbols": (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("bigint"),
            "__upper": F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "__distinct": F.size(F.array_distinct("__words")),
            "__lines": lines,
            "__hashes": hashes,
        }
    ).drop("__words", "__t")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__hashes") - (window - 1)))
    windows = F.when(F.size("__hashes") >= window, F.transform(starts, lambda i: F.xxhash64(F.slice("__hashes", i, window)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"), "__windows": windows}).drop("__lines", "__hashes")
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("__placed", F.when(repeated, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("__windows")
    twice = F.filter("__placed", lambda x, k: F.coalesce(x["h"] == F.get("__placed", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__placed", k + 1)["h"], F.lit(False)))
    rows = rows.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__placed")
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + (s + window - F.greatest(s, a["end"]))).alias("n"), (s + window).alias("end")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", covered).drop("__starts")


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "x_length": F.log1p("n_words"),
        "x_word": F.log(chars / words),
        "x_symbol": F.log1p(F.col("n_symbols") / words),
        "x_upper": F.log1p(10 * F.col("__upper") / chars),
        "x_dup": F.log1p("n_dup_lines"),
        "x_distinct": F.col("__distinct") / words,
    }


_FACTOR = [f"l{i}{j}" for i in range(len(_P)) for j in range(i + 1)]
_CENTRE = [f"m{i}" for i in range(len(_P))]


def _distance(rows: DataFrame, params: DataFrame, name: str) -> DataFrame:
    """Squared Mahalanobis distance of each row from its group, by forward substitution with the Cholesky factor; a row per start if ``params`` has several."""
    rows = rows.join(checked(params), "group", "left")
    for i, x in enumerate(_P):
        rest = sum((F.col(f"l{i}{j}") * F.col(f"__z{j}") for j in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"__z{i}", (F.col(x) - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    total = sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(len(_P))), F.lit(0.0))
    return rows.withColumn(name, total).drop(*[f"__z{i}" for i in range(len(_P))], *_CENTRE, *_FACTOR)


def _factored(moments: DataFrame) -> DataFrame:
    """Means, Cholesky factors and log determinants from sums per group and start; each variance is raised by its floor."""
    n = F.greatest(F.col("n").cast("double"), F.lit(1.0))
    rows = moments.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(len(_P))})
    for i, x in enumerate(_P):
        for j in range(i + 1):
            value = F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            if i == j:
                rows = rows.withColumn(f"l{i}{i}", F.sqrt(F.greatest(value, F.lit(0.0)) + VECTOR[x] ** 2))
            else:
                rows = rows.withColumn(f"l{i}{j}", value / F.col(f"l{j}{j}"))
    return rows.select("group", "start", *_CENTRE, *_FACTOR)


def _log_determinant() -> Column:
    return sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(len(_P))), F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_P)]
    sums += [F.sum(F.col(x) * F.col(y)).alias(f"q{i}{j}") for i, x in enumerate(_P) for j, y in enumerate(_P[: i + 1])]
    return rows.groupBy("group", "start").agg(F.count("*").alias("n"), *sums)


def starts(rows: DataFrame, subsets: int = 2, subset_rows: int = 60) -> DataFrame:
    """The first parameters per ``group`` and ``start``: 0 medians and deviations, 1 all rows, 2 and above hashed subsets of about ``subset_rows``."""
    centre = written(rows.groupBy("group").agg(F.count("*").alias("size"), *[F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(_P)]), "mcd-medians")
    met = rows.join(checked(centre), "group")
    spread = met.groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000).alias(f"a{i}") for i, x in enumerate(_P)])
    diagonal = {f"l{i}{j}": F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + VECTOR[_P[i]] ** 2) if i == j else F.lit(0.0) for i in range(len(_P)) for j in range(i + 1)}
    first = centre.join(spread, "group").withColumns({"start": F.lit(0)} | diagonal).select("group", "start", *_CENTRE, *_FACTOR)
    picked = [F.when(share_of_hash(F.struct(F.lit(k), *_P)) < subset_rows / F.col("size"), F.lit(k)) for k in range(2, 2 + subsets)]
    others = met.select("group", *_P, F.explode(F.array(F.lit(1), *picked)).alias("start")).where("start is not null")
    return written(first.unionByName(_factored(_moments(others))), "mcd-starts")


def concentrated(rows: DataFrame, params: DataFrame, share: float, steps: int) -> DataFrame:
    """``params`` after ``steps`` concentration steps over the closest ``share`` of each group's rows."""
    for step in range(steps):
        near = _distance(rows, params, "d")
        bound = written(near.groupBy("group", "start").agg(F.percentile_approx("d", share, 2000).alias("bound")), "mcd-bounds")
        chosen = near.join(checked(bound), ["group", "start"]).where("d <= bound")
        params = written(_factored(_moments(chosen)), f"mcd-{step}")
    return params


def estimate(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """Location, Cholesky factor and distance scale per ``group``, from columns ``VECTOR``.

    Of all starts, the one with the least determinant after ``steps``
    concentration steps is kept (ties: the first). The scale makes the distance
    at ``share`` equal the chi-squared quantile.
    """
    found = concentrated(rows, starts(rows), share, steps)
    best = found.groupBy("group").agg(F.min(F.struct(_log_determinant().alias("log_det"), "start", *_CENTRE, *_FACTOR)).alias("p"))
    params = written(best.select("group", "p.log_det", *[f"p.{c}" for c in (*_CENTRE, *_FACTOR)]), "mcd-best")
    scale = _distance(rows, params.drop("log_det"), "d").groupBy("group").agg(F.greatest(F.percentile_approx("d", share, 2000) / _CHI2_75, F.lit(1.0)).alias("scale"))
    return written(params.join(scale, "group"), "mcd-scaled")


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", cutoff: float = 70.0) -> DataFrame:
    """``key``, the statistics, ``base_failed``, ``distance`` and ``kept`` of each document.

    Every group (language, source; null is a value like others) has its own
    estimate, however small: variances have a floor, so that the distance of a
    group's only document is 0 and a few like documents are all kept.
    Documents that fail a base rule take no part in the estimates. A document
    is kept if it passes the base rules and its scaled squared distance is at
    most ``cutoff``.

    A null, empty or wordless text has no words and fails a base rule; texts of
    any length are taken whole; repeated rows and rows with a null key are
    judged one by one; an empty table gives an empty table; other columns are
    not looked at.
    """
    named = F.concat_ws("\x1f", F.coalesce(F.col(lang).cast("string"), F.lit("\x1e")), F.coalesce(F.col(source).cast("string"), F.lit("\x1e")))
    rows = with_statistics(docs.select(F.col(key).alias("__key"), named.alias("group"), F.col(text).alias("__text")), "__text").drop("__text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumns(_vector()).withColumn("base_failed", failed).drop("__upper", "__distinct")
    rows = written(rows, "statistics")
    params = estimate(rows.where("not base_failed").select("group", *_P)).drop("log_det")
    out = _distance(rows, params, "d").withColumn("distance", F.col("d") / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; cases as of :func:`judge`."""
    return judge(table(spark, sf_dir, "documents"))
