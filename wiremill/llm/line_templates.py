"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

The tree has three levels: number of tokens, leading tokens, template. A line
goes down by its token count and its first ``depth`` tokens (tokens with a digit
count as variable) into a leaf. Inside a leaf a token stays literal at its
position if enough documents have it there, else it is a variable field; lines
with the same literals share a template. Templates with enough literals that
recur across documents are boilerplate, and their lines are dropped.

Copies of one document should not make its lines boilerplate, while a block of
lines that stand together in unlike documents is. For each document a signature
is therefore taken of what is its own: the least hash of its lines that fewer
than ``min_docs`` documents have. Near copies in large groups have most lines in
common and no own lines but those edited in a few words, so in a document with
as many common lines as others, lines that begin or end like a common one (four
tokens), or are too short to tell, are no own ones. A document without own lines
has the least hash of its common lines, which copies share. Since some edits
escape this, the signatures of a template also have to be a tenth of its
documents. Templates are counted by signatures; a line with enough signatures
makes its tokens literal without further counting, and joins on lines broadcast
the frequent ones, so no task meets all documents of a line. Lines, leaves and
templates are told apart by hashes of 60 and 64 bits.

Nulls, empty texts and repeats: a null text stays null and counts as one empty
line; rows with a null key are documents like others; repeated rows (same key
and text) count as one document and each lose the same lines; lines of fewer
than ``min_tokens`` tokens always stay; an empty table gives an empty table;
texts of any length are taken whole; other columns are passed through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.llm.common import checked, join_skewed, left_join_skewed, spaced, table
from wiremill.session import written

VARIABLE = "<*>"
MIN_TOKENS, MIN_DOCS, LITERAL_SHARE, DEPTH, UNLIKE_SHARE = 3, 10, 0.7, 3, 0.1


def _lines(text: Column) -> Column:
    """The lines of a text, tokens joined by single spaces."""
    return F.transform(F.split(F.regexp_replace(spaced(text, kept="\n"), "  +", " "), "\n"), lambda x: F.trim(x))


def _masked(line: Column) -> Column:
    """A line with its tokens that hold a digit as variable fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(line)


def document_key(key: Column, text: Column) -> Column:
    """A 64-bit hash per different (key, text), null-safe; repeated rows share it."""
    return F.xxhash64(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("~")), F.coalesce(text, F.lit("~"))))


def _short(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _placed(m: Column, depth: int) -> tuple[Column, Column]:
    """Number of tokens and leaf of a masked line."""
    n = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + F.when(m == "", 0).otherwise(1)
    return n, F.xxhash64(n, F.substring_index(m, " ", depth))


#: Tokens at either end by which an edited line is known (half of a shorter line's).
EDGE = 4


def _own_signatures(lines: DataFrame, min_docs: int) -> DataFrame:
    """``k, sig``: each document's signature, from ``lines`` (``k, d, head, tail``, a row for each different line of a document).

    A document's lines stand together, so all that is shuffled are counts of
    lines and a row per document; the common lines and their ends are met by
    broadcast joins while they are few, and otherwise by joins that split the
    frequent ones.
    """
    common = written(lines.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "common-lines")
    few = checked(common) is not common
    met = (lambda rows, known, on: rows.join(F.broadcast(known), on, "left")) if few else left_join_skewed  # as many ends as common lines at most
    held = lines.join(checked(common.select("d")), "d", "left_semi")
    edges = {c: written(held.groupBy(c).agg(F.count("*").alias("n")).where(f"{c} is not null"), f"common-{c}s") for c in ("head", "tail")}
    rows = met(lines, common, ["d"]).withColumn("common", F.col("n").isNotNull()).drop("n")
    for c, known in edges.items():
        rows = met(rows, known, [c]).withColumn(f"like_{c}", F.col("n").isNotNull()).drop("n")
    least = lambda of: F.min(F.when(of, F.col("d")))
    own, unlike = ~F.col("common"), F.col("head").isNotNull() & ~F.col("like_head") & ~F.col("like_tail")
    by = rows.groupBy("k").agg(least(F.col("common")).alias("shared"), least(own).alias("own"), least(own & unlike).alias("unlike"), F.count_if("common").alias("n_common"), F.count_if(own).alias("n_own"))
    doubtful = F.col("n_own") <= F.col("n_common")
    return by.select("k", F.coalesce(F.when(doubtful, F.col("unlike")).otherwise(F.col("own")), "shared", "own").alias("sig"))


def template_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, literal_share: float = LITERAL_SHARE, depth: int = DEPTH, unlike_share: float = UNLIKE_SHARE) -> DataFrame:
    """``k, line_no``: the lines (from 0) that match a recurring template; ``k`` as of :func:`document_key`.

    The texts are read twice: once for a compact table with hashes of each
    line, once for the words of those different lines whose leaf recurs. Lines
    are exploded as outer ones: else the planner would make them once more for
    a filter on their number. A document's lines are sorted by their hash, so
    that each knows whether it is the first of its kind there.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n, leaf = _placed(F.col("m"), depth)
    made = F.array_sort(F.transform(_lines(t), lambda x, i: F.struct(_short(F.md5(x)).alias("d"), i.alias("line_no"), x.alias("x"), _masked(x).alias("m"))))
    marked = F.transform(F.array(made), lambda a: F.transform(a, lambda e, i: F.struct(e["d"].alias("d"), e["line_no"].alias("line_no"), e["x"].alias("x"), e["m"].alias("m"), F.coalesce(F.get(a, i - 1)["d"] != e["d"], F.lit(True)).alias("new"))))
    flat = docs.select(document_key(F.col(key), F.col(text)).alias("k"), F.explode_outer(F.get(marked, F.lit(0))).alias("e")).select("k", "e.*")
    flat = flat.select("k", "d", "line_no", "x", "m", "new", n.alias("n"))
    edge = f"cast(least({EDGE}, floor(n / 2)) as int)"
    ends = {c: F.when(F.expr(edge) >= 2, F.xxhash64(F.expr(f"substring_index(x, ' ', {sign}{edge})"))) for c, sign in (("head", ""), ("tail", "-"))}
    flat = flat.select("k", "line_no", "new", F.when(F.col("n") >= min_tokens, leaf).alias("leaf"), F.when(F.col("n") >= min_tokens, F.xxhash64("m")).alias("h"), "d", *[F.when(F.col("new"), e).alias(c) for c, e in ends.items()])
    flat = written(flat, "lines")
    rows = flat.where("new")
    sigs = _own_signatures(rows.select("k", "d", "head", "tail"), min_docs)
    flat = flat.where("leaf is not null").select("k", "line_no", "leaf", "h")
    # One row per different line and signature of a leaf that recurs: all later counts are over these.
    kinds = rows.where("leaf is not null").select("k", "leaf", "h").join(sigs, "k").groupBy("leaf", "h", "sig").agg(F.count("*").alias("docs"))
    kinds = written(kinds, "line-kinds")
    busy = checked(written(kinds.groupBy("leaf").agg(F.count_distinct("sig").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "busy-leaves"))
    counts = written(kinds.join(busy, "leaf", "left_semi").groupBy("leaf", "h").agg(F.count("*").alias("n"), F.sum("docs").alias("docs")), "line-counts")
    frequent = F.col("n") >= min_docs
    again = docs.select(F.explode_outer(F.transform(_lines(t), _masked)).alias("m")).select("m", n.alias("n")).where(F.col("n") >= min_tokens).select("m", leaf.alias("leaf"))
    forms = again.join(busy, "leaf", "left_semi").select("leaf", F.xxhash64("m").alias("h"), "m").distinct()
    tokens = F.transform(F.split("m", " "), lambda x: F.when(x != VARIABLE, F.xxhash64(x)))
    forms = written(forms.select("leaf", "h", tokens.alias("tokens")).join(counts, ["leaf", "h"]), "line-forms")
    words = forms.select("leaf", "h", "n", "docs", F.posexplode("tokens").alias("pos", "token"))
    place = ["leaf", "pos", "token"]
    # A token can't be literal beyond the sum of its lines' signatures; where one of the lines has enough, it is for sure.
    bounds = words.where("token is not null").groupBy(*place).agg(F.sum("n").alias("most"), F.max("n").alias("n")).where(F.col("most") >= min_docs)
    bounds = written(bounds, "literal-bounds")
    open_words = words.where(~frequent & F.col("token").isNotNull()).join(checked(bounds.where(~frequent).select(*place)), place, "left_semi")
    rare = join_skewed(kinds.drop("docs"), counts.drop("docs"), ["leaf", "h"]).where(~frequent).select("leaf", "h", "sig")  # fewer than min_docs a line
    counted = open_words.select("h", *place).join(rare, ["leaf", "h"]).groupBy(*place).agg(F.count_distinct("sig").alias("n")).where(frequent)
    literal = written(bounds.where(frequent).select(*place).union(counted.select(*place)), "literals")
    shown = words.join(checked(literal).withColumn("kept", F.lit(True)), place, "left")
    fields = F.xxhash64(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("kept"), F.col("token")).alias("token")))))
    templates = shown.groupBy("leaf", "h").agg(fields.alias("template"), F.first("n").alias("n"), F.first("docs").alias("docs"), F.count("kept").alias("literals"), F.count("*").alias("n_tokens"))
    templates = written(templates.where(F.col("literals") >= literal_share * F.col("n_tokens")).select("leaf", "h", "template", "n", "docs"), "line-templates")
    met = join_skewed(kinds.drop("docs"), templates.drop("docs"), ["leaf", "h"]).groupBy("leaf", "template").agg(F.count_distinct("sig").alias("sigs"))
    held = templates.groupBy("leaf", "template").agg(F.sum("docs").alias("docs"))
    recurring = met.join(held, ["leaf", "template"]).where((F.col("sigs") >= min_docs) & (F.col("sigs") >= unlike_share * F.col("docs"))).select("leaf", "template")
    dropped = written(templates.join(recurring, ["leaf", "template"], "left_semi").select("leaf", "h", "n"), "line-dropped")
    if checked(dropped) is not dropped:
        return flat.join(F.broadcast(dropped.select("leaf", "h")), ["leaf", "h"], "left_semi").select("k", "line_no")
    return join_skewed(flat, dropped, ["leaf", "h"]).select("k", "line_no")


def drop_template_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **rules: float) -> DataFrame:
    """``docs`` with its columns, ``text`` without its template lines, plus ``n_lines``, ``n_dropped``.

    Every document stays, with an empty text if all its lines go. The texts are
    dealt once, by key, to meet the numbers of their dropped lines; the plan is
    the same at every size.
    """
    found = template_lines(docs, text, key, **rules).groupBy("k").agg(F.sort_array(F.collect_set("line_no")).alias("__gone"))
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)]).withColumn("__k", document_key(F.col(f"__c{names.index(key)}"), F.col(f"__c{names.index(text)}")))
    rows = rows.join(found.hint("shuffle_hash"), F.col("__k") == F.col("k"), "left").drop("k", "__k")
    old = F.col(f"__c{names.index(text)}")
    rows = rows.withColumn("__lines", F.split(F.coalesce(old, F.lit("")), "\n"))
    bounds = F.concat(F.array(F.lit(-1)), F.coalesce("__gone", F.array().cast("array<int>")), F.array(F.size("__lines")))
    rows = rows.withColumn("__bounds", bounds)
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("__bounds") - 1), lambda i: F.slice("__lines", F.get("__bounds", i - 1) + 2, F.get("__bounds", i) - F.get("__bounds", i - 1) - 1)))
    new = F.when(F.col("__gone").isNull(), old).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        *[(new if c == text else F.col(f"__c{i}")).alias(c) for i, c in enumerate(names)],
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines and the MD5 of the text that is left (null for a null text); cases as of the module."""
    out = drop_template_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


OP4_SQL = f"""
WITH base AS (
  SELECT doc_id, text, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(text, '~'))) AS k, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
spelt AS (SELECT k, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM base),
words AS (SELECT k, line_no, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]'), lambda w: w <> '') AS x FROM spelt),
tokens AS (SELECT k, line_no, x, list_transform(x, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{VARIABLE}' ELSE w END) AS m FROM words),
edges AS (
  SELECT DISTINCT k, md5(array_to_string(x, ' ')) AS d, CASE WHEN len(x) >= 4 THEN array_to_string(x[1:least({EDGE}, len(x) // 2)], ' ') END AS head,
    CASE WHEN len(x) >= 4 THEN array_to_string(x[len(x) - least({EDGE}, len(x) // 2) + 1:], ' ') END AS tail
  FROM tokens),
common AS (SELECT d FROM edges GROUP BY d HAVING count(DISTINCT k) >= {MIN_DOCS}),
marked AS (SELECT *, d IN (SELECT d FROM common) AS is_common FROM edges),
shares AS (SELECT k, min(d) FILTER (is_common) AS shared, count(*) FILTER (NOT is_common) AS n_own, count(*) FILTER (is_common) AS n_common FROM marked GROUP BY k),
heads AS (SELECT DISTINCT head FROM marked WHERE is_common AND head IS NOT NULL),
tails AS (SELECT DISTINCT tail FROM marked WHERE is_common AND tail IS NOT NULL),
own AS (
  SELECT k, d FROM marked m JOIN shares USING (k)
  WHERE NOT is_common AND (n_own > n_common OR head IS NOT NULL AND NOT (EXISTS (SELECT 1 FROM heads WHERE heads.head = m.head) OR EXISTS (SELECT 1 FROM tails WHERE tails.tail = m.tail)))),
sigs AS (SELECT k, coalesce((SELECT min(d) FROM own WHERE own.k = shares.k), shared, (SELECT min(d) FROM marked WHERE marked.k = shares.k)) AS sig FROM shares),
signed AS (SELECT k, sig, x, m, line_no FROM tokens JOIN sigs USING (k)),
placed AS (
  SELECT k, sig, line_no, x, CAST(len(m) AS VARCHAR) || ' ' || array_to_string(m[1:{DEPTH}], ' ') AS leaf, array_to_string(m, ' ') AS m
  FROM signed WHERE len(m) >= {MIN_TOKENS}),
busy AS (SELECT leaf FROM placed GROUP BY leaf HAVING count(DISTINCT sig) >= {MIN_DOCS}),
kinds AS (SELECT leaf, m, sig, count(DISTINCT row(k, x)) AS docs FROM placed WHERE leaf IN (SELECT leaf FROM busy) GROUP BY leaf, m, sig),
spread AS (SELECT leaf, m, sig, unnest(string_split(m, ' ')) AS token, unnest(range(len(string_split(m, ' ')))) AS pos FROM kinds),
literal AS (SELECT leaf, pos, token FROM spread WHERE token <> '{VARIABLE}' GROUP BY ALL HAVING count(DISTINCT sig) >= {MIN_DOCS}),
shown AS (
  SELECT s.leaf, s.m, s.pos, l.token AS kept
  FROM (SELECT DISTINCT leaf, m, pos, token FROM spread) s LEFT JOIN literal l ON l.leaf = s.leaf AND l.pos = s.pos AND l.token = s.token),
templates AS (
  SELECT leaf, m, string_agg(coalesce(kept, '{VARIABLE}'), ' ' ORDER BY pos) AS template
  FROM shown GROUP BY leaf, m HAVING count(kept) >= {LITERAL_SHARE} * count(*)),
recurring AS (SELECT leaf, template FROM kinds JOIN templates USING (leaf, m) GROUP BY leaf, template HAVING count(DISTINCT sig) >= {MIN_DOCS} AND count(DISTINCT sig) >= {UNLIKE_SHARE} * sum(docs)),
dropped AS (SELECT DISTINCT m FROM templates SEMI JOIN recurring USING (leaf, template)),
gone AS (SELECT DISTINCT k, line_no FROM placed WHERE m IN (SELECT m FROM dropped)),
per_doc AS (SELECT k, list(line_no) AS g FROM gone GROUP BY k)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_dropped,
  md5(CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END) AS text_md5
FROM base LEFT JOIN per_doc USING (k)
"""
