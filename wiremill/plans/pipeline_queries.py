"""Linking, merging, dedupe, maintenance and alert queries over the model, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiremill.operators import alerts as A
from wiremill.operators import dedupe as D
from wiremill.operators import extract as E
from wiremill.operators import maintenance as R
from wiremill.operators import upsert as U
from wiremill.operators import news as N
from wiremill.plans.oracle_model import MODEL
from wiremill.sources import feeds as S
from wiremill.sources import model as M
from wiremill.session import written

Q, SQL = {}, {}
NOW = "2024-01-31 12:00:00"
LONG_AGO = "2024-02-10 00:00:00"


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _filled(rows: DataFrame, column: str = "article_id") -> DataFrame:
    """Null ids as -1, so that results compare as whole numbers."""
    return rows.withColumn(column, F.coalesce(column, F.lit(-1)))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Articles as feed entries; every fourth comes from a feed of one symbol."""
    feed = F.when(F.col("id") % 4 == 0, "https://feeds.example/rss?s=la").when(F.col("id") % 4 == 1, "https://feeds.example/rss?s=LA,DE").otherwise("https://feeds.example/rss")
    return M.articles(spark, d).select("id", "title", "summary", F.col("canonical_url").alias("link"), feed.alias("feed_url"), "source_name")


def _sql_list(words: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{w}'" for w in words) + "] AS VARCHAR[])"


_STOP = ", ".join(f"'{w}'" for w in E.STOPWORDS)
_ZONES = ", ".join(f"'{w}'" for w in E.TIMEZONES)
_LETTER = "[\\p{L}\\p{N}_]"
_HITS = f"""
seg AS (
  SELECT id, 'title' AS segment, title AS t FROM articles UNION ALL SELECT id, 'summary', summary FROM articles UNION ALL SELECT id, 'link', canonical_url FROM articles),
cuts AS (SELECT id, segment, string_split(t, 'EST') AS p FROM seg WHERE contains(t, 'EST')),
spots AS (SELECT id, segment, right(array_to_string(p[1:i], 'EST'), 24) AS l, left(array_to_string(p[i + 1:], 'EST'), 24) AS r FROM (SELECT id, segment, p, unnest(range(1, len(p))) AS i FROM cuts)),
zone AS (
  SELECT id, segment, l LIKE '%(' AND r LIKE ')%' AS held,
    regexp_matches(l, '(?i)(\\b\\d{{1,2}}[:.]\\d{{2}}\\s*([ap]\\.?m\\.?)?|\\b\\d{{1,2}}\\s*[ap]\\.?m\\.?|\\b(midnight|noon))\\s*[(\\[]?\\s*$') OR regexp_matches(r, '(?i)^\\s*([|/,;-]\\s*)?\\d{{1,2}}([:.]\\d{{2}})?\\s*[ap]\\.?m\\.?\\b') AS timed
  FROM spots WHERE NOT regexp_matches(l, '{_LETTER}$') AND NOT regexp_matches(r, '^{_LETTER}')),
hits AS (
  SELECT DISTINCT id, symbol, channel, segment, timed FROM (
    SELECT id, 'LA' AS symbol, 'context' AS channel, 'feed' AS segment, false AS timed FROM articles WHERE id % 4 = 0
    UNION ALL SELECT id, unnest(regexp_extract_all(t, '(?:NYSE|NASDAQ|AMEX)\\s*[:\\-]\\s*([A-Z]{{1,5}})', 1)), 'exchange', segment, false FROM seg
    UNION ALL SELECT id, w, 'paren', segment, false FROM (SELECT id, segment, unnest(regexp_extract_all(t, '\\(([A-Z]{{1,5}})\\)', 1)) AS w FROM seg) WHERE w NOT IN ({_ZONES})
    UNION ALL SELECT id, w, 'token', segment, false FROM (SELECT id, segment, unnest(regexp_extract_all(t, '{_LETTER}+')) AS w FROM seg) WHERE regexp_full_match(w, '[A-Z]{{1,5}}') AND w NOT IN ({_ZONES})
    UNION ALL SELECT id, 'EST', 'token', segment, timed FROM zone
    UNION ALL SELECT id, 'EST', 'paren', segment, false FROM zone WHERE held AND NOT timed)
  WHERE symbol IN (SELECT symbol FROM tickers WHERE active))"""
CANDIDATES = f"{MODEL}, {_HITS}"


@query(f"{CANDIDATES} SELECT * FROM hits")
def ticker_candidates(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(entries(spark, d), M.tickers(spark).where("active"))


#: Profiles of the symbols with names, written out: terms, phrases, the sponsor's terms and keywords, phrases that are safe beside a zone of time.
_NAMED = {
    "IDE": (["harbor", "ridge", "idea"], ["harbor ridge", "ridge real", "real idea", "idea fund"], ["harbor", "ridge"], ["harbor", "ridge", "harbor ridge"]),
    "EST": (["stone", "peak", "estate"], ["stone peak", "peak estate", "estate trust"], ["stone", "peak"], ["stone", "peak", "stone peak"]),
    "FUND": (["golden", "meadow"], ["golden meadow", "meadow trust"], ["golden", "meadow"], ["golden", "meadow", "golden meadow"]),
    "HRO": (["harbor", "ridge", "opps"], ["harbor ridge", "ridge global", "global opps", "opps fd"], ["harbor", "ridge"], ["harbor", "ridge", "harbor ridge"]),
}
_PROFILE = " UNION ALL ".join(
    f"SELECT '{s}' AS symbol, " + ", ".join(f"{_sql_list(x)} AS {n}" for x, n in zip(_NAMED[s] if s in _NAMED else ([w for w in k.split(",") if w], [], [], []), ("terms", "phrases", "sponsor_terms", "sponsor"), strict=True))
    for s, k, _, _ in M.SYMBOLS
)
_EDGE = "($|[^a-z0-9])"
_LINKS = f"""
profile AS ({_PROFILE}),
head AS (SELECT id, lower(concat_ws(' ', nullif(title, ''), nullif(summary, ''))) AS head FROM articles),
found AS (
  SELECT h.*, p.*, len(list_concat(terms, phrases)) = 0 AS none, h.symbol IN ({_STOP}) AS stop, len(p.sponsor) > 0 AS named,
    CASE WHEN h.symbol = 'FUND' THEN 'common' WHEN h.symbol = 'IDE' THEN 'ambiguous' WHEN h.symbol = 'EST' THEN 'timezone' ELSE 'normal' END AS kind,
    regexp_matches(head, '(^|[^a-z0-9])({"|".join(E.FINANCE)}){_EDGE}') AS finance,
    list_filter(list_concat(terms, phrases), lambda k: regexp_matches(head, '(^|[^a-z0-9])' || k || '{_EDGE}')) AS f
  FROM hits h JOIN head USING (id) JOIN profile p ON p.symbol = h.symbol),
judged AS (
  SELECT *, len(f) >= 2 OR len(list_filter(f, lambda k: len(k) <= 3 OR contains(k, ' '))) > 0 AS ok, len(f) > 0 AND (NOT named OR list_has_any(f, sponsor)) AS by_name,
    len(list_filter(f, lambda k: list_contains(terms, k) AND NOT list_contains(sponsor_terms, k))) AS extra, len(list_filter(f, lambda k: list_contains(terms, k))) AS n_terms, list_has_any(f, phrases) AS phrase FROM found),
decided AS (
  SELECT id, symbol, channel, segment, CASE channel WHEN 'context' THEN 0.93 WHEN 'exchange' THEN 0.88
    WHEN 'paren' THEN CASE WHEN stop AND NOT ok THEN NULL WHEN none THEN 0.70 WHEN ok THEN 0.75 ELSE 0.62 END
    ELSE CASE WHEN stop OR kind = 'common' THEN NULL WHEN segment = 'link' THEN CASE WHEN kind = 'normal' AND NOT timed THEN 0.62 END
      WHEN kind = 'ambiguous' THEN CASE WHEN finance AND by_name AND (phrase OR CASE WHEN named THEN extra > 0 ELSE n_terms >= 2 END) THEN 0.68 END
      WHEN kind = 'timezone' AND timed THEN CASE WHEN by_name AND (phrase OR CASE WHEN named THEN extra >= 2 ELSE n_terms >= 3 END) THEN 0.68 END
      WHEN ok THEN 0.68 ELSE 0.62 END END::DOUBLE AS confidence
  FROM judged
  UNION ALL SELECT id, 'HRO', 'fund_name', 'feed', 0.66 FROM articles WHERE contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' harbor ridge global opportunities ')),
links AS (
  SELECT id, symbol, CASE WHEN channel = 'token' AND confidence = 0.68 THEN 'validated_token' ELSE channel END AS match_type, confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY id, symbol ORDER BY confidence DESC, list_position(['feed', 'title', 'summary', 'link'], segment), list_position(['context', 'fund_name', 'exchange', 'paren', 'token'], channel)) AS rn FROM decided WHERE confidence IS NOT NULL) WHERE rn = 1)"""
LINKS = f"{CANDIDATES}, {_LINKS}"


def links(spark: SparkSession, d: str) -> DataFrame:
    return E.links(entries(spark, d), M.tickers(spark).where("active"), E.profiles(M.tickers(spark)))


@query(f"{LINKS} SELECT * FROM links")
def ticker_links(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


@query(
    """WITH p AS (SELECT p_partkey AS id, p_name, p_brand, ['LA', 'DER', 'IDE', 'ZZZ'][p_partkey % 4 + 1] AS s FROM part)
    SELECT id, s AS symbol, 'fund name ' || lower(s) || ' ' || p_name || ' & co' || CASE WHEN id % 3 = 0 THEN ' fund name other ' || lower(p_brand) || ' ' || lower(s) ELSE '' END AS context FROM p WHERE s <> 'ZZZ'
    UNION ALL SELECT id, 'QUE', 'fund name other que' FROM p WHERE id % 3 = 1"""
)
def ticker_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables with a header in the middle, entities and tags in cells."""
    i = F.col("p_partkey")
    s = F.element_at(F.array(*[F.lit(x) for x in ("LA", "DER", "IDE", "ZZZ")]), (i % 4).cast("int") + 1)
    html = F.concat(
        F.lit("<p>LA</p><table class='x'><tr><th>Fund</th><th> Name</th><th></th></tr><tr><td><b>"), F.lower(s), F.lit("</b></td><td>"), F.col("p_name"), F.lit(" &amp;\n co</td></tr><tr><TH>Other</TH><td> </td></tr>"),
        F.when(i % 3 == 0, F.concat(F.lit("<tr><td>"), F.col("p_brand"), F.lit("</td><td>"), s, F.lit("</td></tr>"))).when(i % 3 == 1, "<tr><td>QUE</td></tr>").otherwise("<tr><td>THE</td></tr>"), F.lit("</table>"),
    )
    return E.table_contexts(M.read(spark, d, "part").select(i.alias("id"), html.alias("html")), M.tickers(spark).where("active"))


@query(
    f"{MODEL} SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'QUE' ELSE 'IDE' END AS symbol, CASE WHEN page_id % 3 = 0 THEN 'paren' ELSE 'bw_table' END AS match_type, CASE page_id % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.84 ELSE 0.62 END::DOUBLE AS confidence FROM pages"
)
def page_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Entries without a symbol of their own whose pages name one: in the text, beside a keyword, or in a table, with and without support from the title."""
    i = F.col("page_id")
    quiet = F.regexp_replace("html", "[A-Z]{1,5}\\b", "x")  # no symbols but those put in
    more = F.when(i % 3 == 0, "<p>Far off. The que and qui (QUE) of it! Much later.</p>").otherwise("<table><tr><th>Idea Fund</th></tr><tr><td>IDE</td></tr></table>")
    title = F.when(i % 3 == 1, "Harbor Ridge idea dividend").otherwise("Nothing to see")
    pages = M.read(spark, d, "pages").select(i.alias("id"), F.concat(F.regexp_replace(quiet, "(?i)</body>.*$", ""), more).alias("html"))
    rows = M.read(spark, d, "pages").select(i.alias("id"), title.alias("title"), F.lit("").alias("summary"), F.lit("https://www.wire.example/a").alias("link"), F.lit("https://feeds.example/rss").alias("feed_url"))
    return E.with_fallback(rows, pages, E.profiles(M.tickers(spark)), M.tickers(spark).where("active"), "bw_table")


@query(f"{LINKS} SELECT a.id, a.source_name FROM articles a WHERE a.source_name = 'src0' OR a.id IN (SELECT l.id FROM links l JOIN articles x ON x.id = l.id WHERE confidence >= 0.65 AND (match_type <> 'context' OR x.source_name = 'src2')) OR a.id % 50 = 7")
def entry_gate(spark: SparkSession, d: str) -> DataFrame:
    """Policies of feeds and sources; a feed's own symbol verifies entries of the scoped source only."""
    policy = F.when(F.col("code") == M.GENERAL_SOURCE, "general_allowed").when(F.col("code") == "src2", "scoped_context_required").otherwise("validated_mapping_required")
    sources = M.sources(spark, d).select(F.col("code").alias("source_code"), policy.alias("source_policy"))
    own = S.resolve_policy(entries(spark, d).withColumn("source_code", F.col("source_name")), S.registry(spark), sources=sources).join(sources, "source_code", "left")
    return E.gate(own, links(spark, d), own.where("id % 50 = 7").select("id"), scoped=True).select("id", "source_name")


@query(f"{MODEL} SELECT id, CASE source_name WHEN 'src0' THEN 'general_allowed' WHEN 'src2' THEN 'scoped_context_required' ELSE 'validated_mapping_required' END AS policy FROM articles")
def entry_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = M.articles(spark, d).select("id", F.concat(F.lit("feed/"), "source_name").alias("feed_url"))
    return S.resolve_policy(rows, S.registry(spark)).select("id", "policy")


@query(f"{MODEL} SELECT id, source_name FROM articles WHERE source_name IN ('src1', 'src2')")
def strict_feed_articles(spark: SparkSession, d: str) -> DataFrame:
    strict = S.strict_feeds(S.registry(spark)).select(F.col("code").alias("source_name"))
    return M.articles(spark, d).join(strict, "source_name", "left_semi").select("id", "source_name")


_DULL = ", ".join(f"'{w}'" for w in E.NAME_STOPWORDS)


@query(
    f"""WITH one AS (SELECT p_brand AS symbol, max(p_name) || ' Trust, Inc.' AS fund_name, max(p_name) || ' ' || max(p_type) AS sponsor FROM part GROUP BY 1),
    w AS (SELECT symbol, list_transform(string_split(fund_name, ' '), lambda x: lower(trim(x, '.,'))) AS w, list_transform(string_split(sponsor, ' '), lambda x: lower(x)) AS s, string_split(sponsor, ' ') AS raw FROM one),
    t AS (SELECT *, list_transform(w, lambda x: len(x) >= 4 AND x NOT IN ({_DULL})) AS ok, w[1:2] AS lead FROM w),
    p AS (SELECT *, list_filter(w, lambda x, i: ok[i]) AS terms, list_transform(list_filter(range(1, len(w)), lambda i: ok[i] OR ok[i + 1]), lambda i: w[i] || ' ' || w[i + 1]) AS phrases,
      list_filter(lead, lambda x: len(x) >= 4 AND x NOT IN ({_DULL})) AS st FROM t)
    SELECT symbol, list_sort(list_distinct(list_concat(terms, phrases, st, [array_to_string(lead, ' ')]))) AS keywords, list_sort(list_distinct(list_append(st, array_to_string(lead, ' ')))) AS sponsor,
      [array_to_string(lead, ' ') || ' trust', array_to_string(lead, ' ') || ' trust inc'] AS titles FROM p"""
)
def keyword_profiles(spark: SparkSession, d: str) -> DataFrame:
    names = M.read(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.concat(F.max("p_name"), F.lit(" Trust, Inc.")).alias("fund_name"), F.concat(F.max("p_name"), F.lit(" "), F.max("p_type")).alias("sponsor"))
    rows = names.withColumns({"active": F.lit(True), "validation_keywords": F.lit(None).cast("string")})
    return E.profiles(rows).select("symbol", F.array_sort("keywords").alias("keywords"), F.array_sort("sponsor").alias("sponsor"), F.array_sort("titles").alias("titles"))


KEYED = """SELECT *, source_id || '|' || CASE WHEN raw_guid IS NOT NULL THEN 'g:' || raw_guid WHEN raw_pub_date IS NOT NULL THEN 'd:' || raw_link || '|' || CAST(raw_pub_date AS VARCHAR) ELSE 'l:' || raw_link END AS key FROM raw_items"""


def _pass(name: str, of: str, keys: str, where: str) -> str:
    """A pass of the survivors of raw items in SQL: the newest row of each group, its articles and feeds."""
    return f"""{name} AS (
      SELECT * EXCLUDE (rn, a, fs) REPLACE (a AS article_id, fs AS feeds) FROM (
        SELECT *, row_number() OVER w AS rn, first_value(article_id IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY fetched_at DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a,
          flatten(list(feeds) OVER (PARTITION BY {keys} ORDER BY fetched_at DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS fs
        FROM {of} WHERE {where} WINDOW w AS (PARTITION BY {keys} ORDER BY fetched_at DESC, id DESC)) WHERE rn = 1
      UNION ALL SELECT * FROM {of} WHERE NOT ({where}))"""


_ALT = "array_to_string(list_sort(list_distinct(list_filter(feeds, lambda x: x <> feed_url))), ',') AS alt_feeds"


@query(
    f"""{MODEL}, p0 AS (SELECT *, [feed_url] AS feeds FROM raw_items), {_pass('p1', 'p0', 'source_id, raw_guid', 'raw_guid IS NOT NULL')}, {_pass('p2', 'p1', 'source_id, raw_link, raw_pub_date', 'raw_pub_date IS NOT NULL')}, {_pass('p3', 'p2', 'source_id, raw_link', 'raw_guid IS NULL AND raw_pub_date IS NULL')}
    SELECT id, source_id, coalesce(article_id, -1) AS article_id, feed_url, raw_guid, raw_title, raw_link, raw_pub_date, fetched_at, {_ALT} FROM p3"""
)
def raw_item_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _filled(U.dedupe_raw(M.raw_items(spark, d)))


def _stored(entries: str, items: str, attached: bool) -> str:
    """The stored item of each entry in SQL: all that fit any rule, ranked."""
    rules = [
        "i.raw_guid = e.raw_guid", "i.raw_link = e.raw_link AND i.raw_pub_date IS NULL AND e.raw_pub_date IS NULL", "i.raw_link = e.raw_link AND i.raw_guid IS NULL AND e.raw_guid IS NULL AND e.raw_pub_date IS NULL",
        "i.raw_link = e.raw_link AND i.raw_pub_date = e.raw_pub_date", "false" if attached else "i.raw_link = e.raw_link AND i.raw_guid IS NULL AND i.raw_pub_date IS NULL",
    ]
    every = " UNION ALL ".join(f"SELECT e.id AS entry_id, i.id AS item_id, {n} AS rule, i.article_id IS NOT NULL AS attached FROM {entries} e JOIN {items} i ON i.source_id = e.source_id AND {r}{' AND i.article_id IS NOT NULL' if attached else ''}" for n, r in enumerate(rules))
    return f"SELECT entry_id, arg_max(item_id, row(-rule, attached, item_id)) AS item_id FROM ({every}) GROUP BY entry_id"


_SPLIT = "old_items AS (SELECT * FROM raw_items WHERE id % 2 = 0), new_items AS (SELECT * FROM raw_items WHERE id % 2 = 1)"


@query(f"{MODEL}, {_SPLIT}, f AS ({_stored('new_items', 'old_items', False)}) SELECT n.id AS entry_id, coalesce(item_id, -1) AS item_id FROM new_items n LEFT JOIN f ON f.entry_id = n.id")
def raw_item_lookup(spark: SparkSession, d: str) -> DataFrame:
    items = M.raw_items(spark, d)
    return _filled(U.stored_item(items.where("id % 2 = 1"), items.where("id % 2 = 0")), "item_id")


@query(
    f"""{MODEL}, {_SPLIT}, f AS ({_stored('new_items', 'old_items', False)}), met AS (SELECT n.*, item_id, row_number() OVER (PARTITION BY item_id ORDER BY fetched_at DESC, n.id DESC) AS rn FROM new_items n JOIN f ON f.entry_id = n.id),
    g AS (SELECT item_id, first(article_id ORDER BY fetched_at DESC, id DESC) FILTER (article_id IS NOT NULL) AS a, first(raw_guid ORDER BY fetched_at DESC, id DESC) FILTER (raw_guid IS NOT NULL) AS g, first(raw_pub_date ORDER BY fetched_at DESC, id DESC) FILTER (raw_pub_date IS NOT NULL) AS p, list(feed_url) AS fs FROM met GROUP BY item_id),
    kept AS (SELECT o.id, o.source_id, coalesce(a, o.article_id) AS article_id, CASE WHEN m.id IS NULL THEN o.feed_url ELSE m.feed_url END AS feed_url, coalesce(g, o.raw_guid) AS raw_guid, CASE WHEN m.id IS NULL THEN o.raw_title ELSE m.raw_title END AS raw_title, CASE WHEN m.id IS NULL THEN o.raw_link ELSE m.raw_link END AS raw_link,
      coalesce(p, o.raw_pub_date) AS raw_pub_date, CASE WHEN m.id IS NULL THEN o.fetched_at ELSE m.fetched_at END AS fetched_at, list_concat([o.feed_url], coalesce(fs, [])) AS feeds, CASE WHEN m.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old_items o LEFT JOIN (SELECT * FROM met WHERE rn = 1) m ON m.item_id = o.id LEFT JOIN g ON g.item_id = o.id),
    left_over AS (SELECT k.*, [feed_url] AS feeds FROM ({KEYED}) k WHERE id % 2 = 1 AND id NOT IN (SELECT entry_id FROM f)), {_pass('added', 'left_over', 'key', 'true')}
    SELECT * EXCLUDE (feeds) REPLACE (coalesce(article_id, -1) AS article_id), {_ALT} FROM (SELECT * FROM kept UNION ALL SELECT id, source_id, article_id, feed_url, raw_guid, raw_title, raw_link, raw_pub_date, fetched_at, feeds, 'inserted' FROM added)"""
)
def raw_item_merge(spark: SparkSession, d: str) -> DataFrame:
    items = M.raw_items(spark, d)
    return _filled(U.merge_raw(items.where("id % 2 = 0"), items.where("id % 2 = 1")))


@query(f"{MODEL}, {_SPLIT}, f AS ({_stored('new_items', 'old_items', True)}) SELECT id, raw_link FROM new_items WHERE id NOT IN (SELECT entry_id FROM f) OR (raw_guid IS NULL AND raw_pub_date IS NULL AND id % 4 = 1)")
def raw_items_unrecorded(spark: SparkSession, d: str) -> DataFrame:
    items = M.raw_items(spark, d)
    return U.unrecorded(items.where("id % 2 = 1").withColumn("exact", F.col("id") % 4 == 1), items.where("id % 2 = 0")).select("id", "raw_link")


@query(f"{MODEL} SELECT id FROM raw_items WHERE article_id IS NULL AND id % 3 <> 0")
def detached_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Detached items polled again, every third with another title."""
    items = M.raw_items(spark, d).where("article_id is null")
    again = items.withColumn("raw_title", F.when(F.col("id") % 3 == 0, F.concat("raw_title", F.lit("#"))).otherwise(F.col("raw_title")))
    return U.detached_repeats(again, items).select("id")


@query(f"{MODEL} SELECT id, CASE WHEN article_id IS NULL AND id % 3 <> 0 THEN TIMESTAMP '2024-02-01' ELSE fetched_at END AS fetched_at FROM raw_items")
def detached_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Fetch times after detached and attached items were polled again, every third with another title."""
    items = M.raw_items(spark, d)
    again = items.withColumn("raw_title", F.when(F.col("id") % 3 == 0, F.concat("raw_title", F.lit("#"))).otherwise(F.col("raw_title")))
    return U.refresh_detached(items, again, "2024-02-01").select("id", "fetched_at")


MATCHES = f"""{MODEL}, old AS (SELECT * FROM articles WHERE id % 3 <> 0),
ent AS (SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN sha256('https://www.{M.GENERAL_HOST}/news/' || ((id + 1) // 2) || CASE WHEN (id + 1) % 2 = 1 THEN '?feedref=x' ELSE '' END) ELSE canonical_url_hash END AS canonical_url_hash) FROM articles WHERE id % 3 = 0),
facts AS (SELECT article_id, bool_or(source_id = 0) AS from_general FROM raw_items WHERE article_id IS NOT NULL GROUP BY 1),
t AS (SELECT e.id AS e_id, max(o.id) AS t_id FROM ent e JOIN old o USING (title_hash) LEFT JOIN facts f ON f.article_id = o.id
  WHERE abs(date_diff('second', e.published_at, o.published_at)) <= 172800 AND (e.source_name <> 'src0' OR NOT coalesce(f.from_general, true)) GROUP BY 1),
u AS (SELECT canonical_url_hash, max(id) AS u_id FROM old GROUP BY 1),
matches AS (SELECT e.id AS entry_id, coalesce(u_id, t_id) AS matched, CASE WHEN u_id IS NOT NULL THEN 'url' WHEN t_id IS NOT NULL THEN 'title' ELSE 'new' END AS how FROM ent e LEFT JOIN u USING (canonical_url_hash) LEFT JOIN t ON t.e_id = e.id)"""


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored articles, entries (some with the URL of a stored one), and their matches."""
    every = M.articles(spark, d)
    i = F.col("id") + 1
    url = F.concat(F.lit(f"https://www.{M.GENERAL_HOST}/news/"), F.floor(i / 2).cast("string"), F.when(i % 2 == 1, "?feedref=x").otherwise(""))
    old, new = every.where("id % 3 <> 0"), every.where("id % 3 = 0").withColumn("canonical_url_hash", F.when(F.col("id") % 6 == 0, F.sha2(url, 256)).otherwise(F.col("canonical_url_hash")))
    facts = M.raw_items(spark, d).where("article_id is not null").groupBy("article_id").agg(F.bool_or(F.col("source_id") == 0).alias("from_general"))
    return old, new, U.match_articles(new, old, facts, M.GENERAL_SOURCE)


@query(f"{MATCHES} SELECT entry_id, coalesce(matched, -1) AS matched, how FROM matches")
def article_matches(spark: SparkSession, d: str) -> DataFrame:
    return _filled(_batch(spark, d)[2], "matched")


def _walk(name: str, rows: str) -> str:
    """Anchors of 48-hour clusters of a title in SQL, one after another: tables ``{name}_times`` and ``{name}_walk``."""
    later = f"FROM {name}_times x WHERE x.title_hash = w.title_hash AND x.t > w.anchor + 172800"
    return f"""{name}_times AS (SELECT DISTINCT title_hash, epoch(published_at)::BIGINT AS t FROM {rows}),
{name}_walk AS (SELECT title_hash, min(t) AS anchor FROM {name}_times GROUP BY 1 UNION ALL SELECT w.title_hash, (SELECT min(t) {later}) AS anchor FROM {name}_walk w WHERE EXISTS (SELECT 1 {later}))"""


def _stand_ins(new: str) -> str:
    """Which entry of a batch stands for each new one, in SQL: table ``stands`` (id, first)."""
    return f"""urls AS (SELECT id, min(id) OVER (PARTITION BY canonical_url_hash) AS u FROM {new}),
heads AS (SELECT n.* FROM {new} n JOIN urls USING (id) WHERE id = u AND n.source_name <> 'src0'), {_walk('new', 'heads')},
placed AS (SELECT id, title_hash, (SELECT max(anchor) FROM new_walk w WHERE w.title_hash = h.title_hash AND w.anchor <= epoch(published_at)::BIGINT) AS cluster FROM heads h),
stands AS (SELECT urls.id, coalesce(p.first, u) AS first FROM urls LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY title_hash, cluster) AS first FROM placed) p ON p.id = u)"""


@query(
    f"""{MATCHES}, r AS (SELECT e.*, matched, how, e.id % 12 = 0 AS exact FROM ent e JOIN matches ON entry_id = e.id),
    n AS (SELECT matched, arg_max(title, row(published_at, id)) FILTER (how = 'url' AND exact) AS n_title, arg_max(cluster_key, row(published_at, id)) FILTER (how = 'url' AND exact) AS n_cluster, arg_max(content_hash, row(published_at, id)) FILTER (how = 'url' AND exact) AS n_content, arg_max(source_name, row(published_at, id)) FILTER (how = 'url' AND exact) AS n_source,
      arg_max(provider_name, row(published_at, id)) FILTER (how = 'url' AND exact) AS n_provider, arg_max(summary, row(published_at, id)) FILTER (how = 'url' AND exact AND summary <> '') AS n_summary, arg_max(summary, row(length(summary), -id)) FILTER (how = 'title') AS t_summary, max(published_at) FILTER (how = 'title' OR exact) AS n_at FROM r WHERE matched IS NOT NULL GROUP BY matched),
    newr AS (SELECT * FROM r WHERE how = 'new'), {_stand_ins('newr')},
    more AS (SELECT first, arg_max(summary, row(length(summary), -id)) AS m_summary, max(published_at) AS m_at FROM newr JOIN stands USING (id) GROUP BY first)
    SELECT o.id, coalesce(n_title, title) AS title, coalesce(n_source, source_name) AS source_name, coalesce(n_provider, provider_name) AS provider_name, coalesce(n_content, content_hash) AS content_hash, canonical_url, md5(coalesce(n_summary, CASE WHEN length(t_summary) > length(coalesce(summary, '')) THEN t_summary ELSE summary END)) AS summary_md5,
      greatest(published_at, n_at) AS published_at, first_seen_at, canonical_url_hash, title_hash, coalesce(n_cluster, cluster_key) AS cluster_key
    FROM old o LEFT JOIN n ON n.matched = o.id
    UNION ALL SELECT id, title, source_name, provider_name, content_hash, canonical_url, md5(CASE WHEN length(m_summary) > length(coalesce(summary, '')) THEN m_summary ELSE summary END), m_at, first_seen_at, canonical_url_hash, title_hash, cluster_key FROM newr JOIN more ON first = id"""
)
def article_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new, matches = _batch(spark, d)
    out = U.upsert_articles(old, new.withColumn("exact", F.col("id") % 12 == 0), matches, M.GENERAL_SOURCE)
    return out.select("id", "title", "source_name", "provider_name", "content_hash", "canonical_url", F.md5("summary").alias("summary_md5"), "published_at", "first_seen_at", "canonical_url_hash", "title_hash", "cluster_key")


@query(f"{MATCHES} SELECT DISTINCT matched AS article_id FROM matches JOIN ent e ON e.id = entry_id WHERE how = 'url' AND e.id % 12 = 0 AND e.source_name <> 'src0' AND e.id IN (SELECT article_id FROM active)")
def prunable_articles(spark: SparkSession, d: str) -> DataFrame:
    _, new, matches = _batch(spark, d)
    rows = new.select("id", (F.col("id") % 12 == 0).alias("exact"), F.when(F.col("source_name") == M.GENERAL_SOURCE, "general_allowed").otherwise("validated_mapping_required").alias("policy"))
    return U.prunable(rows, matches, _active(spark, d).select(F.col("article_id").alias("id")))


@query(
    f"""{MODEL}, o AS (SELECT * FROM mappings WHERE (article_id + ticker_id) % 3 <> 0), n AS (SELECT article_id, ticker_id, 'paren' AS match_type, 0.7::DOUBLE AS confidence, 10 AS extraction_version FROM mappings WHERE article_id % 2 = 0),
    m AS (SELECT coalesce(o.article_id, n.article_id) AS article_id, coalesce(o.ticker_id, n.ticker_id) AS ticker_id, o.confidence AS oc, n.confidence AS nc, o.match_type AS ot, n.match_type AS nt, o.extraction_version AS ov, n.extraction_version AS nv FROM o FULL JOIN n ON o.article_id = n.article_id AND o.ticker_id = n.ticker_id)
    SELECT article_id, ticker_id, CASE WHEN nc IS NOT NULL AND (oc IS NULL OR nc > oc) THEN nt ELSE ot END AS match_type, CASE WHEN nc IS NOT NULL AND (oc IS NULL OR nc > oc) THEN nc ELSE oc END AS confidence, CASE WHEN nc IS NOT NULL AND (oc IS NULL OR nc > oc) THEN nv ELSE ov END AS extraction_version
    FROM m WHERE NOT (article_id % 10 = 0 AND nc IS NULL)"""
)
def mapping_upsert(spark: SparkSession, d: str) -> DataFrame:
    every = M.mappings(spark, d)
    new = every.where("article_id % 2 = 0").select("article_id", "ticker_id", F.lit("paren").alias("match_type"), F.lit(0.7).alias("confidence"), F.lit(10).alias("extraction_version"))
    return U.merge_mappings(every.where("(article_id + ticker_id) % 3 <> 0"), new, prune=every.where("article_id % 10 = 0"))


@query(
    """WITH o AS (SELECT p_partkey AS symbol, p_name AS fund_name, p_brand AS sponsor FROM part WHERE p_partkey % 4 <> 0),
    n AS (SELECT p_partkey % 1500 AS symbol, arg_max(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(p_name) END, p_partkey) AS fund_name, arg_max(p_brand, p_partkey) AS sponsor FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(o.symbol, n.symbol) AS symbol, CASE WHEN n.symbol IS NOT NULL THEN n.fund_name ELSE o.fund_name END AS fund_name, CASE WHEN n.symbol IS NOT NULL THEN n.sponsor ELSE o.sponsor END AS sponsor,
      CASE WHEN n.symbol IS NULL THEN 'absent' WHEN o.symbol IS NULL THEN 'created' WHEN n.fund_name IS NOT DISTINCT FROM o.fund_name AND n.sponsor IS NOT DISTINCT FROM o.sponsor THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.symbol = n.symbol"""
)
def ticker_dim_upsert(spark: SparkSession, d: str) -> DataFrame:
    part = M.read(spark, d, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    old = part.where("p_partkey % 4 <> 0").select(key.alias("symbol"), name.alias("fund_name"), F.col("p_brand").alias("sponsor"))
    new = part.where("p_partkey % 2 = 0").select((key % 1500).alias("symbol"), F.when(key % 3 == 0, name).otherwise(F.upper("p_name")).alias("fund_name"), F.col("p_brand").alias("sponsor"), key.alias("row"))
    return U.merge_dimension(old, new, "symbol", "row", ["fund_name", "sponsor"])


@query(
    """WITH o AS (SELECT p_partkey AS symbol, p_name AS fund_name, p_brand AS sponsor FROM part WHERE p_partkey % 4 <> 0),
    n AS (SELECT p_partkey % 1500 AS symbol, p_partkey AS row, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(p_name) END AS fund_name, p_brand AS sponsor FROM part WHERE p_partkey % 2 = 0),
    l AS (SELECT n.*, row_number() OVER w AS rn, lag(fund_name) OVER w AS f, lag(sponsor) OVER w AS s FROM n WINDOW w AS (PARTITION BY symbol ORDER BY row)),
    c AS (SELECT l.fund_name AS nf, l.sponsor AS ns, rn > 1 OR o.symbol IS NOT NULL AS known, CASE WHEN rn > 1 THEN f ELSE o.fund_name END AS pf, CASE WHEN rn > 1 THEN s ELSE o.sponsor END AS ps FROM l LEFT JOIN o ON o.symbol = l.symbol)
    SELECT count(*) AS loaded, count(*) FILTER (NOT known) AS created, count(*) FILTER (known AND (nf IS DISTINCT FROM pf OR ns IS DISTINCT FROM ps)) AS updated, count(*) FILTER (known AND nf IS NOT DISTINCT FROM pf AND ns IS NOT DISTINCT FROM ps) AS unchanged FROM c"""
)
def ticker_load_counts(spark: SparkSession, d: str) -> DataFrame:
    part = M.read(spark, d, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    old = part.where("p_partkey % 4 <> 0").select(key.alias("symbol"), name.alias("fund_name"), F.col("p_brand").alias("sponsor"))
    new = part.where("p_partkey % 2 = 0").select((key % 1500).alias("symbol"), F.when(key % 3 == 0, name).otherwise(F.upper("p_name")).alias("fund_name"), F.col("p_brand").alias("sponsor"), key.alias("row"))
    return U.load_counts(old, new, "symbol", "row", ["fund_name", "sponsor"])


@query(
    f"""{MODEL}, o AS (SELECT code, name, id % 3 <> 0 AS enabled FROM sources WHERE id % 2 = 0), n AS (SELECT code, name || CASE WHEN id % 4 = 0 THEN ' (new)' ELSE '' END AS name FROM sources WHERE id <> 6)
    SELECT code, coalesce(n.name, o.name) AS name, coalesce(enabled, true) AS enabled, CASE WHEN n.code IS NULL THEN 'absent' WHEN o.code IS NULL THEN 'created' WHEN n.name = o.name THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n USING (code)"""
)
def source_seed(spark: SparkSession, d: str) -> DataFrame:
    """The registry's names over stored sources; whether a source is enabled stays as it is."""
    every = M.sources(spark, d)
    old = every.where("id % 2 = 0").select("code", "name", (F.col("id") % 3 != 0).alias("enabled"))
    new = every.where("id <> 6").select("code", F.concat("name", F.when(F.col("id") % 4 == 0, " (new)").otherwise("")).alias("name"), F.col("id").alias("row"))
    return U.merge_dimension(old, new, "code", "row", ["name"], {"enabled": True})


RANKED = "ranked AS (SELECT a.*, coalesce(n, 0) AS n_tickers, length(coalesce(summary, '')) AS n_chars FROM articles a LEFT JOIN (SELECT article_id, count(*) AS n FROM mappings GROUP BY 1) m ON m.article_id = a.id)"


URL_GROUPS = f"""{MODEL}, {RANKED}, g AS (SELECT *, split_part(canonical_url, '?', 1) AS url FROM ranked),
groups AS (SELECT url, count(*) AS n_members, arg_max(id, row(canonical_url = url, n_tickers, n_chars, published_at, id)) AS winner, arg_max(summary, row(n_chars, -id)) AS summary, max(published_at) AS published_at, min(first_seen_at) AS first_seen_at, min(first_alert_sent_at) AS first_alert_sent_at FROM g GROUP BY url HAVING count(*) > 1)"""


@query(f"{URL_GROUPS} SELECT url, n_members, winner, md5(summary) AS summary_md5, published_at, first_seen_at, first_alert_sent_at FROM groups")
def dedupe_url(spark: SparkSession, d: str) -> DataFrame:
    out = D.url_groups(M.articles(spark, d), M.mappings(spark, d), M.GENERAL_HOST)
    return out.select("url", "n_members", "winner", F.md5("summary").alias("summary_md5"), "published_at", "first_seen_at", "first_alert_sent_at")


@query(
    f"""{URL_GROUPS} SELECT a.id, coalesce(w.url, canonical_url) AS canonical_url, CASE WHEN w.url IS NULL THEN canonical_url_hash ELSE sha256(w.url) END AS canonical_url_hash, md5(CASE WHEN w.url IS NULL THEN a.summary ELSE w.summary END) AS summary_md5, coalesce(w.published_at, a.published_at) AS published_at,
      coalesce(w.first_seen_at, a.first_seen_at) AS first_seen_at, CASE WHEN w.url IS NULL THEN a.first_alert_sent_at ELSE w.first_alert_sent_at END AS first_alert_sent_at FROM g a LEFT JOIN groups w ON w.winner = a.id WHERE w.url IS NOT NULL OR a.url NOT IN (SELECT url FROM groups)"""
)
def dedupe_url_apply(spark: SparkSession, d: str) -> DataFrame:
    every = M.articles(spark, d)
    groups = D.url_groups(every, M.mappings(spark, d), M.GENERAL_HOST)
    out = D.merged_articles(every, groups, D.losers(groups, D.url_members(every, M.GENERAL_HOST), ["url"]))
    return out.select("id", "canonical_url", "canonical_url_hash", F.md5("summary").alias("summary_md5"), "published_at", "first_seen_at", "first_alert_sent_at")


CLUSTERS = f"""{MODEL}, {RANKED},
times AS (SELECT DISTINCT title_hash, epoch(published_at)::BIGINT AS t FROM articles WHERE title_hash IN (SELECT title_hash FROM articles GROUP BY 1 HAVING count(*) > 1)),
walk AS (SELECT title_hash, min(t) AS anchor FROM times GROUP BY 1
  UNION ALL SELECT w.title_hash, (SELECT min(t) FROM times x WHERE x.title_hash = w.title_hash AND x.t > w.anchor + 172800) AS anchor FROM walk w
    WHERE EXISTS (SELECT 1 FROM times x WHERE x.title_hash = w.title_hash AND x.t > w.anchor + 172800)),
member AS (SELECT r.*, (SELECT max(anchor) FROM walk w WHERE w.title_hash = r.title_hash AND w.anchor <= epoch(r.published_at)::BIGINT) AS cluster FROM ranked r WHERE title_hash IN (SELECT title_hash FROM times)),
facts AS (SELECT article_id, bool_or(source_id = 0) AS general FROM raw_items WHERE article_id IS NOT NULL GROUP BY 1),
groups AS (
  SELECT title_hash, cluster, count(*) AS n_members, arg_max(m.id, row(n_tickers, n_chars, published_at, m.id)) AS winner, arg_max(summary, row(n_chars, -epoch(published_at)::BIGINT, -m.id)) AS summary, max(published_at) AS published_at, min(first_seen_at) AS first_seen_at, min(first_alert_sent_at) AS first_alert_sent_at
  FROM member m LEFT JOIN facts f ON f.article_id = m.id GROUP BY title_hash, cluster HAVING NOT bool_or(coalesce(general, true)) AND count(*) > 1)"""


def _title_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.title_groups(M.articles(spark, d), M.mappings(spark, d), M.raw_items(spark, d), 0)


@query(f"{CLUSTERS} SELECT id, title_hash, cluster FROM member")
def title_clusters(spark: SparkSession, d: str) -> DataFrame:
    return D.members(M.articles(spark, d))


@query(f"{CLUSTERS} SELECT * REPLACE (md5(summary) AS summary) FROM groups")
def dedupe_title(spark: SparkSession, d: str) -> DataFrame:
    return _title_groups(spark, d).withColumn("summary", F.md5("summary"))


LOSERS = f"{CLUSTERS}, losers AS (SELECT m.id, winner FROM member m JOIN groups USING (title_hash, cluster) WHERE m.id <> winner)"


def _title_merge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The plan of merges by title, written once as its losers need it too, and these."""
    groups = written(_title_groups(spark, d), "title-groups")
    return groups, D.losers(groups, D.members(M.articles(spark, d)), ["title_hash", "cluster"])


def _title_winners(spark: SparkSession, d: str, articles: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`_title_merge`, of a plan without texts."""
    groups = D.title_groups(articles, mappings, M.raw_items(spark, d), 0).select("title_hash", "cluster", "n_members", "winner")
    groups = written(groups, "title-winners")
    return groups, written(D.losers(groups, D.members(articles), ["title_hash", "cluster"]), "title-losers")


def _losers(spark: SparkSession, d: str) -> DataFrame:
    return _title_merge(spark, d)[1]


RISES = "moved AS (SELECT coalesce(winner, article_id) AS winner, ticker_id, confidence, coalesce(l.id, -1) AS t FROM mappings LEFT JOIN losers l ON l.id = article_id), w AS (SELECT *, max(confidence) OVER (PARTITION BY winner, ticker_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM moved), rises AS (SELECT winner, count(*) AS updated FROM w WHERE t >= 0 AND confidence > b GROUP BY 1)"


@query(
    f"""{LOSERS}, {RISES}, links AS (SELECT winner, ticker_id, count(*) FILTER (t >= 0) AS n, bool_or(t < 0) AS held FROM moved GROUP BY ALL HAVING count(*) FILTER (t >= 0) > 0)
    SELECT (SELECT count(*) FROM groups) AS groups, (SELECT CAST(coalesce(sum(n_members), 0) AS BIGINT) FROM groups) AS scanned, (SELECT count(*) FROM losers) AS merged, (SELECT count(*) FROM raw_items WHERE article_id IN (SELECT id FROM losers)) AS raw_items_relinked,
      (SELECT count(*) FROM links WHERE NOT held) AS mappings_relinked, (SELECT CAST(coalesce(sum(n - CASE WHEN held THEN 0 ELSE 1 END), 0) AS BIGINT) FROM links) AS mappings_deleted, (SELECT CAST(coalesce(sum(updated), 0) AS BIGINT) FROM rises) AS mappings_updated"""
)
def dedupe_stats(spark: SparkSession, d: str) -> DataFrame:
    mappings = written(M.mappings(spark, d).select("article_id", "ticker_id", "confidence"), "mappings")
    n_chars = F.length(F.coalesce("summary", F.lit(""))).alias("n_chars")
    articles = written(M.articles(spark, d).select("id", "title_hash", "published_at", "created_at", "first_seen_at", "first_alert_sent_at", n_chars), "titles")
    groups, gone = _title_winners(spark, d, articles, mappings)
    return D.statistics(groups, gone, M.raw_items(spark, d), mappings)


@query(
    f"""{LOSERS} SELECT a.id, a.title, md5(CASE WHEN g.winner IS NULL THEN a.summary ELSE g.summary END) AS summary_md5, coalesce(g.published_at, a.published_at) AS published_at, coalesce(g.first_seen_at, a.first_seen_at) AS first_seen_at, CASE WHEN g.winner IS NULL THEN a.first_alert_sent_at ELSE g.first_alert_sent_at END AS first_alert_sent_at
    FROM articles a LEFT JOIN groups g ON g.winner = a.id WHERE a.id NOT IN (SELECT id FROM losers)"""
)
def dedupe_title_apply(spark: SparkSession, d: str) -> DataFrame:
    groups, gone = _title_merge(spark, d)
    return D.merged_articles(M.articles(spark, d), groups, gone).select("id", "title", F.md5("summary").alias("summary_md5"), "published_at", "first_seen_at", "first_alert_sent_at")


@query(f"{LOSERS}, moved AS (SELECT coalesce(winner, article_id) AS article_id, ticker_id, match_type, confidence, l.id AS l_id FROM mappings LEFT JOIN losers l ON l.id = article_id) SELECT article_id, ticker_id, arg_max(match_type, row(confidence, l_id IS NULL, -coalesce(l_id, 0))) AS match_type, max(confidence) AS confidence FROM moved GROUP BY ALL")
def dedupe_mappings(spark: SparkSession, d: str) -> DataFrame:
    return D.merge_links(M.mappings(spark, d), _losers(spark, d))


@query(f"{LOSERS} SELECT r.id, coalesce(winner, article_id, -1) AS article_id FROM raw_items r LEFT JOIN losers l ON l.id = article_id")
def dedupe_raw_links(spark: SparkSession, d: str) -> DataFrame:
    return _filled(D.relink(M.raw_items(spark, d), _losers(spark, d)).select("id", "article_id"))


@query(f"{URL_GROUPS}, losers AS (SELECT g.id, winner FROM g JOIN groups USING (url) WHERE g.id <> winner), {RISES} SELECT * FROM rises")
def dedupe_rises(spark: SparkSession, d: str) -> DataFrame:
    every = M.articles(spark, d)
    groups = D.url_groups(every, M.mappings(spark, d), M.GENERAL_HOST)
    return D.rises(M.mappings(spark, d), D.losers(groups, D.url_members(every, M.GENERAL_HOST), ["url"]))


@query(f"{MODEL} SELECT article_id, -id AS context_order, source_id, raw_link AS link, feed_url FROM raw_items WHERE article_id IS NOT NULL")
def raw_contexts(spark: SparkSession, d: str) -> DataFrame:
    return R.raw_contexts(M.raw_items(spark, d))


@query(f"{MODEL} SELECT DISTINCT article_id FROM mappings WHERE extraction_version < 10 ORDER BY article_id DESC LIMIT 100")
def stale_mappings(spark: SparkSession, d: str) -> DataFrame:
    return R.stale_articles(M.mappings(spark, d), limit=100)


FRESH = f"{LINKS}, fresh AS (SELECT l.id AS article_id, t.id AS ticker_id, match_type, confidence FROM links l JOIN tickers t USING (symbol) WHERE confidence >= 0.65)"


def _fresh(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Verified links of the articles in ``of`` (``article_id``), of all without it; only these are read for links."""
    known = M.tickers(spark).select(F.col("id").alias("ticker_id"), "symbol")
    rows = entries(spark, d)
    if of is not None:
        rows = rows.join(of.select(F.col("article_id").alias("id")), "id", "left_semi")
    found = E.links(rows, M.tickers(spark).where("active"), E.profiles(M.tickers(spark)))
    return E.verified(found).join(known, "symbol").select(F.col("id").alias("article_id"), "ticker_id", "match_type", "confidence")


PURGE = f"""{FRESH}, facts AS (SELECT article_id, max(confidence) AS best, bool_or(match_type = 'token') AS has_token, bool_or(extraction_version < 10) AS stale, count(*) AS n,
      count(*) FILTER (confidence >= 0.7 AND match_type <> 'token' AND active) AS preserved, count(*) FILTER (NOT (confidence >= 0.7 AND match_type <> 'token' AND active) AND match_type <> 'token') AS doubtful FROM mappings JOIN tickers t ON t.id = ticker_id GROUP BY 1),
    i AS (SELECT article_id, bool_or(source_id = 0) AS general FROM raw_items WHERE article_id IS NOT NULL GROUP BY 1),
    plan AS (SELECT article_id, CASE WHEN preserved > 0 AND doubtful = 0 AND preserved < n THEN 'preserve' WHEN article_id IN (SELECT article_id FROM fresh) THEN 'apply' WHEN preserved > 0 AND article_id NOT IN (SELECT page_id FROM pages) THEN 'stamp' ELSE 'clear' END AS action
    FROM facts JOIN i USING (article_id) WHERE NOT general AND (best < 0.65 OR has_token OR stale))"""


@query(f"{PURGE} SELECT * FROM plan")
def purge_plan(spark: SparkSession, d: str) -> DataFrame:
    suspects = _suspects(spark, d)
    return _purge_plan(spark, d, suspects, _fresh(spark, d, suspects))


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    return written(R.suspects(M.mappings(spark, d), M.tickers(spark), M.raw_items(spark, d), 0), "suspects")


def _purge_plan(spark: SparkSession, d: str, suspects: DataFrame, fresh: DataFrame) -> DataFrame:
    return R.purge_plan(suspects, fresh, M.read(spark, d, "pages").select(F.col("page_id").alias("article_id")))


def _purged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    suspects = _suspects(spark, d)
    fresh = written(_fresh(spark, d, suspects), "fresh-links")
    plan = written(_purge_plan(spark, d, suspects, fresh), "purge-plan")
    return R.purged(M.articles(spark, d), M.mappings(spark, d), M.raw_items(spark, d), M.tickers(spark), plan, fresh)


PURGED = f"""{PURGE}, good AS (SELECT m.* FROM mappings m JOIN tickers t ON t.id = ticker_id WHERE confidence >= 0.7 AND match_type <> 'token' AND active),
n AS (SELECT article_id, ticker_id, match_type, confidence FROM good WHERE article_id IN (SELECT article_id FROM plan WHERE action = 'preserve') UNION ALL SELECT article_id, ticker_id, match_type, confidence FROM fresh WHERE article_id IN (SELECT article_id FROM plan WHERE action = 'apply')),
after_purge AS (
  SELECT n.article_id, n.ticker_id, CASE WHEN m.confidence >= n.confidence THEN m.match_type ELSE n.match_type END AS match_type, greatest(n.confidence, m.confidence) AS confidence, 10 AS extraction_version FROM n LEFT JOIN mappings m ON m.article_id = n.article_id AND m.ticker_id = n.ticker_id
  UNION ALL SELECT m.article_id, m.ticker_id, m.match_type, m.confidence, CAST(CASE WHEN p.action = 'stamp' AND g.ticker_id IS NOT NULL THEN 10 ELSE m.extraction_version END AS INT) FROM mappings m LEFT JOIN plan p USING (article_id) LEFT JOIN good g ON g.article_id = m.article_id AND g.ticker_id = m.ticker_id WHERE p.action IS NULL OR p.action = 'stamp')"""


@query(f"{PURGED} SELECT * FROM after_purge")
def purge_apply(spark: SparkSession, d: str) -> DataFrame:
    return _purged(spark, d)[1]


@query(
    f"""{PURGED} SELECT (SELECT count(*) FROM plan WHERE action IN ('preserve', 'apply')) AS kept, CAST(0 AS BIGINT) AS pruned, (SELECT count(*) FROM plan WHERE action = 'clear') AS deleted,
    (SELECT count(*) FROM mappings m LEFT JOIN after_purge a ON a.article_id = m.article_id AND a.ticker_id = m.ticker_id WHERE a.ticker_id IS NULL) AS mappings_deleted, (SELECT count(*) FROM raw_items WHERE article_id IN (SELECT article_id FROM plan WHERE action = 'clear')) AS raw_items_detached"""
)
def purge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _purged(spark, d)[3]


@query(f"{LINKS}, own AS (SELECT id, symbol, match_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, symbol ORDER BY confidence DESC, CASE WHEN channel = 'token' AND confidence = 0.68 THEN 'validated_token' ELSE channel END DESC) AS rn, CASE WHEN channel = 'token' AND confidence = 0.68 THEN 'validated_token' ELSE channel END AS match_type FROM decided WHERE confidence >= 0.65 AND channel <> 'context') WHERE rn = 1) SELECT id AS article_id, symbol, match_type, confidence FROM own WHERE id IN (SELECT article_id FROM raw_items)")
def reextract(spark: SparkSession, d: str) -> DataFrame:
    """Links found anew in the raw contexts of all articles that have any, as a purge does it."""
    known = M.tickers(spark)
    stored = M.mappings(spark, d).where("match_type <> 'token'").join(known.select(F.col("id").alias("ticker_id"), "symbol"), "ticker_id").select("article_id", "symbol").distinct()
    return R.reextracted(R.raw_contexts(M.raw_items(spark, d)), M.articles(spark, d), known.where("active"), E.profiles(known), wanted=stored)


@query(
    f"""{FRESH}, chosen AS (SELECT id FROM articles a WHERE id IN (SELECT article_id FROM raw_items WHERE source_id = 7) ORDER BY published_at DESC, id DESC LIMIT 500), n AS (SELECT * FROM fresh WHERE article_id IN (SELECT id FROM chosen))
    SELECT coalesce(m.article_id, n.article_id) AS article_id, coalesce(m.ticker_id, n.ticker_id) AS ticker_id, CASE WHEN n.confidence > m.confidence OR m.ticker_id IS NULL THEN n.match_type ELSE m.match_type END AS match_type, greatest(m.confidence, n.confidence) AS confidence,
      CAST(CASE WHEN n.confidence > m.confidence OR m.ticker_id IS NULL THEN 10 ELSE extraction_version END AS INT) AS extraction_version FROM mappings m FULL JOIN n ON m.article_id = n.article_id AND m.ticker_id = n.ticker_id"""
)
def remap_apply(spark: SparkSession, d: str) -> DataFrame:
    chosen = R.remap_candidates(M.articles(spark, d), M.raw_items(spark, d), M.mappings(spark, d), 7, only_unmapped=False)
    chosen = chosen.select(F.col("id").alias("article_id"))
    return R.remapped(M.mappings(spark, d), _fresh(spark, d, chosen), chosen)


@query(
    f"""{FRESH}, plan AS (SELECT id AS article_id, CASE WHEN id IN (SELECT article_id FROM fresh) THEN 'kept' WHEN id IN (SELECT article_id FROM raw_items WHERE source_id = 0) THEN 'pruned' ELSE 'deleted' END AS action FROM articles)
    SELECT count(*) FILTER (action = 'kept') AS kept, count(*) FILTER (action = 'pruned') AS pruned, count(*) FILTER (action = 'deleted') AS deleted, (SELECT count(*) FROM mappings m LEFT JOIN fresh f ON f.article_id = m.article_id AND f.ticker_id = m.ticker_id WHERE f.ticker_id IS NULL) AS mappings_deleted,
      (SELECT count(*) FROM raw_items WHERE article_id IN (SELECT article_id FROM plan WHERE action = 'deleted')) AS raw_items_detached FROM plan"""
)
def revalidation_apply(spark: SparkSession, d: str) -> DataFrame:
    fresh = written(_fresh(spark, d), "fresh-links")
    general = M.raw_items(spark, d).where("source_id = 0 and article_id is not null")
    plan = R.revalidation_plan(M.articles(spark, d), fresh.withColumnRenamed("article_id", "id"), M.mappings(spark, d), general)
    return R.applied(M.articles(spark, d), M.mappings(spark, d), M.raw_items(spark, d), plan.select(F.col("id").alias("article_id"), "action"), fresh)[3]


@query(
    f"""{FRESH}, n AS (SELECT article_id, list(DISTINCT ticker_id) AS s FROM fresh GROUP BY 1), o AS (SELECT article_id, list(DISTINCT ticker_id) AS s FROM mappings GROUP BY 1), g AS (SELECT DISTINCT article_id FROM raw_items WHERE source_id = 0 AND article_id IS NOT NULL)
    SELECT a.id, CASE WHEN n.s IS NOT NULL THEN 'kept' WHEN g.article_id IS NOT NULL THEN 'pruned' ELSE 'deleted' END AS action, len(list_filter(coalesce(n.s, []), lambda x: NOT list_contains(coalesce(o.s, []), x)))::BIGINT AS added, len(list_filter(coalesce(o.s, []), lambda x: NOT list_contains(coalesce(n.s, []), x)))::BIGINT AS dropped
    FROM articles a LEFT JOIN n ON n.article_id = a.id LEFT JOIN o ON o.article_id = a.id LEFT JOIN g ON g.article_id = a.id"""
)
def revalidation_plan(spark: SparkSession, d: str) -> DataFrame:
    general = M.raw_items(spark, d).where("source_id = 0 and article_id is not null")
    return R.revalidation_plan(M.articles(spark, d), _fresh(spark, d).withColumnRenamed("article_id", "id"), M.mappings(spark, d), general)


@query(
    f"""{FRESH}, old AS (SELECT DISTINCT article_id FROM mappings WHERE extraction_version < 10), it AS (SELECT DISTINCT article_id FROM raw_items WHERE article_id IS NOT NULL),
    plan AS (SELECT article_id, article_id IN (SELECT article_id FROM it) AS item FROM old WHERE article_id NOT IN (SELECT article_id FROM it) OR article_id IN (SELECT article_id FROM fresh)),
    n AS (SELECT * FROM fresh WHERE article_id IN (SELECT article_id FROM plan WHERE item))
    SELECT coalesce(m.article_id, n.article_id) AS article_id, coalesce(m.ticker_id, n.ticker_id) AS ticker_id, coalesce(n.match_type, m.match_type) AS match_type, coalesce(n.confidence, m.confidence) AS confidence,
      CAST(CASE WHEN coalesce(m.article_id, n.article_id) IN (SELECT article_id FROM plan) THEN 10 ELSE extraction_version END AS INT) AS extraction_version FROM mappings m FULL JOIN n ON m.article_id = n.article_id AND m.ticker_id = n.ticker_id"""
)
def revalidate_stale(spark: SparkSession, d: str) -> DataFrame:
    items = M.raw_items(spark, d).where("article_id is not null")
    return R.revalidate_stale(M.mappings(spark, d), _fresh(spark, d, R.stale_articles(M.mappings(spark, d))), items)


@query(f"{MODEL} SELECT id, title FROM articles a WHERE id IN (SELECT article_id FROM raw_items WHERE source_id = 7) AND id NOT IN (SELECT article_id FROM mappings) ORDER BY published_at DESC, id DESC LIMIT 500")
def remap_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.remap_candidates(M.articles(spark, d), M.raw_items(spark, d), M.mappings(spark, d), 7).select("id", "title")


@query(f"{MODEL} SELECT id, coalesce(article_id, -1) AS article_id FROM raw_items WHERE id NOT IN (SELECT id FROM raw_items WHERE article_id IS NULL AND fetched_at < TIMESTAMP '{LONG_AGO}' - INTERVAL 30 DAY ORDER BY id LIMIT 25000)")
def raw_retention(spark: SparkSession, d: str) -> DataFrame:
    return R.retained(M.raw_items(spark, d), LONG_AGO).select("id", F.coalesce("article_id", F.lit(-1)).alias("article_id"))


@query(f"{MODEL} SELECT id, CASE WHEN id IN (SELECT page_id FROM pages) THEN coalesce(CASE WHEN id % 4 = 0 THEN published_at END, TIMESTAMP '{NOW}') WHEN id % 4 = 0 THEN published_at END AS first_alert_sent_at FROM articles")
def mark_alerted(spark: SparkSession, d: str) -> DataFrame:
    rows = M.articles(spark, d).withColumn("first_alert_sent_at", F.when(F.col("id") % 4 == 0, F.col("published_at")))
    return R.mark_alerted(rows, M.read(spark, d, "pages").select(F.col("page_id").alias("id")), NOW).select("id", "first_alert_sent_at")


@query(f"{MODEL} SELECT count(*) AS requested, (SELECT count(*) FROM articles WHERE first_alert_sent_at IS NULL AND id IN (SELECT page_id FROM pages)) AS marked FROM pages")
def mark_alerted_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.alert_counts(M.articles(spark, d), M.read(spark, d, "pages").select(F.col("page_id").alias("id")))


HITS = f"""{MODEL},
place AS (SELECT a.id AS article_id, lower(a.title) AS title, lower(a.provider_name) AS label, f.article_id IS NOT NULL AS has_items, lower(s.name) AS of_source FROM articles a LEFT JOIN raw_facts f ON f.article_id = a.id LEFT JOIN sources s ON s.id = coalesce(f.canonical_source, f.latest_source) WHERE a.id IN (SELECT article_id FROM active)),
asked AS (SELECT DISTINCT list_sort(tickers) AS tickers, lower(provider) AS provider, lower(q) AS q FROM scopes),
known AS (SELECT *, provider IN (SELECT lower(name) FROM sources) AS is_source FROM asked),
met AS (SELECT k.tickers, k.provider, k.q, p.article_id FROM known k JOIN place p ON (k.tickers IS NULL OR p.article_id IN (SELECT article_id FROM active WHERE list_contains(k.tickers, symbol)))
  AND (k.provider IS NULL OR CASE WHEN is_source AND has_items THEN of_source = k.provider ELSE contains(label, k.provider) END) AND (k.q IS NULL OR contains(title, k.q) OR p.article_id IN (SELECT article_id FROM active WHERE contains(symbol, upper(k.q))))),
reach AS (SELECT s.id, s.scope, s.mark, m.article_id FROM scopes s JOIN met m ON list_sort(s.tickers) IS NOT DISTINCT FROM m.tickers AND lower(s.provider) IS NOT DISTINCT FROM m.provider AND lower(s.q) IS NOT DISTINCT FROM m.q),
hits AS (SELECT id, scope, article_id FROM (SELECT *, row_number() OVER (PARTITION BY id, scope ORDER BY article_id) AS rn FROM reach WHERE article_id > mark AND mark > 0) WHERE rn <= 25)"""


def _active(spark: SparkSession, d: str) -> DataFrame:
    known = M.tickers(spark).where("active").select(F.col("id").alias("ticker_id"), "symbol")
    return M.mappings(spark, d).join(known, "ticker_id").select("article_id", "symbol")


def _reach(spark: SparkSession, d: str, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scopes with their queries, and what each query reaches (written, as hits and marks both need it); ``links`` are the active ones, written."""
    scopes = A.with_query(M.subscriptions(spark, d))
    links = written(_active(spark, d), "active-links") if links is None else links
    sources = written(M.sources(spark, d), "sources")
    facts = N.raw_facts(N.Feed(M.articles(spark, d), M.raw_items(spark, d), sources, M.mappings(spark, d), M.tickers(spark)))
    return scopes, written(A.query_matches(scopes, M.articles(spark, d), links, facts, sources), "query-matches")


def _hits(spark: SparkSession, d: str, links: DataFrame | None = None) -> DataFrame:
    return A.scope_hits(*_reach(spark, d, links))


@query(f"{HITS} SELECT * FROM hits")
def alert_delta(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(
    f"""{HITS}, own AS (SELECT DISTINCT id, article_id FROM hits), by_symbol AS (SELECT id, symbol, max(article_id) AS seen FROM own JOIN active USING (article_id) GROUP BY ALL),
    tags AS (SELECT id, list(symbol ORDER BY seen DESC, symbol) AS t FROM by_symbol GROUP BY 1)
    SELECT o.id, count(*) AS n, any_value(coalesce(array_to_string(t[1:5], ', ') || CASE WHEN len(t) > 5 THEN ', ...' ELSE '' END, 'General')) AS tickers, arg_max(title, article_id) AS title, max(article_id) AS newest FROM own o JOIN articles a ON a.id = article_id LEFT JOIN tags g ON g.id = o.id GROUP BY o.id"""
)
def alert_payload(spark: SparkSession, d: str) -> DataFrame:
    links = written(_active(spark, d), "active-links")
    return A.payloads(_hits(spark, d, links), M.articles(spark, d), links)


@query(
    f"""{HITS}, newest AS (SELECT id, scope, max(article_id) AS newest FROM reach GROUP BY ALL), top AS (SELECT id, scope, max(article_id) AS top FROM hits WHERE id % 30 <> 0 GROUP BY ALL)
    SELECT s.id, s.scope, CASE WHEN coalesce(mark, 0) <= 0 THEN coalesce(newest, 0) ELSE greatest(mark, top) END AS mark FROM scopes s LEFT JOIN top t ON t.id = s.id AND t.scope = s.scope LEFT JOIN newest n ON n.id = s.id AND n.scope = s.scope"""
)
def alert_marks(spark: SparkSession, d: str) -> DataFrame:
    scopes, matches = _reach(spark, d)
    hits = A.scope_hits(scopes, matches)
    sent = hits.select("id", (F.col("id") % 30 != 0).alias("ok")).distinct()
    return A.advance(scopes, hits, sent, matches).select("id", "scope", "mark")


_OUTCOMES = """r AS (SELECT user_id AS id, ts AS t, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'ok' ELSE 'none' END AS outcome FROM events),
    l AS (SELECT id, max(t) FILTER (outcome = 'ok') AS last_ok FROM r GROUP BY 1), f AS (SELECT r.id, count(*) AS n, arg_max('error ' || event_id, t) AS last_error FROM r JOIN l USING (id) WHERE outcome = 'error' AND (last_ok IS NULL OR t > last_ok) GROUP BY 1),
    before AS (SELECT c_custkey AS id, CAST(c_custkey % 18 AS BIGINT) AS failures, c_custkey % 50 <> 1 AS active, TIMESTAMP '2023-12-01' AS last_ok, 'old' AS last_error FROM customer WHERE c_custkey % 3 = 0),
    state AS (SELECT coalesce(l.id, b.id) AS id, CASE WHEN l.last_ok IS NOT NULL THEN 0 ELSE coalesce(b.failures, 0) END + coalesce(n, 0) AS failures, coalesce(b.active, true) AND CASE WHEN l.last_ok IS NOT NULL THEN 0 ELSE coalesce(b.failures, 0) END + coalesce(n, 0) < 20 AS active, coalesce(l.last_ok, b.last_ok) AS last_ok,
      coalesce(f.last_error, CASE WHEN l.last_ok IS NULL THEN b.last_error END, '') AS last_error FROM l LEFT JOIN f ON f.id = l.id FULL JOIN before b ON b.id = l.id)"""


def _outcomes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Deliveries, and the state stored before them."""
    kind, c = F.col("event_type"), F.col("c_custkey")
    outcome = F.when(kind == "error", "error").when(kind == "signup", "ok").otherwise("none")
    results = M.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), outcome.alias("outcome"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error"))
    before = M.read(spark, d, "customer").where("c_custkey % 3 = 0").select(c.alias("id"), (c % 18).cast("bigint").alias("failures"), (c % 50 != 1).alias("active"), F.lit("2023-12-01").cast("timestamp_ntz").alias("last_ok"), F.lit("old").alias("last_error"))
    return results, before


@query(f"WITH {_OUTCOMES} SELECT * FROM state")
def alert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    results, before = _outcomes(spark, d)
    return A.fold_outcomes(results, state=before).withColumn("last_error", F.coalesce("last_error", F.lit("")))


@query(f"{MODEL}, {_OUTCOMES} SELECT (SELECT count(DISTINCT id) FROM scopes) AS scanned, (SELECT count(*) FROM r WHERE outcome = 'ok') AS sent, (SELECT count(*) FROM r WHERE outcome = 'error') AS failed, (SELECT count(*) FROM before b JOIN state s USING (id) WHERE b.active AND NOT s.active) AS deactivated")
def alert_totals(spark: SparkSession, d: str) -> DataFrame:
    results, before = _outcomes(spark, d)
    return A.outcome_totals(M.subscriptions(spark, d), results, before, A.fold_outcomes(results, state=before))


@query(f"{MODEL}, t AS (SELECT count(*) AS total, least(count(*), 100) AS tracked FROM articles), r AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS k, count(*) FILTER (event_id % 3 <> 0) AS u FROM events GROUP BY 1) SELECT user_id, greatest(CASE WHEN total = 0 THEN tracked - k ELSE total - (k + least(u, greatest(total - tracked, 0))) END, 0) AS unread FROM r, t")
def unread_count(spark: SparkSession, d: str) -> DataFrame:
    totals = M.articles(spark, d).agg(F.count("*").alias("total"), F.least(F.count("*"), F.lit(100)).alias("tracked"))
    return A.unread(totals, M.read(spark, d, "events").select("user_id", (F.col("event_id") % 3 == 0).alias("is_tracked")))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 40")
def read_state_trim(spark: SparkSession, d: str) -> DataFrame:
    return R.newest_read_keys(M.read(spark, d, "events"), 40).select("user_id", "event_id")
