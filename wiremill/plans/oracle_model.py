"""The news model of ``wiremill.sources.model`` as DuckDB common table expressions."""

from __future__ import annotations

from wiremill.sources.model import ENDINGS, GENERAL_HOST, SYMBOLS, TEXTS

_ROWS = ", ".join(f"({i}, '{s}', '{k}', {str(i % 5 != 0).lower()})" for i, (s, k, _, _) in enumerate(SYMBOLS, 1))
_LIST = "[" + ", ".join(f"'{s[0]}'" for s in SYMBOLS) + "]"
_TEXTS = "[" + ", ".join(f"'{t}'" for t in TEXTS) + "]"
_ENDS = " || ".join(f"CASE WHEN doc_id % {n} = 0 THEN '{end}' ELSE '' END" for n, end in ENDINGS)
#: Normal form of a title in SQL.
NORMAL = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"

MODEL = f"""
WITH RECURSIVE articles0 AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) || {_ENDS} AS title,
    text AS summary, {EPOCH} + to_hours(CAST((doc_id * 37) % 720 AS INT)) AS published_at, {EPOCH} + to_hours(CAST((doc_id * 37) % 720 + 1 AS INT)) AS created_at,
    source AS source_name, 'Wire ' || source AS provider_name,
    'https://www.{GENERAL_HOST}/news/' || CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 2 = 1 THEN '?feedref=x' ELSE '' END AS canonical_url
  FROM documents),
articles AS (
  SELECT *, sha256(canonical_url) AS canonical_url_hash, sha256({NORMAL.format('title')}) AS title_hash,
    title_hash AS cluster_key, sha256(title_hash || '|' || substr({NORMAL.format('summary')}, 1, 300)) AS content_hash, created_at AS first_seen_at, CASE WHEN id % 4 = 0 THEN published_at END AS first_alert_sent_at
  FROM articles0),
sources AS (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS id, source AS code, 'Wire ' || source AS name FROM documents),
raw_items AS (
  SELECT id, CAST(substr(source_name, 4) AS INT) AS source_id, id AS article_id, 'feed/' || source_name AS feed_url, 'g' || id AS raw_guid, title AS raw_title, canonical_url AS raw_link,
    published_at AS raw_pub_date, published_at + INTERVAL 2 HOUR AS fetched_at
  FROM articles WHERE id % 9 <> 0
  UNION ALL
  SELECT page_id + 100000000, CAST(page_id % 20 AS INT), CASE WHEN page_id % 7 <> 0 THEN page_id END, 'feed/p' || (page_id % 4), CASE WHEN page_id % 3 <> 0 THEN 'p' || (page_id // 2) END, url,
    split_part(url, '?', 1), CASE WHEN page_id % 5 <> 0 THEN {EPOCH} + to_hours(CAST(page_id % 48 AS INT)) END, {EPOCH} + to_hours(CAST(page_id % 720 AS INT))
  FROM pages),
tickers AS (SELECT * FROM (VALUES {_ROWS}) AS t(id, symbol, validation_keywords, active)),
mappings AS (
  SELECT article_id, id AS ticker_id, CASE id % 3 WHEN 0 THEN 'token' WHEN 1 THEN 'paren' ELSE 'exchange' END AS match_type,
    (CASE id % 3 WHEN 0 THEN 62 WHEN 1 THEN 75 ELSE 88 END + article_id % 3)::DOUBLE / 100 AS confidence, CAST(10 - article_id % 4 % 2 AS INT) AS extraction_version
  FROM (SELECT doc_id AS article_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS symbol FROM documents) JOIN tickers USING (symbol) WHERE article_id % 6 <> 5 OR NOT active),
active AS (SELECT article_id, symbol FROM mappings JOIN tickers ON tickers.id = ticker_id WHERE active),
runs AS (
  SELECT event_id AS id, 'feed/' || user_id AS feed_url, CAST(user_id % 20 AS INT) AS source_id, ts AS started_at,
    CASE WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN NULL ELSE ts + to_seconds(event_id % 600) END AS finished_at,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'skipped_backoff' WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'running' ELSE 'success' END AS status,
    CAST(floor(value) AS BIGINT) AS items_inserted, CAST(floor(value) * 2 AS BIGINT) AS items_seen
  FROM events),
requests AS (SELECT event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS duration_ms, ts FROM events),
scopes0 AS (
  SELECT c_custkey AS id, c_mktsegment AS kind, {_LIST}[c_custkey % {len(SYMBOLS)} + 1] AS s1, {_LIST}[c_custkey % 7 + 1] AS s2, c_custkey % 500 AS mark FROM customer),
scopes AS (
  SELECT id, 'all' AS scope, CAST(NULL AS VARCHAR[]) AS tickers, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS q, mark FROM scopes0 WHERE kind IN ('AUTOMOBILE', 'FURNITURE')
  UNION ALL
  SELECT id, 'watchlist:w1', CASE WHEN kind IN ('FURNITURE', 'BUILDING') THEN list_distinct([s1, s2]) WHEN kind = 'HOUSEHOLD' THEN [s1] END,
    CASE WHEN kind = 'BUILDING' OR kind = 'MACHINERY' AND id % 4 <> 1 THEN 'wire SRC' || (id % 20) END,
    CASE WHEN kind = 'HOUSEHOLD' AND id % 3 = 0 THEN 'er' WHEN kind = 'MACHINERY' AND id % 4 = 1 THEN {_TEXTS}[id % {len(TEXTS)} + 1] END, mark FROM scopes0 WHERE kind <> 'AUTOMOBILE'),
raw_facts AS (
  SELECT article_id, arg_max(source_id, r.id) AS latest_source, arg_max(CASE WHEN raw_link = canonical_url THEN source_id END, CASE WHEN raw_link = canonical_url THEN r.id END) AS canonical_source
  FROM raw_items r JOIN articles a ON a.id = r.article_id GROUP BY article_id),
symbols AS (SELECT article_id, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS tickers FROM active GROUP BY article_id)"""

SHOWN = """
SELECT p.id, p.title, p.summary, p.canonical_url, p.first_alert_sent_at, p.published_at AS sort_ts, p.published_at, p.first_seen_at, p.source_name, coalesce(s.name, p.provider_name) AS provider, coalesce(y.tickers, '') AS tickers,
  p.canonical_url_hash AS read_key, p.cluster_key AS dedupe_group
FROM picked p LEFT JOIN symbols y ON y.article_id = p.id LEFT JOIN raw_facts f ON f.article_id = p.id LEFT JOIN sources s ON s.id = coalesce(f.canonical_source, f.latest_source)"""


def news(where: str, limit: int, cursor: str = "true") -> str:
    return f"{MODEL}, picked AS (SELECT * FROM articles a WHERE ({where}) AND ({cursor}) ORDER BY published_at DESC, id DESC LIMIT {limit}) {SHOWN}"


def slot(ts: str, minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTE, {ts}, TIMESTAMP '1970-01-01')"
