"""Queries over text, JSON and HTML sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import html, readers
from . import plan

LINE = """CASE CAST(o_orderkey % 6 AS INT)
  WHEN 0 THEN CONCAT('Paper ', CAST(o_custkey AS STRING), ' (USA) - The best ', CASE WHEN o_custkey % 2 = 0 THEN 'Albums' ELSE 'Songs' END, ' (', CAST(1990 + o_custkey % 30 AS STRING), ', updated)')
  WHEN 1 THEN CONCAT('Charts (UK, ', CAST(1990 + o_custkey % 30 AS STRING), ') - Top Singles')
  WHEN 2 THEN 'Critic - 500 LPs (2000)' WHEN 3 THEN 'Guide (France / Italy) - Recordings of record' WHEN 4 THEN 'no list here' ELSE '# comment' END"""
ROUTED = f"SELECT o_orderkey, {LINE} AS value FROM orders"


@plan(f"""
SELECT o_orderkey,
  CASE WHEN value = 'no list here' THEN NULL WHEN value LIKE 'Paper%' THEN SPLIT_PART(value, ' (', 1) WHEN value LIKE 'Charts%' THEN 'Charts' WHEN value LIKE 'Critic%' THEN 'Critic' ELSE 'Guide' END AS source,
  CASE WHEN value LIKE 'Paper%' THEN 'USA' WHEN value LIKE 'Charts%' THEN 'UK' WHEN value LIKE 'Guide%' THEN 'France / Italy' END AS country,
  CASE WHEN value LIKE 'Paper%' THEN TRIM(SPLIT_PART(SPLIT_PART(value, ' - ', 2), ' (', 1)) WHEN value LIKE 'Charts%' THEN 'Top Singles' WHEN value LIKE 'Critic%' THEN '500 LPs' WHEN value LIKE 'Guide%' THEN 'Recordings of record' END AS name,
  CASE WHEN value LIKE 'Paper%' OR value LIKE 'Charts%' THEN CAST(REGEXP_EXTRACT(value, '[0-9]{{4}}') AS INT) WHEN value LIKE 'Critic%' THEN 2000 END AS year,
  CASE WHEN value LIKE '%Albums%' OR value LIKE 'Critic%' THEN 'album' WHEN value LIKE '%Songs%' OR value LIKE '%Singles%' THEN 'song' WHEN value LIKE 'Guide%' THEN 'ambiguous' END AS list_type,
  CASE WHEN value = 'no list here' THEN 'invalid' WHEN value LIKE 'Guide%' THEN 'ambiguous' WHEN value LIKE 'Critic%' THEN 'missing_country' ELSE 'valid' END AS route
FROM ({ROUTED}) t WHERE value NOT LIKE '#%'
""".replace("REGEXP_EXTRACT(value, '[0-9]{{4}}')", "REGEXP_EXTRACT(value, '(1[0-9]{3}|20[0-9]{2})')").replace("'[0-9]{4}'", "'(19[0-9]{2}|20[0-9]{2})[,)]', 1"))
def list_line_routes(c) -> DataFrame:
    lines = c.orders.select("o_orderkey", F.expr(LINE).alias("value"))
    return readers.list_lines(lines).drop("value")


@plan("SELECT event_id, CAST(0 AS INT) AS idx, CAST(json_extract_string(props, '$.k') AS INT) AS rank, CONCAT('Title ', CAST(user_id AS STRING)) AS title, 'A & B' AS artists FROM events WHERE event_type = 'click'")
def json_items(c) -> DataFrame:
    documents = c.events.where("event_type = 'click'").select("event_id", F.expr("concat('{\"songs\":[{\"rank\":', get_json_object(props, '$.k'), ',\"title\":\"Title ', user_id, '\",\"artists\":[\"A\",\"B\"]}]}')").alias("items_json"))
    return readers.imported_items(documents, "items_json").select("event_id", "idx", "rank", "title", F.array_join("artists", " & ").alias("artists"))


@plan()
def html_simplified(c) -> DataFrame:
    """Tested against small documents: SQL cannot follow a tree of elements."""
    return c.pages.select("page_id", html.simplified(F.col("html")).alias("simplified"))


@plan()
def html_sanitized(c) -> DataFrame:
    """Tested against small documents, as html_simplified."""
    return c.pages.select("page_id", html.rendered(html.sanitized(F.col("html"))).alias("rendered"))


@plan("SELECT event_id, ts, user_id FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 1000")
def keyset_scan(c) -> DataFrame:
    return readers.keyset(c.events, "event_id", 5000, 1000).select("event_id", "ts", "user_id")
