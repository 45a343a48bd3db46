"""Queries on the queue and on rate limits, over a stream's rows at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import index_queue, rate_limit
from . import plan


@plan("SELECT parent_type, parent_id, action, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_type, parent_id ORDER BY id DESC) AS n FROM index_requests) q WHERE n = 1")
def index_queue_batch(c) -> DataFrame:
    return index_queue.last_requests(c.index_requests).select("parent_type", "parent_id", "action", "id")


@plan("SELECT id, parent_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_type ORDER BY id) AS n FROM index_requests) q WHERE n <= 1000")
def index_queue_oldest(c) -> DataFrame:
    return index_queue.oldest_of_each(c.index_requests).select("id", "parent_type")


@plan("SELECT id, title FROM books WHERE id >= 100 AND id % 2 = 0 AND id NOT IN (SELECT parent_id FROM index_requests) UNION ALL SELECT b.id, b.title FROM books b JOIN (SELECT parent_id, action FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_id ORDER BY id DESC) AS n FROM index_requests WHERE parent_type = 'Books::Author') q WHERE n = 1) l ON l.parent_id = b.id AND l.action = 0")
def index_queue_applied(c) -> DataFrame:
    stored = c.books.where("id >= 100 and id % 2 = 0 or id < 0").select("id", "title")
    return index_queue.applied(stored, c.index_requests.where("parent_type = 'Books::Author'"), c.books.select("id", "title"))


@plan("SELECT event_id, CAST(COUNT(*) OVER (PARTITION BY user_id ORDER BY EPOCH_MS(ts) RANGE BETWEEN 21599999 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events")
def rate_window(c) -> DataFrame:
    return rate_limit.recent_arrivals(c.events, "user_id", "ts", 6 * 3600 * 1000).select("event_id", "recent")


@plan()
def rate_limiter(c) -> DataFrame:
    """Tested against a loop: accepted arrivals decide about later ones, which no window of SQL follows."""
    return rate_limit.limited(c.events, "user_id", "ts", 3, 6 * 3600 * 1000, "event_id")
