"""What has to be computed again after a change, in order."""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each result and what it is computed from.
DEPENDS = {
    "list_weight": {"lists", "penalties", "book_countries"},
    "item_ranking": {"list_weight", "list_items", "books"},
    "author_ranking": {"item_ranking", "book_authors"},
    "artist_ranking": {"item_ranking", "song_artists"},
    "reindex_ranked_fields": {"item_ranking"},
    "review_summary": {"reviews"},
    "search_documents": {"books", "category_items", "book_countries", "item_ranking"},
}


def due(*changed: str) -> list[str]:
    """The results that depend on what has changed, each after all it is computed from."""
    order = [x for x in TopologicalSorter({k: sorted(v) for k, v in sorted(DEPENDS.items())}).static_order() if x in DEPENDS]
    hit = set(changed)
    for name in order:
        if DEPENDS[name] & hit:
            hit.add(name)
    return [x for x in order if x in hit and x not in changed]


#: Fixed value: seconds from a merge to the recomputation of what it touches.
MERGE_DELAY = 300


def ready(requests: DataFrame, done: DataFrame, now, delay: int = MERGE_DELAY) -> DataFrame:
    """Targets whose requests (target, ts) have waited ``delay`` seconds by ``now`` and came after their last recomputation in
    done (target, ts): one row each, however many requests there are."""
    last = done.groupBy("target").agg(F.max("ts").alias("done_ts"))
    waited = F.col("ts") <= F.lit(now).cast("timestamp") - F.expr(f"interval {int(delay)} seconds")
    return requests.where(waited).join(last, "target", "left").where("done_ts is null or ts > done_ts").groupBy("target").agg(F.min("ts").alias("asked"))
