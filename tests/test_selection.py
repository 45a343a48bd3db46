"""The canon, facets, merges, and streams against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ranklume.binding import Catalog
from ranklume.operators import browse, canon, entities
from ranklume.operators.browse import Choice
from ranklume.plans.browsing import shelf
from ranklume.streaming import index_queue, rate_limit

from .conftest import SF


def folded(rows, total, percent, cap):
    nonfiction = int(total * percent / 100 + 0.5)
    countries, authors, picked, by_country, by_author = {}, set(), [], 0, 0
    for which, quota in ((0, total - nonfiction), (1, nonfiction)):
        n = 0
        for rank, item, country, author in sorted((r["rank"], r["item_id"], -1 if r["country"] is None else r["country"], -1 if r["author"] is None else r["author"]) for r in rows if r["pass"] == which):
            if n >= quota:
                break
            if author in authors:
                by_author += 1
            elif countries.get(country, 0) >= cap:
                by_country += 1
            else:
                picked.append((rank, item))
                countries[country] = countries.get(country, 0) + 1
                authors.add(author)
                n += 1
    return sorted(picked), by_country, by_author


@pytest.mark.parametrize("total,percent,cap", [(20, 20, 3), (30, 0, 2), (10, 100, 5), (500, 50, 4)])
def test_canon(spark, total, percent, cap):
    rng = random.Random(total)
    rows = [(i, i, rng.randrange(2), rng.choice([None, *range(8)]), rng.choice([None, *range(60)])) for i in range(400)]
    rows += [(i, i, 1 - p, c, a) for i, _, p, c, a in rows[:50]]
    found = spark.createDataFrame(rows, "item_id long, rank int, pass int, country long, author long")
    got = canon.global_canon(found, total, percent, cap).first()
    assert ([tuple(x) for x in got["picked"]], got["blocked_by_country"], got["blocked_by_author"]) == folded(found.collect(), total, percent, cap)


def test_facet_is_what_drilling_down_leaves(spark):
    s = shelf(Catalog(spark, SF))
    for row in browse.facet_genres(s, Choice(years=(1960, None))).collect():
        assert browse.ranked_books(s, Choice([row["category"]], years=(1960, None))).count() == row["n"]


def test_merged_relations_drop_self_links(spark):
    relations = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "song_id long, related_id long")
    merges = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    assert sorted(tuple(r) for r in entities.merged_relations(relations, merges).collect()) == [(1, 3), (3, 4)]


def test_rate_limiter(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), 1_700_000_000_000 + rng.randrange(60_000)) for i in range(400)]
    events = spark.createDataFrame(rows, "id long, k long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["id"]: (r["allowed"], r["remaining"], r["retry_after_ms"]) for r in rate_limit.limited(events, "k", "ts", 5, 10_000, "id").collect()}
    for key in range(4):
        times = []
        for ms, i in sorted((ms, i) for i, k, ms in rows if k == key):
            times = [t for t in times if t > ms - 10_000]
            if len(times) < 5:
                times.append(ms)
                assert got[i] == (True, 5 - len(times), 0)
            else:
                assert got[i] == (False, 0, max(0, 10_000 - (ms - times[0])))


def test_queue_stream(spark, tmp_path):
    rows = [(1, "Books::Book", 7, 0), (2, "Books::Book", 7, 1), (3, "Books::Book", 8, 0)]
    spark.createDataFrame(rows, "id long, parent_type string, parent_id long, action int").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "q"))
    seen = []
    index_queue.consume_available(index_queue.requests(spark, str(tmp_path / "q")), lambda batch, n: seen.extend(batch.collect()), str(tmp_path / "cp"))
    assert sorted((r["parent_id"], r["action"]) for r in seen) == [(7, 1), (8, 0)]


def test_null_keys_are_one_key(spark):
    rows = [(i, None if i % 2 else 5, 1_700_000_000_000 + i) for i in range(8)]
    events = spark.createDataFrame(rows, "id long, k int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["id"]: r["allowed"] for r in rate_limit.limited(events, "k", "ts", 1, 10_000, "id").collect()}
    assert [i for i, ok in got.items() if ok] and sorted(i for i, ok in got.items() if ok) == [0, 1]


def test_queue_takes_the_oldest_first(spark, tmp_path):
    rows = [(i, "Books::Book" if i % 3 else "Books::Author", i % 4, 0) for i in range(30)]
    spark.createDataFrame(rows, "id long, parent_type string, parent_id long, action int").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "q"))
    seen = []
    index_queue.consume_available(index_queue.requests(spark, str(tmp_path / "q")), lambda batch, n: seen.append(sorted(r["id"] for r in batch.collect())), str(tmp_path / "cp"), most=5)
    assert len(seen) == 4 and max(seen[0]) < 15 and max(seen[3]) == 29 and all(len(x) <= 8 for x in seen)


def test_limited_stream(spark, tmp_path):
    rows = [(1, 1_700_000_000_000 + 1000 * i) for i in range(6)]
    spark.createDataFrame(rows, "k long, ms long").select("k", F.timestamp_millis("ms").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "e"))
    out = rate_limit.limited_stream(stream, "k", "ts", 2, 3000)
    out.writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = [r["allowed"] for r in spark.table("limits").orderBy("at_ms").collect()]
    assert got == [True, True, False, True, True, False]
