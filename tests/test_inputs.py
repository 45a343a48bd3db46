"""Readers of years, slugs, criteria, pages; sources; sinks; matches of imported items."""

import json

import pytest
from pyspark.sql import functions as F

from ranklume.functions import predicates as p
from ranklume.functions import text
from ranklume.operators import enrich, entities, lists, search
from ranklume.sources import html, readers, sinks


def test_years():
    assert p.parse_years("1990s") == p.Years(1990, 1999, "decade")
    assert p.parse_years("1990-1995") == p.Years(1990, 1995, "range")
    assert p.parse_years("1994", "since") == p.Years(1994, None, "since")
    assert p.parse_years("1994", "through") == p.Years(None, 1994, "through")
    assert p.parse_years(" ") is None
    for bad in ("1995-1990", "abc", "19900", "1990s-2000"):
        with pytest.raises(ValueError):
            p.parse_years(bad)


def test_slugs():
    known = {"a": 1, "b": 2, "c": 3}
    assert p.resolved_slugs("a, b,a", known, 6) == [1, 2]
    assert p.resolved_slugs("a,x", known, 6) is None
    assert p.resolved_slugs("a,b,c", known, 2) is None
    assert p.resolved_slugs(None, known, 2) == []


def test_criteria():
    c = p.Criteria({"included_category_ids": ["1", "x", 2], "book_length": [0, 9], "ranked": "false", "hide_read": "on"})
    assert c.ids("included_category_ids") == [1, 2] and c.ids("book_length") == [0] and c.ranked is False and c.hide_read and not c.unparseable
    assert p.Criteria({"book_type": "abc"}).unparseable and p.Criteria({"excluded_category_ids": ["abc"]}).unparseable
    assert not p.Criteria({"book_type": "", "excluded_category_ids": ["", None]}).unparseable and p.Criteria(None).ranked is None


def test_pages():
    assert p.page_window(1, 50) == (0, 50) and p.page_window(84, 120) == (9960, 40) and p.page_window(101, 100) == (0, 0)
    with pytest.raises(ValueError):
        p.page_window(0, 10)


def test_api_query():
    q = readers.ApiQuery().fields("name", "id").where("a = 1").where({"b": 2, "c": [3, 4], "d": None}).search('so "x" \\ y').sort("id", "desc").limit(5).offset(10)
    assert str(q) == 'fields name, id; search "so \\"x\\" \\\\ y"; where a = 1 & b = 2 & c = (3,4) & d = null; sort id desc; limit 5; offset 10;'
    assert str(readers.ApiQuery().fields()) == "fields *;" and "limit" not in str(readers.ApiQuery().fields("id"))
    for bad in (lambda: q.limit(501), lambda: q.limit(True), lambda: q.offset(-1), lambda: q.where(3), lambda: str(readers.ApiQuery())):
        with pytest.raises(ValueError):
            bad()
    assert readers.lucene_escaped('a+b "c" & d|e \\') == 'a\\+b\\ \\"c\\"\\ \\&\\ d\\|e\\ \\\\'


def test_lines(spark):
    want = {
        "Evening Post (Peru) - Forty Albums for Winter (2011)": ("Evening Post", "Peru", "Forty Albums for Winter", 2011, "album", "valid"),
        "Chart Almanac (Chile, 1987) - Singles of the Decade": ("Chart Almanac", "Chile", "Singles of the Decade", 1987, "song", "valid"),
        "A Critic - 12 Discs (1999, revised 2005)": ("A Critic", None, "12 Discs", 1999, "album", "missing_country"),
        "Radio Nine (Cuba / Haiti) - Tracks to Keep": ("Radio Nine", "Cuba / Haiti", "Tracks to Keep", None, "song", "missing_year"),
        "Handbook - Opera: the CD shelf": ("Handbook", None, "Opera: the CD shelf", None, "album", "missing_country"),
        "Weekly (Fiji) - Favourites (2001)": ("Weekly", "Fiji", "Favourites", 2001, "ambiguous", "ambiguous"),
        "Notes (Mali, 1990) - Songs (1991)": ("Notes", "Mali", "Songs (1991)", 1990, "song", "valid"),
        "\tTabbed (Oman) - Songs (1970)\t": ("Tabbed", "Oman", "Songs (1970)", None, "song", "missing_year"),
        "no dash here": (None, None, None, None, None, "invalid"),
    }
    lines = [*want, "# a comment", "\t# c - d", "\t", " ", ""]
    got = {r["value"]: tuple(r)[1:] for r in readers.list_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == want


def test_html():
    assert html.simplify('<div style="x" class="a"><script>1</script><li onclick="y">A &amp; B<img src="z"><nav><b>no</b></nav></li></div>') == '<div class="a"><li>A &amp; B</li></div>'
    assert html.simplify("  ") is None and html.sanitize("<p> </p>") is None
    assert html.sanitize('<p onclick="x">a <u>b</u> <a href="javascript:x">c</a><script>d</script>') == "<p>a b <a>c</a></p>"


def test_rendered(spark):
    got = spark.createDataFrame([("one ||two|| three\n\nfour",), ('<p><a href="http://x">y</a></p>',)], "b string").select(html.rendered(F.col("b")).alias("x")).collect()
    assert got[0]["x"] == '<p>one <span class="review-spoiler">two</span> three</p><p>four</p>'
    assert 'rel="nofollow ugc noopener"' in got[1]["x"]


def test_text(spark):
    row = spark.createDataFrame([("  “Café” — B.O.B. ",)], "t string").select(text.search_text(F.col("t")).alias("s"), text.folded(F.col("t")).alias("f"), text.edge_grams(F.lit("Wide")).alias("e"), text.year_of(F.lit("1999-01-02")).alias("y"), text.without_nul(F.lit("a\x00b")).alias("n")).first()
    assert row["s"] == "caf b.o.b." and "cafe" in row["f"] and sorted(row["e"]) == ["wid", "wide"] and row["y"] == 1999 and row["n"] == "ab"


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 5)], "id int, v string, made int")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id int, v string")
    got = {r["id"]: (r["v"], r["made"]) for r in sinks.upserted(old, new, ["id"]).collect()}
    assert got == {1: ("a", 10), 2: ("B", 20), 3: ("C", None), None: ("N", 5)}
    assert sinks.refuse_empty(old, old.limit(0)) is old


def test_upsert_is_idempotent(spark):
    old = spark.range(50).selectExpr("id", "id * 2 as v")
    new = spark.range(25, 75).selectExpr("id", "id * 3 as v")
    once = sinks.upserted(old, new, ["id"])
    assert sorted(sinks.upserted(once, new, ["id"]).collect()) == sorted(once.collect())


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(10), path)
    sinks.replace_table(spark.read.parquet(path).where("id < 5"), path)
    assert spark.read.parquet(path).count() == 5
    sinks.write_documents(spark.range(3).selectExpr("id", "'x' as v"), path)
    sinks.write_csv(spark.range(3).selectExpr("id", "array(1, 2) as a"), str(tmp_path / "c"), [F.desc("id")])
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("a = '1, 2'").count() == 3


def test_reordering_needs_a_permutation(spark):
    items = spark.createDataFrame([(1, i) for i in (5, 6, 7)] + [(2, 8)], "user_list_id long, id long")
    orders = spark.createDataFrame([(1, [7, 5, 6]), (2, [8, 9])], "user_list_id long, ids array<long>")
    assert sorted(tuple(r) for r in lists.reordered(items, orders).select("user_list_id", "position", "id").collect()) == [(1, 1, 7), (1, 2, 5), (1, 3, 6)]
    assert [r[0] for r in lists.invalid_orders(items, orders).collect()] == [2]


def test_recomputation_order():
    from ranklume.streaming.recompute import due

    got = due("penalties")
    assert got.index("list_weight") < got.index("item_ranking") < min(got.index("author_ranking"), got.index("reindex_ranked_fields"))
    assert due("reviews") == ["review_summary"] and due("nothing") == [] and "item_ranking" not in due("book_authors")


def test_patched_json_keeps_types(spark):
    rows = [('{"n":1,"ok":true,"o":{"a":[2,null]},"s":"x","z":null}',), ("[1]",), (None,)]
    out = [json.loads(r[0]) for r in spark.createDataFrame(rows, "d string").select(entities.patched(F.col("d"), ["s"], {"new": [1, {"b": False}], "n": 2.5})).collect()]
    assert out == [{"n": 2.5, "ok": True, "o": {"a": [2, None]}, "z": None, "new": [1, {"b": False}]}, {"n": 2.5, "new": [1, {"b": False}]}, {"n": 2.5, "new": [1, {"b": False}]}]


def test_written_criteria():
    assert p.written_criteria({"included_category_ids": ["3", "x", 3, *range(300)], "book_length": [1, "1", 9], "book_type": "abc", "max_ranked_position": "50", "ranked": True, "hide_read": "0", "genre_match_mode": "all"}) == {"included_category_ids": [3, *[i for i in range(300) if i != 3]][:200], "book_length": [1], "max_ranked_position": 50, "ranked": "true", "genre_match_mode": "all"}
    assert p.written_criteria(None) == {}


def test_names_need_a_text(spark):
    names = spark.createDataFrame([("a_b",), ("axb",), (None,)], "n string")
    assert [names.where(p.named_like(F.col("n"), t)).count() for t in ("A_B ", " ", None, "")] == [1, 0, 0, 0]
    assert names.where(p.contains_ci(F.col("n"), " ")).count() == 3


class Store:
    """A file system whose moves fail, one after another."""

    def __init__(self, *fails):
        self.names, self.fails, self.moves = {"new", "there"}, fails, 0

    def exists(self, x):
        return x in self.names

    def delete(self, x, _):
        self.names.discard(x)

    def rename(self, a, b):
        self.moves += 1
        if self.moves in self.fails:
            return False
        self.names.discard(a)
        self.names.add(b)
        return True


def test_a_failing_move_loses_nothing():
    store = Store()
    sinks.swapped(store, "new", "there", "old")
    assert store.names == {"there"}
    for fails, left in (((1,), {"there"}), ((2,), {"there"}), ((2, 3), {"old"})):
        store = Store(*fails)
        with pytest.raises(OSError):
            sinks.swapped(store, "new", "there", "old")
        assert store.names == left


def test_upsert_with_clashing_names(spark):
    old = spark.createDataFrame([(1, "x", 2, "k")], "id int, was string, came int, new_id string")
    new = spark.createDataFrame([(1, "y", 3, "l"), (2, "z", 4, "m")], "id int, was string, came int, new_id string")
    assert sorted(map(tuple, sinks.upserted(old, new, ["id"], ["was"]).collect())) == [(1, "y", 2, "k"), (2, "z", 4, "m")]


def test_csv_for_spreadsheets(spark, tmp_path):
    items = spark.createDataFrame([(1, "T", ["A", "B"], 1999, None)], "position int, title string, creators array<string>, year int, completed_on date")
    assert sinks.list_csv(items, "Movies::Movie").columns == ["Position", "Title", "Year"]
    sinks.write_csv(sinks.list_csv(items, "Books::Book", completed=True), str(tmp_path / "c"), mark=True)
    texts = [part.read_text("utf-8") for part in (tmp_path / "c").glob("*.csv")]
    assert all(x.startswith("\ufeffPosition,Title,Authors,Year,Completed On\n") for x in texts) and any('1,T,"A, B",1999' in x for x in texts)


def test_categories(spark):
    categories = spark.createDataFrame([("Old", None, False), ("Taken", ["t"], True), ("Other", None, False)], "name string, alternative_names array<string>, deleted boolean")
    links = spark.createDataFrame([("Old", 1), ("Old", 2), ("Taken", 2)], "category string, item_id int")
    state = lambda c: {r["name"]: (sorted(r["alternative_names"] or []), r["deleted"]) for r in c.collect()}
    pairs = lambda x: sorted(map(tuple, x.collect()))
    c, x = entities.renamed_category(categories, links, "Old", "Fresh")
    assert state(c) == {"Old": ([], True), "Taken": (["t"], True), "Other": ([], False), "Fresh": (["Old"], False)} and pairs(x) == [("Fresh", 1), ("Fresh", 2), ("Taken", 2)]
    c, x = entities.renamed_category(categories, links, "Old", "TAKEN")
    assert state(c)["Taken"] == (["Old", "t"], False) and state(c)["Old"][1] and pairs(x) == [("Taken", 1), ("Taken", 2)]
    c, x = entities.deleted_category(categories, links, "Old")
    assert state(c)["Old"][1] and pairs(x) == [("Taken", 2)]
    c, x = entities.deleted_category(categories, links, "Old", soft=False)
    assert "Old" not in state(c) and pairs(x) == [("Taken", 2)]


def test_integrity_of_types(spark):
    lists_ = spark.createDataFrame([(1, "Books::List"), (2, "Music::Songs::List")], "id int, type string")
    configs = spark.createDataFrame([(7, "Books::RankingConfiguration"), (8, "Music::Albums::RankingConfiguration")], "id int, type string")
    ranked = spark.createDataFrame([(1, 7), (2, 8), (1, 8)], "list_id int, ranking_configuration_id int")
    assert sorted((r["list_id"], r["ranking_configuration_id"]) for r in entities.configuration_violations(ranked, lists_, configs).collect()) == [(1, 8), (2, 8)]
    penalties = spark.createDataFrame([(1, "Global::Penalty", None), (2, "Music::Penalty", None), (3, "Books::Penalty", 4)], "id int, type string, dynamic_type int")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (2, 2)], "penalty_id int, list_id int")
    got = {(r["penalty_id"], r["list_id"]): r["reason"] for r in entities.penalty_violations(links, penalties, lists_, "list_id", static_only=True).collect()}
    assert got == {(2, 1): "medium", (3, 1): "dynamic"}


def test_enrichment(spark):
    items = spark.createDataFrame([(1, "Blue Café", ["Ann"]), (2, "Blue cafe", ["Bob"]), (3, "Red", []), (4, " ", ["Ann"]), (5, "None", ["X"])], "key int, title string, creators array<string>")
    catalog = spark.createDataFrame([(10, "blue cafe", ["ANN", "C"]), (11, "Red", None), (12, "Red", ["Z"])], "id int, title string, creators array<string>")
    answers = spark.createDataFrame([(1, "m1", 9.0), (2, "m2", 5.0), (2, "m3", 7.0), (5, "m5", None)], "key int, external_id string, score double")
    got = {r["key"]: (r["matched_by"], r["match_id"]) for r in enrich.enriched(items, ("catalog", catalog), ("fetched", answers)).collect()}
    assert got == {1: ("catalog", "10"), 2: ("fetched", "m3"), 3: ("catalog", "11"), 4: ("not_found", None), 5: ("not_found", None)}
    assert {r["matched_by"] for r in enrich.enriched(items).collect()} == {"not_found"}
    with pytest.raises(ValueError):
        enrich.enriched(items, ("nobody", catalog))
    known = spark.createDataFrame([("a",), (None,)], "external_id string")
    asked, same = enrich.imported(spark.createDataFrame([("a",), ("b",), (None,)], "external_id string"), known)
    assert sorted(str(r[0]) for r in asked.collect()) == ["None", "b"] and [r[0] for r in same.collect()] == ["a"]


def test_registries():
    from ranklume.operators import ranking
    from ranklume.registry import WEIGHTS, Registry

    assert WEIGHTS.get(1) is ranking.list_weight and WEIGHTS.get() is ranking.list_weight
    for bad in (lambda: WEIGHTS.get(2), lambda: WEIGHTS.add(1)(len), lambda: Registry("x").get()):
        with pytest.raises(ValueError):
            bad()


def test_recomputation_waits(spark):
    from ranklume.streaming.recompute import ready

    at = lambda rows: spark.createDataFrame(rows, "target int, ts string").withColumn("ts", F.to_timestamp("ts"))
    requests = at([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:01:00"), (2, "2024-01-01 10:04:00"), (3, "2024-01-01 09:00:00")])
    done = at([(3, "2024-01-01 09:30:00")])
    assert [r["target"] for r in ready(requests, done, "2024-01-01 10:06:00").collect()] == [1]


def test_titles_with_optional_creators(spark):
    games = spark.createDataFrame([(1, "Star Road", ["Dev One"]), (2, "Star Road", ["Else"]), (3, "Other", ["Dev One"])], "id int, title string, names array<string>")
    found = lambda **k: {r["id"]: r["score"] for r in search.by_title_and_creators(games, "star road", ["Dev One"], "names", **k).collect()}
    assert found() == {1: 38.0} and found(required=False) == {1: 38.0, 2: 27.0} and found(required=False, min_score=30.0) == {1: 38.0}
