"""A canon: greedy selection by rank under quotas per country and author."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Books that no canon may have.
BLOCKED = [2526, 1974, 15365, 705]


def first_per_book(links: DataFrame, value: str, *order: str) -> DataFrame:
    """book_id and the value of its first link."""
    w = Window.partitionBy("book_id").orderBy(*order)
    return links.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("book_id", value)


def candidates(ranked_items: DataFrame, category_items: DataFrame, fiction: str, nonfiction: str, excluded: list[str], countries: DataFrame, authors: DataFrame) -> DataFrame:
    """item_id, rank, pass (0 fiction, 1 non-fiction), country and author; a book of both genres stands twice."""
    passes = category_items.where(F.col("category").isin(fiction, nonfiction)).select("item_id", (F.col("category") == nonfiction).cast("int").alias("pass"))
    x = ranked_items.where(F.col("rank").isNotNull() & ~F.col("item_id").isin(*BLOCKED)).select("item_id", "rank").join(passes, "item_id")
    if excluded:
        x = x.join(category_items.where(F.col("category").isin(*excluded)).select("item_id"), "item_id", "left_anti")
    return x.join(countries.withColumnRenamed("book_id", "item_id"), "item_id", "left").join(authors.withColumnRenamed("book_id", "item_id"), "item_id", "left").select("item_id", "rank", "pass", F.col("country_id").alias("country"), F.col("author_id").alias("author"))


def global_canon(found: DataFrame, total: int = 100, nonfiction_percentage: int = 20, per_country: int = 5) -> DataFrame:
    """One row: the picked (item_id, rank) by rank, and how many were passed over for country or author.

    Order decides everything, so the passes are one fold over candidates in order, in the JVM. Ranks are read in growing
    ranges, until both quotas are full or there are no more: what is ranked below changes nothing then. So the one task that
    folds mostly sees a few times the canon; where quotas cannot be filled it sees (item, rank, country, author) of all candidates.
    """
    reach, last = FIRST_REACH * max(1, total), None
    while True:
        done = _folded(found.where(F.col("rank") <= reach), total, nonfiction_percentage, per_country)
        if done.select(F.expr("full")).first()[0]:
            break
        last = last if last is not None else found.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
        if reach >= last:
            break
        reach *= 8
    return done.drop("full")


#: Ranks that are read at first for each book of the canon.
FIRST_REACH = 20


def _folded(found: DataFrame, total: int, nonfiction_percentage: int, per_country: int) -> DataFrame:
    nonfiction = (total * nonfiction_percentage * 2 + 100) // 200
    quotas = [total - nonfiction, nonfiction]
    row = F.struct("pass", "rank", "item_id", "country", "author")
    state = "struct<picked:array<struct<item_id:bigint,rank:int>>,countries:map<bigint,int>,authors:array<bigint>,n0:int,n1:int,by_country:bigint,by_author:bigint>"
    empty = F.struct(F.array().alias("picked"), F.create_map().alias("countries"), F.array().alias("authors"), F.lit(0).alias("n0"), F.lit(0).alias("n1"), F.lit(0).alias("by_country"), F.lit(0).alias("by_author")).cast(state)

    def step(s, c):
        country, author = F.coalesce(c["country"], F.lit(-1)), F.coalesce(c["author"], F.lit(-1))
        count = F.when(c["pass"] == 0, s["n0"]).otherwise(s["n1"])
        quota = F.when(c["pass"] == 0, F.lit(quotas[0])).otherwise(F.lit(quotas[1]))
        done = count >= quota
        taken = F.array_contains(s["authors"], author)
        used = F.coalesce(F.try_element_at(s["countries"], country), F.lit(0))
        full = used >= per_country
        pick = ~done & ~taken & ~full
        spent = F.map_concat(F.map_filter(s["countries"], lambda k, v: k != country), F.create_map(country, used + 1))
        return F.struct(
            F.when(pick, F.concat(s["picked"], F.array(F.struct(c["item_id"].alias("item_id"), c["rank"].alias("rank"))))).otherwise(s["picked"]).alias("picked"),
            F.when(pick, spent).otherwise(s["countries"]).alias("countries"),
            F.when(pick, F.concat(s["authors"], F.array(author))).otherwise(s["authors"]).alias("authors"),
            (s["n0"] + F.when(pick & (c["pass"] == 0), 1).otherwise(0)).alias("n0"),
            (s["n1"] + F.when(pick & (c["pass"] == 1), 1).otherwise(0)).alias("n1"),
            (s["by_country"] + F.when(~done & ~taken & full, 1).otherwise(0)).cast("bigint").alias("by_country"),
            (s["by_author"] + F.when(~done & taken, 1).otherwise(0)).cast("bigint").alias("by_author"),
        )

    folded = found.groupBy().agg(F.array_sort(F.collect_list(row)).alias("rows")).select(F.aggregate("rows", empty, step).alias("s"))
    return folded.select(F.array_sort(F.transform("s.picked", lambda p: F.struct(p["rank"].alias("rank"), p["item_id"].alias("item_id")))).alias("picked"), F.lit(total).alias("requested"), F.size("s.picked").alias("delivered"), F.col("s.by_country").alias("blocked_by_country"), F.col("s.by_author").alias("blocked_by_author"), ((F.col("s.n0") >= quotas[0]) & (F.col("s.n1") >= quotas[1])).alias("full"))
