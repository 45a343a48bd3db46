"""Sinks: upserts, appends, prunes, CSV, documents, and swaps of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused


def upserted(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """old with new's rows: known keys take ``update`` columns (all by default) from new, other columns stay; unknown keys are added. Nulls are equal in keys."""
    update = update or [c for c in new.columns if c not in keys]
    was, came = unused("was", old, new), unused("came", old, new)
    there = {c: unused(f"new_{c}", old, new) for c in new.columns}
    n = new.select(*[F.col(f"`{c}`").alias(name) for c, name in there.items()], F.lit(True).alias(came))
    o = old.withColumn(was, F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & o[k].eqNullSafe(n[there[k]])
    x = o.join(n, same, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.when(F.col(was), F.col(c)).otherwise(F.col(there[c])).alias(c))
        elif c not in new.columns:
            out.append(F.col(c))
        else:
            fresh = F.col(came) if c in update else F.col(came) & F.col(was).isNull()
            out.append(F.when(fresh, F.col(there[c])).otherwise(F.col(c)).alias(c))
    return x.select(*out)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows whose keys old has not, one for each key: what an insert that ignores conflicts adds."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def pruned(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old's rows whose keys are not in new: what a prune deletes."""
    return old.join(new.select(*keys), keys, "left_anti")


def change_report(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """A row for each key of new: old and new value, and whether they differ."""
    return new.select(key, F.col(value).alias("after")).join(old.select(key, F.col(value).alias("before")), key, "left").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def refuse_empty(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, or old if new has no rows: a ranking that came out empty replaces nothing. Only one row of new is looked at."""
    return old if new.isEmpty() else new


#: The mark that spreadsheets know Unicode by.
MARK = "\ufeff"
#: What a list's CSV has beside position, title and year, by the type of its items.
CREATORS = {"Music::Album": "Artists", "Music::Song": "Artists", "Books::Book": "Authors"}


def write_csv(df: DataFrame, path: str, order: list | None = None, mark: bool = False) -> None:
    """CSV with a header; arrays are joined by commas. An order makes ranges of rows, so files follow it. ``mark`` begins each file with MARK."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    out = (df.orderBy(*order) if order else df).select(*flat)
    if mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], MARK + out.columns[0])
    out.write.mode("overwrite").option("header", True).csv(path)


def list_csv(items: DataFrame, item_type: str, completed: bool = False) -> DataFrame:
    """A list's items (position, title, year, creators, completed_on) in the columns that its CSV has for the type."""
    columns = [F.col("position").alias("Position"), F.col("title").alias("Title")]
    if item_type in CREATORS:
        columns.append(F.array_join("creators", ", ").alias(CREATORS[item_type]))
    columns.append(F.col("year").alias("Year"))
    if completed:
        columns.append(F.date_format("completed_on", "yyyy-MM-dd").alias("Completed On"))
    return items.select(*columns)


def write_documents(df: DataFrame, path: str, changes: DataFrame | None = None, key: str = "id") -> None:
    """Documents as Parquet; with changes (some columns of some documents) the stored ones are updated and the rest is kept."""
    if changes is None:
        df.write.mode("overwrite").parquet(path)
        return
    replace_table(upserted(df, changes, [key]), path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table and swaps, so df may read the table itself.

    Both moves are checked: where the new table cannot take its place, the old one is moved back and the new one deleted, and
    OSError is raised. Between the two moves, which touch names only, readers find no table.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    at, there, away = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, path, old))
    swapped(there.getFileSystem(conf), at, there, away)


def swapped(fs, at, there, away) -> None:
    """Moves ``there`` away and ``at`` there, or leaves all as it was and raises OSError."""

    def moved(a, b) -> bool:
        try:
            return bool(fs.rename(a, b))
        except Exception:  # any store's own error
            return False

    had = fs.exists(there)
    if had and not moved(there, away):
        fs.delete(at, True)
        raise OSError(f"cannot move {there} away")
    if not moved(at, there):
        restored = not had or moved(away, there)
        fs.delete(at, True)
        raise OSError(f"cannot move {at} to {there}" + ("" if restored else f"; its rows are in {away}"))
    if had:
        fs.delete(away, True)


def with_errors(df: DataFrame, checks: dict) -> DataFrame:
    """df with ``errors``, the names of the checks that a row fails: one bad row stops no batch."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def reindexed_ranks(documents: DataFrame, ranked_items: DataFrame, listed: DataFrame) -> DataFrame:
    """Partial documents of ranked items only: position, and whether the item is on any list. Items that lost their rank are not reset."""
    on_list = listed.where("listable_id is not null").select(F.col("listable_id").alias("id")).distinct().withColumn("ranked", F.lit(True))
    return documents.select("id").join(ranked_items.where("rank is not null").select(F.col("item_id").alias("id"), F.col("rank").alias("ranked_position")), "id").join(on_list, "id", "left").withColumn("ranked", F.coalesce("ranked", F.lit(False)))
