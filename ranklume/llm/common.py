"""What the operators share: tables, the shared folder, salted lookups, components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Parts into which the rows of one key are dealt in a salted lookup.
SALTS = 32
#: Rows in an Arrow batch. Texts reach 100 KB and more, so Spark's default of 10,000 is too many.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless it already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where it is unset, a new one in local mode; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ranklume-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder and read again: lineage ends there. Also the path, for dropped().

    An application's tables are in one folder of its own, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ranklume-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that nothing reads any more."""
    sc = spark.sparkContext
    for p in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Staged tables that go when the block ends; what outlives it has to be staged by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        df, path = staged(df, label)
        self.paths.append(path)
        return df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        dropped(self.spark, *self.paths)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast value, to be called for on executors; its classes travel with it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def held_out(doc_id) -> bool:
    """Whether labels of the document are kept from every fit."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("None")).cast("binary")) % 5 == 0


def salted_lookup(big: DataFrame, small: DataFrame, key: str, salt_on: str, how: str = "left") -> DataFrame:
    """big joined to small, which has one row for each key. A key's rows in big are dealt over SALTS tasks; small is repeated as often."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_on)), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).hint("merge")  # Spark does not see that explode makes it larger
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: A node of more ends of links than this, and than a MOST_HOTth of all, is hot: fewer than MOST_HOT nodes are.
HOT, MOST_HOT = 100, 20_000


def _with_least(rows: DataFrame, hot: int) -> DataFrame:
    """The rows u, v with ``m``, the least v of their u. Least ends of hot nodes are broadcast, so that no row is repeated and no hot node is one task."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    few, many = low.where(F.col("n") <= hot).drop("n"), low.where(F.col("n") > hot).drop("n")
    cold = rows.join(F.broadcast(many.select("u")), "u", "left_anti")  # rows of hot nodes are gone before the rest are dealt by node
    return cold.join(few.hint("merge"), "u").unionByName(rows.join(F.broadcast(many), "u"))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Nodes (``node``) of the links ``a``-``b`` (long) and the smallest node they reach (``root``).

    Alternates large and small stars until the links are stars about the smallest nodes, which takes
    rounds in the logarithm of a chain's length. Minima are pre-aggregated and those of hot nodes broadcast, so a node
    with very many links is no hot task. Each round is a table in the shared folder; the driver learns only
    whether all are stars and how many links there are. Self-links and null ends are ignored; nodes without a link do not appear.
    """
    spark = edges.sparkSession
    found = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, path = staged(found, label)
    while True:
        done, n = _stars(links)
        if done:
            break
        hot = max(HOT, 2 * n // MOST_HOT)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large, other = staged(large, label)
        moved = _with_least(large, hot).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        links, new = staged(moved.unionByName(low).distinct(), label)
        dropped(spark, path, other)
        path = new
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(links: DataFrame) -> tuple[bool, int]:
    """Whether each node has one lower neighbour at most, which has none: then it is the root, and all are found. Also the number of links."""
    ends = links.select("u", F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("up"))).groupBy("u").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    found = ends.agg(F.coalesce(F.sum("ups"), F.lit(0)).alias("links"), F.count(F.expr("if(ups > 1 or ups = 1 and n > 1, 1, null)")).alias("others")).first()
    return found["others"] == 0, found["links"]


#: Bits of a filter of ids, which has this size however many ids there are.
FILTER_BITS = 1 << 25


def maybe_among(ids: DataFrame, key: str) -> Callable[[F.Column], F.Column]:
    """A test of a long column: false means that the value is not among ids[key]; true means that it may be.

    The bits are set on executors; 4 MB are broadcast for any number of ids. With very many ids the filter passes all,
    so it may only save work.
    """
    spark = ids.sparkSession
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    found = ids.select(F.shiftrightunsigned(slot, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64L) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    held = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy()
        return pd.Series(held.value[(h % FILTER_BITS) >> 6] >> (h % 64) & 1 == 1)

    return lambda column: test(F.xxhash64(column))


__all__ = ["Scratch", "T", "Window", "connected_components", "dropped", "held_out", "held_out_column", "maybe_among", "salted_lookup", "sent", "shared_folder", "small_batches", "staged", "table", "unused"]
