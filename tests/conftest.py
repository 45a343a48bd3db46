import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(pdf):
    """Rows in one order, numbers rounded, so that two engines' results compare."""

    def cell(x):
        if x is None or str(x) in ("nan", "NaN", "NaT", "<NA>"):
            return None
        if type(x).__name__ in ("float", "float64", "float32", "Decimal") or isinstance(x, float):
            return round(float(x), 6) + 0.0
        if hasattr(x, "tolist"):
            return cell(x.tolist()) if not isinstance(x.tolist(), list) else str(x.tolist())
        return float(x) if isinstance(x, int) and not isinstance(x, bool) else x

    rows = [tuple(cell(x) for x in row) for row in pdf[sorted(pdf.columns)].astype(object).values.tolist()]
    return sorted(rows, key=repr)
