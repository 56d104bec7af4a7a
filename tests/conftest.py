import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(pdf):
    """Rows of a pandas frame as sorted tuples of text, columns by name."""

    def show(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "None"
        if isinstance(v, (float, int)) or type(v).__name__ in ("int32", "int64", "float64"):
            return f"{float(v):.9g}" if type(v).__name__ not in ("bool", "bool_") else str(int(v))
        if type(v).__name__ in ("bool", "bool_"):
            return str(int(v))
        return str(v)

    return sorted(tuple(show(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))
