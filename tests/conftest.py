import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from areashift.session import configure  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file:{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """Small DataFrame from a schema string and rows."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def rows_of(df, *order):
    """Rows as tuples, sorted by the given columns (all when none is given)."""
    keys = order or tuple(df.columns)
    rows = [r.asDict() for r in df.collect()]
    rows.sort(key=lambda r: tuple((r[k] is None, str(r[k])) for k in keys))
    return [tuple(r[c] for c in df.columns) for r in rows]
