"""Tables written to the cluster's shared folder, to cut lineage and to be read twice."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from areashift.session import free_scratch, scratch_folder, scratch_made

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory however
#: long texts are (one text longer than that is a batch of its own).
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

#: Spark's own setting to remove the shuffle files of a query when that query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with bounded Arrow batches and adaptive skew handling."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    for name in ("adaptive.enabled", "adaptive.skewJoin.enabled"):
        spark.conf.set(f"spark.sql.{name}", "true")
    return spark


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside remove their shuffle files when they end, not when the
    driver happens to collect its garbage. The session's setting is put back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows as Parquet to the shared folder and read them back.

    Written once, they neither change when a task is repeated nor hang on the executors
    that made them.
    """
    spark = rows.sparkSession
    path = scratch_folder(spark, name)
    with no_shuffle_left(spark):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def free_unread(before: Iterable[str], *plans: DataFrame) -> None:
    """Remove the scratch folders made since ``before`` (of ``scratch_made``) that none of the
    plans reads: those of tables that were needed on the way to them only."""
    read = [f for plan in plans for f in plan.inputFiles()]
    made = [p for p in scratch_made() if p not in set(before)]
    unread = [p for p in made if not any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)]
    free_scratch(plans[0].sparkSession, unread)


class Kept(dict):
    """A cache of a worker: it starts empty wherever it is sent, and goes there by value."""

    def __reduce__(self) -> tuple:
        return type(self), ()


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a value of bounded size, with its classes: workers need not have them. The
    function returned gives it on a worker, unpickled once for a task."""
    shared, cache = spark.sparkContext.broadcast(cloudpickle.dumps(value)), Kept()

    def received() -> Any:
        if "value" not in cache:
            cache["value"] = pickle.loads(shared.value)
        return cache["value"]

    return received


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that the rows do not have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
