"""Write landed tables and published reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areashift.operators.joins import named
from areashift.schemas import FACT_PARTITIONS
from areashift.session import use_checkpoints


def land_facts(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store long facts so that a survey and a state can be read alone. An action.

    The rebalance hint lets Spark split a state that holds much of the data over
    several tasks and files, and join small ones.
    """
    facts.hint("rebalance", *FACT_PARTITIONS).write.mode(mode).partitionBy(
        *FACT_PARTITIONS
    ).parquet(path)


def materialize(rows: DataFrame, path: str) -> DataFrame:
    """Write a table that several later steps read, and read it back. An action."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_export(rows: DataFrame, path: str) -> None:
    """CSV with a header, ``NA`` for missing, values otherwise as they are. An action."""
    rows.write.mode("overwrite").csv(
        path,
        header=True,
        nullValue="NA",
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def with_row_index(rows: DataFrame, order: Sequence[Column], index: str = "row_id") -> DataFrame:
    """Rows in order with an index 1..n, numbered in parallel. An action: it checkpoints.

    Rows that compare equal are put in the order of a hash of all their columns, and wholly
    equal rows in that in which they were read, so ties of any number are dealt over as many
    tasks as other rows and are numbered alike whatever the partitions.

    The sorted rows are checkpointed, as a second sort could place its partition
    bounds elsewhere. Each row then knows its partition and place in it, and the
    partition's first number comes from a table of one row per partition, small
    enough to send everywhere whatever the data holds.
    """
    use_checkpoints(rows.sparkSession)
    place = F.monotonically_increasing_id()
    hashed = [named(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    ties = rows.withColumns({"__tie": F.xxhash64(*hashed), "__read": place})
    ranked = ties.orderBy(*order, "__tie", "__read").drop("__tie", "__read")
    ranked = ranked.withColumn("__place", place).checkpoint()
    # The id holds the partition above bit 33 and the place within it below.
    ranked = ranked.withColumn("__part", F.shiftright("__place", 33))
    sizes = ranked.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first")
    )
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.join(F.broadcast(firsts), "__part").select(
        (F.col("__first") + within + 1).alias(index), *[named(c) for c in rows.columns]
    )


def write_report(
    rows: DataFrame, order: Sequence[Column], path: str, index: str | None = "row_id"
) -> None:
    """Ordered CSV report, with a leading row index unless ``index`` is None."""
    ordered = rows.orderBy(*order) if index is None else with_row_index(rows, order, index)
    write_export(ordered, path)


def publish_views(spark: SparkSession, comparison: DataFrame, classes: Sequence[str]) -> list[str]:
    """A temporary view ``class_<label>`` per class of a comparison table."""
    names = []
    for label in classes:
        name = f"class_{label}"
        comparison.where(F.col("class") == label).createOrReplaceTempView(name)
        names.append(name)
    return names
