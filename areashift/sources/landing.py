"""Landing that repeats: only partitions that are missing or changed are loaded and written.

A manifest beside the data names every landed partition with its number of rows and a
fingerprint of them, which depends neither on their order nor on files. It is written after
the data, so a landing that fails in between is made good by the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areashift.operators.joins import keyed_join, named
from areashift.schemas import FACT_PARTITIONS
from areashift.session import scratch_folder
from areashift.sources.writers import materialize

PRINT = ["n_rows", "p0", "p1", "p2", "p3"]
#: Folder of manifests beside the partitions; Spark does not read names that begin so.
MANIFEST = "_manifest"


def partition_prints(rows: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """One row per partition: rows, and sums of two hashes of them in halves."""
    columns = [named(c) for c in sorted(rows.columns)]
    hashes = [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]
    halves: list[Column] = []
    for h in hashes:
        halves += [F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))), F.sum(F.shiftrightunsigned(h, 32))]
    return rows.groupBy(*[named(p) for p in partitions]).agg(
        F.count(F.lit(1)).alias("n_rows"), *[h.alias(f"p{i}") for i, h in enumerate(halves)]
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    done = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().isdigit()]
    # a manifest without its mark was not written to the end
    return sorted(int(p.getName()) for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, path: str, partitions: StructType) -> DataFrame:
    """The landed partitions, with rows and fingerprints. None where nothing has landed."""
    schema = StructType(list(partitions.fields))
    for c in PRINT:
        schema = schema.add(c, "long")
    found = _versions(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{MANIFEST}/{found[-1]}")


def not_landed(wanted: DataFrame, path: str) -> DataFrame:
    """The partitions, one row each, that have not landed yet."""
    spark = wanted.sparkSession
    landed = manifest(spark, path, wanted.schema)
    return keyed_join(wanted.distinct(), landed, wanted.columns, "left_anti")


def land_changed(rows: DataFrame, path: str, partitions: Sequence[str] = FACT_PARTITIONS) -> DataFrame:
    """Write the partitions whose rows differ from what has landed, and return them. An action.

    Other partitions are neither written nor removed, whether or not ``rows`` has them. The
    rebalance hint splits a partition that holds much of the data over several files. The
    number of partitions bounds the manifest, and what is broadcast of it.
    """
    spark = rows.sparkSession
    prints = partition_prints(rows, partitions)
    keys = StructType([rows.schema[p] for p in partitions])
    known = manifest(spark, path, keys)
    everything = [*partitions, *PRINT]
    number = (_versions(spark, path) or [0])[-1] + 1
    changed = keyed_join(prints, known, everything, "left_anti")
    changed = materialize(changed, scratch_folder(spark, "changed"))
    if changed.isEmpty():
        return changed

    fresh = keyed_join(rows, F.broadcast(changed.select(*partitions)), list(partitions), "left_semi")
    fresh.hint("rebalance", *partitions).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partitions).parquet(path)
    kept = keyed_join(known, F.broadcast(changed.select(*partitions)), list(partitions), "left_anti")
    now = kept.select(*everything).unionByName(changed.select(*everything))
    now.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/{number}")
    return changed


def land_missing(
    wanted: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    path: str,
    partitions: Sequence[str] = FACT_PARTITIONS,
) -> DataFrame:
    """Load and write those of the wanted partitions that have not landed; return them. An
    action. ``load`` gets the missing partitions, one row each, and is not called without."""
    missing = not_landed(wanted.select(*partitions), path)
    if missing.isEmpty():
        return missing
    return land_changed(load(missing), path, partitions).select(*partitions)


def land_rates(rates: DataFrame, path: str) -> DataFrame:
    """Store rates of one geography by state, so that a state is read alone, and return the
    states that were new or changed. An action."""
    return land_changed(rates, path, ["state"])
