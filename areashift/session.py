"""Session settings the plans rely on, and where tables written on the way go."""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import SparkSession

# Joins here are shaped so that adaptive execution can split a hot key on the many
# side. forceOptimizeSkewedJoin lets it do so even where a later operator would have
# reused the partitioning: one more shuffle, paid only when a partition is skewed.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings for this session."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one in the
    session's warehouse, which all machines share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder unless the session has a place for them."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))


#: Scratch folders made by this process and not freed yet, in order.
_SCRATCH: list[str] = []


def scratch_made() -> list[str]:
    """The scratch folders that there are, oldest first."""
    return list(_SCRATCH)


def free_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch folders that no plan reads any more."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        _SCRATCH.remove(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every machine can read and write, removed
    when the session's JVM ends, or before by ``free_scratch``."""
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    _SCRATCH.append(path)
    return path
