"""A crosswalk landed for repeated use: bucketed by source and by target.

Pairs stored in buckets of their source join the attributes of sources without being
shuffled, and pairs in buckets of their target those of targets. A bucket cannot be split,
so the pairs of a unit with more than a bucket's share of them are stored apart; there are
fewer such units than buckets, and their attributes are sent to the pairs instead.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areashift.operators.joins import keyed_join, named

#: Pairs in a bucket, about, where the number of buckets is not given.
BUCKET_PAIRS = 1 << 18

META = "source string, target string, buckets int, columns string, hot_sources long, hot_targets long"


@dataclass(frozen=True)
class Bucketed:
    """Pairs in buckets of one unit, and those of its hot units with the list of them."""

    unit: str
    buckets: int
    pairs: DataFrame
    hot: DataFrame | None
    hot_units: DataFrame | None

    def attach(self, attributes: DataFrame, unallocated: bool) -> DataFrame:
        """All pairs with the attributes of their unit, one row per unit under its name and
        dealt into the buckets; those of units in no pair come with the rest NULL."""
        parts = [keyed_join(self.pairs, attributes, [self.unit], "left", null_safe=False)]
        rest = attributes
        if self.hot is not None:
            few = keyed_join(attributes, F.broadcast(self.hot_units), [self.unit], "left_semi", False)
            parts.append(keyed_join(self.hot, F.broadcast(few), [self.unit], "left", null_safe=False))
            rest = keyed_join(attributes, F.broadcast(self.hot_units), [self.unit], "left_anti", False)
        if unallocated:
            parts.append(keyed_join(rest, self.pairs.select(named(self.unit)), [self.unit], "left_anti", False))
        whole, *more = parts
        for part in more:
            whole = whole.unionByName(part, allowMissingColumns=True)
        return whole

    def all_pairs(self) -> DataFrame:
        return self.pairs if self.hot is None else self.pairs.unionByName(self.hot)


@dataclass(frozen=True)
class LandedCrosswalk:
    """The same pairs twice: in buckets of the source, and in buckets of the target."""

    source: str
    target: str
    by_source: Bucketed
    by_target: Bucketed

    def by(self, unit: str) -> Bucketed:
        if unit not in (self.source, self.target):
            raise ValueError(f"the crosswalk is landed by {self.source} and {self.target}, not {unit}")
        return self.by_source if unit == self.source else self.by_target


def land_crosswalk(
    crosswalk: DataFrame, path: str, source: str, target: str, buckets: int | None = None
) -> LandedCrosswalk:
    """Store a crosswalk under ``path`` and open it. An action: the pairs are shuffled once
    for each side, and never again. Pairs without a source or target are refused.

    Buckets are as many as shuffle partitions unless given: with fewer, Spark would rather
    shuffle the pairs again than run so few tasks. Where each would get more than
    ``BUCKET_PAIRS`` there are more, so that a task's memory does not grow with the pairs.
    """
    spark = crosswalk.sparkSession
    known = named(source).isNotNull() & named(target).isNotNull()
    refused = F.raise_error(F.lit("a landed crosswalk needs a source and a target in every pair"))
    checked = crosswalk.where(F.coalesce(known, F.lit(False)) | refused.cast("boolean"))
    # sides are written from one stored copy, so that both hold the same pairs
    checked.write.mode("overwrite").parquet(f"{path}/pairs")
    pairs = spark.read.schema(crosswalk.schema).parquet(f"{path}/pairs")
    total = pairs.count()
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_PAIRS))
    hot = [_land_side(pairs, path, side, unit, buckets, total) for side, unit in (("source", source), ("target", target))]
    meta = spark.createDataFrame([(source, target, buckets, crosswalk.schema.json(), *hot)], META)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return open_crosswalk(spark, path)


def _land_side(pairs: DataFrame, path: str, side: str, unit: str, buckets: int, total: int) -> int:
    """Write one side and return the number of its hot units."""
    sizes = pairs.groupBy(named(unit)).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.where(F.col("__n") * buckets > total).select(named(unit))
    # the few found go into one file; a coalesce would count all units in one task
    hot.repartition(1).write.mode("overwrite").parquet(f"{path}/hot-{side}-units")
    units = pairs.sparkSession.read.schema(hot.schema).parquet(f"{path}/hot-{side}-units")
    found = units.count()
    if found:
        apart = keyed_join(pairs, F.broadcast(units), [unit], "left_semi", False)
        apart.write.mode("overwrite").parquet(f"{path}/hot-{side}")
        pairs = keyed_join(pairs, F.broadcast(units), [unit], "left_anti", False)
    # dealt as buckets are, so that each task writes the one file of its bucket
    name = f"crosswalk_{uuid4().hex}"
    writer = pairs.repartition(buckets, named(unit)).write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, unit).sortBy(unit).option("path", f"{path}/by-{side}").saveAsTable(name)
    pairs.sparkSession.sql(f"DROP TABLE {name}")  # of an external table only the name goes
    return found


def open_crosswalk(spark: SparkSession, path: str) -> LandedCrosswalk:
    """A landed crosswalk, in this session or another."""
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    schema = StructType.fromJson(json.loads(meta["columns"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def side(name: str, unit: str, hot: int) -> Bucketed:
        table = f"crosswalk_{uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{unit}`) SORTED BY (`{unit}`) "
            f"INTO {meta['buckets']} BUCKETS LOCATION '{path}/by-{name}'"
        )
        if not hot:
            return Bucketed(unit, meta["buckets"], spark.table(table), None, None)
        units = spark.read.schema(schema).parquet(f"{path}/hot-{name}-units").select(named(unit))
        return Bucketed(
            unit, meta["buckets"], spark.table(table), spark.read.schema(schema).parquet(f"{path}/hot-{name}"), units
        )

    return LandedCrosswalk(
        meta["source"],
        meta["target"],
        side("source", meta["source"], meta["hot_sources"]),
        side("target", meta["target"], meta["hot_targets"]),
    )

