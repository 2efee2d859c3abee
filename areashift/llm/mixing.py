"""Mix sources to target weights, in whole and partial epochs.

Native DataFrame operations only. Documents get a hash-random key; the key's leading bits
are a range of keys, so (source, range) is a range sort of each source that needs no
sampling and splits a source of any size. Running token counts within a range plus the
totals of the ranges before give the prefix sum at which a source is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areashift.llm.storage import prepared, stored

#: Rows that a range of keys holds on average.
RANGE_ROWS = 2000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the whole text, 0 for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_column: Column) -> Column:
    """Hash-random text key of an id, the same in every run."""
    return F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, n_rows, target of every source.

    Sources by code point, a missing one last, take the weights in turn. The budget is
    ``share`` of all tokens, split by weight; a source stops at ``most`` times its size and
    the excess goes to the others by weight. The level at which the rest share is found
    from prefix sums over the sources by (cap / weight): the windows run over one row per
    source.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (
        share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # the first source, by cap / weight, that its level does not fill, sets the level of all after
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rank = F.row_number().over(by_level)
    per = per.withColumn("rank", rank).withColumn(
        "shared", F.min(F.when(free.isNotNull(), F.struct("rank", "level"))).over(everything)
    )
    target = F.when(
        F.col("shared").isNull() | (F.col("rank") < F.col("shared.rank")), F.col("cap")
    ).otherwise(F.col("shared.level") * F.col("weight"))
    return per.select("source", "source_size", "n_rows", target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``taken`` counts tokens with repeats: whole epochs of the source, and of the last one
    the documents by random key up to the budget, the document at the cut in part. The
    taken tokens of a source add up to its target, rounded down. A missing text has size
    0; a missing source is a source of its own; rows with equal ids are taken in any order
    among themselves, with the same multiset of results.
    """
    prepared(docs.sparkSession)
    sizes = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
        ),
        "sizes",
    )
    targets = stored(source_targets(sizes, weights, share, most), "targets").withColumnRenamed(
        "source", "of"
    )
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = random_key(F.col("id"))
    leading = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("n_rows") / range_rows)
    rows = rows.withColumn("key", key).withColumn(
        "range", F.floor(leading * ranges / F.lit(float(1 << 32)))
    )
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size")
    rows = rows.withColumn(
        "upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("__total"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(
        F.col("source").alias("__source"),
        F.col("range").alias("__range"),
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("first"),
    )
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("range") == F.col("__range"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    before = F.col("first") + F.col("upto") - F.col("size")
    partial = F.least(F.col("size"), F.greatest(F.lit(0), rest - before))
    return rows.join(firsts, same).select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + partial).cast("long").alias("taken"),
    )


#: The same in SQL: a plain window over each source.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM {docs}
), per AS (
  SELECT source, sum(size) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sizes GROUP BY source
), caps AS (
  SELECT *, 2.0 * source_size AS cap,
         row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS rank FROM per
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM caps
), free AS (SELECT rank AS from_rank, level AS shared FROM levels WHERE level * weight <= cap ORDER BY rank LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN from_rank IS NULL OR rank < from_rank THEN cap ELSE shared * weight END AS target
  FROM levels LEFT JOIN free ON true
), upto AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM upto
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size,
       CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + least(size, greatest(0, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM cut
"""
