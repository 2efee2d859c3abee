"""Scratch folders and when they go."""

import os

from areashift.session import free_scratch, scratch_folder, scratch_made


def test_scratch_is_freed_on_demand(spark):
    one, other = scratch_folder(spark, "one"), scratch_folder(spark, "other")
    spark.range(3).write.mode("overwrite").parquet(one)
    assert scratch_made()[-2:] == [one, other]
    free_scratch(spark, [one])
    assert not os.path.exists(one.removeprefix("file:")) and os.path.exists(other.removeprefix("file:"))
    assert one not in scratch_made() and scratch_made()[-1] == other
