"""Run the three analyses over landed files: ``python -m areashift --help``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from areashift.operators import focus
from areashift.plans import focus_region, national, regional_average
from areashift.plans.inputs import Paths, Region
from areashift.schemas import (
    PEERS,
    PIVOT_HEADINGS,
    PIVOT_HEADINGS_ALL_CLASSES,
    REGION_COUNTIES,
    REGION_STATE,
    THRESHOLD,
)
from areashift.session import configure


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="areashift", description=__doc__)
    for field in fields(Paths):
        optional = field.name in ("place_list", "snapshot", "rates_format")
        parser.add_argument(
            f"--{field.name.replace('_', '-')}",
            required=not optional,
            default=field.default if optional else None,
        )
    parser.add_argument("--out", required=True, help="folder all machines can write to")
    parser.add_argument("--focus-label", required=True, help="group name of the focus region")
    parser.add_argument("--state", default=REGION_STATE)
    parser.add_argument("--counties", nargs="+", default=REGION_COUNTIES)
    parser.add_argument("--threshold", type=float, default=THRESHOLD, help="majority above this share")
    parser.add_argument("--peers", type=int, default=PEERS, help="number of groups compared")
    parser.add_argument("--all-classes", action="store_true", help="report the changes of all classes")
    options = vars(parser.parse_args(arguments))

    out, label = options.pop("out"), options.pop("focus_label")
    region = Region(options.pop("state"), tuple(options.pop("counties")))
    headings = PIVOT_HEADINGS_ALL_CLASSES if options.pop("all_classes") else PIVOT_HEADINGS
    threshold, peers = options.pop("threshold"), options.pop("peers")
    paths = Paths(**options)
    spark = configure(SparkSession.builder.appName("areashift").getOrCreate())

    units = national.run(spark, paths, out, label, headings, threshold, peers)["units"]
    tracts = focus(units, "MSA", label)
    if paths.place_list:
        focus_region.run(spark, paths, out, tracts, region)
    if paths.snapshot:
        regional_average.run(spark, paths, out, tracts, region)


if __name__ == "__main__":
    main()
