"""python -m pellucid --folder FOLDER [--report FILE]: scan a folder, print its health, write a report."""

from __future__ import annotations

import argparse
import os
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pellucid", description=__doc__)
    parser.add_argument("--folder", required=True, help="the folder to scan; the last one given counts")
    parser.add_argument("--report", help="a .csv file, or any other name for HTML")
    given = parser.parse_args(args)
    if not os.path.isdir(given.folder):
        print(f"not a folder: {given.folder}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans.analysis import Analysis
    from .plans.report import export
    from .sources.folder import scan_folder

    spark = SparkSession.builder.appName("pellucid").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    analysis = Analysis.make(scan_folder(spark, given.folder), given.folder)
    for name, value in analysis.health.first().asDict().items():
        print(f"{name}: {value}")
    if given.report:
        export(given.report, analysis)
    return 0


if __name__ == "__main__":
    sys.exit(main())
