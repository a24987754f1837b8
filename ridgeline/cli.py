"""Command line: list registered queries, run one, or run several with their parameters from a config file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ridgeline.sources import writers


def main(arguments: list[str] | None = None) -> None:
    from ridgeline.plans.queries import QUERIES

    parser = argparse.ArgumentParser(prog="ridgeline", description=__doc__)
    parser.add_argument("query", nargs="?", help="name of a query; without one, all names are listed")
    parser.add_argument("folder", nargs="?", help="folder with the input tables")
    parser.add_argument("--out", help="folder for the result; without one, rows are shown")
    parser.add_argument("--format", choices=["parquet", "json", "csv"], default="parquet")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    given = parser.parse_args(arguments)
    if not given.query:
        print("\n".join(QUERIES))
        return
    if given.query not in QUERIES or not given.folder:
        parser.error("name a known query and a folder")
    spark = SparkSession.builder.appName(f"ridgeline {given.query}").getOrCreate()
    found = QUERIES[given.query](spark, given.folder)
    if not given.out:
        found.show(given.rows, truncate=80)
    elif given.format == "csv":
        writers.csv_report(found, given.out)
    else:
        found.write.mode("overwrite").format(given.format).save(given.out)


if __name__ == "__main__":
    main()
