"""Runs a registered query from the command line: spark-submit fieldloom/cli.py QUERY TABLES [--out FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import registry


def apply(df: DataFrame, *steps) -> DataFrame:
    """A chain of operators, each a function of a table."""
    for step in steps:
        df = df.transform(step)
    return df


def main(args: list[str] | None = None) -> int:
    """Runs one query over a folder of tables; writes parquet, or shows the first rows."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("query", choices=sorted(registry.queries()))
    parser.add_argument("tables")
    parser.add_argument("--out")
    given = parser.parse_args(args)
    df = registry.queries()[given.query](SparkSession.builder.getOrCreate(), given.tables.rstrip("/"))
    if given.out:
        df.write.mode("overwrite").parquet(given.out)
    else:
        df.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
