"""Command line: python -m tidewell probe|preflight|sets|extract|verify PATH [TARGET]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidewell import api


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all is well, 1 if files are at fault, 2 if the command cannot be carried out."""
    parser = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("probe", "a row for each file"), ("preflight", "files that cannot be extracted"), ("sets", "files put together to recordings"), ("verify", "files of an extracted folder that changed")):
        one = commands.add_parser(name, help=words)
        one.add_argument("path")
        if name == "sets":
            one.add_argument("--extension")
    one = commands.add_parser("extract", help="tables and a manifest of all files")
    one.add_argument("path")
    one.add_argument("target")
    one.add_argument("--motion", choices=("raw", "legacy"), default="raw", help="how motion samples are packed")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tidewell").getOrCreate()
    if given.command == "extract":
        try:
            made = api.extract(spark, given.path, given.target, raw_motion=given.motion == "raw")
        except FileExistsError as e:
            print(f"exists already: {e}", file=sys.stderr)
            return 2
        print(json.dumps(made))
        return 0
    found = api.input_sets(spark, given.path, given.extension) if given.command == "sets" else getattr(api, given.command)(spark, given.path)
    n = 0
    for n, row in enumerate(found.toLocalIterator(), 1):
        print(json.dumps(row.asDict(recursive=True), default=str))
    return int(given.command in ("preflight", "verify") and n > 0)


if __name__ == "__main__":
    sys.exit(main())
