"""Command line: runs a query of the catalogue and writes or shows its rows."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .catalogue import QUERIES


@dataclass(frozen=True)
class Options:
    query: str
    data: str
    out: str | None = None
    show: int = 20


def parse(args: list[str] | None = None) -> Options:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("data", help="folder of the tables")
    parser.add_argument("--out", help="folder to write Parquet to")
    parser.add_argument("--show", type=int, default=20, help="rows to show without --out")
    return Options(**vars(parser.parse_args(args)))


def main(args: list[str] | None = None) -> None:
    options = parse(args)
    found = QUERIES[options.query](SparkSession.builder.getOrCreate(), options.data)
    if options.out:
        found.write.parquet(options.out)
    else:
        found.show(options.show, truncate=80)


if __name__ == "__main__":
    main()
