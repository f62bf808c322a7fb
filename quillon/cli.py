"""Command line: `index` builds from a CIFF file, `search` prints or writes a run."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillon import api
from quillon.sources.runs import TAG, write_run


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build an index from a CIFF file")
    index.add_argument("-c", "--ciff-file", required=True)
    index.add_argument("-o", "--output", required=True)
    index.add_argument("-b", "--bsize", type=int, required=True)
    index.add_argument("-r", "--compress-range", action="store_true")
    search = commands.add_parser("search", help="answer the queries of a file")
    search.add_argument("-i", "--index", required=True)
    search.add_argument("-q", "--queries", required=True)
    search.add_argument("-k", "--k", type=int, required=True)
    search.add_argument("-a", "--alpha", type=float, default=1.0)
    search.add_argument("-b", "--beta", type=float, default=1.0)
    search.add_argument("-o", "--output", help="folder for the run; without it the run is printed")
    search.add_argument("-t", "--tag", default=TAG)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    try:
        if args.command == "index":
            made = api.build_from_ciff(spark, args.ciff_file, args.output, args.bsize, args.compress_range)
            print(made.statistics(), file=sys.stderr)
        elif args.output:
            found = api.search_file(spark, args.index, args.queries, args.k, args.alpha, args.beta)
            write_run(found.drop("q_ord"), args.output, found.select("qid", "q_ord").distinct(), args.tag)
        else:
            sys.stdout.write(api.search_run(spark, args.index, args.queries, args.k, args.alpha, args.beta, args.tag))
    except Exception as e:  # noqa: BLE001  the command's failure is its exit code
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
