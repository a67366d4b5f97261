"""Run one model from a ticket table to a CSV result.

    python -m harborline pop --tickets extract.csv --out pop_result --set year=2019

Under spark-submit the session is the cluster's own.
"""

from __future__ import annotations

import argparse
import ast
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from harborline.plans.models import MODELS
from harborline.sources.results import write_result
from harborline.sources.tickets import read_tickets


def run(
    spark: SparkSession,
    model: str,
    tickets: str | Sequence[str],
    out: str,
    format: str = "csv",
    options: Mapping | None = None,
    mode: str = "errorifexists",
    order: Sequence[str] | None = None,
    row_names: bool = False,
    **read_options,
) -> None:
    frame = read_tickets(spark, tickets, format, **read_options)
    result = MODELS[model](frame, **(options or {}))
    write_result(result, out, mode, order=order, row_names=row_names)


def _setting(text: str) -> tuple[str, object]:
    name, _, value = text.partition("=")
    try:
        return name, ast.literal_eval(value)
    except (SyntaxError, ValueError):
        return name, value


def main() -> None:
    parser = argparse.ArgumentParser(prog="harborline", description=__doc__.splitlines()[0])
    parser.add_argument("model", choices=sorted(MODELS))
    parser.add_argument("--tickets", required=True, nargs="+", help="paths of the ticket table")
    parser.add_argument("--out", required=True, help="directory of the result")
    parser.add_argument("--format", default="csv", help="csv, or a columnar format")
    parser.add_argument("--date-format", default=None, help="pattern of dates in CSV")
    parser.add_argument("--set", type=_setting, action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--order", nargs="+", help="columns that the result is sorted by")
    parser.add_argument("--row-names", action="store_true", help="number the rows in a first column")
    args = parser.parse_args()
    run(
        SparkSession.builder.appName("harborline").getOrCreate(),
        args.model,
        args.tickets,
        args.out,
        args.format,
        dict(args.set),
        "overwrite" if args.overwrite else "errorifexists",
        order=args.order,
        row_names=args.row_names,
        date_format=args.date_format,
    )


if __name__ == "__main__":
    main()
