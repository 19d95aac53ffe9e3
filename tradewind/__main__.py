"""Command line, also for spark-submit.

clean writes raw CSV files as cleaned tables, load stores them in the four models, run writes the
whole result of one analysis as a table.
"""

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.storage import table_scope
from .plans.analyses import ANALYSES, KEYWORDS, analyse
from .plans.load import MODELS, clean_dataset, load_models
from .plans.models import PARTS
from .sources.tables import current


class _Stored(dict):
    """Tables of a model, opened when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self._spark, self._folder = spark, folder

    def __missing__(self, name: str):
        self[name] = self._spark.read.parquet(f"{self._folder}/{name}")
        return self[name]


def _number(text: str) -> int | None:
    return None if text == "all" else int(text)


def _parts(text: str) -> int:
    if int(text) < 1:
        raise ValueError(text)
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tradewind", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    clean = commands.add_parser("clean", help="raw CSV files to cleaned tables, with an audit report")
    clean.add_argument("raw_folder")
    clean.add_argument("clean_folder")
    clean.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks")
    load = commands.add_parser("load", help="cleaned tables to the models, with an audit report")
    load.add_argument("clean_folder")
    load.add_argument("models_folder")
    load.add_argument("--forms", nargs="+", choices=MODELS, default=list(MODELS))
    load.add_argument("--months", nargs=2, metavar=("FIRST", "LAST"), help="months to store events by, as 2019-10; others lie together")
    load.add_argument("--parts", type=_parts, default=PARTS, help="rows that a user's document is cut into, 1 for a single one")
    run = commands.add_parser("run", help="one analysis on one model")
    run.add_argument("models_folder")
    run.add_argument("form", choices=MODELS)
    run.add_argument("analysis", choices=ANALYSES)
    run.add_argument("out_folder", help="the result goes here as a table")
    run.add_argument("keywords", nargs="*", help="of q3")
    run.add_argument("--k", type=_number, help="rows of q1a and q1b, or all")
    run.add_argument("--limit", type=_number, help="rows of q2, or all")
    run.add_argument("--exclusion", choices=("after_rank", "before_rank"), help="of bought products in q2")
    run.add_argument("--match", choices=("token", "segment", "contains"), help="of q3")
    run.add_argument("--n", type=_number, help="products per keyword of q3, or all")
    return top


OPTIONS = {"q1a": ["k"], "q1b": ["k"], "q2": ["limit", "exclusion"], "q3": ["match", "n"]}


def _report(df: DataFrame) -> None:
    df.show(df.count(), truncate=False)  # an audit has a row for each table or key


def main(arguments: list[str]) -> int:
    given = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("tradewind").getOrCreate()
    if given.command == "clean":
        _report(clean_dataset(spark, given.raw_folder, given.clean_folder, given.multi_line))
    elif given.command == "load":
        _report(load_models(spark, given.clean_folder, given.models_folder, tuple(given.forms), given.parts, given.months and tuple(given.months)))
    else:
        passed = {name for name in ("k", "limit", "exclusion", "match", "n") if f"--{name}" in (a.split("=")[0] for a in arguments)}
        if surplus := passed - set(OPTIONS[given.analysis]):
            parser().error(f"{given.analysis} has no option {', '.join(sorted(surplus))}")
        options = {name: getattr(given, name) for name in passed}
        with table_scope(spark):
            tables = _Stored(spark, f"{current(spark, given.models_folder)}/{given.form}")
            result = analyse(given.analysis, given.form, tables, given.keywords or KEYWORDS, **options)
            result.write.mode("overwrite").parquet(given.out_folder)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
