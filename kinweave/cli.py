"""python -m kinweave.cli QUESTION --pages … [--follows …] [--activity …] --out …"""

from __future__ import annotations

import argparse
import sys
from typing import NoReturn

from pyspark.sql import DataFrame, SparkSession

from kinweave import plans, sinks, sources, timing

NEEDS = {"a": "", "b": "activity", "c": "", "d": "follows", "e": "activity", "f": "follows", "g": "activity", "h": "follows"}


class Parser(argparse.ArgumentParser):
    """Wrong arguments end the command with status 1."""

    def error(self, message: str) -> NoReturn:
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="kinweave", description="Answer one of the questions a to h over text files.")
    p.add_argument("question", choices=sorted(NEEDS))
    p.add_argument("--pages", required=True)
    p.add_argument("--follows")
    p.add_argument("--activity")
    p.add_argument("--out", required=True)
    p.add_argument("--hobby", default="", help="c: the hobby to look for")
    p.add_argument("--k", type=int, default=10, help="b: how many pages")
    p.add_argument("--window-hours", type=int, default=2160, help="g: length of the window")
    p.add_argument("--strict", action="store_true", help="a: five fields exactly, hobby untrimmed")
    p.add_argument("--average", choices=["people", "rows"], default="people", help="f: which average")
    p.add_argument("--plan", choices=["pair", "anti"], default="pair", help="h: which plan")
    p.add_argument("--strategy", choices=["broadcast", "merge", "shuffle_hash"], help="d to h: join form")
    return p


def answer(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    q = a.question
    if q == "a":
        return plans.hobby_frequency(sources.read_page_rows(spark, a.pages, a.strict), a.strict)
    if q == "c":
        return plans.users_by_hobby(sources.read_page_rows(spark, a.pages), a.hobby)
    pages = sources.read_pages(spark, a.pages)
    if q == "b":
        return plans.top_pages(pages, sources.read_activity(spark, a.activity), a.k)
    if q == "d":
        return plans.follower_totals(pages, sources.read_follows(spark, a.follows), a.strategy)
    if q == "e":
        return plans.activity_totals(pages, sources.read_activity(spark, a.activity), a.strategy)
    if q == "f":
        counted = sources.count_lines(spark, a.pages)
        return plans.above_average(pages, sources.read_follows(spark, a.follows), a.average, counted, a.strategy)
    if q == "g":
        return plans.outdated(pages, sources.read_activity(spark, a.activity), a.window_hours, a.strategy)
    return plans.one_way_in_region(pages, sources.read_follows(spark, a.follows), a.plan, a.strategy)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if NEEDS[a.question] and not getattr(a, NEEDS[a.question]):
        p.error(f"question {a.question} needs --{NEEDS[a.question]}")
    label = f"question_{a.question}"
    with timing.timed(label):
        spark = SparkSession.builder.appName(f"kinweave-{a.question}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        result = answer(spark, a)
        with timing.timed(label, "job"):
            sinks.write_text(result, a.question, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
