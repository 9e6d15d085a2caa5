"""Text output in the line layout of each question. An existing folder is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: question: columns before the tab, columns after it (none: no tab).
LAYOUTS = {
    "a": (["hobby"], ["n"]),
    "b": (["id", "nick", "job", "n"], []),
    "c": (["nick"], ["job"]),
    "d": (["id", "nick", "n"], []),
    "e": (["id"], ["total_actions", "distinct_pages"]),
    "f": (["id", "nick", "n"], []),
    "g": (["id", "nick"], []),
    "h": (["id", "nick"], []),
}


def lines(result: DataFrame, question: str) -> DataFrame:
    """One column `value`; a null field is an empty string."""
    sides = [F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in side]) for side in LAYOUTS[question] if side]
    return result.select(F.concat_ws("\t", *sides).alias("value"))


def write_text(result: DataFrame, question: str, path: str) -> None:
    lines(result, question).write.mode("errorifexists").text(path)
