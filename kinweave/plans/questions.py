"""Each question aggregates before it joins, so a join sees at most one row per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import equals_ignoring_case, trim_controls
from kinweave.operators import checked_join, count_by, global_average, latest_by_actor, left_with_zero, one_way_followers, rank_top
from kinweave.operators.graph import region_edges
from kinweave.operators.joining import hinted

#: 90 days.
WINDOW_HOURS = 2160


def _people(pages: DataFrame) -> DataFrame:
    return pages.where("nick_name is not null").select("id", F.col("nick_name").alias("nick"))


def hobby_frequency(page_rows: DataFrame, strict: bool = False) -> DataFrame:
    """(hobby, n): how many people name each hobby; blank hobbies are left out. Case matters.
    `strict` groups the hobby as it stands, for rows of the strict reader."""
    hobby = F.col("favorite_hobby") if strict else trim_controls(F.col("favorite_hobby"))
    rows = page_rows.select(hobby.alias("hobby")).where("hobby is not null")
    return count_by(rows if strict else rows.where("hobby <> ''"), "hobby", "hobby")


def top_pages(pages: DataFrame, activity: DataFrame, k: int = 10) -> DataFrame:
    """(id, nick, job, n): the k most visited pages, most first, ties to the smaller id.
    The k rows are chosen before the join; an unknown id stays with blank nick and job."""
    top = rank_top(count_by(activity, "what_page"), k)
    known = pages.where("job_title is not null").select("id", F.col("nick_name").alias("nick"), F.col("job_title").alias("job"))
    # k rows are the only ones that can travel whole; people are streamed past them.
    found = known.join(F.broadcast(top.select("id")), "id", "left_semi")
    return (
        top.join(found, "id", "left")
        .select("id", F.coalesce("nick", F.lit("")).alias("nick"), F.coalesce("job", F.lit("")).alias("job"), "n")
        .orderBy(F.desc("n"), F.asc("id"))
    )


def access_counts_with_people(pages: DataFrame, activity: DataFrame) -> DataFrame:
    """(id, nick, job, n): visit counts and people side by side, either side may be missing."""
    known = pages.select("id", F.col("nick_name").alias("nick"), F.col("job_title").alias("job"))
    both = count_by(activity, "what_page").join(known, "id", "full")
    return both.select(
        "id",
        F.coalesce("nick", F.lit("")).alias("nick"),
        F.coalesce("job", F.lit("")).alias("job"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def users_by_hobby(page_rows: DataFrame, hobby: str = "") -> DataFrame:
    """(nick, job) of everyone with the hobby, case and spaces around it ignored; '' finds blank hobbies. No shuffle."""
    named = page_rows.where(equals_ignoring_case(trim_controls(F.col("favorite_hobby")), trim_controls(F.lit(hobby))))
    return named.select(F.col("nick_name").alias("nick"), F.col("job_title").alias("job"))


def follower_totals(pages: DataFrame, follows: DataFrame, strategy: str | None = None) -> DataFrame:
    """(id, nick, n): followers of each person, zero when none. Repeated and self follows count."""
    totals = left_with_zero(_people(pages), count_by(follows, "id2"), "id", ["n"], strategy)
    return totals.select("id", "nick", "n")


def activity_totals(pages: DataFrame, activity: DataFrame, strategy: str | None = None) -> DataFrame:
    """(id, total_actions, distinct_pages) of each person with a positive id, zeros when inactive."""
    valid = activity.where("by_who > 0 and what_page > 0")
    # Two levels of grouping keep a hot person's rows combined per (person, page) before they meet.
    pairs = valid.groupBy(F.col("by_who").alias("id"), "what_page").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("id").agg(F.sum("n").alias("total_actions"), F.count(F.lit(1)).alias("distinct_pages"))
    owners = pages.where("id > 0").select("id").distinct()
    joined = left_with_zero(owners, totals, "id", ["total_actions", "distinct_pages"], strategy)
    return joined.select("id", "total_actions", "distinct_pages")


def above_average(
    pages: DataFrame, follows: DataFrame, average: str = "people", lines: DataFrame | None = None, strategy: str | None = None
) -> DataFrame:
    """(id, nick, n) of people with strictly more followers than average.

    'people' averages the counts of known people. 'rows' divides all follow rows by all lines of the
    people file; `lines` is a one-row frame (n), by default the rows of `pages`.
    """
    totals = follower_totals(pages, follows, strategy)
    if average == "people":
        mean = global_average(totals)
    elif average == "rows":
        all_lines = (pages.agg(F.count(F.lit(1)).alias("n")) if lines is None else lines).select(F.col("n").alias("n_lines"))
        all_follows = follows.where("id2 is not null").agg(F.count(F.lit(1)).alias("n_follows"))
        mean = all_follows.select(
            (F.col("n_follows") / F.nullif(all_lines.scalar(), F.lit(0))).alias("average")
        ).select(F.coalesce("average", F.lit(0.0)).alias("average"))
    else:
        raise ValueError(f"unknown average {average!r}; 'people' or 'rows'")
    return totals.where(F.col("n") > mean.scalar())


def outdated(pages: DataFrame, activity: DataFrame, window_hours: int = WINDOW_HOURS, strategy: str | None = None) -> DataFrame:
    """(id, nick) of people without an action in the window that ends at the latest action in the data.
    Someone who never acted is outdated; an action exactly at the window's start is recent enough."""
    by_actor = latest_by_actor(activity)
    # Both columns are read on either way, or the two ways would not share the shuffle.
    start = by_actor.agg((F.coalesce(F.max(F.struct("t", "id"))["t"], F.lit(0)) - window_hours).alias("t0"))
    joined = checked_join(_people(pages), by_actor.where("id > 0"), "id", "left", strategy)
    return joined.where(F.col("t").isNull() | (F.col("t") < start.scalar())).select("id", "nick")


def one_way_in_region(pages: DataFrame, follows: DataFrame, plan: str = "pair", strategy: str | None = None) -> DataFrame:
    """(id, nick) of people who follow someone of their own region and are not followed back."""
    ids = one_way_followers(region_edges(pages, follows, strategy), plan)
    return _people(pages).join(hinted(ids, strategy), "id", "left_semi")
