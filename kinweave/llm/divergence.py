"""How far the sources of a language differ in their words: a relational audit in integers.

1. Regular-expression matches of every text are exploded into terms and counted for each group, a pair of
   language and source, with the number of documents that hold a term beside it.
2. A language keeps the terms of at least `min_docs` of its documents. Every group of the language is crossed
   with them, so that terms it lacks stand there with zero, in one shuffle by language and term.
3. A self-join on language and term pairs the groups, values are summed for each pair, and windows rank the
   pairs of a group, and the terms that it has more of than its language.

A group's smoothed share of a term is p = 1 + floor(scale * (count + 1) / (N + V)), with N its counts of all
kept terms and V their number; against a share q the value is floor((p - q)² / q). All of it is exact.

Null texts, languages and sources are read as ''. A group without terms takes part with zero counts; where a
language keeps no term, its pairs have the value 0. An empty table gives an empty one, a language with a single
source no pairs. Repeated rows are documents of their own. Ties of the value go to the smaller item by its
UTF-8 bytes. A very long text's terms are held as one array. Other columns aren't read. Whatever a source's or
language's part of the rows: terms are summed before they move, and the vocabulary is dealt to `salts` places of
a language to meet its groups. The result itself has a row for every two sources of a language.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import Columns, cut_table

#: Fixed value: what a term consists of, for Java's regular expressions.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GROUP = ["lang", "source"]


def _lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; for ASCII only, lower is the same and quicker."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def counted(rows: DataFrame) -> DataFrame:
    """(l, g, term, n, docs) of rows (l, g, text): occurrences, and documents that have the term. A document's terms are
    sorted, so of a run of equal ones only its two ends are counted: where it ends, less where it starts."""
    found = rows.select("l", "g", F.sort_array(F.regexp_extract_all(_lowered(F.col("text")), F.lit(TERM), F.lit(0))).alias("terms"))
    # Before an inner explode the optimizer would filter by the array's size, and work out every array twice.
    each = found.select("l", "g", "terms", F.posexplode_outer("terms").alias("at", "term")).where("term is not null")
    other = lambda step: F.coalesce(F.get("terms", F.col("at") + step) != F.col("term"), F.lit(True))
    ends = each.select("l", "g", "term", "at", other(-1).alias("starts"), other(1).alias("ends")).where("starts or ends")
    of_end, of_start = F.expr("if(ends, at + 1L, 0L)"), F.expr("if(starts, cast(at as bigint), 0L)")
    return ends.groupBy("l", "g", "term").agg(F.sum(of_end - of_start).alias("n"), F.sum(F.expr("if(starts, 1L, 0L)")).alias("docs"))


def _share(n: str, total: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + kept)), in decimals where the product leaves 64 bits."""
    product = F.expr(f"if({n} < {(1 << 62) // scale}, {scale}L * least({n} + 1, {(1 << 62) // scale}L) div ({total} + kept), cast({scale} * cast({n} + 1 as decimal(20, 0)) as decimal(38, 0)) div ({total} + kept))")
    return (1 + product).cast("bigint")


def _value(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """With a limit, each task passes on no more than that many rows of a group."""
    place = F.row_number().over(W.partitionBy("g").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", place)
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200, scale: int = 1_000_000_000, salts: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source): part `pair` has the other sources of the
    language, part `term` the terms that a source has more of than its language, at most `top_terms`."""
    given = Columns(docs)
    rows = given.rows.select(*[F.coalesce(F.col(given[c]).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    # Numbers stand for groups, g, and languages, l, in what is counted and joined. This pass reads no texts.
    numbers = cut_table(rows.select(*GROUP).distinct().withColumn("g", F.monotonically_increasing_id()))
    numbers = numbers.withColumn("l", F.min("g").over(W.partitionBy("lang")))
    of_term = W.partitionBy("l", "term")
    sums = counted(rows.join(F.broadcast(numbers), GROUP).select("l", "g", "text"))
    sums = sums.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "least": F.min("g").over(of_term)})
    kept = cut_table(sums.where(F.col("lang_docs") >= min_docs).select("l", "g", "term", "n", "lang_n", (F.col("g") == F.col("least")).alias("is_first")))
    vocabulary = kept.where("is_first").select("l", "term", "lang_n")

    # A row for each group, with the sums that its shares need.
    languages = vocabulary.groupBy("l").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("g").agg(F.sum("n").alias("total"))
    groups = numbers.join(totals, "g", "left").join(languages, "l", "left")
    groups = cut_table(groups.na.fill(0, ["total", "kept", "lang_total"]))

    salted = groups.select("l", "g", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    crossed = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["l", "salt"])
    zeros = crossed.select("l", "term", "g", F.lit(0).cast("bigint").alias("n"))
    # The sums need no shuffle of their own, nor does the self-join: rows already lie by language and term.
    cells = zeros.union(kept.select("l", "term", "g", "n")).repartition("l", "term").groupBy("l", "term", "g").agg(F.sum("n").alias("n"))
    shares = cells.join(groups.select("g", "total", "kept"), "g").select("l", "term", "g", _share("n", "total", scale).alias("p"))
    other = shares.select("l", "term", F.col("g").alias("h"), F.col("p").alias("q"))
    met = shares.join(other, ["l", "term"]).where("g <> h")
    sums = met.groupBy("g", "h").agg(F.sum(_value("p", "q")).alias("value"))
    all_pairs = groups.select(*GROUP, "g", "l").join(groups.select("l", F.col("g").alias("h"), F.col("source").alias("item")), "l").where("g <> h")
    pairs = all_pairs.join(sums, ["g", "h"], "left").na.fill(0, ["value"])

    own = kept.where("n > 0").join(groups.drop("l"), "g").select(*GROUP, "g", F.col("term").alias("item"), _share("n", "total", scale).alias("p"), _share("lang_n", "lang_total", scale).alias("q"))
    terms = own.where("p > q").select(*GROUP, "g", "item", _value("p", "q").alias("value"))
    return _ranked(pairs, "pair").union(_ranked(terms, "term", top_terms))
