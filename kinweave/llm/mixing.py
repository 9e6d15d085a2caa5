"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame expressions only.

1. Targets. The mix has `share` times all words. Sources share it by weight; a source's target stops
   at `most` times its words and the excess goes to the others by weight. The level at which that
   comes to rest is found directly: sources in order of words per weight fill up one after another.
2. Blocks. The targets are dealt out in blocks of `block_words` words by the highest quotients
   target / (2k + 1): first to sources, then each source's blocks to its shards by their words.
   A shard is a hashed part of a source of about `shard_docs` documents, so that a source holding a
   third of all rows is dealt with by many tasks.
3. Selection. A shard's documents are put in an order seeded by `seed`; a quota of f shard lengths
   takes every word floor(f) times and the rest from the front of that order.

A null text has 0 words and is taken 0 times. A null source is a source of its own, the last one.
Repeated rows (equal ids) are rows of their own; those with equal ids and sizes come in order of their
texts' hashes, and only rows with equal texts are in any order. An empty table gives an empty one. A very
long text may be cut like any other; its shard is as large as it is. Nothing depends on the order or
partitioning of the rows, so reruns agree. Columns of the input that are named like an output are
replaced, others keep their values whatever their names. There are a few rows for each source and shard;
the sources, thousands at most, are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import Columns, cut_table, stored, words

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Finest parts of a source that are counted, at least; shards are made of whole ones.
PARTS = 4096
OUTPUTS = ["size", "source_size", "target", "taken"]


def seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _spread(doc_id: Column, seed: int) -> Column:
    """A number below 2^32 that doc_ids are dealt to parts by."""
    return F.conv(F.substring(seeded(doc_id, seed), 1, 8), 16, 10).cast("bigint")


def parts_for(documents: int, shard_docs: int) -> int:
    """So many parts, a power of two, that a source with all of the documents still has a part for each shard."""
    return max(PARTS, 1 << max(0, -(-documents // shard_docs) - 1).bit_length())


def targets(sources: DataFrame, share: float, most: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with a column target: min(most * source_size, level * weight)."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    everything = W.partitionBy()
    s = sources.withColumn("weight", weight.cast("bigint"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("all", F.sum("source_size").over(everything))
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    # The level if all sources before this one are full and this one and the rest are not.
    s = s.withColumn("level", (F.col("all") * share - before) / after)
    rests = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    level = rests["level"]
    full = level.isNull() | (level * F.col("weight") > F.col("cap"))
    return s.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight"))).drop("cap", "all", "level", "weight")


def apportion(rows: DataFrame, group: list[str], key: list[Column], votes: str, seats: Column, into: str) -> DataFrame:
    """Sainte-Laguë: within each group, `seats` seats to rows by the highest quotients votes/(2k+1).

    Rounding votes/divisor at the group's mean divisor already places all but a few seats. A row's
    seats at the true divisor differ by at most its share of (missing + rows) plus one, so only the
    quotients in that range are laid out and ranked: a few for each row, however many seats there are.
    """
    whole = W.partitionBy(*group)
    r = rows.withColumn("_seats", seats).withColumn("_votes", F.sum(F.col(votes).cast("double")).over(whole))
    share = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(F.lit(0.0))
    r = r.withColumn("_share", share).withColumn("_first", F.floor(F.col("_share") * F.col("_seats") + 0.5))
    r = r.withColumn("_missing", F.col("_seats") - F.sum("_first").over(whole)).withColumn("_rows", F.count(F.lit(1)).over(whole))
    reach = F.ceil(F.col("_share") * (F.abs("_missing") + F.col("_rows"))) + 1
    r = r.withColumn("_low", F.greatest(F.lit(0), F.col("_first") - reach)).withColumn("_high", F.col("_first") + reach)
    r = r.withColumn("_open", F.col("_seats") - F.sum("_low").over(whole))
    # Written down, as it is used twice, and plans would double with each apportionment.
    r = cut_table(r.withColumn("_id", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])))
    # Quotients _low … _high - 1 compete for the seats that are still open.
    quotients = r.where(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), *key, "_k"))
    won = quotients.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_open")).groupBy("_id").agg(F.count(F.lit(1)).alias("_won"))
    placed = r.join(won.withColumnRenamed("_id", "_won_id"), F.col("_id").eqNullSafe(F.col("_won_id")), "left")
    got = F.when(F.col(votes) > 0, F.col("_low")).otherwise(F.lit(0)) + F.coalesce("_won", F.lit(0))
    return placed.withColumn(into, got.cast("bigint")).select(*rows.columns, into)


def mix(
    docs: DataFrame, share: float = 1.5, most: int = 2, block_words: int = 16, shard_docs: int = 4096,
    seed: int = 1, weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """The rows of docs (columns doc_id, text, source) without text, with size, source_size, target and taken.

    Words are counted in one pass over the texts; what is decided on, all columns but text, is kept in the
    shared folder.
    """
    given = Columns(docs, [*OUTPUTS, "text"])
    text = F.col(given["text"])
    facts = {"doc_id": F.col(given["doc_id"]), "source": F.col(given["source"]), "size": F.size(words(text)).cast("bigint"), "tie": F.xxhash64(text)}
    sized = cut_table(given.rows.withColumns(facts | {"spread": _spread(F.col(given["doc_id"]), seed)}).drop(given["text"]))
    finest = parts_for(sized.count(), shard_docs)
    sized = sized.withColumn("part", F.pmod("spread", F.lit(finest)))
    parts = cut_table(sized.groupBy("source", "part").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    shards = F.least(F.lit(finest), F.greatest(F.lit(1), F.ceil(F.col("n") / shard_docs)))
    sources = targets(sources.select("source", "source_size", shards.alias("shards")), share, most, weights)
    blocks = F.round(F.sum("target").over(W.partitionBy()) / block_words)
    sources = cut_table(apportion(sources, [], [F.col("source").isNull(), F.col("source")], "target", blocks, "blocks"))

    def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        right = table.withColumnsRenamed({"source": "_source", "shards": "_shards"})
        return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_shard", F.pmod("part", "_shards"))

    by_shard = with_source(parts.drop("n"), sources).groupBy("source", "_shard").agg(
        F.sum("words").alias("shard_words"), F.max("blocks").alias("blocks"), *[F.max(c).alias(c) for c in ("source_size", "target")]
    )
    quotas = apportion(by_shard, ["source"], [F.col("source").isNull(), F.col("source"), F.col("_shard")], "shard_words", F.col("blocks"), "quota")
    quota = F.least(F.col("quota") * block_words, F.col("shard_words") * most).alias("_quota")
    quotas = quotas.select(F.col("source").alias("_source"), F.col("_shard").alias("_in"), F.col("shard_words").alias("_words"), quota, "source_size", "target")

    placed = with_source(sized, sources.select("source", "shards"))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_in")))
    order = W.partitionBy("source", "_shard").orderBy(seeded(F.col("doc_id"), seed), "doc_id", "size", "tie")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    times = F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_quota") - times * F.col("_words") - before))
    taken = placed.withColumn("taken", (F.col("size") * times + rest).cast("bigint"))
    return given.back(taken, {c: F.col(c) for c in OUTPUTS})


def resample(docs: DataFrame, number=stored, **options) -> DataFrame:
    """The mix as rows of docs: each row as often as it is taken whole, and, where a quota ends inside
    a text, once more with that text's leading words. Columns stay as they came. number: how rows are told
    apart, `common.stored` or, for files as they were read, `common.placed`. Texts move once, to meet what
    was decided about their rows."""
    given = Columns(docs)
    numbered = number(given.rows)
    asked = [F.col(given[c]).alias(c) for c in ("doc_id", "text", "source")]
    m = mix(numbered.select("row", *asked), **options).where("taken > 0")
    whole, left = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("bigint"), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    rows = numbered.join(m.select("row", copies.alias("copies")), "row").withColumn("cut", F.explode("copies"))
    text = F.col(given["text"])
    front = F.array_join(F.slice(words(text), F.lit(1), F.col("cut").cast("int")), " ")
    return given.back(rows, replaced={"text": F.when(F.col("cut") > 0, front).otherwise(text)})
