"""Quality rules by distribution divergence: how far a text's characters and common words are from
those of known languages, as Jensen-Shannon distances. All of it is DataFrame expressions over one
row at a time: one scan, no shuffle, no Python.

Rules, for each row:
- base: fewer than `min_words` words, or over `max_repeat_percent` % of the words stand in a 5-word
  window that occurs twice or more in the text: the row fails.
- characters: with at least `min_chars` characters, the histogram over seven character classes is
  compared with each language's; the row fails if even the nearest is further than `max_char_distance`.
- words: with at least `min_common_words` words, the histogram over the languages' common words and
  "any other word" is compared with each language's; the row fails if the nearest is further than
  `max_word_distance`.
- both: with both lengths reached, the row also fails if the two distances are each further than the
  nearer pair of limits `joint_char_distance` and `joint_word_distance`; either alone is too weak there.

A null text counts as an empty one (0 words: base fails). Repeated rows are judged alike, each by
itself. An empty table gives an empty one. A very long text is judged as any other, in memory of some
ten times its size. Other columns pass through unread, whatever their names, except that a column named
like an output is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import SPACE, Columns, words

# Fixed values, set by hand as round numbers and not fitted to any corpus: shares of character classes in
# prose of each language, by class: lower-case ASCII,
# white space, upper-case ASCII, digits, symbols, non-ASCII, other ASCII.
CLASSES = ("lower", "space", "upper", "digit", "symbol", "wide", "other")
CHARACTERS = {
    "en": (0.780, 0.170, 0.025, 0.003, 0.0005, 0.0015, 0.020),
    "de": (0.775, 0.140, 0.045, 0.003, 0.0005, 0.0165, 0.020),
    "fr": (0.745, 0.165, 0.022, 0.003, 0.0005, 0.0395, 0.025),
    "es": (0.765, 0.165, 0.022, 0.003, 0.0005, 0.0245, 0.020),
}
# Fixed values, set by hand likewise: common words of each language with their shares of running words, in percent.
COMMON = {
    "en": {"the": 6.0, "of": 3.2, "and": 2.8, "to": 2.5, "a": 2.2, "in": 2.0, "that": 1.1, "is": 1.1, "was": 0.9, "for": 0.9, "it": 0.9, "with": 0.7, "on": 0.7, "as": 0.7},
    "de": {"der": 3.2, "die": 3.1, "und": 2.8, "in": 1.8, "den": 1.3, "von": 1.1, "zu": 1.1, "das": 1.1, "mit": 0.9, "ist": 0.9, "des": 0.8, "auf": 0.8, "im": 0.8, "ein": 0.7},
    "fr": {"de": 5.0, "la": 3.0, "le": 2.6, "et": 2.4, "les": 2.2, "des": 1.8, "en": 1.5, "un": 1.2, "du": 1.2, "une": 1.1, "que": 1.0, "est": 1.0, "qui": 0.9, "pas": 0.6},
    "es": {"de": 5.8, "la": 3.6, "que": 3.0, "el": 2.9, "en": 2.6, "y": 2.4, "los": 1.7, "del": 1.2, "se": 1.2, "las": 1.1, "un": 1.0, "por": 1.0, "con": 0.9, "una": 0.8},
}
# Fixed value: characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"

VOCABULARY = list(dict.fromkeys(w for shares in COMMON.values() for w in shares))
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]


def js_distance(counts: list[Column], total: Column, shares: list[float]) -> Column:
    """The root of the Jensen-Shannon divergence (base 2, so 0 to 1) of counts/total from fixed shares."""

    def term(count: Column, q: float) -> Column:
        p = count / total
        m = (p + F.lit(q)) / 2
        left = F.when(count > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
        return left + (F.lit(q) * F.log2(F.lit(q) / m) if q > 0 else F.lit(0.0))

    divergence = reduce(lambda a, b: a + b, [term(c, q) for c, q in zip(counts, shares, strict=True)]) / 2
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def nearest(counts: list[Column], total: Column, references: list[list[float]]) -> Column:
    distances = [js_distance(counts, total, r) for r in references]
    return F.when(total > 0, F.least(*distances))


def _word_reference(language: str) -> list[float]:
    shares = [COMMON[language].get(w, 0.0) / 100 for w in VOCABULARY]
    return [*shares, 1 - math.fsum(shares)]


def assess(
    docs: DataFrame,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_chars: int = 150,
    max_char_distance: float = 0.30,
    min_common_words: int = 30,
    max_word_distance: float = 0.70,
    joint_char_distance: float = 0.17,
    joint_word_distance: float = 0.25,
) -> DataFrame:
    """The rows of docs (which need a column text) with the columns of OUTPUTS added."""
    given = Columns(docs, OUTPUTS)
    d = given.rows.withColumn("_t", F.coalesce(given["text"], F.lit("")))
    d = d.withColumn("_w", words(F.col("_t")))
    # Strip one class of characters after another; each count is the difference of two lengths.
    for at, pattern in enumerate(("[a-z]+", SPACE + "+", "[A-Z]+", "[0-9]+", SYMBOLS + "+", r"[^\x00-\x7F]+")):
        d = d.withColumn(f"_r{at + 1}", F.regexp_replace(f"_r{at}" if at else "_t", pattern, ""))
    lengths = [F.length("_t"), *[F.length(f"_r{i}") for i in range(1, 7)], F.lit(0)]
    d = d.withColumn("_n", F.size("_w"))
    d = d.withColumns({f"_{c}": (lengths[i] - lengths[i + 1]).cast("bigint") for i, c in enumerate(CLASSES)})
    d = d.drop(*[f"_r{i}" for i in range(1, 7)])
    d = _repeats(_lines(_common(d)))
    total = reduce(lambda a, b: a + b, [F.col(f"_{c}") for c in CLASSES])
    d = d.withColumns(
        {
            "n_words": F.col("_n").cast("bigint"),
            "word_chars": (total - F.col("_space")).cast("bigint"),
            "n_symbols": F.col("_symbol"),
            "char_distance": nearest([F.col(f"_{c}") for c in CLASSES], total, [list(x) for x in CHARACTERS.values()]),
            "word_distance": nearest(
                [*[F.col(f"_c{i}") for i in range(len(VOCABULARY))], F.col("_n") - F.size("_codes")],
                F.col("_n"), [_word_reference(x) for x in COMMON],
            ),
        }
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    long, wordy = total >= min_chars, F.col("n_words") >= min_common_words
    far = long & (F.col("char_distance") > max_char_distance)
    odd = wordy & (F.col("word_distance") > max_word_distance)
    both = long & wordy & (F.col("char_distance") > joint_char_distance) & (F.col("word_distance") > joint_word_distance)
    diverges = F.coalesce(far | odd | both, F.lit(False))
    # A filter is not moved below a column that is not deterministic. Moved down step by step, the rules
    # would become one expression that repeats every step's work many times over.
    fence = F.monotonically_increasing_id() >= 0
    judged = d.withColumns({"base_failed": base, "kept": ~base & ~diverges & fence})
    return given.back(judged, {c: F.col(c) for c in OUTPUTS})


def _common(d: DataFrame) -> DataFrame:
    """_c0, _c1, …: how often each common word stands in the text, in lower case or capitalised."""
    spelled = [*VOCABULARY, *[w.capitalize() for w in VOCABULARY]]
    order = F.array(*[F.lit(w) for w in spelled])
    d = d.withColumn("_hits", F.filter("_w", lambda w: w.isin(spelled)))
    d = d.withColumn("_codes", F.transform("_hits", lambda w: F.pmod(F.array_position(order, w) - 1, F.lit(len(VOCABULARY))).cast("int")))
    return d.withColumns({f"_c{i}": F.size("_codes") - F.size(F.array_remove("_codes", F.lit(i))) for i in range(len(VOCABULARY))})


def _lines(d: DataFrame) -> DataFrame:
    """n_dup_lines: lines with a word that equal an earlier line."""
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    d = d.withColumn("_lines", lines)
    return d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))


def _repeats(d: DataFrame, width: int = 5) -> DataFrame:
    """n_repeat_words: words inside a window of `width` words that occurs twice or more in the text.
    Windows are compared by 64-bit hashes of word hashes; only texts with a repeated window sort theirs."""
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    starts = F.when(F.col("_n") >= width, F.sequence(F.lit(0), F.col("_n") - width)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_win", F.transform(starts, lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(width)])))
    again = F.size(F.array_distinct("_win")) < F.size("_win")
    pairs = F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_sorted", F.when(again, F.sort_array(pairs)))

    def same(e: Column, i: Column) -> Column:
        return F.coalesce(F.get("_sorted", i)["h"] == e["h"], F.lit(False))

    repeated = F.filter("_sorted", lambda e, i: same(e, i - 1) | same(e, i + 1))
    d = d.withColumn("_at", F.sort_array(F.transform(repeated, lambda e: e["i"])))
    steps = F.transform("_at", lambda p, i: F.least(F.lit(width), F.coalesce(F.get("_at", i + 1) - p, F.lit(width))))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint")))


def reject(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows that pass all rules, with all the columns they came with."""
    given = Columns(docs)
    judged = assess(given.rows.withColumnRenamed(given["text"], "text"), **limits).withColumnRenamed("text", given["text"])
    return given.back(judged.where("kept"))
