"""License scans by diagonal voting.

A text's words are its runs of letters and digits, A-Z in lower case. Every rolling k-gram of words is
hashed and joined in Spark to the positions where license templates have it. Each match votes for a
diagonal, the offset between the two positions; a diagonal's votes come together by aggregation.
Neighbouring diagonals, as insertions and deletions make them, come together by their offsets, whatever
stray diagonals lie between them in the text, and are cut along the text into spans. A span that is
longer than four templates, as periodic texts give, is cut into pieces that overlap by two templates.

A span is verified by aligning its matches with the template: the longest chain in which both word
places rise, so every word of the template counts once, and within the chain the stretch with most words
that is dense enough. Its words, over the template's, are the cover; a label needs `min_cover` of the
template, and `min_density` of the stretch's words to be in the chain. That takes a few hundred words a span.

Beside that, base phrases are found where their words stand consecutively; their labels always stay.
The templates are the only side that is broadcast, after a check of their size.

A null text counts as an empty one: no words, no labels, score 0. Repeated rows are scanned each by
itself, whatever their ids. An empty table gives an empty one. A very long text gives as many rows as any
other with its matches, which are sorted, not held. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Texts of well-known licenses and notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

#: Bytes of a text to letters in lower case and spaces; bytes over 0x7F belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, kept; forgotten all at once when they get too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_FOLD).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * _STEP + hashes[j : j + n]
    return g.view(np.int64)


def places(hashes: np.ndarray, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Starts and labels of the phrases in a text given as word hashes, in order."""
    found = []
    for phrase, label in phrases.items():
        words = [np.uint64(xxhash.xxh64_intdigest(w.encode())) for w in phrase.split()]
        at = np.flatnonzero(hashes == words[-1]) - len(words) + 1
        at = at[at >= 0]
        for j, w in enumerate(words[:-1]):
            at = at[hashes[at + j] == w]
        found += [(int(a), label) for a in at]
    return sorted(found)


#: Templates that may be broadcast have this many words at most, together.
MOST_WORDS = 1 << 20


def template_table(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(gram, template, at): where each k-gram of the templates stands."""
    h = WordHashes()
    if sum(len(h.of(text)) for _, text in templates) > MOST_WORDS:
        raise ValueError(f"templates have over {MOST_WORDS} words")
    rows = [(int(g), t, p) for t, (_, text) in enumerate(templates) for p, g in enumerate(grams(h.of(text), k).tolist())]
    return spark.createDataFrame(rows, "gram bigint, template int, at int")


def _rolling(phrases: dict[str, str], k: int):
    """For each text one row with its base results, and one row for each of its k-grams."""

    def run(batches):
        import pyarrow as pa

        h = WordHashes()
        names = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "pos", "gram"]
        for batch in batches:
            rows, ids, texts = (batch.column(c) for c in ("row", "doc_id", "text"))
            for i in range(batch.num_rows):
                w = h.of(texts[i].as_py())
                found = places(w, phrases)
                g = grams(w, k)
                n = len(g) + 1  # the first row is the base row

                def once(value, kind, n=n):
                    return pa.concat_arrays([pa.array([value], kind), pa.nulls(n - 1, kind)])

                at = np.arange(-1, n - 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, rows[i].as_py())), once(ids[i].as_py(), ids.type), once(len(w), pa.int64()), once(len(found), pa.int64()),
                        once(found[0][0] if found else None, pa.int64()), once(found[-1][0] if found else None, pa.int64()),
                        once(",".join(sorted({x for _, x in found})), pa.string()), pa.array(at), pa.array(np.r_[0, g], mask=at < 0),
                    ],
                    names=names,
                )

    return run


def chain(pos: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For k-grams that match at (pos, at), the word places of the longest chain of matching words in which
    the text's places and the template's both rise. Of equal chains, the one whose places come latest."""
    pairs = np.unique((pos[:, None] + np.arange(k)) << 32 | 0xFFFFFFFF - (at[:, None] + np.arange(k)))
    tails: list[int] = []  # the smallest end of a chain of each length, and the pair that it is
    ends: list[int] = []
    before = []
    where, place = (pairs >> 32).tolist(), (0xFFFFFFFF - (pairs & 0xFFFFFFFF)).tolist()
    for i, x in enumerate(place):  # a text's place meets its template places from the last to the first
        n = bisect_left(tails, x)
        tails[n : n + 1], ends[n : n + 1] = [x], [i]
        before.append(ends[n - 1] if n else -1)
    i, out = ends[-1] if ends else -1, []
    while i >= 0:
        out.append(where[i])
        i = before[i]
    return np.array(out[::-1], np.int64)


def stretch(places: np.ndarray, length: int, min_cover: float, min_density: float) -> tuple[int, int, int] | None:
    """(first, end, words) of the stretch of a chain with most words of those that reach cover and density;
    the first of equals."""
    i, j = np.meshgrid(np.arange(len(places)), np.arange(len(places)), indexing="ij")
    words = j - i + 1
    extent = places[None, :] - places[:, None] + 1
    good = (words >= min_cover * length) & (words >= min_density * extent)
    if not good.any():
        return None
    first, last = np.unravel_index(np.argmax(np.where(good, words, 0)), words.shape)
    return int(places[first]), int(places[last]) + 1, int(words[first, last])


def _verify(k: int, lengths: list[int], min_cover: float, min_density: float, base: list[str]):
    """The spans that hold, as (row, …base, template, first, end, cover); rows without a template pass as they are."""

    def run(batches):
        import pyarrow as pa

        kinds = {"template": pa.int32(), "first": pa.int64(), "end": pa.int64(), "cover": pa.float64()}
        for batch in batches:
            take, spans = [], []
            for i, (t, matches) in enumerate(zip(batch.column("template").to_pylist(), batch.column("matches"), strict=True)):
                span = None
                if t is not None:
                    m = matches.as_py()
                    pos, at = (np.array([x[c] for x in m], np.int64) for c in ("pos", "at"))
                    if (span := stretch(chain(pos, at, k), lengths[t], min_cover, min_density)) is None:
                        continue
                take.append(i)
                spans.append((t, *span[:2], span[2] / lengths[t]) if span else (None,) * 4)
            kept = batch.select(["row", *base]).take(pa.array(take, pa.int64()))
            columns = zip(*spans, strict=True) if spans else [()] * 4
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)]], names=["row", *base, *kinds])

    return run


def scan(
    docs: DataFrame, k: int = 4, neighbour: int = 4, gap: int = 12, min_cover: float = 0.6, min_density: float = 0.6,
    phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs.

    spans: the verified spans as label, first word, end word (exclusive) and cover. score: 1 with a base
    place, else the best span's cover of its template, 0 without a span.
    """
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    kind = dict(docs.dtypes)["doc_id"]
    h = WordHashes()
    lengths = [len(h.of(text)) for _, text in templates]
    facts = spark.createDataFrame([(t, label, n) for t, ((label, _), n) in enumerate(zip(templates, lengths, strict=True))], "template int, label string, length int")
    schema = f"row bigint, doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, pos int, gram bigint"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_rolling(PHRASES if phrases is None else phrases, k), schema)
    # One pass over the texts gives both the base rows and the matches.
    hits = rows.join(F.broadcast(template_table(spark, templates, k)), "gram", "left").where("pos < 0 or template is not null")
    base = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    # A diagonal meets each template place once, so its list is no longer than the template. Base rows have no template.
    diagonals = hits.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_list("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"), *[F.max(c).alias(c) for c in base]
    )
    across = W.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(across) > neighbour
    near = diagonals.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("near", F.sum("far").over(across))
    along = W.partitionBy("row", "template", "near").orderBy("first", "diagonal")
    apart = F.col("first") - F.max("last").over(along.rowsBetween(W.unboundedPreceding, -1)) > gap + k
    merged = near.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(along))
    span = W.partitionBy("row", "template", "near", "span")
    merged = merged.withColumns({"begin": F.min("first").over(span), "stop": F.max("last").over(span)}).join(F.broadcast(facts), "template", "left")
    step = 2 * F.col("length")
    matches = merged.withColumn("at", F.explode_outer("ats")).withColumn("pos", F.col("at") + F.col("diagonal"))
    piece = F.floor((F.col("pos") - F.col("begin")) / step)
    pieces = F.when(F.col("stop") - F.col("begin") < 2 * step, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(piece, piece - 1))
    matches = matches.withColumn("piece", F.explode(F.coalesce(pieces, F.array(F.lit(0).cast("bigint")))))
    spans = matches.groupBy("row", "template", "near", "span", "piece").agg(
        F.collect_set("at").alias("places"), F.collect_list(F.struct("pos", "at")).alias("matches"), F.max("length").alias("length"), *[F.max(c).alias(c) for c in base]
    )
    # A match gives k words at most, so a span that holds has this many; few others get as far as Python.
    spans = spans.where(F.col("template").isNull() | (F.size("places") * k >= min_cover * F.col("length"))).select("row", *base, "template", "matches")
    verified = spans.mapInArrow(_verify(k, lengths, min_cover, min_density, base), schema.replace("pos int, gram bigint", "template int, first bigint, end bigint, cover double"))
    found = F.when(F.col("template").isNotNull(), F.struct("label", "first", "end", "cover"))
    per_row = verified.join(F.broadcast(facts), "template", "left").groupBy("row").agg(F.sort_array(F.collect_set(found)).alias("spans"), *[F.max(c).alias(c) for c in base])
    own = F.transform("spans", lambda s: s["label"])
    all_labels = F.array_sort(F.array_distinct(F.concat(own, F.array_remove(F.split("base_labels", ","), ""))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return per_row.select(*base, F.array_join(all_labels, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "spans")
