"""License scan by diagonal voting, with DataFrame functions only.

All rolling word k-gram hashes of a document join the positions of the template
texts: 2-grams those of phrases and opening lines, 4-grams those of whole
license texts. A hit votes for the diagonal document position - template
position. A phrase stands where its diagonal got all votes. For the longer
notices and texts, neighbouring diagonals of a document merge (words added or
lost shift the diagonal) and the merged span is verified by the share of the
template's k-grams that it holds. Every hit is verified on the words themselves,
so hash collisions count for nothing.

Null text has no words: counts 0, words null, labels "", score 0. Repeated rows
are scanned one by one; an empty table gives none. Very long texts are scanned
whole. Other columns of the table,
whatever their names, are not used. A document's hits meet in one group, whose
size is bounded by the document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import with_row_id

#: The phrases whose places are counted, and their labels.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
#: Opening words of common notices, as their publishers print them.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "licensed under cc by"),
    ("cc", "licensed under a creative commons attribution"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
]
#: License texts and the notices that go with licenses, whole, without their copyright lines.
TEXTS = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
     "You should have received a copy of the GNU General Public License along with this program."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
     "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
     "This notice may not be removed or altered from any source distribution."),
]
#: Words of a gram of phrases and opening lines, and of whole texts.
SHORT, LONG = 2, 4
#: Diagonals at most this far apart are one alignment.
NEIGHBOUR = 3
#: Least share of a notice's 2-grams in a verified span.
COVERAGE = 0.7
#: Stands for the row of counts that each document sends besides its hits.
HEADER = -1

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character outside ASCII whose lower case is an ASCII letter, and what stands in for it.
KELVIN, OTHER = "K", "Å"


def words(text: Column) -> Column:
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.array_remove(F.split(plain, SEPARATOR), "")


def templates(spark: SparkSession) -> DataFrame:
    """(hash, template, label, phrase, n_grams, at, gram): one row for each gram place, some 800 in all."""
    rows = [(k, label, k < len(PHRASES), SHORT if k < len(PHRASES + NOTICES) else LONG, text) for k, (label, text) in enumerate(PHRASES + NOTICES + TEXTS)]
    texts = spark.createDataFrame(rows, "template int, label string, phrase boolean, k int, text string").withColumn("w", words(F.col("text")))
    n = F.size("w") - F.col("k") + 1
    grams = texts.withColumn("n_grams", n).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")).withColumn("gram", F.slice("w", F.col("at") + 1, F.col("k")))
    word = lambda k: F.get("gram", F.lit(k))
    pair = F.xxhash64(word(0), word(1))
    hashes = F.when(F.col("k") == SHORT, pair).otherwise(F.xxhash64(pair, F.xxhash64(word(2), word(3))))
    header = spark.range(1).select(F.lit(HEADER).cast("long"), F.lit(HEADER).cast("int"), F.lit(""), F.lit(False), F.lit(0), F.lit(0), F.array().cast("array<string>"))
    return grams.select(hashes.alias("hash"), "template", "label", "phrase", "n_grams", "at", "gram").union(header)


def hits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n_words, template, ..., at, pos): verified hits, and one header row for each document."""
    docs = with_row_id(docs.select("doc_id", words(F.col(text_col)).alias("w")), "rid")
    # A gram of four is a pair of pairs. The last pairs of a text hold nulls and are no template's.
    docs = docs.withColumn("pairs", F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(a, b)))
    fours = F.zip_with("pairs", F.slice("pairs", 3, F.size("w")), lambda a, b: F.xxhash64(a, b))
    rolled = docs.select("rid", "doc_id", "w", F.posexplode(F.concat("pairs", F.array(F.lit(HEADER).cast("long")), fours)).alias("place", "hash"))
    # The templates are fixed above: their number doesn't depend on the data.
    found = rolled.join(F.broadcast(templates(docs.sparkSession)), "hash")
    n = F.size("w")
    found = found.withColumn("pos", F.when(F.col("place") > n, F.col("place") - n - 1).otherwise(F.col("place")))
    same = F.lit(True)
    for k in range(LONG):
        same &= (F.size("gram") <= k) | F.coalesce(F.get("w", F.col("pos") + k) == F.get("gram", F.lit(k)), F.lit(False))
    real = F.when(F.col("template") == HEADER, F.col("place") == n).otherwise(same & ((F.col("place") > n) == (F.size("gram") == LONG)))
    return found.filter(real).select("rid", "doc_id", n.cast("long").alias("n_words"), "template", "label", "phrase", "n_grams", "at", "pos")


def spans(found: DataFrame) -> DataFrame:
    """(rid, doc_id, template, label, phrase, n_words, first, last, coverage): aligned spans of word positions.

    Headers pass through as spans of their own. One flow serves phrases,
    notices and headers, so the texts are read and rolled once.
    """
    own = ["rid", "doc_id", "template", "label", "phrase", "n_grams"]
    diagonals = found.groupBy(*own, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.min("pos").alias("first"), (F.max("pos") + 1).alias("last"), F.collect_set("at").alias("ats")
    )
    # The diagonals of a notice that are near each other merge; a phrase must stand whole.
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR)
    runs = diagonals.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("run", F.sum("apart").over(order))
    merged = runs.groupBy(*own, "run").agg(
        F.max("n_words").alias("n_words"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats")
    )
    coverage = F.when(F.col("n_grams") > 0, F.size("ats") / F.col("n_grams"))
    merged = merged.withColumn("coverage", coverage).filter(~F.col("phrase") | (F.col("coverage") == 1))
    return merged.drop("n_grams", "run", "ats")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each document: counts, label lists and the best coverage."""
    rows = spans(hits(docs, text_col).repartition("rid"))
    start = F.when(F.col("phrase"), F.col("first")).cast("long")
    verified = F.col("phrase") | (F.col("coverage") >= COVERAGE)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    header = F.col("template") == HEADER
    return rows.groupBy("rid", "doc_id").agg(
        F.max(F.when(header, F.col("n_words"))).alias("n_words"), F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), listed(F.when(verified & ~header, F.col("label"))).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    ).drop("rid")
