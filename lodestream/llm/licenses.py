"""License scans: runs of a text's words compared with licence notices by the Dice coefficient of word bigrams.

Text is normalised as a whole (lower case, runs of letters and digits are words), so line breaks, comment marks and
punctuation don't matter, and a notice may be wrapped over lines or stand within a longer line. A window of the text
with as many words as a notice, or what is left of the text, has a set of word bigrams A; it matches the notice's set B
with 2 |A & B| / (|A| + |B|). Windows begin where a bigram of the notice stands. Of the windows of a text that reach the
coefficient t the best is returned for each notice, the first of equal ones.

Size bounds: a coefficient of at least t needs t / (2 - t) |B| shared bigrams. So a notice is a candidate for a text
only if the text has that many bigrams at all, and then only if it has that many of the notice's; windows are
compared for candidates alone. Bigrams are compared by 64-bit hashes.

Defined results: null, empty and blank texts match nothing; a text of one word has that word as its only bigram;
repeated rows are matched alike and appear once per row; ties between notices all appear; a very long text is one row
and searched whole; an empty table or no notices give an empty result; a null doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Short notices by which works name their licence, grant sentences of common licences, and whole short licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]

GAPS = r"[^\p{L}\p{N}]+"


def normal_words(text: Column) -> Column:
    """Words of the lower-cased text: runs of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(text), GAPS, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


#: The distinct bigrams of all notices, which tasks hold; more are refused.
MAX_BIGRAMS = 50_000


def bigrams(words: Column) -> Column:
    """Hashed word bigrams of an array of words, in order; one word stands for itself."""

    def of(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))

    return common.let(words, of)


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, lic, text) for i, (lic, text) in enumerate(NOTICES)], "notice_id int, license string, notice string")


def scan(docs: DataFrame, templates: DataFrame, min_dice: float = 0.8) -> DataFrame:
    """doc_id, notice_id, license, start, n_words, dice: each row's best window for every notice it matches.

    start counts the text's normalised words from 0. templates: notice_id, license, notice; a table that does not
    grow with the corpus, of MAX_BIGRAMS distinct bigrams at most, which is checked.
    """
    low = min_dice / (2 - min_dice)
    tpl = templates.select("notice_id", "license", normal_words(F.col("notice")).alias("w")).where("size(w) > 0")
    tpl = tpl.select("notice_id", "license", F.size("w").alias("len"), F.array_distinct(bigrams(F.col("w"))).alias("b"))
    tpl = tpl.withColumn("need", F.greatest(F.ceil(F.size("b") * low - 1e-9).cast("int"), F.lit(1)))
    tpl = common.stored(tpl, "notices")
    known = tpl.select(F.explode("b").alias("h")).distinct()
    if known.count() > MAX_BIGRAMS:
        raise ValueError(f"notices of more than {MAX_BIGRAMS} distinct bigrams")
    listed = sorted(r.h for r in known.collect())
    everything = F.broadcast(tpl.agg(F.collect_list(F.struct("notice_id", "license", "len", "b", "need")).alias("notices"), F.coalesce(F.min("need"), F.lit(1)).alias("least")))
    texts = docs.select("doc_id", bigrams(normal_words(F.coalesce("text", F.lit("")))).alias("g"))
    # outer forms of explode keep filters, which would compute the bigrams once more, behind it
    at = F.filter(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isin(listed) if listed else F.lit(False))
    met = texts.select("doc_id", "g", at.alias("at")).select("doc_id", F.when(F.size("at") > 0, F.col("g")).alias("g"), "at")
    met = met.crossJoin(everything).withColumn("hits", F.array_distinct(F.transform("at", lambda x: x["h"])))
    possible = F.filter("notices", lambda n: (n["need"] <= F.size("hits")) & (F.size(F.array_intersect(n["b"], F.col("hits"))) >= n["need"]))
    met = met.withColumn("possible", F.when(F.size("hits") >= F.col("least"), possible))
    pairs = met.select("doc_id", "g", "at", F.explode_outer("possible").alias("n")).where(F.col("n").isNotNull())

    def window(x: Column) -> Column:
        own = F.array_distinct(F.slice(F.col("g"), x["i"] + 1, F.greatest(F.col("n.len") - 1, F.lit(1))))
        dice = 2.0 * F.size(F.array_intersect(own, F.col("n.b"))) / (F.size(own) + F.size("n.b"))
        return F.struct(dice.alias("dice"), (-x["i"]).alias("back"))

    starts = F.filter("at", lambda x: F.array_contains("n.b", x["h"]))
    best = pairs.select("doc_id", "n", F.size("g").alias("n_grams"), F.array_max(F.transform(starts, window)).alias("best")).where(F.col("best.dice") >= min_dice)
    start = -F.col("best.back")
    return best.select("doc_id", "n.notice_id", "n.license", start.cast("long").alias("start"), F.least(F.col("n.len"), F.col("n_grams") + 1 - start).cast("long").alias("n_words"), "best.dice")


def oracle_sql(min_dice: float = 0.8) -> str:
    """All windows at all anchors, by brute force."""
    values = ", ".join(f"({i}, '{lic}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (lic, text) in enumerate(NOTICES))
    words = r"list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    grams = "CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END"
    return f"""
    WITH t AS (SELECT notice_id, license, {words.format("notice")} AS w FROM (VALUES {values}) v(notice_id, license, notice)),
    tb AS (SELECT notice_id, license, len(w) AS size, list_distinct({grams}) AS b FROM t), te AS (SELECT notice_id, license, size, b, unnest(b) AS x FROM tb),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("text")} AS w FROM documents), g AS (SELECT r, doc_id, {grams} AS g FROM d WHERE len(w) > 0),
    h AS (SELECT r, doc_id, g, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
    m AS (SELECT r, doc_id, notice_id, license, b, size, i, len(g) AS n, list_distinct(g[i:i + greatest(size - 1, 1) - 1]) AS a FROM h JOIN te USING (x)),
    s AS (SELECT *, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM m)
    SELECT doc_id, notice_id, license, i - 1 AS start, least(size, n + 1 - (i - 1)) AS n_words, dice FROM s WHERE dice >= {min_dice} QUALIFY row_number() OVER (PARTITION BY r, notice_id ORDER BY dice DESC, i) = 1
    """
