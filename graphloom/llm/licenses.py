"""License scans: Dice coefficient over word bigrams against licence templates.

Text and templates are normalised alike: lower case, letters and digits only,
copyright holders and years dropped. What is compared with a template of n
words are windows of n consecutive words, wherever line and paragraph ends
fall, so a licence among other text or in the middle of a line is seen as well
as one that stands alone.

A set of bigrams can reach a Dice coefficient of t with a template's m bigrams
only if it has t m / (2 - t) of them; so each window that reaches it holds at
least one of any m - t m / (2 - t) + 1 of the template's bigrams. The longest
(rarest) so many are its anchors, and a window is placed wherever an anchor
occurs, so that the anchor stands where the template has it. Of two sets of
sizes a and b, 2 min(a, b) / (a + b) bounds the coefficient and prunes before
sets are compared. The scan is one projection and two joins with tables of the
templates' size; texts are not moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: Public notices and texts by SPDX id: fixed values, for each licence its usual short notices and, where it is short, its text.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
)
#: A copyright mark at a line's start and the holder after it, up to the sentence's end or a grant; what follows is kept.
_COPYRIGHT = r"(?im)^\W*(?:copyright(?!\s+(?:notice|holder|owner)s?\b)|\(c\)|©).*?(?:(?<=[\p{L}\p{Nd}]{2})[.;](?=\s|$)|(?=\ball rights reserved\b|\b(?:licensed|released|distributed) under\b)|$)"


def words_of(text: Column) -> Column:
    """Normalised words: copyright holders dropped, lower case, letters and digits, no years."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, _COPYRIGHT, " ")), r"[^\p{L}\p{Nd}]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: (w != "") & ~w.rlike("^(?:19|20)[0-9]{2}$"))


def bigrams_of(words: Column) -> Column:
    """Distinct word bigrams; a single word is one bigram of itself."""
    n = F.size(words)
    pairs = F.transform(F.arrays_zip(F.slice(words, F.lit(1), n - 1).alias("a"), F.slice(words, F.lit(2), n - 1).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.array_distinct(F.when(n > 1, pairs).otherwise(words))


def template_words(spark: SparkSession, templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, words) of every template with words, by the same rules as for texts. Templates are few and short."""
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "i int, t string")
    got = {r["i"]: r["w"] for r in frame.select("i", words_of(F.col("t")).alias("w")).collect()}
    return [(templates[i][0], w) for i, w in sorted(got.items()) if w]


def pairs_of(words: list[str]) -> list[str]:
    """A template's bigrams in order; a single word is one bigram of itself."""
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words


def anchors_of(words: list[str], threshold: float) -> set[str]:
    """Bigrams of a template of which every window at the threshold holds one: the longest, as rare ones are."""
    grams = sorted(set(pairs_of(words)), key=lambda g: (-len(g), g))
    need = math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
    return set(grams[: len(grams) - need + 1])


def scan(docs: DataFrame, threshold: float = 0.7, templates=TEMPLATES) -> DataFrame:
    """(doc_id, licence, dice, n_windows, first_word, n_words) for every document and licence with a window at ``threshold`` or more.

    dice, first_word (number of the normalised word it starts at) and n_words
    are those of the best window, of equal ones the first; n_windows counts the
    windows that reach the threshold. Null and empty texts have no licence;
    equal rows give equal results, once; templates of one licence count as
    one; other columns are ignored.
    """
    spark = docs.sparkSession
    known = template_words(spark, templates)
    if not known:
        return spark.createDataFrame([], "doc_id long, licence string, dice double, n_windows long, first_word int, n_words int")
    ratio = threshold / (2 - threshold)  # the smaller set's least share of the larger one
    lengths = [len(w) for _, w in known]
    step, reach = len(known), max(lengths)
    # a window is one number: (its start + reach) * step + template
    places: dict[str, set[int]] = {}
    for t, (_, words) in enumerate(known):
        some = anchors_of(words, threshold)
        for o, g in enumerate(pairs_of(words)):
            if g in some:
                places.setdefault(g, set()).add((reach - o) * step + t)
    grams = sorted(places)
    single = sorted(g for g in grams if " " not in g)
    firsts = sorted({g.split(" ")[0] for g in grams})
    lookup = F.map_from_arrays(F.array(*[F.lit(g) for g in grams]), F.array(*[F.array(*[F.lit(x).cast("long") for x in sorted(places[g])]) for g in grams]))

    rows = docs.filter("text is not null").select(F.col("doc_id"), words_of(F.col("text")).alias("__gl_w"))
    pair = lambda x, i: F.concat(x, F.lit(" "), F.get(F.col("__gl_w"), i + 1))
    anchor = lambda x, i: F.when(x.isin(firsts), F.when(x.isin(single), x).otherwise(F.when(pair(x, i).isin(grams), pair(x, i))))
    found = F.filter(F.transform("__gl_w", lambda x, i: F.struct(i.alias("i"), anchor(x, i).alias("g"))), lambda s: s["g"].isNotNull())
    rows = rows.withColumn("__gl_a", found)
    windows = F.array_distinct(F.flatten(F.transform("__gl_a", lambda a: F.transform(F.try_element_at(lookup, a["g"]), lambda x: x + a["i"].cast("long") * step))))
    sizes = F.array(*[F.lit(n) for n in lengths])
    start = lambda k: (F.floor(k / step) - reach).cast("int")
    span = lambda k: F.slice("__gl_w", F.greatest(start(k), F.lit(0)) + 1, F.get(sizes, (k % step).cast("int")) + F.least(start(k), F.lit(0)))
    cut = F.transform(F.filter(windows, lambda k: F.get(sizes, (k % step).cast("int")) + F.least(start(k), F.lit(0)) > 0), lambda k: F.struct((k % step).cast("int").alias("t"), F.greatest(start(k), F.lit(0)).alias("at"), span(k).alias("w")))
    rows = rows.select("doc_id", F.explode(F.when(F.size("__gl_a") > 0, cut)).alias("x")).select("doc_id", "x.t", "x.at", F.size("x.w").alias("len"), bigrams_of(F.col("x.w")).alias("b"))
    # as many rows as templates
    sets = spark.createDataFrame([(t, k, len(set(pairs_of(w))), sorted(set(pairs_of(w)))) for t, (k, w) in enumerate(known)], "t int, licence string, m int, grams array<string>")
    rows = rows.join(F.broadcast(sets), "t").filter((F.size("b") >= F.col("m") * ratio - 1e-9) & (F.size("b") <= F.col("m") / ratio + 1e-9))
    rows = rows.withColumn("dice", 2.0 * F.size(F.array_intersect("b", "grams")) / (F.size("b") + F.col("m"))).filter(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", (-F.col("at")).alias("at"), (-F.col("len")).alias("len"))).alias("best")
    out = rows.groupBy("doc_id", "licence").agg(best, F.countDistinct("t", "at", "len").alias("n_windows"))
    return out.select("doc_id", "licence", "best.dice", "n_windows", (-F.col("best.at")).alias("first_word"), (-F.col("best.len")).alias("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents against all templates."""
    return scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))
