"""License scans by MinHash over overlapping text windows, with DataFrame functions only.

Texts become word shingles of five. Shingles that occur in no template cannot
add to any containment, so only the others are kept, with their positions; that
leaves nothing of most texts. Overlapping windows over the kept positions are
sketched by MinHash and met with the templates' parts through bands. The bands
are set so that a window holding four fifths of a part collides with near
certainty, whatever else fills it. A template too short for such parts is lost
in a window among other templates' text, so it is retrieved exactly: by any of
so many of its shingles that no sufficient share can do without them all.
Whatever is retrieved is verified: the share of the template's distinct shingles
that the text holds.

Defined cases: null and empty texts and texts under five words match nothing;
case, punctuation and white space do not count; a template of fewer than five
words is refused; a text that holds a template several times is reported once
with its first place; every row is reported by itself, whether its id repeats or
is null; texts are read whole, and what is kept of one grows with the licence
words in it; templates that tie are all reported; an empty table or no templates
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from vertexloom.plans.scratch import Scratch

SHINGLE = 5
CONTAINMENT = 0.8
#: Shingle positions that a window covers, and its step; parts of templates fit whole into some window.
WINDOW, STEP = 64, 32
PART = WINDOW - STEP
BANDS, ROWS = 48, 2
#: Templates are broadcast while they hold at most this many shingles together.
BROADCAST_SHINGLES = 200_000
#: Distinct template shingles that stand in the plan as a set; more are joined as a table.
LITERAL_SHINGLES = 20_000
#: What a word is.
WORD = r"[\p{L}\p{N}]+(?:[.-]+[\p{L}\p{N}]+)*"

#: Texts and notices by which works state their license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/"
        "LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the "
        "License."),
    "bsd-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."),
    "bsd-3-clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices "
        "in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
        "works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
        "object code generated by a source language processor."),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "isc-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "mit-release": "Released under the MIT License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-terms": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
        "in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law."),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. Altered source versions must be plainly marked "
        "as such, and must not be misrepresented as being the original software. This notice may not be removed or "
        "altered from any source distribution."),
}


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def least_similarity(containment: float) -> float:
    """The Jaccard similarity of a part and a full window that holds this share of it beside other templates' text."""
    return containment * PART / (WINDOW + (1 - containment) * PART)


#: How surely a window must collide with the smallest part that is retrieved by bands.
CERTAINTY = 0.998
assert collision_probability(least_similarity(CONTAINMENT)) > CERTAINTY


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits; versions such as 2.0 and names such as by-nc stay whole."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingle(words: Column, i: Column) -> Column:
    """The hash of the five words from position ``i`` on."""
    return F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])


def _places(words: Column) -> Column:
    n = F.size(words) - SHINGLE
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _bands(hashes: Column) -> Column:
    """Band keys of a set of shingle hashes."""

    def seeded(j: int):
        return lambda h: F.xxhash64(h, F.lit(j))

    low = [F.array_min(F.transform(hashes, seeded(j))) for j in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *low[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """``(license, shingles, parts)``: the template's distinct shingles, and those of its overlapping parts.

    ``templates`` maps names to texts, or is a table ``(license, body)`` such as
    one read from a folder of license files. Parts are ``PART`` shingles long,
    the last one too; a shorter template is one part.
    """
    if isinstance(templates, DataFrame):
        df = templates.select("license", "body")
    else:
        df = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    df = df.withColumn("w", _words(F.col("body")))
    hashed = df.select("license", F.transform(_places(F.col("w")), lambda i: _shingle(F.col("w"), i)).alias("all"))
    last = F.greatest(F.lit(0), F.size("all") - PART)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PART // 2)), F.array(last)))
    return hashed.select("license", F.array_distinct("all").alias("shingles"), F.transform(
        starts, lambda s: F.array_distinct(F.slice(F.col("all"), s + 1, PART))).alias("parts"))


def _by_bands(template: Row, containment: float) -> bool:
    """Whether bands find the template with near certainty: it has parts enough, and none of few shingles."""
    return (len(template.shingles) >= WINDOW and min(map(len, template.parts)) >= PART
            and collision_probability(least_similarity(containment)) > CERTAINTY)


def _without_bands(known: list[Row], containment: float) -> list[tuple[str, int]]:
    """``(license, shingle)`` for the templates that bands may miss: what holds the share of one holds one of these.

    They are as many as may be missing and one more, those first that the fewest templates have.
    """
    common = Counter(h for r in known for h in r.shingles)
    out = []
    for r in known:
        if not _by_bands(r, containment):
            missing = len(r.shingles) - math.ceil(containment * len(r.shingles) - 1e-9)
            out += [(r.license, h) for h in sorted(r.shingles, key=lambda h: (common[h], h))[:missing + 1]]
    return out


def _hits(docs: DataFrame, id_col: str, text_col: str, universe: list[int]) -> DataFrame:
    """``(row, doc_id, hits)``: the places and hashes of the template shingles in each row's text, in order."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        _words(F.col(text_col)).alias("w"))
    shingles = F.transform(_places(F.col("w")), lambda i: F.struct(i.alias("at"), _shingle(F.col("w"), i).alias("h")))
    if len(universe) <= LITERAL_SHINGLES:
        return words.select("row", "doc_id", F.filter(shingles, lambda x: x["h"].isin(universe or [0])).alias("hits"))
    table = docs.sparkSession.createDataFrame([(h,) for h in universe], "h long")
    each = words.select("row", "doc_id", F.explode(shingles).alias("x")).select("row", "doc_id", "x.*")
    met = each.join(F.broadcast(table) if len(universe) <= BROADCAST_SHINGLES else table, "h", "left_semi")
    return met.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                  F.sort_array(F.collect_list(F.struct("at", "h"))).alias("hits"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, license, containment, word)``: templates found in each row's whole text.

    ``word`` is the position of the first of the template's shingles. Rows
    without any match give no row.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    known = table.collect()  # the templates are a parameter, not data
    short = [r.license for r in known if not r.shingles]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    universe = sorted({h for r in known for h in r.shingles})
    # written once: a filter on the hits would be pushed below the split and repeat it for every shingle
    scratch = Scratch(spark, "licenses")
    hits = scratch.save(_hits(docs, id_col, text_col, universe), "hits").where(F.size("hits") > 0)
    each = hits.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    last = F.floor(F.col("at") / STEP).cast("int")
    seen = each.select("row", "h", F.explode(F.array_distinct(F.array(last, F.greatest(last - 1, F.lit(0))))).alias("k"))
    seen = scratch.save(seen.groupBy("row", "k").agg(F.sort_array(F.collect_set("h")).alias("inside")), "windows")
    # equal windows are everywhere alike: each distinct one is sketched and retrieved once
    sets = seen.select("inside").distinct()
    keys = sets.withColumn("key", F.explode(F.concat(_bands(F.col("inside")), "inside")))
    part = table.where(F.col("license").isin([r.license for r in known if _by_bands(r, containment)]))
    part = part.select("license", F.explode("parts").alias("part"))
    part = part.select("license", F.explode(_bands(F.col("part"))).alias("key")).distinct()
    part = part.union(spark.createDataFrame(_without_bands(known, containment), "license string, key long"))
    small = sum(len(r.shingles) for r in known) <= BROADCAST_SHINGLES
    side = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    retrieved = keys.join(side(part), "key").groupBy("inside").agg(F.collect_set("license").alias("licenses"))
    asked = seen.join(retrieved, "inside").select("row", F.explode("licenses").alias("license")).distinct()
    tpl = table.select(F.col("license").alias("l"), "shingles")
    near = asked.join(hits, "row").join(side(tpl), F.col("license") == F.col("l"))
    held = F.filter("hits", lambda x: F.array_contains("shingles", x["h"]))
    scored = near.select("doc_id", "license", held.alias("held"), F.size("shingles").alias("n")).select(
        "doc_id", "license", (F.size(F.array_distinct(F.transform("held", lambda x: x["h"]))) / F.col("n")).alias("containment"),
        F.array_min(F.transform("held", lambda x: x["at"])).alias("word"))
    return scored.where(F.col("containment") >= containment)
