"""Licence scans: sparse TF-IDF cosine of whole files, headers and statements to templates, then nearest-ancestor inheritance.

DataFrame operations only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georank.llm.common import lookup_join, materialize

#: Licence texts, standard notices and statements that files carry, as (SPDX name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
)
MIN_COSINE = 0.8
_TOKEN = r"[\p{L}\p{N}]+"


def _tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _prefix(weights: dict[str, float], min_cosine: float) -> list[str]:
    """A template's heaviest terms, so many that what shares none of them stays below min_cosine.

    The cosine of a unit that shares only the rest is at most the rest's length over the template's.
    """
    total = sum(w * w for w in weights.values())
    left, out = total, []
    for term, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if math.sqrt(left / total) < min_cosine - 1e-9:
            break
        out.append(term)
        left -= w * w
    return out


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row for each row of docs: doc_id, path, license, found, cosine, license_dir.

    found is ``file`` where the whole text is a licence text, notice or statement (cosine >= min_cosine; it then holds
    for its directory), ``header`` where a window of words is one, ``inherited`` where neither is and a directory above
    holds a file's licence, the nearest counting; else null. Windows have a template's length and begin where a heavy
    term of it, in the place of its first one there, would put the template's start, so notices over any number of lines,
    with comment marks or amid other words, are found. Of several templates the highest cosine counts (to 9 places),
    then the name. Weights are TF-IDF, 1 + ln tf times ln((1 + n) / (1 + df)) + 1, over document frequencies of
    all rows. Units that share no heavy term of a template can't reach the cosine and aren't scored; equal units are
    scored once. Null paths inherit nothing; null and empty texts have no licence; a directory with several
    licence files has the one of the least path, then name. templates are (name, text) pairs.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    n_docs = rows.count()
    frequencies = materialize(
        rows.select(F.explode(F.array_distinct(_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "license-df"
    )
    spark = docs.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in templates])).alias("template", "t")).select("template", "t.*")
    idf = (F.log((F.lit(1.0) + n_docs) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
    terms = listed.select("template", F.posexplode(_tokens(F.col("text"))).alias("place", "term")).groupBy("template", "term").agg(F.count("*").alias("tf"), F.min("place").alias("place"))
    # The templates' own terms, a few hundred, are the only rows that reach the driver.
    weights: list[dict[str, float]] = [{} for _ in templates]
    places: list[dict[str, int]] = [{} for _ in templates]
    sizes = [0] * len(templates)
    for r in F.broadcast(terms).join(frequencies, "term", "left").select("template", "term", "tf", "place", ((1 + F.log("tf")) * idf).alias("w")).collect():
        weights[r["template"]][r["term"]] = r["w"]
        places[r["template"]][r["term"]] = r["place"]
        sizes[r["template"]] += r["tf"]
    anchors: dict[str, list[dict[str, int]]] = {}
    for k, own in enumerate(weights):
        for t in _prefix(own, min_cosine):
            anchors.setdefault(t, []).append({"place": places[k][t], "size": sizes[k]})
    literal = lambda value, schema: F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)
    norms_of = [math.sqrt(sum(x * x for x in own.values())) for own in weights]
    vectors = spark.range(1).select(F.explode(literal(
        [{"template": templates[k][0], "ord": k, "term": t, "tw": w / norms_of[k]} for k, own in enumerate(weights) for t, w in sorted(own.items())], "array<struct<template: string, ord: int, term: string, tw: double>>"
    )).alias("v")).select("v.*")

    # Units: the whole text, and a window for each heavy term in it, of rows with a heavy term.
    heavy = sorted(anchors)
    by_term = literal(anchors, "map<string, array<struct<place: int, size: int>>>")
    marked = rows.select("uid", _tokens(F.col("text")).alias("words")).where(F.arrays_overlap("words", F.lit(heavy)))
    marked = materialize(marked, "license-marked")
    hits = F.filter(F.transform("words", lambda x, i: F.when(x.isin(heavy), F.struct(i.alias("i"), x.alias("x")))), lambda s: s.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda s: F.transform(F.element_at("by_term", s["x"]), lambda a: F.struct(F.greatest(s["i"] - a["place"], F.lit(0)).alias("start"), a["size"].alias("size"))))))
    windows = marked.withColumn("by_term", by_term).select("uid", "words", F.explode(starts).alias("w")).select("uid", F.lit(False).alias("whole"), F.slice("words", F.col("w.start") + 1, F.col("w.size")).alias("x"))
    units = windows.union(marked.select("uid", F.lit(True), "words")).withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit(1), "x"))
    units = materialize(units, "license-units")
    distinct = units.groupBy("h1", "h2").agg(F.min("x").alias("x"))
    parts = distinct.select("h1", "h2", F.explode("x").alias("term")).groupBy("h1", "h2", "term").agg(F.count("*").alias("tf"))
    weighed = parts.join(frequencies, "term").select("h1", "h2", "term", ((1 + F.log("tf")) * idf).alias("w"))
    weighed = materialize(weighed, "license-weights")
    norms = weighed.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("h1", "h2", "ord", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosines = dots.join(norms, ["h1", "h2"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= min_cosine)
    best = materialize(cosines.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "template")).alias("b")), "license-scored")
    own = lookup_join(units.drop("x"), best, ["h1", "h2"], best.count()).groupBy("uid").agg(
        F.min(F.when(F.col("whole"), F.col("b"))).alias("as_file"), F.min(F.when(~F.col("whole"), F.col("b"))).alias("as_header")
    )
    slim = materialize(rows.drop("text").join(own, "uid", "left"), "license-own")
    return inherit(slim)


def inherit(slim: DataFrame) -> DataFrame:
    """scan's rows from (doc_id, path, as_file, as_header), the latter structs (minus cosine, template) or null.

    Every directory above a path is joined to the directories that hold a licence file; the longest one counts.
    """
    folders = F.regexp_replace("path", r"/?[^/]*$", "")
    held = slim.where(F.col("as_file").isNotNull() & F.col("path").isNotNull()).select(folders.alias("dir"), F.struct("path", F.col("as_file.template").alias("template"), F.col("as_file.minus").alias("minus")).alias("f"))
    held = materialize(held.groupBy("dir").agg(F.min("f").alias("f")), "license-dirs")
    pieces = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.concat_ws("/", F.slice(pieces, F.lit(1), n))))
    )
    # Directories repeat over documents: each distinct one looks for its ancestors once.
    needy = slim.where("as_file is null and as_header is null and path is not null").select(folders.alias("folder")).distinct()
    found = lookup_join(needy.select("folder", F.explode(F.array_distinct(above)).alias("dir")), held, "dir", held.count())
    nearest = found.groupBy("folder").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "f")).alias("near"))
    out = slim.withColumn("folder", folders).join(nearest, "folder", "left")
    mine = F.coalesce("as_file", "as_header")
    given = mine.isNull() & F.col("near").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce(mine["template"], F.when(given, F.col("near.f.template"))).alias("license"),
        F.when(F.col("as_file").isNotNull(), "file").when(F.col("as_header").isNotNull(), "header").when(given, "inherited").alias("found"),
        F.round(-F.coalesce(mine["minus"], F.when(given, F.col("near.f.minus"))), 9).alias("cosine"), F.when(given, F.col("near.dir")).alias("license_dir"),
    )
