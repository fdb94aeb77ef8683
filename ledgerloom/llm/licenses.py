"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Lines, windows of consecutive lines and whole files are compared: tokens are weighed by
tf * idf, and the best cosine at or above THRESHOLD to a notice (lines, windows) or to a whole
licence text (files) gives the file its own licence; an SPDX tag gives it with score 1.
Document frequencies of the templates' tokens come from all files; any other token weighs as
one that no file has. Lines without tokens do not count, and a window has at most as many
lines as its notice has tokens, so every way to wrap a notice fits. Two bounds leave out only
what cannot reach the threshold: by Cauchy and Schwarz a file needs tokens with 0.36 of a
template's squared length, and the squared cosine of a window is at most the sum of those of
its lines. Windows are compared only where they can beat the file's best line.

A text that begins with the title of a licence (TITLES) is that licence, with score 1, whatever
notices it quotes; a line that reserves all rights counts only where a file says no more.

A file like a whole licence text or with its title, one named LICENSE, COPYING, NOTICE or alike
that has an own licence, or one of which lines at or above the threshold, tags and the best window
make up at least half, is a licence file and covers its directory. A file without
an own licence takes that of its nearest ancestor directory:
distinct directories, not files, are joined with the directories of licence files on every
prefix of their path, and files then meet the resolved directories.

Cases: null and empty texts have no own licence; null paths have no directory and inherit
nothing. Ties go to the licence that sorts last, of several licence files of a directory to
the best score. Repeated rows are repeated in the result. Kept columns with the name of a
result column are replaced. Texts are read whole, also those of one very long line. An empty
table gives an empty table.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ascii_lower, written

THRESHOLD = 0.6
#: What a line that reserves all rights says, unless the file says more.
RESERVED = "proprietary"

# Notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
_WARRANTY = ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
             "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")  # fmt: skip
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")  # fmt: skip
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")  # fmt: skip
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or any later version."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
#: Notices beyond those of the SQL.
NOTICES = (
    ("AGPL-3.0", "This program is free software: " + _GNU.format("Affero General Public License", 3)),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This program is free software; " + _GNU.format("General Public License", 2)),
    ("ISC", _ISC),
    ("LGPL-2.1", "This library is free software; " + _GNU.format("Lesser General Public License", 2.1)),
    ("LGPL-3.0", "This library is free software: " + _GNU.format("Lesser General Public License", 3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
#: Whole licence texts, compared with whole files.
TEXTS = (
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "ISC License " + _ISC + " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
            "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
)
#: Title pages of whole licence texts, the more precise ones first.
TITLES = (
    ("AGPL-3.0", "gnu affero general public license version 3"),
    ("GPL-1.0", "gnu general public license version 1"),
    ("GPL-2.0", "gnu general public license version 2"),
    ("GPL-3.0", "gnu general public license version 3"),
    ("LGPL-2.0", "gnu library general public license version 2"),
    ("LGPL-2.1", "gnu lesser general public license version 2.1"),
    ("LGPL-3.0", "gnu lesser general public license version 3"),
    ("GFDL-1.1", "gnu free documentation license version 1.1"),
    ("GFDL-1.2", "gnu free documentation license version 1.2"),
    ("GFDL-1.3", "gnu free documentation license version 1.3"),
    ("Apache-1.1", "apache software license version 1.1"),
    ("Apache-2.0", "apache license version 2.0"),
    ("MPL-1.0", "mozilla public license version 1.0"),
    ("MPL-1.1", "mozilla public license version 1.1"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("EPL-1.0", "eclipse public license v 1.0"),
    ("EPL-2.0", "eclipse public license v 2.0"),
    ("BSL-1.0", "boost software license version 1.0"),
    ("CC0-1.0", "cc0 1.0 universal"),
    ("CC0-1.0", "creative commons legal code cc0 1.0 universal"),
    ("CC-BY-4.0", "creative commons attribution 4.0 international"),
    ("CC-BY-4.0", "attribution 4.0 international"),
    ("CC-BY-SA-4.0", "attribution sharealike 4.0 international"),
    ("CC-BY-NC-4.0", "attribution noncommercial 4.0 international"),
    ("Artistic-1.0", "the artistic license preamble"),
    ("Artistic-2.0", "the artistic license 2.0"),
)
#: Names of files that hold the licence of their directory.
LICENCE_FILE = r"(?i)^(?:.*/)?(?:licen[sc]e|copying|notice|unlicense)(?:[._-][^/]*)?$"
SPDX = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]*[a-z0-9.+)])"
CUES = r"(?i)licen[sc]|reserved|permission|permitted"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def template_tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def line_tokens(line: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(line), F.lit(TOKEN), F.lit(0))


def token_frequencies(files: DataFrame, text: str, templates: Sequence[tuple[str, str]]) -> tuple[int, dict[str, int]]:
    """Number of files, and of files that hold each token of the templates."""
    held = _held(F.coalesce(F.col(text), F.lit("")), {t for _, x in templates for t in template_tokens(x)})
    rows = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("token")).groupBy("token").count().collect()
    counts = {r["token"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def _held(content: Column, vocabulary: set[str]) -> Column:
    return F.array_intersect(line_tokens(content), F.from_json(F.lit(json.dumps(sorted(vocabulary))), "array<string>"))


def _weights(n: int, counts: dict[str, int], templates: Sequence[tuple[str, str]]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """idf of the vocabulary, idf of any other token, and each template's unit vector."""
    idf = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for _, x in templates for t in template_tokens(x)}
    units = []
    for _, text in templates:
        vector = {t: c * idf[t] for t, c in Counter(template_tokens(text)).items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        units.append({t: v / length for t, v in vector.items()})
    return idf, math.log(1 + n) + 1, units


def directory(path: Column) -> Column:
    """The path without its last part; the empty text is the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def _tag(content: Column) -> Column:
    """Expression of the first SPDX tag, null without one; GNU ids lose -only and -or-later."""
    found = F.regexp_extract(content, SPDX, 1)
    return F.when(found != "", F.trim(F.regexp_replace(found, "(?i)(GPL-[0-9.]+)(?:-only|-or-later|\\+)", "$1")))


def _titled(content: Column) -> Column:
    """The licence whose title page the text begins with, null without one; signs and white space between words do not count."""
    ways = "|".join(r"[^a-z0-9]+".join(re.escape(w) for w in title.split()) for _, title in TITLES)
    found = F.regexp_extract(content, r"(?i)^[^a-z0-9]*(" + ways + r")(?![a-z0-9]|\.[0-9])", 1)
    plain = {re.sub("[^a-z0-9]", "", title): name for name, title in TITLES}
    names = F.create_map(*(F.lit(x) for pair in plain.items() for x in pair))
    return F.when(found != "", F.try_element_at(names, F.regexp_replace(ascii_lower(found), "[^a-z0-9]", "")))


def _judged(base: DataFrame, n: int, counts: dict[str, int], notices: Sequence[tuple[str, str]], texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, best, held, whole): the best line, window, file or tag, characters in good lines and the best window, whether the file is a licence text."""
    spark = base.sparkSession
    templates = (*notices, *texts)
    idf, other, units = _weights(n, counts, templates)
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()) or [("", 1.0)], "token string, idf double"))
    vectors = F.broadcast(spark.createDataFrame([(t, k, u) for k, unit in enumerate(units) for t, u in unit.items()] or [("", -1, 0.0)], "token string, k int, u double"))
    facts = F.broadcast(spark.createDataFrame([(k, name, k >= len(notices), len(template_tokens(x))) for k, (name, x) in enumerate(templates)] or [(-1, "", False, 0)], "k int, licence string, is_text boolean, most int"))
    held = F.transform(F.split("content", "\n", -1), lambda x: F.struct(line_tokens(x).alias("tokens"), F.length(x).alias("size"), F.rlike(x, F.lit(SPDX)).alias("tagged")))
    lines = written(base.where("content is not null").select("id", F.posexplode(F.filter(held, lambda x: F.size(x["tokens"]) > 0)).alias("l", "x")).select("id", "l", "x.*"), "lines")
    terms = lines.select("id", "l", F.explode("tokens").alias("token")).groupBy("id", "l", "token").agg(F.count("*").alias("tf"))
    terms = written(terms.join(weights, "token", "left").select("id", "l", "token", "tf", F.coalesce("idf", F.lit(other)).alias("idf")), "terms")
    norms = terms.groupBy("id", "l").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("norm"))
    dots = terms.join(vectors, "token").groupBy("id", "l", "k").agg(F.sum(F.col("tf") * F.col("idf") * F.col("u")).alias("dot"))
    rows = written(dots.join(norms, ["id", "l"]).join(facts, "k").withColumn("cosine", F.col("dot") / F.sqrt("norm")), "cosines")
    score = F.round(F.least("cosine", F.lit(1.0)), 6).alias("score")
    single = rows.where("not is_text").select("id", "l", F.struct(score, "licence").alias("best")).groupBy("id", "l").agg(F.max("best").alias("best")).where(F.col("best.score") >= THRESHOLD)
    single = written(single, "good_lines")
    own_line = F.coalesce(F.max(F.when(F.col("best.licence") != RESERVED, F.col("best"))), F.max("best"))
    line_best = single.groupBy("id").agg(F.max("best.score").alias("top"))

    # Starts of windows that can beat the best line, and what each line adds to the length of such a window.
    listed = rows.where("not is_text").withColumn("block", F.floor(F.col("l") / F.col("most")))
    later = listed.select("id", "k", F.explode(F.array("block", F.col("block") - 1)).alias("block"), F.struct("l", "cosine").alias("x"))
    starts = listed.select("id", "k", "l", "block", "most", "licence").join(later, ["id", "k", "block"]).where("x.l >= l").groupBy("id", "k", "l", "most", "licence").agg(F.sum(F.when(F.col("x.l") - F.col("l") < F.col("most"), F.pow("x.cosine", 2))))
    starts = starts.toDF("id", "k", "first", "most", "licence", "bound").join(line_best, "id", "left")
    starts = starts.where((F.col("most") > 1) & (F.coalesce("top", F.lit(0.0)) < 1) & (F.col("bound") >= F.greatest(F.lit(THRESHOLD), F.coalesce("top", F.lit(0.0))) ** 2 - 1e-5))
    starts = written(starts.select("id", "k", "first", "most", "licence"), "starts")
    spans = starts.groupBy("id", "first").agg(F.max("most").alias("most")).select("id", "first", F.explode(F.expr("sequence(first, first + most - 1)")).alias("l"))
    seen = F.coalesce(F.sum("tf").over(W.partitionBy("id", "first", "token").orderBy("l").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    added = spans.join(terms, ["id", "l"]).select("id", "first", "l", (F.pow("idf", 2) * F.col("tf") * (F.col("tf") + 2 * seen)).alias("added")).groupBy("id", "first", "l").agg(F.sum("added").alias("added"))
    lengths = added.select("id", "first", "l", F.sum("added").over(W.partitionBy("id", "first").orderBy("l")).alias("norm"))
    reach = starts.join(lengths, ["id", "first"]).where("l < first + most").join(rows.select("id", "l", "k", "dot"), ["id", "l", "k"])
    upto = W.partitionBy("id", "k", "first").orderBy("l")
    reach = reach.select("id", "first", F.col("l").alias("last"), "licence", (F.sum("dot").over(upto) / F.sqrt("norm")).alias("cosine"))
    window = reach.select("id", F.struct(score, "licence", (F.col("first") - F.col("last")).alias("short"), "first", "last").alias("window")).groupBy("id").agg(F.max("window").alias("window"))
    window = written(window.where(F.col("window.score") >= THRESHOLD), "windows")

    whole = terms.groupBy("id", "token").agg(F.sum(F.col("tf") * F.col("idf")).alias("w"))
    whole_norms = whole.groupBy("id").agg(F.sum(F.pow("w", 2)).alias("norm"))
    whole = whole.join(vectors.where(F.col("k") >= len(notices)), "token").groupBy("id", "k").agg(F.sum(F.col("w") * F.col("u")).alias("dot")).join(whole_norms, "id").join(facts, "k")
    whole = whole.select("id", (F.col("dot") / F.sqrt("norm")).alias("cosine"), "licence").select("id", F.struct(score, "licence").alias("text")).groupBy("id").agg(F.max("text").alias("text")).where(F.col("text.score") >= THRESHOLD)

    tags = base.where("content is not null").select("id", _tag(F.col("content")).alias("tag")).where("tag is not null").select("id", F.struct(F.lit(1.0).alias("score"), F.col("tag").alias("licence")).alias("tag"))
    covered = lines.select("id", "l", "size", "tagged").join(single, ["id", "l"], "left").join(window, "id", "left")
    covered = covered.where(F.col("tagged") | F.col("best").isNotNull() | F.col("l").between(F.col("window.first"), F.col("window.last")))
    covered = covered.groupBy("id").agg(F.sum("size").alias("held"), own_line.alias("line"))
    titles = base.where("title is not null").select("id", F.struct(F.lit(1.0).alias("score"), F.col("title").alias("licence")).alias("title"))
    found = covered.join(window, "id", "full").join(whole, "id", "full").join(tags, "id", "full").join(titles, "id", "full")
    notice = lambda x: F.when(F.col(x)["licence"] != RESERVED, F.col(x))
    best = F.coalesce("title", F.greatest(notice("line"), F.when(F.col("window.licence") != RESERVED, F.struct("window.score", "window.licence")), "text", "tag"), "line")
    return found.select("id", best.alias("best"), "held", (F.col("text").isNotNull() | F.col("title").isNotNull()).alias("whole")).where("best is not null")


def scan_licences(
    files: DataFrame, keep: Sequence[str], path: str = "path", text: str = "text", templates: Sequence[tuple[str, str]] = (*TEMPLATES, *NOTICES), texts: Sequence[tuple[str, str]] = TEXTS
) -> DataFrame:
    """Adds licence, origin (own, inherited or none) and score."""
    every = (*templates, *texts)
    n, counts = token_frequencies(files, text, every)
    kept = [c for c in keep if c not in ("licence", "origin", "score")]
    content = F.coalesce(F.col(text), F.lit(""))
    masses: dict[str, list[float]] = {}
    for k, unit in enumerate(_weights(n, counts, every)[2]):
        for t, u in unit.items():
            masses.setdefault(t, [0.0] * len(every))[k] = u * u
    mass = F.from_json(F.lit(json.dumps(masses)), "map<string,array<double>>")
    sums = F.aggregate(_held(content, set(masses)), F.array_repeat(F.lit(0.0), len(every)), lambda a, t: F.zip_with(a, F.element_at(mass, t), lambda x, y: x + y))
    near = (F.array_max(sums) >= THRESHOLD**2 - 1e-6) | F.rlike(content, F.lit(SPDX))
    base = files.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)), directory(F.col(path)).alias("dir"), F.length(content).alias("size"), F.when(near, content).alias("content"), _titled(content).alias("title"), F.coalesce(F.rlike(path, F.lit(LICENCE_FILE)), F.lit(False)).alias("named"))
    base = written(base.withColumn("id", F.monotonically_increasing_id()), "files")
    found = _judged(base, n, counts, templates, texts)
    covers = F.coalesce(F.col("whole") | F.col("named") | (2 * F.coalesce("held", F.lit(0)) >= F.col("size")), F.lit(False)) & F.col("best").isNotNull()
    rows = written(base.drop("content").join(found, "id", "left").select(*(f"k{i}" for i in range(len(kept))), "dir", "best", covers.alias("covers")), "licences")
    licensed = rows.where("covers and dir is not null").groupBy("dir").agg(F.max("best").alias("found"))
    parts = F.split("dir", "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    asked = rows.where("best is null and dir is not null").select("dir").distinct().select("dir", F.explode(up).alias("x")).select("dir", "x.depth", "x.above")
    nearest = asked.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("found", "depth").alias("found"))
    nearest = written(nearest, "nearest")
    out = rows.join(nearest, "dir", "left")
    answer = F.coalesce("best", "found")
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), answer["licence"].alias("licence"),
        F.when(F.col("best").isNotNull(), "own").when(F.col("found").isNotNull(), "inherited").otherwise("none").alias("origin"), answer["score"].alias("score"),
    )
