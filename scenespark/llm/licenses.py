"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Headers are a text's lines, and its sentences with their lines joined, so that wrapped notices
are whole. A licence file is a text that as a whole is close to a whole licence, or one that is named as
such files are and has a header. A document's own licence is that of its closest header; one
without takes that of the licence file in its nearest ancestor directory. DataFrame functions only.

Document frequencies are over the templates, so that weights are known before any text is
read. That gives a prefilter without loss: by the Cauchy-Schwarz inequality a text cannot
reach the threshold for a template if it has none of the terms that hold all but the threshold's square of
the template's squared weight. Only texts, and lines and sentences, with one of these terms for some template are
counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
SPACE = r"[\x20\x09-\x0D]+"
# Words of English that say nothing of a licence, no terms on either side.
STOP = tuple(
    """
    a all an and any are as at be been by can do for from has have if in into is it its may no not of on or other our out so such that the
    their there these they this to upon use was we were which who whom will with without you your
    """.split()
)
#: Names of licence files.
NAMED = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"

# Licences and how notices of them commonly read.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Proprietary", "Copyright. All rights reserved."),
)
# Whole licences, as files of their own commonly read. Longer ones are a parameter.
FILES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
)


def terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)), lambda t: ~t.isin(*STOP))


def plain_terms(text: str) -> list[str]:
    return [t for t in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower()) if t not in STOP]


def weighed(templates: tuple[tuple[str, str], ...]) -> tuple[float, dict[str, float], list[dict[str, float]]]:
    """The idf of terms in no template, that of the others, and each template's unit weights."""
    counts = [Counter(plain_terms(text)) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for c in counts:
        w = {t: (math.log(n) + 1) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return math.log(1 + len(templates)) + 1, idf, out


def needed(weights: list[dict[str, float]], at: float) -> list[str]:
    """Terms of which every text has one whose cosine to one of the templates is ``at`` or more.

    Terms of more than three characters come first, being rarer in other texts, and of those the ones that
    cover most of what is left over all templates.
    """
    spare = [1 - at * at * (1 - 1e-9)] * len(weights)  # squared weight that is still to be covered
    cover: list[str] = []
    while max(spare, default=0.0) > 0:
        gain = Counter()
        for w, left in zip(weights, spare, strict=True):
            for t, x in w.items():
                if left > 0 and t not in cover:
                    gain[t] += min(x * x, left)
        best = min(gain, key=lambda t: (len(t) <= 3, -gain[t], t))
        cover.append(best)
        spare = [left - w.get(best, 0.0) ** 2 for w, left in zip(weights, spare, strict=True)]
    return sorted(cover)


def found_by(words: list[str]) -> str:
    """An expression for texts with one of the words, which goes character by character down the words' common beginnings."""

    def branch(some: list[str]) -> str:
        rest = [w for w in some if w]
        each = [re.escape(h) + branch([w[1:] for w in rest if w[0] == h]) for h in sorted({w[0] for w in rest})]
        whole = each[0] if len(each) == 1 else f"(?:{'|'.join(each)})" if each else ""
        return whole if len(rest) == len(some) else f"(?:{whole})?" if rest else ""

    # a term begins and ends where no letter or digit is beside it
    return rf"(?<![\p{{L}}\p{{N}}])(?=[{''.join(sorted({re.escape(w[0]) for w in words}))}])" + branch(words) + r"(?![\p{L}\p{N}])" if words else "(?!)"


def license_scan(docs: DataFrame, path: Column | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, files: tuple[tuple[str, str], ...] = FILES, header_at: float = 0.6, file_at: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, path, own_license, own_score, file_license, inherited_license, inherited_from, license.

    ``path`` has / between directories; null: no directory, nothing is inherited. Ties of
    the score go to the licence that is first in code point order, ties of files in a directory to the
    higher score, the licence and the path in order. Null and empty texts
    have no licence of their own; texts of any length are read whole. Rows are told apart by a row key, so that repeated ids
    and null ids each keep a row; an empty table gives no rows; clashing names
    of other columns do not matter, as they are not read.
    """
    spark = docs.sparkSession
    every = (*templates, *files)
    other, idf, unit_weights = weighed(every)
    head, whole = needed(unit_weights[: len(templates)], header_at), needed(unit_weights[len(templates) :], file_at)
    where = (F.lit(None) if path is None else path).cast("string").alias("path")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), where, F.col("text").cast("string").alias("text"))
    has = lambda c, what: F.coalesce(F.lower(c).rlike(what), F.lit(False))
    either = found_by(sorted({*head, *whole}))
    head, whole = found_by(head), found_by(whole)
    rows = rows.select(id_col, "path", F.when(has(F.col("text"), either), F.col("text")).alias("text"))
    keyed = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    # A text's parts stay where the text is dealt to, so that counting needs no other shuffle.
    hits = keyed.where("text is not null").select("row", "text").repartition("row")
    sentences = F.split(F.regexp_replace(F.regexp_replace("text", SPACE, " "), "([.;!?]) ", "$1\n"), "\n")
    parts = hits.select("row", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"), sentences)).alias("unit", "part"))
    units = parts.where(F.when(F.col("unit") == 0, has(F.col("part"), whole)).otherwise(has(F.col("part"), head)))
    counts = units.select("row", "unit", F.explode(terms(F.col("part"))).alias("term")).groupBy("row", "unit", "term").agg((F.log(F.count(F.lit(1))) + 1.0).alias("tf"))
    # A row per term of the templates, which are a parameter: broadcast, and with it the templates' weights.
    side = spark.createDataFrame([(t, idf[t], [w.get(t, 0.0) for w in unit_weights]) for t in idf], "term string, idf double, w array<double>")
    value = F.col("tf") * F.coalesce("idf", F.lit(other))
    dots = [F.sum(F.when(F.col("w").isNotNull(), value * F.get("w", F.lit(t))).otherwise(0.0)).alias(f"d{t}") for t in range(len(every))]
    scored = counts.join(F.broadcast(side), "term", "left").groupBy("row", "unit").agg(F.sqrt(F.sum(value * value)).alias("norm"), *dots)
    names = sorted({who for who, _ in every})

    def best(of: range) -> Column:
        """The greatest score, and for equal scores the first name."""
        return F.array_max(F.array(*[F.struct(F.round(F.col(f"d{t}") / F.col("norm"), 9).alias("score"), F.lit(-names.index(every[t][0])).alias("k")) for t in of]))

    is_file = F.col("unit") == 0
    found = scored.select("row", is_file.alias("file"), F.when(is_file, best(range(len(templates), len(every)))).otherwise(best(range(len(templates)))).alias("b"))
    found = found.select("row", "file", F.col("b.score").alias("score"), F.col("b.k").alias("k")).where(F.when(F.col("file"), F.col("score") >= file_at).otherwise(F.col("score") >= header_at))
    per = found.groupBy("row").agg(F.max(F.when(~F.col("file"), F.struct("score", "k"))).alias("h"), F.max(F.when(F.col("file"), F.struct("score", "k"))).alias("f"))
    order = F.array(*[F.lit(x) for x in names])
    named = lambda c: F.when(F.col(c).isNotNull(), F.element_at(order, 1 - F.col(f"{c}.k")))
    own = per.select("row", named("h").alias("h_license"), F.col("h.score").alias("h_score"), named("f").alias("f_license"), F.col("f.score").alias("f_score"))
    # A file that is a licence as a whole has that licence before that of a line in it.
    called = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(NAMED), F.lit(False))
    own = keyed.drop("text").join(own, "row", "left").select(
        "row",
        id_col,
        "path",
        F.coalesce("f_license", "h_license").alias("own_license"),
        F.coalesce("f_score", "h_score").alias("own_score"),
        F.coalesce(F.col("f_license"), F.when(called, F.col("h_license"))).alias("file_license"),
        F.coalesce(F.col("f_score"), F.when(called, F.col("h_score"))).alias("file_score"),
    )
    own = checkpoint(own)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    files = own.where("file_license is not null and path is not null").select(folder.alias("dir"), "file_license", "file_score", "path")
    files = files.groupBy("dir").agg(F.min_by("file_license", F.struct(-F.col("file_score"), "file_license", "path")).alias("dir_license"))
    bare = own.where("own_license is null and path is not null")
    steps = F.split(folder, "/")
    up = bare.select("row", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("depth", "dir"))
    near = up.join(files, "dir").groupBy("row").agg(F.max_by(F.struct("dir_license", "dir"), "depth").alias("from"))
    out = own.join(near.select("row", F.col("from.dir_license").alias("inherited_license"), F.col("from.dir").alias("inherited_from")), "row", "left")
    return out.select(id_col, "path", "own_license", F.round("own_score", 6).alias("own_score"), "file_license", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))
