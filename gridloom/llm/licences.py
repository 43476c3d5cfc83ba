"""Licences of files: their own, by sparse TF-IDF cosine to templates, or of the nearest directory above.

What is compared are the lines of a text that speak of licences, the paragraphs that have such lines
(a header runs over several), and the whole text of a licence file. Each is a vector over words;
templates are headers and whole licence texts. The vocabulary is that of the templates, so the
document frequencies are a bounded table however large the corpus is; they are counted over all
that is compared. Words outside of it count as never seen, which makes a vector longer and its
cosines smaller. What is the same in many texts is compared once.

A file without a licence of its own takes that of the nearest directory above it which has a licence
file. That is settled for directories, by joining each to the paths above it, and then joined to the
files; at most one row a directory meets them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, swept, text_of

# Headers that name licences, and the texts of the short ones.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "MIT": (
        "Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT",
        """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    "MPL-2.0": ("Subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "proprietary": ("All rights reserved", "No part of this work may be reproduced without permission"),
}
SIGNS = r"(?i)licen[cs]|copyright|spdx|rights reserved|hereby granted|redistribut|permission|creative commons"
LIKE = 0.6
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _units(text: Column, whole: Column) -> Column:
    """What of a text is compared, each once: lines and paragraphs with a sign, and all of a licence file."""
    speaks = lambda x: x.rlike(SIGNS)
    parts = F.concat(F.filter(F.split(text, "\n"), speaks), F.filter(F.split(text, "\n\\s*\n"), speaks))
    return F.when(speaks(text), F.array_distinct(F.concat(parts, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def _vocabulary() -> list[str]:
    return sorted({t for all_said in TEMPLATES.values() for said in all_said for t in re.findall(TOKEN, said.lower())})


def _frequencies(units: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many units there are, and how many have each word of the vocabulary."""
    words = F.array_intersect(_tokens(F.col("unit")), F.array(*map(F.lit, vocabulary)))
    counted = units.select("n", F.explode(F.array_append(words, F.lit(""))).alias("t"))
    found = dict(tuple(r) for r in counted.groupBy("t").agg(F.sum("n")).collect())  # one row a word of the templates, at most
    return found.pop("", 0), found


def _inverse(total: int, frequency: int) -> float:
    return math.log((1 + total) / (1 + frequency)) + 1


def _template_vectors(total: int, frequency: dict[str, int]) -> list[tuple[str, dict[str, float]]]:
    """(licence, word -> weight) of each template, of length one."""
    out = []
    for name, all_said in TEMPLATES.items():
        for said in all_said:
            found = re.findall(TOKEN, said.lower())
            vector = {t: found.count(t) * _inverse(total, frequency.get(t, 0)) for t in found}
            size = math.sqrt(sum(x * x for x in vector.values()))
            out.append((name, {t: x / size for t, x in vector.items()}))
    return out


def _scored(units: DataFrame, vocabulary: list[str]) -> DataFrame:
    """units: u (its number), unit, n (how many times it is there). unit, score and licence of the best template, ties to the first.

    A unit's vector is rows of (word, weight); so are the templates', which are bounded and broadcast.
    """
    spark = units.sparkSession
    total, frequency = _frequencies(units, vocabulary)
    vectors = _template_vectors(total, frequency)
    postings = spark.createDataFrame([(t, k, float(w)) for k, (_, vector) in enumerate(vectors) for t, w in vector.items()], "word string, template int, share double")
    inverse = spark.createDataFrame([(t, _inverse(total, frequency.get(t, 0))) for t in vocabulary], "word string, inverse double")
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(vectors)], "template int, licence string")
    words = units.select("u", F.explode(_tokens(F.col("unit"))).alias("word")).groupBy("u", "word").agg(F.count(F.lit(1)).alias("n"))
    weighed = words.join(F.broadcast(inverse), "word", "left").select("u", "word", (F.col("n") * F.coalesce("inverse", F.lit(_inverse(total, 0)))).alias("weight"))
    size = weighed.groupBy("u").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    dots = weighed.join(F.broadcast(postings), "word").groupBy("u", "template").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    cosine = dots.join(size, "u").select("u", F.round(F.col("dot") / F.col("size"), 12).alias("score"), "template")
    best = cosine.groupBy("u").agg(F.max(F.struct("score", (-F.col("template")).alias("first"))).alias("b"))
    best = best.select("u", "b.score", (-F.col("b.first")).alias("template")).join(F.broadcast(names), "template")
    return best.join(units.select("u", "unit"), "u").select("unit", "score", "template", "licence")


def licences(df: DataFrame, id_col: str, path_col: str, text_col: str, licence_file: Column, like: float = LIKE) -> DataFrame:
    """One row for each row of df: id, path, own, score, licence, via, from_dir.

    own: the licence of the likest of the text's lines and paragraphs, and, of a licence file, of
    its whole text, at `like` or above, ties to the first template; licence: own, or that of the
    nearest directory above with a licence file (in one directory, the likest, then the smallest
    id, null first); via: own, inherited or none. licence_file says, over df's columns, which rows
    are licence files. A null text has no lines; a null path has no directory and inherits nothing.
    Repeated rows and rows of null ids each give a row. An empty table gives an empty result.
    """
    vocabulary, whole = _vocabulary(), F.coalesce(licence_file, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), whole.alias("is_file"), _units(text_of(text_col), whole).alias("units"))
    rows = rows.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)
    units = rows.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    units = cut(units.withColumn("u", F.monotonically_increasing_id()))
    best = swept(cut(_scored(units, vocabulary)))
    mine = rows.select("row", F.explode("units").alias("unit")).join(best, "unit").groupBy("row").agg(F.max(F.struct("score", (-F.col("template")).alias("first"), "licence")).alias("b"))
    rows = cut(rows.join(mine, "row", "left").select("id", "path", "dir", "is_file", F.when(F.col("b.score") >= like, F.col("b.licence")).alias("own"), F.coalesce("b.score", F.lit(0.0)).alias("score")), units)
    files = rows.filter("is_file AND own IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "own")).alias("f"))
    files = files.select(F.col("dir").alias("above"), F.col("f.own").alias("given"))
    dirs = rows.filter("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above"))
    nearest = above.join(files, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("m"))
    # One row a directory, in a table of its own: a hot directory's rows can then be split.
    out = rows.join(cut(nearest), "dir", "left")
    return out.select(
        F.col("id").alias(id_col), "path", "own", "score", F.coalesce("own", "m.given").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("m.given").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(F.col("own").isNull(), F.col("m.above")).alias("from_dir"),
    )
