"""Licence scan: notices in texts compared with templates by Dice coefficient over word bigrams.

A whole text is normalised to lower-case words, across line ends. A template of B distinct bigrams can only reach
a Dice coefficient t with a window of B*t/(2-t) to B*(2-t)/t bigrams that shares B*t/(2-t) of its own; texts that
hold fewer of a template's bigrams never meet it. In the others a window that starts or ends with a bigram that the
template lacks is no better than the shorter one, so windows run from shared bigram to shared bigram. The templates
are a constant of the plan; all is expressions inside rows, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import let, table

#: Licence notices. (licence id, text)
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("proprietary", "All rights reserved."),
]

#: Whole short licences, without their copyright lines. (licence id, text)
BODIES = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
]


def normalised_words(text: str) -> list[str]:
    """The normalisation of templates; :func:`line_words` is the same rule for columns."""
    return [w for w in re.split(r"[^a-z0-9.+]+", re.sub(r"[.]+(?![0-9])", " ", text.lower())) if w]


def bigram_set(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def line_words(line: Column) -> Column:
    """Lower-case words of letters, digits, ``+`` and inner dots (as in ``2.0``)."""
    flat = F.regexp_replace(F.lower(line), r"[.]+(?![0-9])", " ")
    return F.filter(F.split(flat, r"[^a-z0-9.+]+"), lambda w: w != "")


def version_words(words: list[str]) -> list[str]:
    return sorted({w for w in words if re.fullmatch(r"[0-9]+([.][0-9]+)*", w)})


def windows(w: Column, g: Column, grams: Column, versions: Column, license: Column, threshold: float) -> Column:
    """``start, end, dice, license`` (bigram positions from 1) of all windows of a text that reach ``threshold``."""
    size = F.size(grams)
    high = (2 - threshold) / threshold
    hits = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(grams, F.element_at(g, i)))

    def between(a: Column, b: Column) -> Column:
        part = F.array_distinct(F.slice(g, a, b - a + 1))
        said = F.array_distinct(F.filter(F.slice(w, a, b - a + 2), lambda x: x.rlike(r"^[0-9]+([.][0-9]+)*$")))
        agree = (F.size(versions) == 0) | ((F.size(said) == F.size(versions)) & (F.size(F.array_except(versions, said)) == 0))
        dice = F.when(agree, 2.0 * F.size(F.array_intersect(part, grams)) / (F.size(part) + size))
        return F.struct(a.alias("start"), b.alias("end"), dice.alias("dice"), license.alias("license"))

    def from_start(hits: Column, a: Column, i: Column) -> Column:
        # The windows' ends are among the next hits; a window has as many bigrams as its bounds allow.
        ends = F.slice(hits, i + 1, F.ceil(size * high + 1e-9).cast("int"))
        near = F.filter(ends, lambda b: (b - a + 1 <= size * high + 1e-9) & (b - a + 1 >= size / high - 1e-9))
        return F.filter(F.transform(near, lambda b: between(a, b)), lambda x: x["dice"] >= threshold)

    return let(hits, lambda h: F.flatten(F.transform(h, lambda a, i: from_start(h, a, i))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + BODIES, threshold: float = 0.9) -> DataFrame:
    """``doc_id, license, dice, line_no, n_matches, line`` of every document; nulls where nothing matches.

    Windows of a text are compared, wherever its lines end; where a template has version numbers, the window must
    have the same. The best match of a document is that of the highest Dice coefficient, then the first, then the
    licence's name; "proprietary" (All rights reserved) comes after all others, as most licences stand beside it.
    ``line_no`` and ``line`` are of the window's first word, ``n_matches`` counts places: windows that overlap are
    one. Null and empty texts match nothing, and repeated rows each get their row. Templates of one word have no
    bigram and never match.
    """
    ready = [(name, normalised_words(text)) for name, text in templates]
    ready = [(name, bigram_set(words), version_words(words)) for name, words in ready if bigram_set(words)]
    text = F.coalesce(F.col("text"), F.lit(""))
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    found = "array<struct<start:int,end:int,dice:double,license:string>>"

    def with_words(w: Column) -> Column:
        grams = F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(
            F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        )
        return let(grams, lambda g: with_grams(w, g))

    def with_grams(w: Column, g: Column) -> Column:
        low = threshold / (2 - threshold)
        known = F.array_intersect(g, strings(sorted({x for _, t, _ in ready for x in t})))
        shapes = F.array(*[F.struct(F.lit(n).alias("license"), strings(t).alias("grams"), strings(v).alias("versions")) for n, t, v in ready])

        def with_known(k: Column) -> Column:
            possible = F.filter(shapes, lambda t: F.size(F.array_intersect(k, t["grams"])) >= F.size(t["grams"]) * low - 1e-9)
            every = F.transform(possible, lambda t: windows(w, g, t["grams"], t["versions"], t["license"], threshold))
            return F.when(F.size(k) >= min(len(t) for _, t, _ in ready) * low - 1e-9, F.flatten(every)).otherwise(F.array().cast(found))

        return let(known, with_known)

    matches = let(line_words(text), with_words) if ready else F.array().cast(found)
    rank = lambda x: F.struct((x["license"] == "proprietary").alias("p"), (-x["dice"]).alias("d"), x["start"].alias("s"), x["license"].alias("l"))
    best = F.array_min(F.transform("_m", rank))
    places = F.aggregate(
        F.array_sort("_m"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.when(x["start"] > a["end"], 1).otherwise(0)).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    # Lines that end before the window's first word.
    ends = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit(0).alias("no"), F.lit(0).alias("words")),
        lambda a, line: let(
            a["words"] + F.size(line_words(line)),
            lambda n: F.struct((a["no"] + F.when(n < F.col("_b.s"), 1).otherwise(0)).alias("no"), n.alias("words")),
        ),
        lambda a: a["no"],
    )
    none = F.size("_m") == 0
    return (
        docs.select("doc_id", "text", matches.alias("_m"))
        .withColumn("_b", F.when(~none, best))
        .withColumn("_no", F.when(~none, ends))
        .select(
            "doc_id",
            F.col("_b.l").alias("license"),
            F.round(-F.col("_b.d"), 6).alias("dice"),
            F.col("_no").alias("line_no"),
            F.when(none, F.lit(0).cast("long")).otherwise(places).alias("n_matches"),
            F.when(~none, F.get(F.split(text, "\n"), F.col("_no"))).alias("line"),
        )
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
