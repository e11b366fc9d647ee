"""Licence notices by Dice coefficient over word bigrams, with DataFrame expressions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
#: Licence notices and short licences as their stewards publish them; fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0 header": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD": [_BSD_START, "Use of this source code is governed by a BSD-style license."],
    "BSD-2-Clause": [f"{_BSD_START} {_BSD_TWO} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD_START} {_BSD_TWO} {_BSD_THREE} {_BSD_END}"],
    "BSL-1.0 header": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0 header": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + _GPL_END.format("")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-3.0 header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GPL_END.format(""),
    ],
    "ISC": [f'{_ISC} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "ISC permission": [_ISC],
    "LGPL-2.1 header": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. " + _GPL_END.format("Lesser ").replace("program", "library")],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"],
    "MIT permission": [_MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z in lower case, divided at everything ASCII that is no letter or digit."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAPS), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """The pairs of neighbouring words; of the last word with nothing, null."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    return F.array_distinct(F.array_compact(pairs_of(words)))


def _python_words(text: str) -> list[str]:
    return re.sub(_GAPS, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()


def _known(templates: dict[str, list[str]], least: float) -> list[tuple]:
    """(licence, bigrams, words, stride, fewest common bigrams, fewest and most bigrams of a unit)."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            words = _python_words(text)
            own = list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))
            low = len(own) * least / (2 - least)
            out.append((name, own, len(words), max(1, len(words) // 8), math.ceil(low - 1e-9), low, len(own) * (2 - least) / least))
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, license, dice, line_no, n_matches.

    docs: doc_id and text; other columns are ignored. Units of comparison are the lines of the
    whole text, the whole text (line_no 0) and, for each template of w words, all
    windows of w words that start at every max(1, w // 8)-th word, whatever lines they
    are wrapped over (line_no is that of the first word). So a notice inside a longer line or
    paragraph is found too. license and dice are those of the best unit, of the smallest line_no
    and then of the first name in order among equals; all three are null without a match of `least`
    or more. n_matches counts the templates that some unit matches. Null and empty texts match
    nothing; repeated rows are scanned each for itself; an empty table gives no rows. Nothing is shuffled.

    A template of m pairs reaches `least` only against units of m * least / (2 - least)
    to m * (2 - least) / least pairs, and only if m * least / (2 - least) of its own pairs are in
    the unit, so in the text: of most texts one intersection with the pairs of all templates is made.
    """
    known = _known(TEMPLATES if templates is None else templates, least)
    pairs = sorted({p for k in known for p in k[1]})
    strings = lambda v: F.array(*map(F.lit, v)) if v else F.expr("cast(array() as array<string>)")
    table = F.array(*[
        F.struct(
            F.lit(name).alias("license"), strings(own).alias("own"), F.lit(w).alias("w"), F.lit(stride).alias("stride"),
            F.lit(need).alias("need"), F.lit(low).alias("low"), F.lit(high).alias("high"),
        )
        for name, own, w, stride, need, low, high in known
    ]) if known else F.expr("cast(array() as array<struct<license:string,own:array<string>,w:int,stride:int,need:int,low:double,high:double>>)")

    def best(t: Column) -> Column:
        """struct<dice, line> of the best unit against one template."""

        def compared(unit: Column, line: Column) -> Column:
            found = bigrams(unit)
            dice = 2.0 * F.size(F.array_intersect(found, t["own"])) / (F.size(found) + F.size(t["own"]))
            return F.when(
                (F.size(unit) > t["low"]), F.struct(F.when(F.size(found).between(t["low"], t["high"]), dice).otherwise(0.0).alias("dice"), (-line).alias("line"))
            )

        by_line = F.transform("lines", lambda words, i: compared(words, i + 1))
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), t["stride"])

        def windows(hits: Column) -> Column:  # those with a pair of the template; no other can match
            near = F.filter(starts, lambda a: F.exists(hits, lambda p: p.between(a, a + t["w"] - 2)))
            return F.transform(near, lambda a: compared(F.slice("words", a + 1, t["w"]), F.get("line_of", a)))

        hits = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains(t["own"], p), i)), lambda i: i.isNotNull())
        found = F.get(F.transform(F.array(hits), windows), F.lit(0))
        return F.array_max(F.concat(by_line, F.array(compared(F.col("words"), F.lit(0))), found))

    rows = docs.select("doc_id", "text", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.select("doc_id", "text", "words", F.array_intersect(pairs_of(F.col("words")), strings(pairs)).alias("seen"))
    line_of = F.flatten(F.transform("lines", lambda words, i: F.array_repeat(i + 1, F.size(words))))
    possible = F.filter(table, lambda t: F.size(F.array_intersect("seen", t["own"])) >= t["need"])
    rows = rows.select("doc_id", "text", "words", F.when(F.size("seen") > 0, possible).alias("possible"))
    lines = F.when(F.size("possible") > 0, F.transform(F.split("text", "\n"), words_of))
    rows = rows.select("doc_id", lines.alias("lines"), "words", "possible")
    some = F.size("possible") > 0
    rows = rows.select("doc_id", "lines", "words", "possible", F.when(some, line_of).alias("line_of"), F.when(some, pairs_of(F.col("words"))).alias("pairs"))
    hits = F.when(
        F.size("possible") > 0,
        F.filter(F.transform("possible", lambda t: F.struct(best(t).alias("best"), t["license"].alias("license"))), lambda h: h["best"]["dice"] >= least),
    )
    top = F.array_max(F.transform("hits", lambda h: h["best"]))
    return rows.select("doc_id", hits.alias("hits")).select(
        "doc_id",
        F.array_min(F.transform(F.filter("hits", lambda h: h["best"] == top), lambda h: h["license"])).alias("license"),
        F.round(top["dice"], 6).alias("dice"), (-top["line"]).cast("long").alias("line_no"),
        F.coalesce(F.when(F.size("hits") >= 0, F.size("hits")), F.lit(0)).cast("long").alias("n_matches"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def oracle(least: float = 0.8) -> str:
    """The same in DuckDB's SQL, every unit compared with every template of its size.

    Only templates of which a text has enough pairs at all are compared with its units.
    """
    rows = ", ".join(f"({i}, '{name}', {_sql_list(own)}, {w}, {stride})" for i, (name, own, w, stride, *_) in enumerate(_known(TEMPLATES, least)))
    return f"""
WITH templates(t, license, own, w, stride) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_transform(string_split(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), chr(10)), lambda l: list_filter(string_split_regex(l, '{_GAPS}'), lambda x: x <> '')) AS lines
  FROM documents
), e AS (
  SELECT r, flatten(lines) AS words, flatten(list_transform(range(1, len(lines) + 1), lambda i: list_transform(lines[i], lambda x: i))) AS line_of FROM d
), c AS (
  SELECT r, t FROM (SELECT r, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS seen FROM e), templates
  WHERE len(list_filter(own, lambda x: list_contains(seen, x))) * {2 - least} >= len(own) * {least} - 1e-9
), u AS (
  SELECT r, unnest(lines) AS unit, generate_subscripts(lines, 1) AS line_no, NULL AS t FROM d SEMI JOIN c USING (r)
  UNION ALL SELECT r, words, 0, NULL FROM e SEMI JOIN c USING (r)
  UNION ALL SELECT r, words[a + 1 : a + w], line_of[a + 1], t
  FROM (SELECT r, words, line_of, t, w, unnest(range(0, len(words), stride)) AS a FROM e JOIN c USING (r) JOIN templates USING (t) WHERE len(words) > 0)
), b AS (
  SELECT r, line_no, t, list_distinct(list_transform(range(1, len(unit)), lambda i: unit[i] || ' ' || unit[i + 1])) AS pairs FROM u WHERE len(unit) > 1
), m AS (
  SELECT r, line_no, license, p.t, 2.0 * len(list_intersect(pairs, own)) / (len(pairs) + len(own)) AS dice
  FROM b JOIN c USING (r) JOIN templates p ON p.t = c.t AND (b.t IS NULL OR b.t = p.t) AND 2.0 * least(len(pairs), len(own)) / (len(pairs) + len(own)) >= {least}
), a AS (
  SELECT r, count(DISTINCT t) AS n, max(dice) AS dice, arg_min(license, (-dice, line_no, license)) AS license, arg_min(line_no, (-dice, line_no)) AS line_no
  FROM m WHERE dice >= {least} GROUP BY r
)
SELECT doc_id, license, round(CAST(dice AS DOUBLE), 6) AS dice, CAST(line_no AS BIGINT) AS line_no, coalesce(n, 0) AS n_matches FROM d LEFT JOIN a USING (r)
"""
