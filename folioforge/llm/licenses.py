"""Licence scan: Dice coefficient over word bigrams against templates.

A document's lines, paragraphs and whole text are its units.  A unit is
normalised (lower case, other characters than a-z and 0-9 as spaces) and its
set of word bigrams compared with each template's.  Dice >= t forces
t / (2 - t) <= |unit| / |template| <= (2 - t) / t, so templates outside those
size bounds are never compared, and a unit is cut into bigrams only if it has
words enough for the least of them, one of the words that no match can do
without, and in its beginning no more different bigrams than the largest allows.  All of it runs within the row, in SQL expressions.

Defined results: null and empty texts have no unit and no licence; of equal
scores the template that sorts first is reported; repeated rows report alike;
with no template there is no match; other columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Identifier, and the names that notices call a licence by.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0 License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "New BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2", "GPL-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3", "GPL-3.0 License"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
}
#: The sentences that notices put such a name in.
NOTICES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is licensed under the {}.", "This project is licensed under the {} - see the LICENSE file for details.", "This software is released under the {}.",
)
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, "
    "or (at your option) any later version."
)
_GNU_WARRANTY = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {0}General Public License for more details."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = (
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law. "
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_REST = (
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
#: Licence texts and notices as they are commonly written, short licences in full, and the openings that stand for longer ones.
TEXTS = {
    "AGPL-3.0": [_GNU.format(":", "Affero ", ",", "3"), _GNU.format(":", "Affero ", ",", "3") + _GNU_WARRANTY.format("Affero ")],
    "Apache-2.0": [_APACHE, _APACHE + _APACHE_REST],
    "BSD-2-Clause": [f"{_BSD} {_BSD_TWO}{_BSD_WARRANTY}"],
    "BSD-3-Clause": [_BSD, f"{_BSD} {_BSD_TWO}{_BSD_THREE}{_BSD_WARRANTY}"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": [_GNU.format(";", "", ";", "2"), _GNU.format(";", "", ";", "2") + _GNU_WARRANTY.format("")],
    "GPL-3.0": [_GNU.format(":", "", ",", "3"), _GNU.format(":", "", ",", "3") + _GNU_WARRANTY.format("")],
    "ISC": [_ISC, f"{_ISC} {_ISC_WARRANTY}"],
    "LGPL-3.0": [_GNU.format(":", "Lesser ", ",", "3"), _GNU.format(":", "Lesser ", ",", "3") + _GNU_WARRANTY.format("Lesser ")],
    "MIT": [_MIT, f"{_MIT} {_MIT_REST} {_WARRANTY}", f"MIT License {_MIT} {_MIT_REST} {_WARRANTY}"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["Copyright. All rights reserved. No part of this work may be reproduced without permission."],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE}{_UNLICENSE_REST}{_WARRANTY}"],
}
#: All templates: the texts, each name in each notice, and the identifier's tag line.
TEMPLATES = {
    key: [*TEXTS.get(key, []), *(n.format(name) for name in NAMES.get(key, []) for n in NOTICES), *([f"SPDX-License-Identifier: {key}"] if key in NAMES else [])] for key in sorted(TEXTS.keys() | NAMES.keys())
}


_PLAIN = set("a all an and any as at be by do for from in is it its not of on or so such that the then there this to under use was we with work you".split())


def _bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _templates(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    made = {(name, tuple(grams)) for name, texts in templates.items() for t in texts if (grams := _bigrams(t))}
    return [(name, list(grams)) for name, grams in sorted(made)]


def _markers(known: list[tuple[str, list[str]]], up: int, of: int) -> list[str]:
    """Words of which every unit that reaches the threshold has one: without them it could share too few bigrams with any template.

    A match shares at least t / (2 - t) of the template's bigrams.  Of each
    template the longest words are taken, words of all prose last, until fewer
    bigrams are without.
    """
    out: set[str] = set()
    for _, grams in known:
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w in _PLAIN, w not in out, -len(w), w))
        bare = set(grams)
        for w in words:
            if len(bare) * (2 * of - up) < up * len(grams):
                break
            out.add(w)
            bare = {g for g in bare if w not in g.split()}
    return sorted(out)


def _rational(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers: comparisons stay exact."""
    return round(threshold * 1000), 1000


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with license (null if none), score (its Dice coefficient, else 0) and n_license_units."""
    known = _templates(templates)
    out = docs.drop("license", "score", "n_license_units")
    if not known:
        return out.withColumns({"license": F.lit(None).cast("string"), "score": F.lit(0.0), "n_license_units": F.lit(0)})
    up, of = _rational(threshold)
    least = min(len(g) for _, g in known) * up // (2 * of - up)
    most = max(len(g) for _, g in known) * (2 * of - up) // up
    sets = "array({})".format(", ".join("named_struct('name', '{}', 'grams', array({}))".format(n, ", ".join(f"'{x}'" for x in g)) for n, g in known))
    whole = F.coalesce(F.col(text), F.lit(""))
    units = F.array_distinct(F.concat(F.split(whole, "\n"), F.split(whole, r"\n[ \t\r]*\n"), F.array(whole)))
    # sizes first: bigrams are cut for units whose number of words can reach a template, and of long units
    # only where their beginning has no more different ones than a match may have
    markers = "array({})".format(", ".join(f"'{w}'" for w in _markers(known, up, of)))
    words = F.expr(f"filter(transform(_units, u -> filter(split(regexp_replace(lower(u), '[^a-z0-9]+', ' '), ' '), x -> x <> '')), w -> size(w) > {least} and arrays_overlap(w, {markers}))")
    cut = "array_distinct(zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> concat(a, ' ', b)))"
    head = f"slice(w, 1, {2 * most + 1})"
    fits = F.expr(f"filter(_words, w -> size(w) <= {2 * most + 1} or size({cut.format(w=head)}) <= {most})")
    grams = F.expr(f"filter(transform(_words, w -> {cut.format(w='w')}), g -> size(g) <= {most})")
    within = f"size(g) * {2 * of - up} >= {up} * size(t.grams) and size(g) * {up} <= {2 * of - up} * size(t.grams)"
    # per unit, the templates within its size bounds that reach the threshold
    matches = F.expr(
        f"filter(transform(_grams, g -> array_sort(filter(transform(filter(_sets, t -> {within}), "
        f"t -> named_struct('at', -2.0D * size(array_intersect(g, t.grams)) / (size(g) + size(t.grams)), 'name', t.name)), m -> m.at * {of} <= -{up}))), h -> size(h) > 0)"
    )
    best = F.array_min(F.transform("_matches", lambda m: m[0]))
    return (
        out.withColumn("_units", units)
        .withColumn("_words", words)
        .withColumn("_words", fits)
        .withColumn("_grams", grams)
        .withColumn("_sets", F.expr(sets))
        .withColumn("_matches", matches)
        .withColumns({"license": best["name"], "score": F.coalesce(-best["at"], F.lit(0.0)), "n_license_units": F.size("_matches")})
        .drop("_units", "_words", "_grams", "_sets", "_matches")
    )


def oracle() -> str:
    """DuckDB SQL with the rows of ``op1_license_scan``."""
    up, of = _rational(THRESHOLD)
    rows = ", ".join("('{}', {}, [{}])".format(n, len(g), ", ".join(f"'{x}'" for x in g)) for n, g in _templates(TEMPLATES))
    return f"""
    with t(name, size, grams) as (values {rows}),
    d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    u as (select distinct rid, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])) as unit from d),
    w as (select rid, unit, regexp_extract_all(lower(unit), '[a-z0-9]+') as words from u),
    g as (select rid, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams from w where len(words) > 1),
    m as (select rid, unit, name, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + size) as dice
          from g join t on len(g.grams) * {2 * of - up} >= {up} * size and len(g.grams) * {up} <= {2 * of - up} * size),
    b as (select rid, arg_min(name, (-dice, name)) as license, max(dice) as score, count(distinct unit) as n from m where dice * {of} >= {up} group by rid)
    select doc_id, license, round(coalesce(score, 0), 6) as score, coalesce(n, 0)::int as n_license_units from d left join b using (rid)"""
