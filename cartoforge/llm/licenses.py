"""License scans: normalised texts and lines against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Texts of short licences, and the usual headers of long ones.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
BSD_1 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
BSD_2 = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
UNLICENSE = """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

# Short notices by which texts name their licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", APACHE, *APACHE.split("\n")),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{BSD}\n{BSD_1}\n{BSD_2}"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", f"{BSD}\n{BSD_1}\n{BSD_2}\n{BSD_3}", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", GPL),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "ISC": ("Released under the ISC License.", ISC),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", f"{MIT}\n{AS_IS_MIT}", MIT, *MIT.split("\n"), AS_IS_MIT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", UNLICENSE),
}

#: What parts words: all but a-z, 0-9 and what is beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bigrams(text: str) -> list[str]:
    w = [x for x in re.split(GAP, text.lower()) if x]
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _native(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, num: int = 85, den: int = 100, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Licences of every row of docs: doc_id, n_matches (units that match), licenses (sorted, comma-joined), best_license, best_dice.

    docs: doc_id, text; other columns are ignored. The units of a text are its lines, its paragraphs (wrapped over lines,
    parted by blank lines) and the text as a whole; they are lower-cased (A-Z), stripped of punctuation and cut into distinct
    word bigrams. A template T matches a unit U if 2|T & U| / (|T| + |U|) >= num/den; as
    |T & U| is at most the smaller size, only units with |T| * num <= |U| * (2*den - num), and the other way round, are compared
    with T, and units with too few words are dropped before bigrams are made. Ties go to the licence name that sorts first.
    Nulls and texts without two words match nothing (n_matches 0, licenses empty, best_* null).
    """
    t = [(k, bigrams(x)) for k, xs in (templates or TEMPLATES).items() for x in xs]
    if not t:
        raise ValueError("no templates")
    low = min(math.ceil(len(b) * num / (2 * den - num)) for _, b in t)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = lambda u: F.filter(F.split(ascii_lower(u), GAP), lambda w: w != "")
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[\x20\t\r]*\n"), lambda p: F.contains(p, F.lit("\n")) & (F.length(p) < F.length(text)))
    units = F.when(F.size(lines) > 1, F.concat(lines, paragraphs, F.array(text))).otherwise(lines)
    enough = F.filter(F.transform(units, words), lambda w: F.size(w) > low)  # there are fewer bigrams than words
    best = F.array(*(F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, b)).alias("grams"), F.lit(len(b)).alias("n")) for k, b in t))

    def matches(grams: Column) -> Column:
        near = F.filter(best, lambda x: (x["n"] * num <= F.size(grams) * (2 * den - num)) & (F.size(grams) * num <= x["n"] * (2 * den - num)))
        rated = F.transform(near, lambda x: F.struct((-2.0 * F.size(F.array_intersect(x["grams"], grams)) / (x["n"] + F.size(grams))).alias("minus"), x["license"].alias("license")))
        return F.sort_array(F.filter(rated, lambda x: -x["minus"] * den >= num))

    found = F.filter(F.transform(F.transform(enough, _native), matches), lambda m: F.size(m) > 0)
    one = docs.select("doc_id", F.transform(found, lambda m: m[0]).alias("found"))
    first = F.get(F.sort_array("found"), F.lit(0))
    return one.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"]))), ",").alias("licenses"), first["license"].alias("best_license"), F.round(-first["minus"], 6).alias("best_dice"))
