"""Licence scans: texts against licence templates by Dice over word bigrams."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import bind

#: Templates and their bigrams are literals in the plan; larger sets are refused.
MAX_TEMPLATES, MAX_BIGRAMS = 200, 100_000
WINDOWS = "array<struct<d:double,template:string,first:int,last:int,n:int,shared:int,m:int>>"

# Notices by which texts say their licence, and short licences in full. Longer
# licences are known by their notices; pass further templates to scan() to seek their texts.
TEMPLATES: dict[str, str] = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def normal_words(text: str) -> list[str]:
    """The words a template is compared by: runs of a-z, 0-9 and non-ASCII letters, lower case."""
    return re.findall(r"[0-9a-z\u0080-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^0-9a-z\x{80}-\x{FFFF}]+", " ")), " ")


def _pairs(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))


def _bigrams(text: Column) -> Column:
    return bind(_words(text), lambda w: F.when(F.size(w) > 1, F.array_distinct(_pairs(w))).otherwise(F.array().cast("array<string>")))


def least_shared(m: int, num: int, den: int) -> int:
    """Bigrams of m that any unit with a Dice coefficient of num/den shares: it has no fewer bigrams than it shares."""
    return -(-num * m // (2 * den - num))


def _held(text: Column, sets: dict[str, list[str]]) -> Column:
    """The bigrams of text that any template has: each word is looked up, and pairs of known words are."""
    bigrams = sorted(set().union(*sets.values()))
    known = lambda w: w.isin(sorted({x for b in bigrams for x in b.split(" ")}))
    pair = lambda w: F.transform(w, lambda x, i: F.when(known(x) & known(F.get(w, i + 1)), F.concat_ws(" ", x, F.get(w, i + 1))))
    return bind(_words(text), lambda w: F.array_distinct(F.filter(pair(w), lambda y: y.isin(bigrams))))


def _passages(b: Column, begins: Column, template: Column, bigrams: Column, num: int, den: int) -> Column:
    """Array of windows of b, a text's bigrams, that reach num/den with a template, the best first, none over a better one.

    The best windows begin and end with a bigram of the template and have at
    least `least` of them, so only those are tried. Ones in a line that itself
    reaches num/den are left to the line; begins has the words at which lines
    begin, and the end.
    """
    m, least, longest = F.size(bigrams), template["least"], template["longest"]
    enough = lambda shared, n: 2 * den * shared >= num * (n + m)
    shared = lambda x: F.size(F.array_intersect(x, bigrams))

    def window(first: Column, last: Column) -> Column:
        fields = lambda x, k: F.struct((-2.0 * k / (F.size(x) + m)).alias("d"), template["template"].alias("template"), first.alias("first"), last.alias("last"), F.size(x).alias("n"), k.alias("shared"), m.alias("m"))
        return bind(F.array_distinct(F.slice(b, first + 1, last - first + 1)), lambda x: bind(shared(x), lambda k: fields(x, k)))

    def windows(h: Column) -> Column:
        ends = lambda i: F.when(i + least <= F.size(h), F.sequence(i + least - 1, F.least(F.size(h), i + longest) - 1)).otherwise(F.array().cast("array<int>"))
        from_one = lambda i: F.transform(F.filter(ends(i), lambda j: F.get(h, j) - F.get(h, i) < longest), lambda j: window(F.get(h, i), F.get(h, j)))
        tried = F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.filter(from_one(i), lambda x: enough(x["shared"], x["n"]))))
        return F.when(F.size(h) >= least, F.array_sort(tried))

    def stated(x: Column) -> Column:
        inside = lambda k: (F.get(begins, k) <= x["first"]) & (x["last"] + 1 < F.get(begins, k + 1))
        line = lambda k: F.array_distinct(F.slice(b, F.get(begins, k) + 1, F.get(begins, k + 1) - F.get(begins, k) - 1))
        return F.exists(F.filter(F.sequence(F.lit(0), F.size(begins) - 2), inside), lambda k: bind(line(k), lambda y: enough(shared(y), F.size(y))))

    h = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.array_contains(bigrams, F.get(b, i)))
    return F.filter(bind(bind(h, windows), _apart), lambda x: ~stated(x))


def _apart(found: Column) -> Column:
    """Of windows, best first, those that overlap no better one."""
    clear = lambda kept, x: ~F.exists(kept, lambda y: (x["first"] <= y["last"]) & (x["last"] >= y["first"]))
    return F.aggregate(found, F.slice(found, 1, 0), lambda kept, x: F.when(clear(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, num: int = 80, den: int = 100) -> DataFrame:
    """Licence statements in docs (doc_id, text): doc_id, unit, template, dice, shared, unit_bigrams, template_bigrams.

    Units are the whole text (0), each of its lines (1, 2, ...) if it has more
    than one, and passages (-1, -2, ...: the word they begin with), over lines
    and within them. Of a whole text and of a line the template with the largest
    Dice coefficient is returned, if that is num/den or more; ties go to the
    first by name. Sizes bound Dice: a unit of n bigrams can reach d only with
    templates of d n / (2 - d) to (2 - d) n / d bigrams, and only those are
    intersected. Passages are sought where a text holds enough of a template's
    bigrams, in windows of up to (2 - d) / d times the template's length; they
    are each template's best, of those that overlap the one that shares most, and
    leave out what the whole text or one line states. A unit shares no more with a template than its text, so texts that
    share too little with each are left after one look. Texts without a bigram,
    and null ones, have no statement. Repeated rows give repeated rows; no
    templates, none.
    """
    texts = TEMPLATES if templates is None else templates
    sets = {k: v for k in sorted(texts) if (v := template_bigrams(texts[k]))}
    if len(sets) > MAX_TEMPLATES or sum(map(len, sets.values())) > MAX_BIGRAMS:
        raise ValueError("more templates than a plan should hold; scan in several calls")
    shape = "doc_id {}, unit int, unit_bigrams int, template string, shared int, template_bigrams int, dice double"
    if not sets:
        return docs.sparkSession.createDataFrame([], shape.format(dict(docs.dtypes)["doc_id"]))
    low = min(len(v) for v in sets.values()) * num // (2 * den - num)
    high = -(-max(len(v) for v in sets.values()) * (2 * den - num) // num)
    literal = lambda bigrams: F.array(*[F.lit(b) for b in bigrams])
    enough = lambda held: functools.reduce(Column.__or__, [F.size(F.array_intersect(held, literal(v))) >= least_shared(len(v), num, den) for v in sets.values()])
    fewest = min(least_shared(len(v), num, den) for v in sets.values())
    # A unit of w words has at most w - 1 bigrams, and one of c characters at most c / 2 words.
    some = docs.select("doc_id", "text").filter((F.length("text") > 2 * low) & bind(_held(F.col("text"), sets), lambda held: F.when(F.size(held) >= fewest, enough(held)).otherwise(False)))
    split = F.split("text", "\n")
    lines = bind(split, lambda x: F.when(F.size(x) > 1, F.concat(F.array(F.col("text")), x)).otherwise(F.array(F.col("text"))))
    units = some.select("doc_id", F.posexplode(lines).alias("unit", "part")).filter(F.length("part") > 2 * low)
    units = units.select("doc_id", "unit", _bigrams(F.col("part")).alias("set"), F.when(F.col("unit") == 0, F.col("part")).alias("whole")).withColumn("n", F.size("set"))
    units = units.filter((F.col("n") >= max(low, 1)) & ((F.col("n") <= high) | (F.col("unit") == 0)))
    known = F.array_intersect(F.col("set"), literal(sorted(set().union(*sets.values()))))

    def compared(name: str, bigrams: list[str], inter: Column) -> Column:
        m, n, size = len(bigrams), F.col("n"), len(normal_words(texts[name])) - 1
        least = least_shared(m, num, den)
        reached = lambda k: 2 * den * k >= num * (n + m)
        # d first, then the name: the least of these structs is the best template.
        fields = lambda k: F.struct((-2.0 * k / (n + m)).alias("d"), F.lit(name).alias("template"), k.alias("shared"), F.lit(m).alias("m"), reached(k).alias("whole"), F.lit(least).alias("least"), F.lit(-(-size * (2 * den - num) // num)).alias("longest"))
        return bind(F.size(F.array_intersect(inter, literal(bigrams))), lambda k: F.when((k >= least) & ((F.col("unit") == 0) | reached(k)), fields(k)))

    each = bind(known, lambda inter: F.filter(F.array(*[compared(k, v, inter) for k, v in sets.items()]), lambda x: x.isNotNull()))
    rows = units.select("doc_id", "unit", "n", "whole", each.alias("each")).filter(F.size("each") > 0)
    best = F.array_min(F.filter("each", lambda x: x["whole"]))
    stated = F.when(best.isNotNull(), F.array(F.struct(F.col("unit"), F.col("n"), best["template"].alias("template"), best["shared"].alias("shared"), best["m"].alias("m"))))
    count = lambda line: bind(_words(line), lambda w: F.when(F.get(w, F.lit(0)) == "", F.lit(0)).otherwise(F.size(w)))
    begins = F.aggregate(F.split("whole", "\n"), F.array(F.lit(0)), lambda at, line: F.concat(at, F.array(F.element_at(at, -1) + count(line))))
    of = F.create_map(*[x for k, v in sets.items() for x in (F.lit(k), literal(v))])
    partly = F.filter("each", lambda x: ~x["whole"])
    sought = lambda b, at: F.flatten(F.transform(partly, lambda t: bind(F.element_at(of, t["template"]), lambda v: F.coalesce(_passages(b, at, t, v, num, den), F.array().cast(WINDOWS)))))
    # Over all templates the passage that shares most goes first: a notice before the line in it.
    ranked = lambda found: F.array_sort(F.transform(found, lambda x: F.struct((-x["shared"]).alias("less"), *[x[c].alias(c) for c in ("d", "template", "first", "last", "n", "shared", "m")])))
    passages = bind(bind(_words(F.col("whole")), _pairs), lambda b: bind(begins, lambda at: bind(ranked(sought(b, at)), _apart)))
    inside = F.transform(passages, lambda x: F.struct((-1 - x["first"]).alias("unit"), x["n"].alias("n"), x["template"].alias("template"), x["shared"].alias("shared"), x["m"].alias("m")))
    none = F.array().cast("array<struct<unit:int,n:int,template:string,shared:int,m:int>>")
    found = rows.select("doc_id", F.explode(F.concat(F.coalesce(stated, none), F.when((F.col("unit") == 0) & (F.size(partly) > 0), inside).otherwise(none))).alias("u"))
    found = found.select("doc_id", "u.unit", F.col("u.n").alias("unit_bigrams"), "u.template", "u.shared", F.col("u.m").alias("template_bigrams"))
    return found.withColumn("dice", 2.0 * F.col("shared") / (F.col("unit_bigrams") + F.col("template_bigrams")))
