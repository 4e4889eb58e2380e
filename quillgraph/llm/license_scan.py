"""Licence scans with DataFrame functions only: a positional index of rare licence words.

The words of the templates' key phrases get their document frequency from all documents. Each template is looked up by
the rarest word of its key phrases, in every document that has all words of these phrases: as a template counts only if
its key phrases stand in their place, none is missed. Each occurrence says where the template would start; where all key
phrases stand at their distance from there, the template is laid over the document, and the share of equal words is its
score. The base phrases are found wherever they stand. A document costs steps in proportion to its words.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_NO_WARRANTY = "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
#: Label, grant or licence text, mandatory key phrases (each stands once in its text).
_TEXTS = [
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license", "version 2 1"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license", "version 3"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license", "version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify and or distribute this software"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ["permission is hereby granted free of charge", "merge publish distribute sublicense and or sell copies of the software"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
        "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ["permission to use copy modify and or distribute this software", "with or without fee is hereby granted"],
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
        ["redistribution and use in source and binary forms", "provided with the distribution this software is provided"],
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        ["redistribution and use in source and binary forms", "3 neither the name of"],
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
        "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        ["provided by the copyright holders and contributors as is", "procurement of substitute goods or services"],
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License.",
        ["apache license version 2 0", "distributed on an as is basis"],
    ),
    (
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        f"option) any later version. This program is distributed in the hope that it will be useful, but {_NO_WARRANTY}. See the GNU General Public License for more details.",
        ["program is free software", "terms of the gnu general public license as published", "either version 2 of the license"],
    ),
    (
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        f"option) any later version. This program is distributed in the hope that it will be useful, but {_NO_WARRANTY}. See the GNU General Public License for more details.",
        ["program is free software", "terms of the gnu general public license as published", "either version 3 of the license"],
    ),
    (
        "lgpl-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        f"(at your option) any later version. This library is distributed in the hope that it will be useful, but {_NO_WARRANTY}. See the GNU Lesser General Public License for more details.",
        ["library is free software", "terms of the gnu lesser general public license as published", "either version 2 1 of the license"],
    ),
    (
        "agpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        f"(at your option) any later version. This program is distributed in the hope that it will be useful, but {_NO_WARRANTY}. See the GNU Affero General Public License for more details.",
        ["program is free software", "terms of the gnu affero general public license as published", "either version 3 of the license"],
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ["terms of the mozilla public license v 2 0", "copy of the mpl was not distributed with this file"],
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        ["permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software released into the public domain"],
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        ["to any person or organization obtaining a copy of the software", "to prepare derivative works of the software"],
    ),
    (
        "cc-by-4.0",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        ["creative commons attribution 4 0 international license"],
    ),
    (
        "cc-by-sa-4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        ["creative commons attribution sharealike 4 0 international license"],
    ),
]
#: The same in lower-case words.
TEMPLATES = [(label, " ".join(re.findall(f"{WORD}+", text.lower())), keys) for label, text, keys in _TEXTS]
#: Words of key phrases that say nothing by themselves.
COMMON = frozenset("a and any are as by copy for from free in is not of on or other source the this to use was with under v version without 0 1 2 3 4".split())
#: Words that templates can be told by, and those with the words of base phrases.
TELLING = sorted({w for _, _, ks in TEMPLATES for x in ks for w in x.split()} - COMMON)
LISTED = sorted({*TELLING, *(w for p in BASE for w in p.split())})
#: A template and a place in one number: template * PLACES + place + BEFORE, as a template may begin before the text.
PLACES, BEFORE = 2**40, 2**16


def words(text: Column | str = "text") -> Column:
    """The words of a text with A-Z in lower case. Lower-casing other letters as well moves no word end and makes no ASCII
    word, but for the Kelvin sign, which becomes k and is therefore replaced by another letter.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.replace(c, F.lit("\u212a"), F.lit("\u212b"))), F.lit(f"({WORD}+)"), F.lit(1))


def listed(w: Column) -> Column:
    """Those of a document's words that are in LISTED, each once."""
    return F.array_intersect(w, F.array(*[F.lit(x) for x in LISTED]))


def places(w: Column, phrase: str) -> Column:
    """Where, in an array of words, the phrase's words start."""
    parts = phrase.split()
    n = F.size(w) - len(parts)
    at = F.sequence(F.lit(0), F.greatest(n, F.lit(0)))
    hit = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == x for k, x in enumerate(parts)])
    return F.when(n >= 0, F.filter(at, hit)).otherwise(F.array().cast("array<int>"))


def frequencies(docs: DataFrame) -> dict[str, int]:
    """Of each telling template word, the number of documents that have it, over all whole texts."""
    counted = docs.select(F.explode(listed(words())).alias("word")).groupBy("word").count().collect()  # LISTED's words at most
    seen = {r["word"]: r["count"] for r in counted}
    return {w: seen.get(w, 0) for w in TELLING}


def _lookup(postings: list[tuple[str, int, int]]) -> Column:
    """word -> numbers of its templates, less the word's place in each, as a literal map of an entry for each template."""
    by: dict[str, list[int]] = {}
    for w, k, at in postings:
        by.setdefault(w, []).append(k * PLACES + BEFORE - at)
    return F.create_map(*[x for w, ps in sorted(by.items()) for x in (F.lit(w), F.array(*[F.lit(p).cast("long") for p in ps]))])


def rarest(seen: dict[str, int]) -> list[tuple[str, int, int]]:
    """For each template, the rarest telling word of its key phrases, the template's number, the word's place in it."""
    out = []
    for k, (_, text, keys) in enumerate(TEMPLATES):
        t = text.split()
        spans = [(i, i + len(p)) for p in map(str.split, keys) for i in range(len(t)) if t[i : i + len(p)] == p]
        _, w, at = min((seen[t[i]], t[i], i) for a, b in spans for i in range(a, b) if t[i] in TELLING)
        out.append((w, k, at))
    return out


def _key_places() -> Column:
    """Of each template, its key phrases: where in it, how many words, and the words."""
    out = []
    for _, text, keys in TEMPLATES:
        t = text.split()
        parts = [p.split() for p in keys]
        out.append(F.array(*[F.struct(F.lit(next(i for i in range(len(t)) if t[i : i + len(p)] == p)).alias("at"), F.lit(len(p)).alias("n"), F.split(F.lit(" ".join(p)), " ").alias("words")) for p in parts]))
    return F.array(*out)


def matches(w: Column, top: Column, postings: list[tuple[str, int, int]]) -> Column:
    """array<struct<label, score>>: the templates laid over the words wherever a posting of a word of top puts them and
    all their key phrases stand. A word has a template at one place only, so no place comes twice.
    """
    lookup, keys = _lookup(postings), _key_places()
    layout = F.array(*[F.split(F.lit(t), " ") for _, t, _ in TEMPLATES])
    labels = F.array(*[F.lit(x) for x, _, _ in TEMPLATES])
    spots = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.array_contains(top, s["x"]))
    starts = F.flatten(F.transform(spots, lambda s: F.transform(F.try_element_at(lookup, s["x"]), lambda p: p + s["i"])))
    known = F.transform(starts, lambda q: F.struct(F.floor(q / PLACES).cast("int").alias("k"), (F.pmod(q, F.lit(PLACES)) - BEFORE).cast("int").alias("start")))

    def stands(q: Column) -> Column:
        here = lambda p: F.when(q["start"] + p["at"] >= 0, F.slice(w, q["start"] + p["at"] + 1, p["n"]) == p["words"])
        return F.forall(F.get(keys, q["k"]), lambda p: F.coalesce(here(p), F.lit(False)))

    def judged(q: Column) -> Column:
        t = F.get(layout, q["k"])
        equal = F.filter(F.transform(t, lambda x, i: F.get(w, q["start"] + i) == x), lambda e: e)
        return F.struct(F.get(labels, q["k"]).alias("label"), (F.size(equal) / F.size(t)).alias("score"))

    return F.transform(F.filter(known, stands), judged)


def scan(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    A template counts where at least `least` of its words and all its key phrases stand in place. score is the best share
    of a template's words in place; a base phrase is a template of its own that stands whole: 1. Null and empty texts have
    no words, no labels and score 0. Repeated rows each give a row; only doc_id and text are read; an empty table gives
    no rows.
    """
    postings = rarest(frequencies(docs.select("text")))
    rows = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    rows = rows.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), listed(F.col("w")).alias("hits"))
    # a word is looked up where all listed words of the key phrases of one of its templates stand in the document
    needed = sorted({(w, *sorted({x for p in TEMPLATES[k][2] for x in p.split() if x in LISTED})) for w, k, _ in postings})
    top = F.array_distinct(F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [F.array_contains("hits", x) for x in xs]), F.lit(w)) for w, *xs in needed])))
    has = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains("hits", x) for x in p.split()]) for p in BASE])
    rows = rows.select("doc_id", "w", "n_words", has.alias("has"), F.when(F.size("hits") > 0, top).alias("top"))
    spots = F.when(F.col("has"), F.array(*[places(F.col("w"), p) for p in BASE]))
    laid = F.when(F.size("top") > 0, F.filter(matches(F.col("w"), F.col("top"), postings), lambda m: m["score"] >= least))
    listed_rows = rows.select("doc_id", "n_words", spots.alias("spots"), laid.alias("laid"))
    every = F.flatten("spots")
    none = F.array().cast("array<string>")
    known = F.array_compact(F.array(*[F.when(F.size(F.get("spots", i)) > 0, F.lit(x)) for i, x in enumerate(BASE.values())]))
    more = F.coalesce(F.transform("laid", lambda m: m["label"]), none)
    best = F.coalesce(F.array_max(F.transform("laid", lambda m: m["score"])), F.lit(0.0))
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return listed_rows.select(
        "doc_id", "n_words", F.when(F.col("spots").isNotNull(), F.size(every)).otherwise(0).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        text(known).alias("base_labels"), text(F.concat(known, more)).alias("labels"), F.when(F.size(known) > 0, 1.0).otherwise(best).alias("score"),
    )
