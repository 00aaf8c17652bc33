"""License notices found by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
from collections.abc import Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import let

# Notices as they are published, one or more per license.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
}
MIT_CONDITIONS = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be"
    " included in all copies or substantial portions of the Software."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
    " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN"
    " THE SOFTWARE."
)
ISC_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY'
    " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM"
    " LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
BSD_START = (
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"
    " specific prior written permission."
)
BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"
    " FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
    " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Texts of the short licenses as a whole, each made of its opening sentence in TEMPLATES and the rest.
FULL_TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (TEMPLATES["MIT"][1] + MIT_CONDITIONS,),
    "ISC": (TEMPLATES["ISC"][0] + ISC_DISCLAIMER,),
    "BSD-2-Clause": (TEMPLATES["BSD-3-Clause"][0] + BSD_START + BSD_DISCLAIMER,),
    "BSD-3-Clause": (TEMPLATES["BSD-3-Clause"][0] + BSD_START + BSD_NAMES + BSD_DISCLAIMER,),
}


def _gnu(title: str, version: str, subjects: tuple[str, ...] = ("program",)) -> tuple[str, ...]:
    by = f"you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation"
    return (
        f"This work is licensed under the {title}, version {version}.",
        f"Licensed under the {title} v{version}.",
        *(f"This {s} is free software: {by}, either version {version} of the License, or (at your option) any later version." for s in subjects),
        *(f"This {s} is free software: {by}, version {version} of the License." for s in subjects),
        f"{title} Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    )


def _creative_commons() -> dict[str, tuple[str, ...]]:
    kinds = {"": "", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC": "-NonCommercial", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
    scopes = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
    return {
        f"CC-BY{kind}-{version}": (
            f"This work is licensed under a Creative Commons Attribution{name} {version} {scope} License.",
            f"Licensed under CC BY{kind} {version}.",
        )
        for kind, name in kinds.items()
        for version, scope in scopes.items()
    }


#: Further licenses and versions, and further notices of those above. Neighbours of a license must be here, or their texts count as it.
MORE_NOTICES: dict[str, tuple[str, ...]] = _creative_commons() | {
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "The Apache Software License, Version 1.1 Copyright (c) The Apache Software Foundation. All rights reserved."),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "This work is licensed under a Creative Commons CC0 1.0 Universal License.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0."),
    "GPL-1.0": _gnu("GNU General Public License", "1"),
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": _gnu("GNU General Public License", "3"),
    "ISC": ("Released under the ISC License.", "Licensed under the ISC License."),
    "LGPL-2.0": _gnu("GNU Library General Public License", "2", ("program", "library")),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", ("program", "library")),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", ("program", "library")),
    "MIT": ("Licensed under the MIT License.",),
    "MPL-1.1": (
        "Licensed under the Mozilla Public License, version 1.1.",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This work is licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Runs of a-z and 0-9 after A-Z are lower-cased; everything else separates them."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(text: Column) -> Column:
    """The set of neighbouring word pairs of a text."""

    def pairs(words: Column) -> Column:
        later = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.array_distinct(F.transform(later, lambda w, i: F.concat_ws(" ", F.get(words, i), w)))

    # The words are split once a line, not once a pair.
    return let(normal_words(text), pairs)


def template_bigrams(notice: str) -> list[str]:
    words = "".join(c if c in LOWER or c.isascii() and c.isdigit() else " " for c in notice.translate(str.maketrans(UPPER, LOWER))).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needed_bigrams(templates: list[list[str]], threshold: float) -> str:
    """A pattern that every normalised text within the threshold of a template has.

    Dice of t or more means that at least t / (2 - t) of a template's b bigrams are in the line, so of any
    b - ceil(b t / (2 - t)) + 1 of them one is. The longest are taken, as these are seldom met by chance.
    """
    wanted = set()
    for grams in templates:
        shared = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        if shared > 0:
            wanted.update(sorted(grams, key=len, reverse=True)[: len(grams) - shared + 1])
    listed = "|".join(g.replace(" ", "[^a-z0-9]+") for g in sorted(wanted))
    return f"(?<![a-z0-9])(?:{listed})(?![a-z0-9])" if wanted else "(?!)"


def scan(df: DataFrame, doc_id: str, text: str, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_lines): the licenses of which a line of the document is a notice.

    Each line, and a text of one line as a whole, is compared with the templates whose number of bigrams allows
    the threshold: with a and b bigrams Dice is at most 2 min(a, b) / (a + b). dice is the best value of the document's
    lines, n_lines how many reach the threshold. Lines without any of the bigrams that a match must have are passed over; this
    loses nothing (needed_bigrams). Null and empty texts and unrelated documents give no row; documents
    that share an id are one. Lines are compared where they are read, only the found ones are shuffled.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    compiled = {name: [template_bigrams(notice) for notice in notices] for name, notices in templates.items()}
    needed = needed_bigrams([grams for of_name in compiled.values() for grams in of_name], threshold)
    documents = df.where(F.translate(F.col(text), UPPER, LOWER).rlike(needed))
    lines = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    lines = lines.where(F.translate("line", UPPER, LOWER).rlike(needed))

    def score(grams: Column, template: list[str]) -> Column:
        a, b = F.size(grams), len(template)
        possible = F.least(a, F.lit(b)) * 2 >= (a + b) * threshold
        shared = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in template])))
        return F.when(possible, shared * 2 / (a + b)).otherwise(0.0)

    def per_license(grams: Column) -> Column:
        best = [(name, F.array_max(F.array(*[score(grams, t) for t in of_name]))) for name, of_name in compiled.items()]
        return F.array(*[F.struct(F.lit(name).alias("license"), dice.alias("dice")) for name, dice in best])

    found = lines.select("doc_id", F.inline(let(bigrams(F.col("line")), per_license))).where(F.col("dice") >= threshold)
    return found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_lines"))


def _all_templates(*parts: Mapping[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    return {name: tuple(dict.fromkeys(n for part in parts for n in part.get(name, ()))) for name in sorted(set().union(*parts))}


#: What find_notices looks for.
NOTICES = _all_templates(TEMPLATES, FULL_TEXTS, MORE_NOTICES)


def pattern_of(grams: list[str]) -> str:
    """A pattern for any of the bigrams as a prefix tree, so that few branches are tried at a place."""

    def tree(words: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for word in words:
            by_first.setdefault(word[:1], []).append(word[1:])
        out = [("[^a-z0-9]+" if c == " " else c) + tree(rest) if c else "(?![a-z0-9])" for c, rest in sorted(by_first.items())]
        return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"

    return f"(?<![a-z0-9]){tree(sorted(set(grams)))}" if grams else "(?!)"


def needed_of(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which a text within the threshold has one (see needed_bigrams)."""
    shared = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
    return sorted(grams, key=len, reverse=True)[: len(grams) - shared + 1] if shared > 0 else []


def gram_hash(gram: str) -> int:
    """What Spark's xxhash64 gives for a bigram."""
    value = xxhash.xxh64_intdigest(gram.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def find_notices(df: DataFrame, doc_id: str, text: str, templates: Mapping[str, tuple[str, ...]] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_lines): the licenses of which a passage of the document is a notice.

    The words of the whole text are compared, so a notice may span lines or stand within one. A template with p bigrams, repeated
    ones counted, is compared with the windows of up to p (2 - threshold) / threshold bigrams that begin with the head of a run of its own bigrams
    and end with the end of one, or with the last of its bigrams within that length: one more bigram of the template at an end never lowers Dice, any other
    does. Windows that overlap are one place, which goes to the template with
    the most bigrams in common, then the best Dice: a neighbour of the same length, as another version, has fewer, and
    an opening sentence that licenses share has fewer than the text of one. dice is the best value of the license's places, n_lines how many
    places there are. Null and empty texts and unrelated documents give no row; documents that share an id are one. Texts
    are compared where they are read; only the found rows are shuffled.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    compiled = []
    for name, notices in templates.items():
        for notice in notices:
            grams = template_bigrams(notice)
            if grams:
                words = len("".join(c if c.isascii() and c.isalnum() else " " for c in notice).split())
                compiled.append((name, grams, math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9), int((words - 1) * (2 - threshold) / threshold + 1e-9)))
    needed = [g for _, grams, _, _ in compiled for g in needed_of(grams, threshold)]
    # Bigrams are compared by their 64-bit hashes; one literal that is split builds faster than one for each.
    hashes = lambda grams: F.split(F.lit("\n".join(str(gram_hash(g)) for g in grams)), "\n").cast("array<bigint>")
    known = F.array(
        *[
            F.struct(F.lit(n).alias("license"), hashes(g).alias("grams"), hashes(needed_of(g, threshold)).alias("needed"), F.lit(least).alias("least"), F.lit(most).alias("most"))
            for n, g, least, most in compiled
        ]
    )
    of_needed = hashes(dict.fromkeys(needed))
    of_any = hashes(dict.fromkeys(g for _, grams, _, _ in compiled for g in grams))
    documents = df.where(F.translate(F.col(text), UPPER, LOWER).rlike(pattern_of(needed)))

    def in_order(words: Column) -> Column:
        later = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.transform(later, lambda w, i: F.xxhash64(F.concat_ws(" ", F.get(words, i), w)))

    def near_templates(grams: Column) -> Column:
        """The templates that share enough bigrams with the whole text; others are within the threshold of none of its windows."""

        def enough(met: Column) -> Column:
            counted = lambda t: F.size(F.array_intersect(t["grams"], met)) >= t["least"]
            # Few templates have one of the bigrams that theirs must have, so few are counted.
            return let(F.array_intersect(met, of_needed), lambda some: F.filter(F.filter(known, lambda t: F.arrays_overlap(t["needed"], some)), counted))

        return let(F.array_intersect(grams, of_any), enough)

    def windows(grams: Column, t: Column) -> Column:
        """The best window from the head of each run of the template's bigrams, as dice, shared, begin, end, license."""

        def from_places(places: Column) -> Column:
            far = F.lit(1 << 30)
            marked = F.transform(
                places, lambda p, i: F.struct(p.alias("p"), i.alias("i"), F.coalesce(F.get(places, i - 1), F.lit(-2)).alias("last"), F.coalesce(F.get(places, i + 1), far).alias("next"))
            )
            return let(marked, from_marked)

        def from_marked(marked: Column) -> Column:
            def from_head(head: Column) -> Column:
                begin = head["p"]
                limit = begin + t["most"] - 1

                def of_end(end: Column) -> Column:
                    def scored(window: Column) -> Column:
                        shared = F.size(F.array_intersect(window, t["grams"]))
                        dice = shared * 2 / (F.size(window) + F.size(t["grams"]))
                        return F.struct(dice.alias("dice"), shared.alias("shared"), begin.alias("begin"), end["p"].alias("end"), t["license"].alias("license"))

                    return let(F.array_distinct(F.slice(grams, begin + 1, end["p"] - begin + 1)), scored)

                # Ends of runs within reach, and the last place within it; a reach that holds too few of the bigrams has none.
                ends = F.filter(
                    F.slice(marked, head["i"] + t["least"], t["most"]),
                    lambda e: (e["p"] <= limit) & ((e["next"] > e["p"] + 1) | (e["next"] > limit)),
                )
                reached = F.size(F.array_intersect(F.slice(grams, begin + 1, t["most"]), t["grams"])) >= t["least"]
                return F.when(reached, F.array_max(F.transform(ends, of_end)))

            heads = F.filter(marked, lambda m: m["last"] < m["p"] - 1)
            return F.filter(F.transform(heads, from_head), lambda w: w["dice"] >= threshold)

        places = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
        return let(places, from_places)

    def ranked(grams: Column) -> Column:
        found = F.flatten(F.transform(near_templates(grams), lambda t: windows(grams, t)))
        order = lambda w: F.struct((-w["shared"]).alias("a"), (-w["dice"]).alias("b"), w["begin"].alias("begin"), w["end"].alias("end"), w["license"].alias("license"))
        return F.array_sort(F.transform(found, order))

    def apart(kept: Column, w: Column) -> Column:
        return ~F.exists(kept, lambda k: (k["begin"] <= w["end"]) & (w["begin"] <= k["end"]))

    def best(found: Column) -> Column:
        return F.aggregate(found, F.slice(found, 1, 0), lambda kept, w: F.when(apart(kept, w), F.concat(kept, F.array(w))).otherwise(kept))

    # One expression, and an outer explode: a condition on the result would be pushed below and compute each part of it again.
    kept = let(let(let(normal_words(F.col(text)), in_order), ranked), best)
    places = documents.select(F.col(doc_id).alias("doc_id"), F.explode_outer(kept).alias("w")).where(F.col("w").isNotNull())
    return places.groupBy("doc_id", F.col("w.license").alias("license")).agg(F.max(-F.col("w.b")).alias("dice"), F.count(F.lit(1)).alias("n_lines"))
