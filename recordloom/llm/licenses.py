"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Two passes over all files. The first counts, for each term of the templates, the files that hold it: these are the
inverse document frequencies. The second compares each file's candidate segments (lines with an anchor word, and windows
of the whole text around it, across lines and comment leaders) with the notices, and whole files and their openings with the licence texts, as sparse vectors. A licence file
(by its name, or by its whole text or opening, whatever its name) licenses its directory; files without a notice of their own take the
licence of the nearest directory above them, by a join of their ancestor paths with the licensed directories.

The nearest notice counts only if its words don't say otherwise (Lesser, Affero, NonCommercial, another version, "not released
under"): a licence without a template is none, not its neighbour. An SPDX identifier names its licence by itself.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import join_small, written

# The usual short notices of public licences, and characteristic sentences of their texts.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "SPDX-License-Identifier: GPL-2.0"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: LGPL-3.0"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}

# Whole texts of short public licences (without their copyright lines), and how the texts of long ones open.
TEXTS: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
OPENINGS: dict[str, str] = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "CC-BY-4.0": "Attribution 4.0 International Creative Commons Corporation is not a law firm and does not provide legal services or legal advice.",
    "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0 International Creative Commons Corporation is not a law firm and does not provide legal services or legal advice.",
    "CC-BY-NC-4.0": "Attribution-NonCommercial 4.0 International Creative Commons Corporation is not a law firm and does not provide legal services or legal advice.",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.",
}

# What the words of a notice must say, and must not, to be of a licence: its nearest neighbours differ in these only.
GNU, CC = "general public|gpl", r"creative commons|\bcc[ -]by\b|attribution"
NC, ND, SA = r"non-?commercial|\bnc\b|-nc\b", r"no-?deriv\w*|\bnd\b|-nd\b", r"share-? ?alike|\bsa\b|-sa\b"
SAYS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "GPL-3.0": ((r"\b3\b|3\.0",), ("lesser", "library general", "affero", "lgpl", "agpl")), "GPL-2.0": ((r"\b2\b|2\.0",), ("lesser", "library general", "affero", "lgpl", "agpl")),
    "LGPL-3.0": (("lesser|lgpl", r"\b3\b|3\.0"), ()), "LGPL-2.1": (("lesser|lgpl", r"2\.1"), ()), "AGPL-3.0": (("affero|agpl", r"\b3\b|3\.0"), ()),
    "CC-BY-4.0": ((r"4\.0",), (NC, ND, SA)), "CC-BY-SA-4.0": ((r"4\.0", SA), (NC, ND)), "CC-BY-NC-4.0": ((r"4\.0", NC), (ND, SA)), "CC-BY-ND-4.0": ((r"4\.0", ND), (NC, SA)),
    "CC-BY-NC-SA-4.0": ((r"4\.0", NC, SA), (ND,)), "CC-BY-NC-ND-4.0": ((r"4\.0", NC, ND), (SA,)), "Apache-2.0": ((r"2\.0",), ()), "BSD-2-Clause": ((), ("neither the name", "3-clause")), "BSD-3-Clause": ((), ("2-clause",)),
}
SAYS = {k: (tuple(map(re.compile, must)), tuple(map(re.compile, never))) for k, (must, never) in SAYS.items()}
#: A notice that denies, and an identifier of the SPDX form: what it names, less -only and -or-later, is the licence.
DENIES = re.compile(r"\b(?:not|isn't|never|no longer)\s+(?:\w+\s+)?(?:released|licen[sc]ed|distributed|available|covered)\s+(?:under|by)\b", re.I)
SPDX = re.compile(r"spdx-license-identifier:\s*\(?\s*([a-z0-9.+-]+)", re.I)

ANCHOR = re.compile(r"licen[sc]e|copyright|public domain|permission is|permission to|redistribution|spdx-|creative commons", re.I)
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
WORDS = re.compile(r"\S+")
LETTER = re.compile(r"[^\W_]")
#: Words of the windows besides those of the notices' own lengths; the least cosine of a notice.
WINDOWS, LEAST = (6, 12, 24), 0.7
#: Where a sentence ends, and words of it that are looked at before a window.
SENTENCE, SENTENCE_WORDS = re.compile(r"[.!?][\s\"')]+"), 30
#: A file is a licence file by its text if all of it has at least this cosine to a licence's text or notice, or its opening to a long text's.
WHOLE_LEAST = 0.85
#: A text of two clauses says the second and the disclaimer, but not the third.
BINARY, NEITHER = re.compile(r"(?is)redistributions in binary form.*software is provided by"), re.compile(r"(?i)neither\s+the\s+name")
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"


def terms(text: str) -> Counter:
    """Words and pairs of adjacent words, without case."""
    w = TERM.findall(text.lower())
    return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def vector(counts: Counter, idf: dict[str, float], rare: float) -> tuple[dict[str, float], float]:
    v = {t: (1 + math.log(n)) * idf.get(t, rare) for t, n in counts.items()}
    return v, math.sqrt(sum(x * x for x in v.values()))


def contradicted(licence: str, words: str) -> bool:
    """Whether the words that are nearest to a licence's say that they are of another one, or deny it."""
    low = words.lower()
    must, never = SAYS.get(licence, ((), ()))
    return any(not p.search(low) for p in must) or any(p.search(low) for p in never) or bool(DENIES.search(low))


def identifiers(text: str, names: dict[str, str]) -> list[str]:
    """The licences that a text's SPDX identifiers name; unknown ones stand as they are."""
    found = (re.sub(r"(?i)(-only|-or-later|\+)$", "", m[1].rstrip(".")) for m in SPDX.finditer(text))
    return [names.get(x.lower(), x) for x in found]


class Matcher:
    """Cosines of a text to all notices."""

    def __init__(self, idf: dict[str, float], rare: float, notices: dict[str, tuple[str, ...]]) -> None:
        self.idf, self.rare = idf, rare
        self.templates = [(name, *vector(terms(t), idf, rare)) for name, texts in sorted(notices.items()) for t in texts]
        self.post: dict[str, list[tuple[int, float]]] = {}
        for i, (_, v, norm) in enumerate(self.templates):
            for t, x in v.items():
                self.post.setdefault(t, []).append((i, x / norm))

    def best(self, text: str) -> tuple[float, str | None]:
        """The highest cosine and its licence; ties go to the first name."""
        v, norm = vector(terms(text), self.idf, self.rare)
        dots = [0.0] * len(self.templates)
        for t, x in v.items():
            for i, y in self.post.get(t, ()):
                dots[i] += x * y
        top = max(range(len(dots)), key=lambda i: (dots[i], -i))
        return (dots[top] / norm, self.templates[top][0]) if norm and dots[top] else (0.0, None)


def word_starts(text: str) -> list[int]:
    """Places of a text's words; comment leaders and other marks alone are none."""
    return [m.start() for m in WORDS.finditer(text) if LETTER.search(m.group())]


def spans(notices: dict[str, tuple[str, ...]]) -> list[tuple[int, int]]:
    """(words before the anchor, words) of windows: where each notice has its first anchor, and a few general ones."""
    out = {(before, size) for before in (0, 4) for size in WINDOWS}
    for notice in (n for texts in notices.values() for n in texts):
        starts = word_starts(notice)
        if first := ANCHOR.search(notice):
            out.add((bisect_right(starts, first.start()) - 1, len(starts)))
    return sorted(out)


def segments(text: str, windows: list[tuple[int, int]]) -> Iterator[tuple[str, str]]:
    """Lines of up to WINDOWS[-1] words with an anchor word, and windows of the whole text at each anchor: a notice may stand amid other prose or be
    wrapped. Each with the rest of its sentence before it."""
    for line in text.split("\n"):
        if ANCHOR.search(line) and len(line.split(None, WINDOWS[-1])) <= WINDOWS[-1]:
            yield line, line
    starts = word_starts(text)
    starts.append(len(text))
    seen = set()
    for m in ANCHOR.finditer(text):
        at = max(0, bisect_right(starts, m.start()) - 1)
        for before, size in windows:
            first = max(0, at - before)
            window = first, min(first + size, len(starts) - 1)
            if window not in seen:
                seen.add(window)
                ahead = SENTENCE.split(text[starts[max(0, first - SENTENCE_WORDS)] : starts[window[0]]])[-1]
                yield (own := text[starts[window[0]] : starts[window[1]]]), ahead + own


def whole_licence(text: str, texts: Matcher, openings: Matcher, sizes: list[int]) -> tuple[float, str | None]:
    """The licence whose text a file is, by all of it or by its opening, as the highest cosine."""
    best = texts.best(text)
    starts = [*islice((m.start() for m in WORDS.finditer(text) if LETTER.search(m.group())), max(sizes) + 1), len(text)]
    for size in sizes:
        got = openings.best(text[: starts[min(size, len(starts) - 1)]])
        if got[1] and (got[0] > best[0] or (got[0] == best[0] and best[1] and got[1] < best[1])):
            best = got
    return best


def license_scan(files: DataFrame, path: Column, *, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, tuple[str, ...]] | None = None, least: float = LEAST) -> DataFrame:
    """One row for each row of files: doc_id, path, license (null if none), score, origin (notice, file, inherited, none).

    path: the file's path with / between its parts. A null path has no directory, a null or empty text no notice. Of
    several notices the closest counts, ties by licence name; of several licence files in a directory likewise.
    Rows that repeat an identifier are judged one by one; other columns aren't looked at; an empty table gives an empty one.
    """
    chosen = notices or NOTICES
    templates = [x for texts in chosen.values() for x in texts] + ([*TEXTS.values(), *OPENINGS.values()] if notices is None else [])
    known = sorted({t for x in templates for t in terms(x)})
    words = {t for t in known if " " not in t}
    pairs = {t for t in known if " " in t}
    firsts = {p.split(" ")[0] for p in pairs}
    rows = files.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                found[""] += 1
                if isinstance(text, str):
                    w = TERM.findall(text.lower())
                    have = words.intersection(w)
                    found.update(have)
                    if len(have & firsts) and ANCHOR.search(text):
                        found.update(pairs.intersection(f"{a} {b}" for a, b in zip(w, w[1:])))
                    elif have & firsts:
                        found.update(pairs.intersection(f"{a} {b}" for a, b in zip(w, w[1:]) if a in firsts))
        if found:
            yield pd.DataFrame({"term": list(found), "files": list(found.values())})

    df = {r["term"]: r["n"] for r in rows.select("text").mapInPandas(frequencies, "term string, files long").groupBy("term").agg(F.sum("files").alias("n")).collect()}  # the templates' terms only
    total = df.pop("", 0)
    idf = {t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1 for t in known}
    rare = math.log(total + 1) + 1

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, windows = Matcher(idf, rare, chosen), spans(chosen)
        own = {name: (text,) for name, text in TEXTS.items()} if notices is None else {}
        texts = Matcher(idf, rare, {name: (*chosen.get(name, ()), *own.get(name, ())) for name in {*chosen, *own}})
        openings = Matcher(idf, rare, {name: (text,) for name, text in OPENINGS.items()} if notices is None else {"": ("",)})
        sizes = sorted({len(word_starts(text)) for text in OPENINGS.values()}) if notices is None else [0]
        name, spelt = re.compile(LICENCE_FILE), {x.lower(): x for x in chosen}
        for batch in batches:
            out = []
            for where, text in zip(batch["path"], batch["text"], strict=True):
                score, found, whole = 0.0, None, False
                if isinstance(text, str) and ANCHOR.search(text):
                    named = identifiers(text, spelt) if notices is None else []
                    if named:
                        score, found = 1.0, min(named)
                    for s, around in () if named else segments(text, windows):
                        got = matcher.best(s)
                        nearer = got[1] and (got[0] > score or (got[0] == score and found and got[1] < found))
                        if nearer and not (got[0] >= least and contradicted(got[1], around)):
                            score, found = got
                    if found == "BSD-3-Clause" and BINARY.search(text) and not NEITHER.search(text):
                        found = "BSD-2-Clause"  # all but its third clause
                    all_of_it = whole_licence(text, texts, openings, sizes)
                    if all_of_it[0] >= WHOLE_LEAST and not contradicted(all_of_it[1], " ".join(islice((m.group() for m in WORDS.finditer(text)), max(sizes)))):
                        (score, found), whole = all_of_it, True
                        if found == "BSD-3-Clause" and BINARY.search(text) and not NEITHER.search(text):
                            found = "BSD-2-Clause"
                    elif found and score >= least:
                        whole = bool(isinstance(where, str) and name.search(where))
                out.append((found, score, whole) if found and score >= least else (None, 0.0, False))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "path": batch["path"], "license": [o[0] for o in out], "score": [o[1] for o in out], "whole": [o[2] for o in out]})

    found = written(rows.mapInPandas(scan, "doc_id long, path string, license string, score double, whole boolean").withColumn("row", F.monotonically_increasing_id()))
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    licensed = found.where("whole and path is not null").groupBy(directory.alias("dir")).agg(F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    licensed = written(licensed.select("dir", F.col("best.license").alias("dir_license"), F.col("best.score").alias("dir_score")))
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))
    bare = found.where("license is null and path is not null").select("row", F.explode(above).alias("a")).select("row", F.col("a.depth").alias("depth"), F.col("a.up").alias("up"))
    taken = join_small(bare, licensed, F.col("up") == F.col("dir"), "inner").groupBy("row").agg(F.max_by(F.struct("dir_license", "dir_score"), "depth").alias("from_dir")).withColumnRenamed("row", "of_row")
    out = found.join(written(taken), F.col("row") == F.col("of_row"), "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("whole"), "file").otherwise("notice")).when(F.col("from_dir").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "from_dir.dir_license").alias("license"), F.when(F.col("license").isNotNull(), F.col("score")).otherwise(F.coalesce("from_dir.dir_score", F.lit(0.0))).alias("score"), origin.alias("origin"))
