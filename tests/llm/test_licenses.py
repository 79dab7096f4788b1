import math

from pyspark.sql import functions as F

from recordloom.llm import licenses as lic

MIT = lic.NOTICES["MIT"][2] + " to deal in the Software without restriction."


def test_notices_files_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the MIT License."),
        (2, "a/b/c/x.py", "print(1)"),
        (3, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/d/y.py", None),
        (5, "a/z.py", "# SPDX-License-Identifier: Apache-2.0\ncode"),
        (6, "other/x.py", "we talk of a license to drive"),
        (7, None, "nothing"),
        (8, "top.py", ""),
        (9, "doc.txt", "word " * 100 + "Licensed under CC BY-NC 4.0. " + "word " * 100),
        (9, "doc.txt", "word " * 100 + "Licensed under CC BY-NC 4.0. " + "word " * 100),
    ]
    got = lic.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).toPandas()
    assert len(got) == len(rows)
    what = {r.doc_id: (r.license, r.origin) for r in got.itertuples()}
    assert what == {1: ("MIT", "file"), 2: ("GPL-3.0", "inherited"), 3: ("GPL-3.0", "file"), 4: ("GPL-3.0", "inherited"), 5: ("Apache-2.0", "notice"), 6: (None, "none"), 7: (None, "none"), 8: (None, "none"), 9: ("CC-BY-NC-4.0", "notice")}


def test_cosine_against_plain_python():
    idf = {t: 1.0 + len(t) % 3 for texts in lic.NOTICES.values() for x in texts for t in lic.terms(x)}
    m = lic.Matcher(idf, 4.0, lic.NOTICES)

    def cosine(a, b):
        x, nx = lic.vector(lic.terms(a), idf, 4.0)
        y, ny = lic.vector(lic.terms(b), idf, 4.0)
        return sum(x[t] * y.get(t, 0) for t in x) / (nx * ny)

    for text in (MIT, "licensed under the apache license", "public domain"):
        want = max((cosine(text, t), n) for n, ts in lic.NOTICES.items() for t in ts)
        assert math.isclose(m.best(text)[0], want[0], rel_tol=1e-9)
    assert m.best("") == (0.0, None)


def test_empty(spark):
    assert lic.license_scan(spark.createDataFrame([], "doc_id long, path string, text string"), F.col("path")).count() == 0


def test_notices_in_short_lines_and_across_lines(spark):
    filler = [f"word{i} thing{i}" for i in range(400)]
    texts = {
        1: ("MIT", "alpha beta gamma delta epsilon zeta Released under the MIT License. eta theta iota kappa lambda mu nu"),
        2: ("GPL-2.0", "# you can redistribute it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 2 of the License\n# or so"),
        3: ("GPL-3.0", "// you can redistribute it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License\n// or so"),
        4: ("MIT", " * Permission is hereby granted, free of charge,\n * to any person obtaining a copy\n * of this software and associated documentation files\n * now"),
        5: ("BSD-3-Clause", "-- Redistribution and use in source and binary\n-- forms, with or without modification, are\n-- permitted provided that the following conditions are met\n-- now"),
    }
    rows = [(i, t) for i, (_, t) in texts.items()] + [(100 + i, f) for i, f in enumerate(filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in lic.license_scan(docs, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/f"))).collect()}
    assert {i: got[i] for i in texts} == {i: name for i, (name, _) in texts.items()}
    assert not any(got[100 + i] for i in range(len(filler)))


def test_licence_files_by_their_text_under_any_name(spark):
    gpl = lic.OPENINGS["GPL-3.0"].replace("Inc. Everyone", "Inc. <https://fsf.org/>\n Everyone") + "\n" + " ".join(f"clause{i} of the work" for i in range(3000))
    apache = "\n\n      " + lic.OPENINGS["Apache-2.0"].replace("License Version", "License\n            Version") + " " + " ".join(f'"Term{i}" shall mean something' for i in range(900))
    rows = [
        (1, "m/about.txt", "Copyright (c) 2020 Ann\n\n" + lic.TEXTS["MIT"]),
        (2, "b/NOTES", "Copyright 2011, Some People\n" + lic.TEXTS["BSD-3-Clause"].replace("2. Redist", "\n* Redist")),
        (3, "g/terms.md", gpl),
        (4, "a/terms.md", apache),
        (5, "i/x", "Copyright 1999 B\n" + lic.TEXTS["ISC"]),
        *[(10 + i, f"{d}/src/code.py", "print(1)") for i, d in enumerate("mbgai")],
        (20, "n/story.txt", " ".join(f"word{i}" for i in range(500)) + " " + lic.TEXTS["MIT"] + " " + " ".join(f"word{i}" for i in range(3000))),
        (21, "n/src/code.py", "print(1)"),
        (22, "n2/permit.txt", "a license to drive is not what this is about, permission is another matter"),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in lic.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    names = ["MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "ISC"]
    assert [got[i] for i in range(1, 6)] == [(n, "file") for n in names]
    assert [got[10 + i] for i in range(5)] == [(n, "inherited") for n in names]
    assert got[20] == ("MIT", "notice") and got[21] == (None, "none") and got[22] == (None, "none")


def test_scan_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    known = sorted({t for x in [*(x for texts in lic.NOTICES.values() for x in texts), *lic.TEXTS.values(), *lic.OPENINGS.values()] for t in lic.terms(x)})
    held = [set(lic.terms(r["text"])) if r["text"] else set() for r in rows]
    idf = {t: math.log((len(rows) + 1) / (sum(t in h for h in held) + 1)) + 1 for t in known}
    rare = math.log(len(rows) + 1) + 1

    def cosine(a, b):
        x, nx = lic.vector(lic.terms(a), idf, rare)
        y, ny = lic.vector(lic.terms(b), idf, rare)
        return sum(x[t] * y.get(t, 0) for t in x) / (nx * ny) if nx and ny else 0.0

    windows = lic.spans(lic.NOTICES)
    want = {}
    for r in rows:
        near = [(max((cosine(s, t), n) for n, ts in lic.NOTICES.items() for t in ts), around) for s, around in lic.segments(r["text"] or "", windows)]
        named = lic.identifiers(r["text"] or "", {n.lower(): n for n in lic.NOTICES})
        best = (1.0, min(named)) if named else max((b for b, around in near if not (b[0] >= lic.LEAST and lic.contradicted(b[1], around))), default=(0.0, None), key=lambda x: x[0])
        want[r["doc_id"]] = best if best[0] >= lic.LEAST else (0.0, None)
    got = lic.license_scan(docs, F.concat(F.col("doc_id").cast("string"), F.lit("/f")))
    some = 0
    for r in got.collect():
        if r["origin"] in ("notice", "none"):
            assert r["license"] == want[r["doc_id"]][1] and math.isclose(r["score"], want[r["doc_id"]][0], rel_tol=1e-9)
            some += r["license"] is not None
    assert some


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."


def test_neighbours_of_licences_are_told_apart(spark):
    texts = [
        ("GPL-2.0", GNU.format("", 2)), ("GPL-3.0", GNU.format("", 3)), ("LGPL-2.1", GNU.format("Lesser ", 2.1)), ("LGPL-3.0", GNU.format("Lesser ", 3)), ("AGPL-3.0", GNU.format("Affero ", 3)), (None, GNU.format("Lesser ", 2)), (None, GNU.format("", 1)),
        ("CC-BY-4.0", CC.format("")), ("CC-BY-SA-4.0", CC.format("-ShareAlike")), ("CC-BY-NC-SA-4.0", CC.format("-NonCommercial-ShareAlike")), ("CC-BY-ND-4.0", CC.format("-NoDerivatives")), (None, "Licensed under CC BY 3.0."),
        (None, "This is not released under the MIT License."), ("MIT", "We don't cover it. Released under the MIT License."), ("BSD-2-Clause", "\n".join(x for x in lic.TEXTS["BSD-3-Clause"].split("\n") if not x.startswith("3."))), ("BSD-3-Clause", lic.TEXTS["BSD-3-Clause"]),
        ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;"), ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("Zlib", "SPDX-License-Identifier: Zlib"),
    ]
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(100 + i, f"word{i} thing{i}") for i in range(300)]
    got = {r["doc_id"]: r["license"] for r in lic.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/f"))).collect()}
    assert [got[i] for i in range(len(texts))] == [n for n, _ in texts]
