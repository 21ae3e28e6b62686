"""Licence scans against a plain version that compares every part of every text, without any bound."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from sciobs.llm import licenses, queries

from .helpers import awkward, documents, empty, sentence

TEXT = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
MIT = TEXT["MIT"].replace("<year> <copyright holders>", "2019 Jane Doe")
#: As publishers ship it: without a title, with holders, and with the line that forbids all.
BSD_FILE = TEXT["BSD-3-Clause"].split("\n", 2)[2].replace("<year>, <owner>", "2008-2022, Eli Doe")
APACHE_FILE = TEXT["Apache-2.0"]
#: Templates over several lines that end where the code begins.
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met.\n# Neither the name of the copyright holder nor the names of its\n# contributors may be used to endorse or promote products."
APACHE = "// Copyright 2021 Jane Doe. Licensed under the Apache License, Version 2.0 (the License);\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
COMMON = "including use copy limited other rights subject following provided conditions out event kind all particular purpose express whether action claim connection holders authors contract"


def code(header, k, gap="\n\n"):
    return f"{header}{gap}" + "\n".join(sentence(k + j, 12) for j in range(10))


def table(n):
    """Ordinary documents hold the words that licences share with other texts."""
    rows = [(k, f"x/{k // 50}/{k}", f"{COMMON} of the software and the use is in this for no any or a to with be from notice above {sentence(k, 20)}") for k in range(n)]
    parts = [
        ("mit/LICENSE", MIT), ("mit/src/a.py", sentence(5, 30)), ("b/b.py", code(BSD, 7)), ("c/c.py", code(APACHE, 8)), ("d/d.py", code("# (c) 2020 Jane Doe. Released under the MIT License.", 9)),
        ("bsd/LICENSE", BSD_FILE), ("bsd/deep/er/x.c", sentence(6, 30)), ("apache/LICENSE.txt", APACHE_FILE), ("apache/y.c", sentence(7, 30)), ("e/1", code("Released under CC BY 4.0.", 10)),
        ("e/2", code("Distributed under CC BY-SA 4.0.", 11)), ("e/3", code("CC BY 4.0", 12)), ("e/4", code("All rights reserved.", 13)), ("e/5", code("Copyright 2020 Jane Doe. All rights reserved.\nReleased under the MIT License.", 14)),
        ("f/1", code(MIT, 15, "\n")), ("f/2", code(APACHE, 16, "\n")), ("f/3", " ".join(MIT.split())), ("gpl/COPYING", TEXT["GPL-2.0"]), ("gpl/z", None), ("e/6", code("# This file is licensed under the BSD 3-Clause\n# License", 17)), ("g/4", None), (None, MIT),
        ("h/1", code("This package parses dates and numbers. Released under the MIT License. See the project page of all its authors and other readers.", 18)), ("h/2", code("# Copyright 2020 Foo. Licensed under the Apache License, Version 2.0. Contributions are welcome; write to the authors of the garden.", 19)),
        ("agpl/COPYING", re.sub("(?i)gnu general public", "GNU Affero General Public", TEXT["GPL-3.0"])), ("agpl/z", sentence(8, 30)), ("gpl3/COPYING", TEXT["GPL-3.0"]), ("un/LICENSE", TEXT["Unlicense"]),
        ("i/1", "Permission is hereby granted, free of charge, to any person obtaining a copy"), ("i/2", sentence(9, 30)), ("j/1", "THE SOFTWARE IS NOT licensed under the MIT License."), ("j/2", sentence(10, 30)),
    ]
    return rows + [(10_001 + k, *p) for k, p in enumerate(parts)]


def find(text):
    return re.findall(licenses._TERM, "".join(c.lower() if c.isascii() else c for c in text))


def brute(texts):
    """(best part, whole text) of each text by the definition, as (named, cosine, licence) or None."""
    texts = [t or "" for t in texts]
    held = Counter(t for x in texts for t in set(find(x)))
    weigh = lambda found: {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + held[w])) + 1) for w, n in Counter(found).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, weigh(find(x)), len(find(x))) for name, x in licenses.templates()]
    sizes = [norm(v) for _, v, _ in known]

    def best(found, ks, least):
        mine = weigh(found)
        size = norm(mine)
        scored = [(known[k][0] != licenses.LAST, round(sum(x * known[k][1].get(w, 0) for w, x in mine.items()) / size / sizes[k], 9), known[k][0]) for k in ks] if size else []
        return max((s for s in scored if s[1] >= least), default=None)

    grants = lambda x: not re.search(licenses.NEGATED, x)
    full = range(len(licenses.TEMPLATES), len(known))
    headers, every, long = range(len(licenses.TEMPLATES)), range(len(known)), [k for k, x in enumerate(known) if x[2] > licenses.SHORT]
    done = {}
    for text in set(texts):
        lines, ts = text.split("\n"), find(text)
        pairs = [f"{a} {b}" for a, b in zip(lines, lines[1:], strict=False)]
        sentences = [x for line in lines + pairs for x in re.split(licenses.SENTENCE_END, line)]
        found = [best(find(x), headers, licenses.HEADER) for x in lines + pairs + sentences if grants(x)]
        found += [best(find(x), every, licenses.HEADER) for x in re.split(r"\n[ \t\r]*\n", text) if grants(x)]
        for size in licenses.WINDOWS:
            found += [best(ts[a : a + size], long, licenses.HEADER) for a in range(0, len(ts), size // 2)]
        done[text] = (max((f for f in found if f), default=None), best(ts, full, licenses.FILE))
    return [done[t] for t in texts]


@pytest.mark.parametrize("n", [40, 700])
def test_every_part_against_brute_force(spark, n):
    rows = table(n)
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (part, whole) in zip(rows, brute([t for *_, t in rows]), strict=True):
        own = max(((f[0], whole_, *f[1:]) for f, whole_ in ((part, False), (whole, True)) if f), default=None)
        if own:
            assert (got[i]["how"], got[i]["licence"]) == ("own", own[3]), i
            assert got[i]["cosine"] == pytest.approx(own[2], abs=1e-8)
        else:
            assert got[i]["how"] != "own", (i, got[i])
    name = {p: (got[i]["licence"], got[i]["how"], got[i]["licence_dir"]) for i, p, _ in rows}
    assert name["mit/LICENSE"][:2] == name["f/3"][:2] == name["f/1"][:2] == name["d/d.py"][:2] == name["e/5"][:2] == ("MIT", "own")
    assert name["bsd/LICENSE"][:2] == name["b/b.py"][:2] == ("BSD-3-Clause", "own") and name["bsd/deep/er/x.c"] == ("BSD-3-Clause", "inherited", "bsd")
    assert name["apache/LICENSE.txt"][:2] == name["c/c.py"][:2] == name["f/2"][:2] == ("Apache-2.0", "own") and name["apache/y.c"] == ("Apache-2.0", "inherited", "apache")
    assert name["e/1"][0] == name["e/3"][0] == "CC-BY-4.0" and name["e/2"][0] == "CC-BY-SA-4.0" and name["e/4"][:2] == ("Proprietary", "own")
    assert name["gpl/COPYING"][:2] == ("GPL-2.0", "own") and name["gpl/z"] == ("GPL-2.0", "inherited", "gpl") and name["mit/src/a.py"] == ("MIT", "inherited", "mit")
    assert name["h/1"][:2] == ("MIT", "own") and name["h/2"][:2] == ("Apache-2.0", "own") and name["un/LICENSE"][:2] == ("Unlicense", "own")
    assert name["agpl/COPYING"][:2] == ("AGPL-3.0", "own") and name["agpl/z"] == ("AGPL-3.0", "inherited", "agpl") and name["gpl3/COPYING"][:2] == ("GPL-3.0", "own")
    assert name["i/2"] == name["j/1"] == name["j/2"] == (None, None, None)  # neither is a licence file
    assert all(got[k]["licence"] is None for k in range(n)) and name["g/4"] == (None, None, None) and name[None][:2] == ("MIT", "own")


def test_the_bound_loses_nothing():
    """No set of terms below the bound reaches the cosine."""
    vector = {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.5, "e": math.sqrt(1 - 0.39)}
    for spare in (1.0, 0.5):
        kept, many = licenses.needed(vector, 0.6, spare)
        for bits in range(32):
            held = {t for k, t in enumerate("abcde") if bits >> k & 1}
            if math.sqrt(sum(vector[t] ** 2 for t in held)) >= 0.6:
                assert len(held & kept) >= many


def test_nearest_directory_and_repeated_rows(spark):
    rows = [(1, "a/LICENSE", MIT), (2, "a/b/code.py", sentence(1, 30)), (3, "a/b/c/d/LICENSE", APACHE_FILE), (4, "a/b/c/d/x", sentence(4, 9)), (5, "ab/x", sentence(5, 9)), (6, "top", sentence(6, 9)), (7, None, sentence(7, 9)), (8, "a/b/z", ""), (8, "a/b/z", "")]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    got = {r["doc_id"]: (r["licence"], r["how"], r["licence_dir"]) for r in out}
    assert len(out) == len(rows) and got[2] == got[8] == ("MIT", "inherited", "a") and got[4] == ("Apache-2.0", "inherited", "a/b/c/d")
    assert got[5] == got[6] == got[7] == (None, None, None)


def test_tags_and_denials(spark):
    texts = {
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later\nx = 1": "GPL-2.0", "SPDX-License-Identifier: Foo-1.0": None, "SPDX-License-Identifier: Foo-1.0\nSPDX-License-Identifier: (apache-2.0 OR MIT)": "Apache-2.0",
        "SPDX-License-Identifier: MITX": None, "SPDX-License-Identifier: LGPL-3.0+ and more": "LGPL-3.0", "This is not released under the MIT License.": None, "It was never licensed under the Apache License, Version 2.0. It is released under the MIT License.": "MIT", "a" * 50_000: None, "": None,
    }
    filler = [(100 + k, f"f/{k}", sentence(k, 40)) for k in range(60)]
    docs = spark.createDataFrame(filler + [(k, f"d{k}/x", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for k, (text, licence) in enumerate(texts.items()):
        assert got[k]["licence"] == licence, text[:80]
        assert got[k]["licence_dir"] is None


def test_licence_awkward_rows(spark):
    docs = queries.document_paths(documents(spark)).withColumnsRenamed({"lang": "licence", "n_chars": "cosine"})
    out = licenses.scan(docs)
    assert out.count() == len(awkward()) and out.columns == ["doc_id", "source", "path", "licence", "cosine", "how", "licence_dir"]
    assert licenses.scan(queries.document_paths(empty(spark))).count() == 0
