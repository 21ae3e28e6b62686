"""Operator 8: licence scans by sparse TF-IDF cosine, with directory inheritance.

Parts of a text (lines and two neighbouring lines, their sentences, paragraphs,
windows of terms) are compared to licence templates as TF-IDF vectors: headers and
titles, and full licence texts; whole texts are compared to full licence texts.
Frequencies are those of all terms over all
documents. What no bound on the cosine excludes is compared; the bounds follow
from the weights (Cauchy-Schwarz), so nothing is lost by them. A document without
a licence of its own inherits that of its nearest ancestor directory that has a
licence file, found by joins on directory paths. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: A part of a text has a licence from the first cosine on; a whole text is a licence file, of its directory too, from the second.
HEADER, FILE = 0.6, 0.5
#: Terms of the windows that texts are cut into, each beginning at the half of the one before; templates longer than SHORT terms ask for windows.
WINDOWS, SHORT = (32, 64, 128, 256, 512, 1024, 2048), 24
#: Terms that at least this share of all documents hold are joined by broadcast; there are at most the mean number of terms / share of them.
HOT_SHARE = 0.01

#: The headers and titles of licences, (licence, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
]
#: Full licence texts, one file each; read by the driver only.
TEXTS = Path(__file__).parent / "licence_texts"
#: Says that all is forbidden; whatever grants a licence goes before it.
LAST = "Proprietary"
_TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Where a sentence of a line ends; what says that a part grants nothing; a tag that names a licence.
SENTENCE_END = "(?<=[.;!?])[ \\t]+(?=[A-Z])"
NEGATED = "(?:^|[^A-Za-z])(?i:not|never|no longer)[ \\t]+(?i:be[ \\t]+|been[ \\t]+)?(?i:licensed|released|distributed|dedicated|published)(?:$|[^A-Za-z])"
TAG = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.-]+?)(?:-only|-or-later|\+)?(?:$|[^A-Za-z0-9.+-])"
_WHOLE, _PARAGRAPH, _LINE, _PAIR, _SENTENCE, _WRAPPED, _WINDOW = range(7)


def templates() -> list[tuple[str, str]]:
    """(licence, text): the headers, then the full texts. That of AGPL-3.0 is GPL-3.0's with the other name."""
    texts = {f.stem: f.read_text() for f in TEXTS.glob("*.txt")}
    texts["AGPL-3.0"] = re.sub(r"(?i)\bgnu general public\b", "GNU Affero General Public", texts["GPL-3.0"])
    return TEMPLATES + sorted(texts.items())


def terms(text: Column) -> Column:
    """Lowered runs of ASCII letters and digits, joined by dots and hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, held: documents that hold it) of all terms of all documents."""
    words = F.array_distinct(terms(F.coalesce("text", F.lit(""))))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("held"))


def inverse(held: float, total: int) -> float:
    return math.log((1 + total) / (1 + held)) + 1


def template_vectors(known: list[tuple[str, str]], held: dict[str, int], total: int) -> list[dict[str, float]]:
    """Of each template term -> weight: 1 + log(count) times the inverse document frequency, of length 1."""
    out = []
    for _, text in known:
        weights = {t: (1 + math.log(n)) * inverse(held.get(t, 0), total) for t, n in Counter(re.findall(_TERM, text.lower())).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.append({t: w / norm for t, w in weights.items()})
    return out


def needed(vector: dict[str, float], cosine: float, spare: float = 1.0) -> tuple[set[str], int]:
    """Terms of a template, and how many of them a text must hold to reach the cosine.

    A cosine is at most the root of the summed squares of the shared terms'
    weights. The lightest terms with a sum below ``spare`` of the cosine's square
    are left out; of the others, so many as the heaviest need for the rest.
    """
    goal, dropped, kept = cosine**2 * (1 - 1e-9), 0.0, []
    for w, t in sorted((w * w, t) for t, w in vector.items()):
        if not kept and dropped + w < goal * spare:
            dropped += w
        else:
            kept.append((w, t))
    rest, many = goal - dropped, 0
    for w, _ in reversed(kept):
        many += 1
        rest -= w
        if rest <= 0:
            break
    return {t for _, t in kept}, max(1, many)


def parts(texts: DataFrame, heavy: list[str], pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(digest, kind, n, term): the terms that ``pick`` leaves of all parts that are compared. texts: (digest, text, windowed)."""
    strings = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
    lines = F.split("text", "\n")
    pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.concat_ws(" ", a, b))
    # a line of one sentence is compared as a line
    several = lambda found: F.flatten(F.filter(F.transform(found, lambda x: F.split(x, SENTENCE_END)), lambda x: F.size(x) > 1))
    out = texts.select("digest", F.lit(_WHOLE).alias("kind"), F.lit(0).alias("n"), F.explode(terms(F.col("text"))).alias("term"))
    for kind, cut in ((_PARAGRAPH, F.split("text", r"\n[ \t\r]*\n")), (_LINE, lines), (_PAIR, pairs), (_SENTENCE, several(lines)), (_WRAPPED, several(pairs))):
        each = texts.select("digest", F.lit(kind).alias("kind"), F.posexplode(cut).alias("n", "part")).select("digest", "kind", "n", "part", terms(F.col("part")).alias("terms"))
        if kind != _PARAGRAPH:  # no header without one of its heavy terms
            each = each.where(F.arrays_overlap("terms", strings(heavy)))
        out = out.unionByName(each.where(~F.col("part").rlike(NEGATED)).select("digest", "kind", "n", F.explode("terms").alias("term")))
    placed = pick(texts.where("windowed").select("digest", F.posexplode(terms(F.col("text"))).alias("at", "term")))
    covering = [F.struct(F.lit(_WINDOW + k).alias("kind"), (F.floor(F.col("at") / (size // 2)).cast("int") - back).alias("n")) for k, size in enumerate(WINDOWS) for back in (0, 1)]
    windows = placed.select("digest", F.explode(F.array(*covering)).alias("w"), "term").where("w.n >= 0").select("digest", "w.kind", "w.n", "term")
    return pick(out).select("digest", "kind", "n", "term").unionByName(windows)


def cosines(texts: DataFrame, known: list[tuple[str, str]], vectors: list[dict[str, float]], heavy: list[str], held: DataFrame, total: int, header: float, file: float) -> DataFrame:
    """Of every text: digest, __header (of its best part) and __file (of the whole text), each struct(named, cosine, licence)
    of the nearest template, null below the threshold; licences go before ``LAST``, of equal ones the last name counts."""
    spark = texts.sparkSession
    found = [(t, *([v.get(t, 0.0) for v in vectors],)) for t in sorted({t for v in vectors for t in v})]
    # the templates' terms only: bounded, whatever the corpus
    mine = spark.createDataFrame(found, "term string, v array<double>").join(F.broadcast(held.where("of_template")), "term", "left").select("term", "v", F.coalesce("held", F.lit(0)).alias("held"))
    mine = shared.keep(mine, "licence-vocabulary")
    weight = (1 + F.log(F.col("tf").cast("double"))) * (F.log((1.0 + total) / (1 + F.col("held"))) + 1)
    unit = ["digest", "kind", "n"]
    counted = lambda rows: rows.groupBy(*unit, "term").agg(F.count("*").alias("tf"))
    dots = [F.sum(F.col("w") * F.col("v")[k]).alias(f"dot{k}") for k in range(len(known))]
    inside = counted(parts(texts, heavy, lambda rows: rows.join(F.broadcast(mine.select("term")), "term"))).join(F.broadcast(mine), "term").withColumn("w", weight).groupBy(*unit).agg(F.sum(F.col("w") * F.col("w")).alias("square"), *dots)
    # terms outside the templates only make a vector longer: parts that are too far without them need not be completed
    least = min(header, file) * (1 - 1e-9)
    inside = shared.keep(inside.where(F.greatest(*(F.col(f"dot{k}") for k in range(len(known)))) >= least * F.sqrt("square")), "licence-near")
    near = texts.join(inside.select("digest").distinct(), "digest", "left_semi")
    rest = counted(parts(near, heavy, lambda rows: rows.join(F.broadcast(mine.select("term")), "term", "left_anti")).join(inside.select(*unit), unit, "left_semi"))
    common = held.where(F.col("held") >= HOT_SHARE * total).select("term", "held")
    weighed = rest.join(F.broadcast(common), "term").unionByName(rest.join(held.where(F.col("held") < HOT_SHARE * total).select("term", "held"), "term"))
    outside = weighed.groupBy(*unit).agg(F.sum(weight * weight).alias("more"))
    scored = inside.join(outside, unit, "left").withColumn("norm", F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0))))
    score = lambda k: F.struct(F.lit(known[k][0] != LAST).alias("named"), F.round(F.col(f"dot{k}") / F.col("norm"), 9).alias("cosine"), F.lit(known[k][0]).alias("licence"))
    least_of = F.when(F.col("kind") == _WHOLE, file).otherwise(header)
    of = lambda ks: F.array_max(F.filter(F.array(*map(score, ks)), lambda s: s["cosine"] >= least_of))
    long = [k for k, (_, x) in enumerate(known) if len(re.findall(_TERM, x.lower())) > SHORT]
    nearest = F.when(F.col("kind").isin(_LINE, _PAIR, _SENTENCE, _WRAPPED), of(range(len(TEMPLATES)))).when(F.col("kind") >= _WINDOW, of(long)).when(F.col("kind") == _WHOLE, of(range(len(TEMPLATES), len(known)))).otherwise(of(range(len(known))))
    best = scored.select("digest", "kind", nearest.alias("best"))
    return best.groupBy("digest").agg(F.max(F.when(F.col("kind") != _WHOLE, F.col("best"))).alias("__header"), F.max(F.when(F.col("kind") == _WHOLE, F.col("best"))).alias("__file"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(docs: DataFrame, path: str = "path", header: float = HEADER, file: float = FILE) -> DataFrame:
    """The rows of docs without text, with licence, cosine, how (``own``, ``inherited`` or null) and licence_dir.

    A whole text whose cosine to a full licence text reaches ``file`` is a licence
    file; lines, pairs of neighbouring lines and sentences of both are compared to
    the headers, windows to the templates of more than SHORT terms, paragraphs to
    all, and count from ``header`` on. Lines, pairs, sentences and paragraphs that
    say of something that it is not licensed or released count for nothing. The
    first SPDX tag that names a licence of the templates is a header of cosine 1.
    Own: a licence goes before "all rights reserved", then the whole text's before
    a part's.
    A licence file sets the licence of its directory; of several one that grants
    something, then the largest cosine, then the first name, counts. Documents
    without an own licence inherit from the nearest directory above them that has
    one, their own directory first. Null texts are empty; a null path is in no
    directory; columns of the new names are replaced; repeated rows stay.
    """
    known = templates()
    vocabulary = docs.sparkSession.createDataFrame([(t,) for t in sorted({t for _, x in known for t in re.findall(_TERM, x.lower())})], "term string")
    held = shared.keep(document_frequencies(docs).join(F.broadcast(vocabulary.withColumn("of_template", F.lit(True))), "term", "left").select("term", "held", F.coalesce("of_template", F.lit(False)).alias("of_template")), "licence-frequencies")
    total = docs.count()
    vectors = template_vectors(known, {r["term"]: r["held"] for r in held.where("of_template").collect()}, total)  # at most the vocabulary
    long = [v for (_, x), v in zip(known, vectors, strict=True) if len(re.findall(_TERM, x.lower())) > SHORT]
    heavy, heavy_long = (sorted(set().union(*(needed(v, least)[0] for v in some))) for some, least in ((vectors[: len(TEMPLATES)], header), (long, min(header, file))))

    strings = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
    new = ("licence", "cosine", "how", "licence_dir")
    columns = [c for c in docs.columns if c not in ("text", *new)]
    held_here = F.array_distinct(terms(F.coalesce("text", F.lit(""))))

    def enough(ts: Column) -> Column:
        """Whether a text holds enough of some long template; counted only where it holds a heavy term of one."""
        each = [F.size(F.array_intersect(ts, strings(sorted(found)))) >= n for found, n in (needed(v, min(header, file), 0.5) for v in long)]
        return F.when(F.arrays_overlap(ts, strings(heavy_long)), F.exists(F.array(*each), lambda x: x)).otherwise(False)

    flags = F.transform(F.array(held_here), lambda ts: F.struct(F.arrays_overlap(ts, strings(heavy)).alias("short"), enough(ts).alias("long")))[0]
    text = F.col("text").cast("string")
    names = F.create_map(*(F.lit(x) for name in sorted({n for n, _ in known} - {LAST}) for x in (name.lower(), name)))
    tagged = F.filter(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda x: names[F.lower(x)]), lambda x: x.isNotNull())
    tag = F.when(F.contains(text, F.lit("SPDX-License-Identifier:")), F.get(tagged, F.lit(0)))
    rows = docs.select(*columns, text.alias("text"), parent(F.col(path)).alias("__dir"), flags.alias("__may"), tag.alias("__tag"))
    may = F.col("__may.short") | F.col("__may.long")
    # texts that may hold a licence are kept beside their rows: one pass, and no join to find them again
    rows = shared.keep(rows.select(*columns, "__dir", "__tag", F.when(may, F.unhex(F.md5(F.col("text").cast("binary")))).alias("__digest"), F.when(may, F.col("text")).alias("__text"), F.coalesce("__may.long", F.lit(False)).alias("__windowed")), "licence-rows")
    texts = rows.where("__digest is not null").select(F.col("__digest").alias("digest"), F.col("__text").alias("text"), F.col("__windowed").alias("windowed")).dropDuplicates(["digest"])
    texts = shared.keep(texts, "licence-texts")
    best_of = cosines(texts, known, vectors, heavy, held, total, header, file)
    rows = rows.drop("__text", "__windowed")
    none = [F.lit(None).cast(best_of.schema[c].dataType).alias(c) for c in ("__header", "__file")]
    screened = rows.where("__digest is not null").join(best_of.withColumnRenamed("digest", "__digest"), "__digest", "left")
    rows = screened.drop("__digest").unionByName(rows.where("__digest is null").drop("__digest").select("*", *none))
    rows = shared.keep(rows, "licences")
    by_tag = F.struct(F.lit(True).alias("named"), F.lit(1.0).alias("cosine"), F.col("__tag").alias("licence"))
    rows = rows.withColumn("__header", F.when(F.col("__tag").isNotNull(), by_tag).otherwise(F.col("__header")))
    whole_first = F.array_max(F.array(*(F.struct(F.col(f"{c}.named").alias("named"), F.lit(c == "__file").alias("whole"), F.col(f"{c}.cosine").alias("cosine"), F.col(f"{c}.licence").alias("licence")) for c in ("__header", "__file"))))
    rows = rows.withColumn("__own", F.when(F.coalesce("__file.cosine", "__header.cosine").isNotNull(), whole_first))
    # directories are few against documents: inheritance is settled between directories first
    set_here = rows.where(F.col("__file").isNotNull() & F.col("__dir").isNotNull()).groupBy(F.col("__dir").alias("__above")).agg(
        F.min(F.struct((~F.col("__file.named")).alias("last"), (-F.col("__file.cosine")).alias("c"), F.col("__file.licence").alias("licence"))).alias("__set")
    )
    dirs = rows.where("__dir is not null").select("__dir").distinct()
    steps = F.split(F.col("__dir"), "/")
    above = dirs.select("__dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("__depth", "__above"))
    nearest = above.join(set_here, "__above").groupBy("__dir").agg(F.max(F.struct("__depth", "__above", "__set")).alias("__near"))
    out = rows.join(nearest, "__dir", "left")
    own = F.col("__own").isNotNull()
    return out.select(
        *columns,
        F.coalesce("__own.licence", "__near.__set.licence").alias("licence"),
        F.when(own, F.col("__own.cosine")).otherwise(-F.col("__near.__set.c")).alias("cosine"),
        F.when(own, "own").when(F.col("__near").isNotNull(), "inherited").alias("how"),
        F.when(~own, F.col("__near.__above")).alias("licence_dir"),
    )
