"""License scans: MinHash bands over windows of words retrieve templates, shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The notices to look for, as their publishers word them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at"
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "BSD-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit "
        "the Software, and to prepare derivative works of the Software"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or any later version."
    ),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."
    ),
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-NC-SA-4.0-line": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."
    ),
    "CC-BY-ND-4.0-line": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."
    ),
    "CC-BY-NC-ND-4.0-line": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."
    ),
}

#: Notices that differ in a few words: of those of a family that a document holds only the ones held best count.
FAMILIES = {n: "gnu" for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}

#: Words of a shingle; least share of a template's shingles that a document holds.
SHINGLE, CONTAINED = 5, 0.8
#: A word: a run of ASCII letters and digits and of all other non-ASCII characters.
TERM = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
#: Windows, in shingles, and their step in a document. A template is indexed, at every place, in windows of the
#: largest size that it has SIZE + STEP - 1 shingles for, so each copy of it holds a whole window of the document.
WINDOWS = ((1, 1), (4, 1), (16, 4))
#: Bands of one MinHash value each: windows of similarity s meet with probability 1 - (1 - s) ** 3, 0.992 at 0.8.
BANDS = 3


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(value: Column) -> Column:
    """A column that later filters and projections can't pull in again and compute twice: a generator of one row."""
    return F.explode(F.array(value))


def _ahead(xs: Column, k: int) -> Column:
    return F.slice(xs, F.lit(k + 1), F.size(xs))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _shingles(terms_: Column) -> Column:
    """64-bit hashes of five words in a row, built by doubling."""
    both = lambda x, y: F.xxhash64(x, y)
    four = lambda w: _let(F.zip_with(w, _ahead(w, 1), both), lambda a: F.zip_with(a, _ahead(a, 2), both))
    all_ = lambda w: F.zip_with(four(w), _ahead(w, 4), both)
    hashed = F.transform(terms_, lambda t: F.xxhash64(t))
    return _let(hashed, lambda w: F.slice(all_(w), F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))))


def _fours(values: Column) -> Column:
    """The least of each four values in a row."""
    least = lambda a, b: F.least(a, b)
    cut = lambda a, k: F.slice(F.zip_with(a, _ahead(a, k), least), F.lit(1), F.greatest(F.size(a) - k, F.lit(0)))
    return _let(_let(values, lambda a: cut(a, 1)), lambda a: cut(a, 2))


def _sixteens(fours: Column, step: int) -> Column:
    """The least of each sixteen values in a row, from those of four, at every ``step``-th place."""
    places = F.when(F.size(fours) >= 13, F.sequence(F.lit(0), F.size(fours) - 13, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(places, lambda i: F.least(*[F.get(fours, i + 4 * j) for j in range(4)]))


def _band_keys(rows: DataFrame, *keep: str, long_step: int) -> tuple[DataFrame, list[Column]]:
    """rows with shingle hashes h -> rows and, for each window size and band, an array of MinHash values.

    Windows of one shingle need no band: theirs is the hash itself.
    """

    def hashed(band: int) -> Column:
        return F.transform("h", lambda x: F.xxhash64(x, F.lit(band)))

    fours = F.struct(*[_fours(hashed(band)).alias(f"b{band}") for band in range(BANDS)])
    wide = rows.select(*keep, "h", _once(fours).alias("m"))
    each = [F.col(f"m.b{band}") for band in range(BANDS)]
    return wide, [F.col("h"), *each, *[_sixteens(x, long_step) for x in each]]


def _window(n: int) -> int:
    return max(i for i, (size, step) in enumerate(WINDOWS) if i == 0 or n >= size + step - 1)


def index(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """For each template its name, its shingles as strings and the band keys of its windows: a few thousand numbers."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").coalesce(1)
    keyed = rows.select("name", terms(F.col("text")).alias("terms")).withColumn("h", _shingles(F.col("terms")))
    wide, keys = _band_keys(keyed, "name", "terms", long_step=1)
    found = wide.select("name", "terms", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).collect()
    out = []
    for r in found:
        n = len(r["terms"]) - SHINGLE + 1
        if n < 1:
            raise ValueError(f"template {r['name']} has fewer than {SHINGLE} words")
        at = _window(n)
        columns = [0] if at == 0 else range(1 + BANDS * (at - 1), 1 + BANDS * at)
        shingles = sorted({" ".join(r["terms"][i : i + SHINGLE]) for i in range(n)})
        out.append({"name": r["name"], "shingles": shingles, "keys": {c: sorted(set(r[f"k{c}"])) for c in columns}})
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, families: dict[str, str] = FAMILIES) -> DataFrame:
    """One row for each document and template it holds: ``doc_id, license, n_shingles, n_found, containment``.

    Every window's keys are looked up among the templates' (a parameter of fixed size, carried in the plan);
    a document that meets a template in a band is a candidate, and is a match if its text holds at least
    CONTAINED of the template's shingles, compared as strings; of templates of one family (of ``families``, by name)
    those with the largest share in the document. No row of text is moved. Null texts and texts of
    under five words hold nothing; a template that occurs often in a text is one row; repeated rows of docs are
    repeated. An empty table gives no rows; other columns are ignored.
    """
    known = index(docs.sparkSession, templates)
    longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs]) if xs else F.array().cast("array<bigint>")
    worded = docs.select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("terms"))
    hashed = worded.select("doc_id", "terms", _once(_shingles(F.col("terms"))).alias("h"))
    wide, columns = _band_keys(hashed, "doc_id", "terms", long_step=WINDOWS[-1][1])
    hits = []
    for c, keys in enumerate(columns):
        wanted = sorted({k for t in known for k in t["keys"].get(c, [])})
        if wanted:
            hits.append(F.array_intersect(keys, longs(wanted)))
    met = wide.select("doc_id", "terms", _once(F.concat(*hits)).alias("hits")).where(F.size("hits") > 0)
    candidates = F.concat(
        *[
            F.when(F.arrays_overlap("hits", longs(sorted({k for ks in t["keys"].values() for k in ks}))), F.array(F.lit(i))).otherwise(
                F.array().cast("array<int>")
            )
            for i, t in enumerate(known)
        ]
    )
    strings = F.array(*[F.array(*map(F.lit, t["shingles"])) for t in known])
    spaced = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))
    inside = lambda s: F.contains(F.col("words"), F.concat(F.lit(" "), s, F.lit(" ")))
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    sizes = [len(t["shingles"]) for t in known]
    family = [families.get(t["name"], t["name"]) for t in known]
    counted = F.transform(
        candidates,
        lambda i: F.struct(
            of([t["name"] for t in known], i).alias("license"),
            of(family, i).alias("family"),
            of(sizes, i).cast("long").alias("n_shingles"),
            F.size(F.filter(F.get(strings, i), inside)).cast("long").alias("n_found"),
        ),
    )
    share = lambda x: x["n_found"] / x["n_shingles"]
    worded = met.select("doc_id", spaced.alias("words"), "hits")
    held = worded.select("doc_id", _once(counted).alias("all"))
    held = held.select("doc_id", _once(F.filter("all", lambda x: share(x) >= CONTAINED)).alias("held"))
    best = F.filter("held", lambda x: ~F.exists("held", lambda y: (y["family"] == x["family"]) & (share(y) > share(x))))
    rows = held.select("doc_id", F.explode(best).alias("x"))
    return rows.select("doc_id", "x.license", "x.n_shingles", "x.n_found", share(F.col("x")).alias("containment"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the templates that they hold."""
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Every document against every template, by containment alone.
ORACLE = f"""
WITH t AS (SELECT unnest([{", ".join(f"struct_pack(license := {_quoted(k)}, family := {_quoted(FAMILIES.get(k, k))}, body := {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}]) AS t),
w AS (SELECT t.license AS license, t.family AS family, regexp_extract_all(lower(t.body), '{TERM}') AS ws FROM t),
s AS (SELECT DISTINCT license, family, array_to_string(ws[i:i+{SHINGLE - 1}], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM w)),
g AS (SELECT license, family, list(s) AS ss FROM s GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '{TERM}'), ' ') || ' ' AS words FROM documents),
m AS (SELECT r, doc_id, license, family, CAST(len(ss) AS BIGINT) AS n_shingles,
             CAST(len(list_filter(ss, lambda x: contains(words, ' ' || x || ' '))) AS BIGINT) AS n_found FROM d, g),
c AS (SELECT *, n_found / n_shingles AS containment FROM m WHERE n_found / n_shingles >= {CONTAINED})
SELECT doc_id, license, n_shingles, n_found, containment FROM c QUALIFY containment = max(containment) OVER (PARTITION BY r, family)
"""
