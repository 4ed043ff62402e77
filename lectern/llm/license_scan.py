"""License scans: lines, paragraphs and whole texts against licence templates by Dice coefficient.

A unit of text (each line, each paragraph between blank lines, the whole text) is normalised to words, and its
set of word bigrams is compared with each template's: Dice = 2 |A and B| / (|A| + |B|). A pair can only reach
a threshold t if the smaller set has at least t / (2 - t) of the larger's bigrams, so templates of other sizes
are left out before any comparison, and so are units that share no bigram with any template.

Templates are rows of (license_id, text); the standard ones are below. They are turned into literals of
the plan, which :func:`scan` allows up to ``max_templates``.

Defined cases: null and empty texts and units of one word have no bigrams and match nothing; equal scores go
to the smaller license_id; repeated rows are scanned one by one; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.text import let, whole

# Usual notices and short texts of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def normal_words(text: str) -> list[str]:
    """Words of a template, as :func:`bigrams` makes them of a column."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def template_bigrams(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in sorted(templates):
        w = normal_words(text)
        if pairs := sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}):
            out.append((name, pairs))
    return out


def bigrams(text: Column) -> Column:
    """The set of word bigrams of a normalised text."""
    ws = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return let(ws, lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.75, max_templates: int = 2000) -> DataFrame:
    """``docs`` plus _ls_hits: array of (license_id, dice, unit), one for each unit that reaches the threshold."""
    known = template_bigrams(templates if templates is not None else TEMPLATES)
    if len(known) > max_templates:
        raise ValueError("too many templates for literals")
    if not known:
        return docs.withColumn("_ls_hits", F.array().cast("array<struct<license_id:string,dice:double,unit:string>>"))
    every = F.array(*[F.lit(x) for x in sorted({p for _, pairs in known for p in pairs})])
    most = max(len(pairs) for _, pairs in known)
    ratio = threshold / (2 - threshold)

    def best(found: Column) -> Column:
        """The best template of a unit with these bigrams, as (dice, license_id), or null."""

        def one(name: str, pairs: list[str]) -> Column:
            n = len(pairs)
            fits = (F.size(found) >= ratio * n) & (n >= ratio * F.size(found))
            shared = F.size(F.array_intersect(found, F.array(*[F.lit(p) for p in pairs])))
            return F.when(fits, F.struct((2.0 * shared / (F.size(found) + n)).alias("dice"), F.lit(name).alias("license_id")))

        scores = F.filter(F.array(*[one(*k) for k in known]), lambda s: s.isNotNull() & (s["dice"] >= threshold))
        ranked = F.array_sort(scores, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license_id"] < b["license_id"], -1).when(a["license_id"] > b["license_id"], 1).otherwise(0))
        return F.when((F.size(found) > 0) & (F.size(found) * ratio <= most) & F.arrays_overlap(found, every), F.get(ranked, 0))

    text = whole("text")
    units = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, "\n[ \\t\\r]*\n", -1), F.array(text)))
    scored = F.transform(units, lambda u: let(let(bigrams(u), best), lambda s: F.struct(s["license_id"].alias("license_id"), s["dice"].alias("dice"), u.alias("unit"))))
    return docs.withColumn("_ls_hits", F.filter(scored, lambda s: s["license_id"].isNotNull()))
