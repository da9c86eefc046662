"""Licence notices in texts, by Dice coefficient over word bigrams; DataFrame functions only.

Units are a text's lines and its paragraphs of several lines (blank lines between them), normalised to the words of
lower-cased A-Z and digits. A unit is compared with the templates whose number of distinct bigrams lies within the
bounds that the threshold sets: with Dice ``2c / (a + b) >= t`` and ``c <= min(a, b)``, b lies between ``a * t / (2 - t)``
and ``a * (2 - t) / t``. A unit that shares too few of its bigrams with all templates together is passed over before that,
which loses nothing: c is at least ``t * (a + b) / 2 >= a * t / (2 - t)``.

All of it is a projection of the row: no shuffle, no explode, and hot sources or repeated rows cost what any row costs.
A null text has no hits, as has a text without two words in any unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# fixed values: public notices, by SPDX identifier
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(text: str) -> list[str]:
    """The words of a template, as the columns below make them."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def scan_table(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, then n_hits, licenses (distinct, in order, comma-joined), best_license and best_dice of every row.

    Each unit that reaches the threshold is a hit of its best template; ties go to the template listed first.
    """
    grams = [bigrams(normalise(t)) for _, t in TEMPLATES]
    lit = lambda xs: F.array(*map(F.lit, xs))
    templates = F.array(*[F.struct(F.lit(-i).alias("rank"), F.lit(name).alias("name"), F.lit(len(g)).alias("n"), lit(g).alias("grams")) for i, ((name, _), g) in enumerate(zip(TEMPLATES, grams, strict=True))])
    every = lit(sorted({x for g in grams for x in g}))
    share, sizes = threshold / (2 - threshold), [len(g) for g in grams]

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.split(body, "\n")
    paragraphs = F.filter(F.split(body, "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    words = F.transform(F.concat(lines, paragraphs), _words)
    paired = F.transform(words, lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))))
    # the bounds of the smallest and largest template, then the share of any template's bigrams
    sized = F.filter(paired, lambda g: (F.size(g) >= share * min(sizes)) & (F.size(g) <= max(sizes) / share))
    likely = F.filter(sized, lambda g: F.size(F.array_intersect(g, every)) >= share * F.size(g))

    def best(g: Column) -> Column:
        near = F.filter(templates, lambda t: (t["n"] >= share * F.size(g)) & (t["n"] <= F.size(g) / share))
        return F.array_max(F.transform(near, lambda t: F.struct((2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"), t["rank"].alias("rank"), t["name"].alias("name"))))

    hits = F.filter(F.transform(likely, best), lambda b: b["dice"] >= threshold)
    top = F.array_max("hits")
    return docs.select(*[F.col(f"`{k}`") for k in keep], hits.alias("hits")).select(
        *[F.col(f"`{k}`") for k in keep],
        F.size("hits").cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.col("hits.name"))), ",").alias("licenses"),
        top["name"].alias("best_license"),
        F.round(top["dice"], 6).alias("best_dice"),
    )


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB, by joins in place of arrays and without any pruning."""
    values = ", ".join(f"({-i}, '{name}', {_sql_list(bigrams(normalise(t)))})" for i, (name, t) in enumerate(TEMPLATES))
    return f"""
    WITH t(rank, name, grams) AS (VALUES {values}),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
    u AS (SELECT r, unnest(list_concat(string_split(body, chr(10)), list_filter(regexp_split_to_array(body, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))))) AS unit FROM d),
    w AS (SELECT r, row_number() OVER () AS k, list_filter(string_split(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM u),
    g AS (SELECT r, k, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
    s AS (SELECT r, k, rank, name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g, t),
    h AS (SELECT r, k, max(struct_pack(dice := dice, rank := rank, name := name)) AS b FROM s WHERE dice >= {threshold} GROUP BY r, k),
    a AS (SELECT r, count(*) AS n, list_aggregate(list_sort(list_distinct(list(b.name))), 'string_agg', ',') AS licenses, max(b) AS top FROM h GROUP BY r)
    SELECT doc_id, coalesce(n, 0) AS n_hits, coalesce(licenses, '') AS licenses, top.name AS best_license, round(top.dice, 6) AS best_dice FROM d LEFT JOIN a USING (r)
    """
