"""License scans: Dice coefficient of word bigrams between lines and notice templates; DataFrame operations only."""

from __future__ import annotations

import functools
import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import whole
from tonegrid.session import materialize

#: Fixed texts: notices by which works are put under common licences, as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
]

#: Least Dice coefficient of a match.
LEAST = 0.8


def normal_words(line: Column) -> Column:
    """Lower-case words of ASCII letters and digits; anything else separates them."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(line), r"[^a-z0-9]+", " ")), " "), lambda w: w != "")


def bigrams(words: str) -> Column:
    """The set of pairs of neighbouring words of a column of words."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda a, b: F.concat_ws(" ", a, b)))


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Licence and bigrams of every template, normalised as lines are; one-word templates have none and are left out."""
    words = [(name, re.sub(r"[^a-z0-9]+", " ", text.lower()).split()) for name, text in templates]
    return [(name, list(dict.fromkeys(map(" ".join, itertools.pairwise(w))))) for name, w in words if len(w) > 1]


def needles(sets: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Bigrams of which every matching unit has one or more.

    A match shares at least least / (2 - least) of a template's s bigrams, o of them say, so it has one of any s - o + 1;
    the longest are taken, as the rarest.
    """
    found: dict[str, None] = {}
    for _, pairs in sets:
        shared = math.ceil(len(pairs) * least / (2 - least) - 1e-9)
        found.update(dict.fromkeys(sorted(pairs, key=lambda p: (-len(p), p))[: len(pairs) - shared + 1]))
    return list(found)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", windows: bool = False) -> DataFrame:
    """Matches: id, ``unit`` (line or paragraph), ``place`` (from 1), ``licence``, ``dice``, ``matched`` (its text).

    Units are the lines of a text and its paragraphs of several lines (between blank lines), of any length. The
    normalised words of a unit give a set of bigrams, which is compared with those of the templates whose set has a size
    that can still reach ``least``: smaller / larger >= least / (2 - least). Per unit and licence the best template
    counts. Texts without any bigram that a match must have are not split at all. Null and empty texts and units of one
    word match nothing; repeated rows are scanned one by one. The templates are a fixed list of literals; no row moves.
    With ``windows``, notices inside something longer are found too: see ``window_rows``. The texts with such a bigram are
    then written once, so that all texts are searched once for both.
    """
    sets = template_sets(templates)
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, pairs)).alias("pairs"), F.lit(len(pairs)).alias("size")) for name, pairs in sets])
    text = whole(F.col(text_col))
    normal = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")
    # one element, so that the normalised text is made once for all needles
    likely = F.exists(F.array(normal), lambda t: functools.reduce(lambda a, b: a | b, [t.contains(n) for n in needles(sets, least)]))
    rows = docs.where(likely).select(F.col(id_col).alias("_id"), text.alias("_text"))
    if windows:
        rows = materialize(rows, "licence-texts")
    several = F.filter(F.transform(F.split("_text", r"\n[ \t\r]*\n"), lambda p, i: F.struct(F.lit("paragraph").alias("unit"), (i + 1).alias("place"), p.alias("text"))), lambda p: p["text"].contains("\n"))
    lines = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), (i + 1).alias("place"), x.alias("text")))
    units = rows.select("_id", F.explode(F.concat(lines, several)).alias("_u")).withColumn("_words", normal_words(F.col("_u.text")))
    units = units.withColumn("_pairs", bigrams("_words")).withColumn("_n", F.size("_pairs"))
    narrow = least / (2 - least) - 1e-9
    fitting = F.filter(table, lambda t: (F.col("_n") >= narrow * t["size"]) & (t["size"] >= narrow * F.col("_n")))
    dice = lambda t: 2.0 * F.size(F.array_intersect(t["pairs"], F.col("_pairs"))) / (F.col("_n") + t["size"])
    scored = units.where(F.col("_n") > 0).withColumn("_hits", F.transform(fitting, lambda t: F.struct(t["licence"].alias("licence"), dice(t).alias("dice"))))
    ordered = scored.withColumn("_hits", F.sort_array(F.filter("_hits", lambda h: h["dice"] >= least), asc=False))
    best = F.filter("_hits", lambda h, i: (i == 0) | (h["licence"] != F.element_at(F.col("_hits.licence"), F.greatest(i, F.lit(1)))))
    found = ordered.withColumn("_hit", F.explode(best)).select(F.col("_id").alias(id_col), "_u.unit", "_u.place", "_hit.licence", "_hit.dice", F.col("_u.text").alias("matched"))
    return found.unionByName(window_rows(rows, sets, least).withColumnRenamed("_id", id_col)) if windows else found


def window_rows(rows: DataFrame, sets: list[tuple[str, list[str]]], least: float) -> DataFrame:
    """Matches of ``unit`` window in the words of whole texts, whatever lines, sentences and marks lie between them.

    A window runs from one bigram of a template to another, as any best window does, and has one of the template's
    needles. Per licence the best of overlapping windows counts; one within a line or paragraph that matches the licence
    as a whole is that match and is left out. ``place`` is the number of its first word, ``matched`` its words.
    """
    narrow = least / (2 - least)
    shared = [math.ceil(len(pairs) * narrow - 1e-9) for _, pairs in sets]
    most = [math.floor(len(pairs) / narrow + 1e-9) for _, pairs in sets]
    of = [F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, pairs)).alias("pairs"), F.lit(len(pairs)).alias("size"), F.lit(o).alias("shared"), F.lit(m).alias("most"), F.array(*map(F.lit, needles([(name, pairs)], least))).alias("needles")) for (name, pairs), o, m in zip(sets, shared, most, strict=True)]
    table = F.array(*of)
    once = lambda df, **columns: df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once")).select(*df.columns, "_once.*")
    numbered = F.flatten(F.transform(F.split("_text", "\n"), lambda x, i: F.transform(normal_words(x), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    texts = once(rows, _words=numbered).where(F.size("_words") > 1)
    before, after = F.slice("_words.w", F.lit(1), F.size("_words") - 1), F.slice("_words.w", F.lit(2), F.size("_words") - 1)
    texts = once(texts, _pairs=F.zip_with(before, after, lambda a, b: F.concat_ws(" ", a, b)))
    texts = once(texts, _live=F.filter(table, lambda t: F.arrays_overlap(t["needles"], F.col("_pairs")))).where(F.size("_live") > 0)
    hits = lambda t: F.filter(F.transform("_pairs", lambda p, i: F.when(F.array_contains(t["pairs"], p), i)), lambda i: i.isNotNull())
    texts = once(texts, _hits=F.transform("_live", lambda t: F.struct(t.alias("t"), hits(t).alias("at"))))

    def best_from(t, a, ends):
        """The best window that begins at bigram a and ends at one of the given."""
        def scored(e):
            inside = F.slice("_pairs", a + 1, e - a + 1)
            both = F.size(F.array_intersect(t["pairs"], inside))
            return F.struct((2.0 * both / (F.size(F.array_distinct(inside)) + t["size"])).alias("dice"), e.alias("stop"))

        return F.array_max(F.transform(F.filter(ends, lambda e: e - a + 1 >= t["shared"]), scored))

    def of_template(h):
        t, at = h["t"], h["at"]
        reach = F.transform(at, lambda a, k: F.struct(a.alias("a"), F.filter(F.slice(at, k + 1, t["most"]), lambda e: e < a + t["most"]).alias("ends")))
        full = F.filter(reach, lambda r: F.size(r["ends"]) >= t["shared"])
        tried = F.transform(full, lambda r: F.struct(r["a"].alias("a"), best_from(t, r["a"], r["ends"]).alias("b")))
        return F.transform(F.filter(tried, lambda w: w["b"]["dice"] >= least), lambda w: F.struct(t["licence"].alias("licence"), w["a"].alias("start"), w["b"]["stop"].alias("stop"), w["b"]["dice"].alias("dice")))

    texts = once(texts, _found=F.array_sort(F.flatten(F.transform("_hits", of_template)))).where(F.size("_found") > 0)

    def keep(kept, w):
        last = F.element_at(kept, -1)
        apart = (F.size(kept) == 0) | (last["licence"] != w["licence"]) | (last["stop"] < w["start"])
        return F.when(apart, F.concat(kept, F.array(w))).when(last["dice"] < w["dice"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(w))).otherwise(kept)

    none = F.array().cast("array<struct<licence:string,start:int,stop:int,dice:double>>")
    wins = texts.select("_id", "_text", "_words", F.explode(F.aggregate("_found", none, keep)).alias("_w"))
    first, last = F.col("_words.line")[F.col("_w.start")], F.col("_words.line")[F.col("_w.stop") + 1]
    wins = once(wins, _first=first, _last=last)
    # every cut between paragraphs has two line ends
    lines_of = lambda p: F.size(F.split(p, "\n"))
    parts = F.split("_text", r"\n[ \t\r]*\n")
    ends = lambda i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(-1), lambda n, p: n + lines_of(p) + 1)
    paragraphs = F.filter(parts, lambda p, i: (ends(i) >= F.col("_last")) & (ends(i) - lines_of(p) < F.col("_first")))
    line = F.when(F.col("_first") == F.col("_last"), F.array(F.element_at(F.split("_text", "\n"), F.col("_first")))).otherwise(F.array().cast("array<string>"))
    wins = once(wins, _units=F.transform(F.concat(line, paragraphs), lambda u: F.transform(F.array(normal_words(u)), bigrams)[0]))
    whole_match = lambda p: F.exists(table, lambda t: (t["licence"] == F.col("_w.licence")) & (2.0 * F.size(F.array_intersect(t["pairs"], p)) / (F.size(p) + t["size"]) >= least))
    wins = wins.where(~F.exists("_units", whole_match))
    words = F.slice("_words.w", F.col("_w.start") + 1, F.col("_w.stop") - F.col("_w.start") + 2)
    return wins.select("_id", F.lit("window").alias("unit"), (F.col("_w.start") + 1).alias("place"), "_w.licence", "_w.dice", F.concat_ws(" ", words).alias("matched"))


def sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> str:
    """The same matches, without their texts, over ``documents`` in DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in templates)
    pairs = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    words = lambda t: f"list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""
with t as (select licence, {pairs('w')} as p from (select licence, {words('body')} as w from (values {values}) v(licence, body)) a where len(w) > 1),
 u as (select doc_id, 'line' as unit, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as place from documents
  union all select * from (select doc_id, 'paragraph' as unit, unnest(string_split_regex(text, '\n[ \t\r]*\n')) as body,
   generate_subscripts(string_split_regex(text, '\n[ \t\r]*\n'), 1) as place from documents) b where contains(body, chr(10))),
 n as (select doc_id, unit, place, {pairs('w')} as p from (select doc_id, unit, place, {words('body')} as w from u) c where len(w) > 1)
select doc_id, unit, cast(place as int) as place, licence, max(2.0e0 * len(list_intersect(t.p, n.p)) / (len(n.p) + len(t.p))) as dice
from n join t on list_has_any(n.p, t.p) where 2.0e0 * len(list_intersect(t.p, n.p)) / (len(n.p) + len(t.p)) >= {least}
group by doc_id, unit, place, licence
"""
