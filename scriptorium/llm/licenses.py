"""Licence scan: Dice coefficient over word bigrams, in DataFrame functions only.

A text is cut into units: its sentences, its lines and the whole text. Units are normalised
(lower case, words of letters and digits) and compared as sets of word bigrams with the
templates. A coefficient of ``DICE`` or more is possible only between sets of sizes within
``DICE / (2 - DICE)`` of each other, so most units are pruned by their size. The best template
of a unit wins; equal ones are ordered by name.

Work stays inside the row: nothing is shuffled. Null, empty and one-word texts match nothing.
Repeated rows each give their row; repeated units of a text count once. Other columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import LOWER, UPPER, bind

DICE = 0.8

#: Names of licences and the notices by which texts state them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words, joined by a space."""
    def make(w):
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.slice(w, i, 2)))
        return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))

    return bind(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[0-9a-z]+"), 0), make)


def template_bigrams(text: str) -> list[str]:
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def units(text: Column) -> Column:
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    return F.array_distinct(F.concat(sentences, F.split(text, "\n"), F.array(text)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id and matches: array of (dice, license, unit), one per matching unit."""
    sets = [(name, template_bigrams(text)) for name, text in templates]
    least = min(len(s) for _, s in sets) * dice / (2 - dice)
    most = max(len(s) for _, s in sets) * (2 - dice) / dice

    def best(u, b):
        scored = []
        for name, s in sets:
            value = 2.0 * F.size(F.array_intersect(b, F.array(*map(F.lit, s)))) / (F.size(b) + len(s))
            fits = (F.size(b) >= len(s) * dice / (2 - dice)) & (F.size(b) <= len(s) * (2 - dice) / dice)
            scored.append(F.struct(F.when(fits, -value).otherwise(0.0).alias("minus"), F.lit(name).alias("license")))
        top = reduce(F.least, scored[1:], scored[0])
        return bind(top, lambda t: F.struct((-t["minus"]).alias("dice"), t["license"].alias("license"), u.alias("unit")))

    def judge(u):
        none = F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license"), F.lit("").alias("unit"))
        return bind(bigrams(u), lambda b: F.when((F.size(b) < least) | (F.size(b) > most), none).otherwise(best(u, b)))

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.filter(F.transform(units(text), judge), lambda m: m["dice"] >= dice).alias("matches"))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (names, comma-joined), best_dice (0 without a match)."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    top = F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0))
    return scanned.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", names).alias("licenses"), top.alias("best_dice"))


def oracle() -> str:
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in template_bigrams(t))) for n, t in TEMPLATES)
    return f"""
with s(license, s) as (values {rows}),
t as (select doc_id, coalesce(text, '') as text from documents),
u as (
  select doc_id, unnest(list_distinct(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) || string_split(text, chr(10)) || [text])) as unit from t
), w as (select doc_id, unit, regexp_extract_all(translate(unit, '{UPPER}', '{LOWER}'), '[0-9a-z]+') as w from u
), b as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from w where len(w) > 1
), d as (
  select doc_id, unit, license, 2.0 * len(list_intersect(b, s)) / cast(len(b) + len(s) as double) as dice from b join s on len(b) between len(s) * {DICE} / (2 - {DICE}) and len(s) * (2 - {DICE}) / {DICE}
), m as (select doc_id, unit, license, dice from d qualify row_number() over (partition by doc_id, unit order by dice desc, license) = 1),
g as (select doc_id, count(*) as n, string_agg(distinct license, ',' order by license) as l, max(dice) as top from m where dice >= {DICE} group by all)
select t.doc_id, coalesce(n, 0) as n_matches, coalesce(l, '') as licenses, cast(coalesce(top, 0) as double) as best_dice from t left join g using (doc_id)"""
