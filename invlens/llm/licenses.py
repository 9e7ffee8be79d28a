"""Licence scan by a positional index of rare words (operator 2), in DataFrame functions only.

A licence is a template: a text with mandatory key phrases. The index holds, for
every key phrase, its two words of highest inverse document frequency over the
corpus, as postings (word, phrase, position). A file's words are looked up among
the indexed words; each hit votes for the place where its phrase would start, and
the votes of a phrase's two words are intersected. Places that are left are
verified against all words of the phrase. A template is found if all its key
phrases are, each as far from the first as in the template, up to ``DRIFT`` words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases (lower-cased words, consecutive) and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# The mandatory key phrases of public licences' own notices, and their SPDX-like labels.
PHRASES = {
    "under the mit license": "MIT",
    "permission is hereby granted free of charge to any person obtaining a copy": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "gnu general public license": "GPL",
    "gnu lesser general public license": "LGPL",
    "gnu affero general public license": "AGPL",
    "mozilla public license version 2 0": "MPL-2.0",
    "eclipse public license": "EPL",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSD",
    "permission to use copy modify and or distribute this software for any purpose": "ISC",
    "free and unencumbered software released into the public domain": "Unlicense",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "cc by nc nd 4 0": "CC-BY-NC-ND-4.0",
    "creative commons attribution": "CC",
    "all rights reserved": "Proprietary",
}
# Words of public licences, lower-cased, and the key phrases that each must have. Their distances are those of the text.
TEMPLATES = {
    "ISC": (
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ["modify and distribute this software for any purpose with or without fee", "this permission notice appear in all copies"],
    ),
    "Zlib": (
        "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the "
        "product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such",
        ["in no event will the authors be held liable", "to alter it and redistribute it freely", "must not be misrepresented", "altered source versions must be plainly marked as such"],
    ),
    "PostgreSQL": (
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby "
        "granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
        ["without fee and without a written agreement is hereby granted", "this paragraph and the following two paragraphs appear in all copies"],
    ),
    "CDDL-1.0": (
        "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in "
        "compliance with the license",
        ["common development and distribution license", "you may not use this file except in compliance with the license"],
    ),
    "BSL-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ["to any person or organization obtaining a copy of the software", "use reproduce display distribute execute and transmit the software"],
    ),
    "BSD-3-Clause": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form "
        "must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with "
        "the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "contributors may be used to endorse or promote products"],
    ),
    "GPL-3.0-or-later": (
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license", "either version 3 of the license or at your option any later version"],
    ),
    "GPL-2.0-or-later": (
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ["gnu general public license", "either version 2 of the license or at your option any later version"],
    ),
}
#: Words that may be missing or more between the first and any other key phrase of a template (names, numbering, rewordings).
DRIFT = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; none for null.

    Letters beyond ASCII may be lower-cased too, which changes no comparison with an ASCII
    phrase: of those only the Kelvin sign becomes an ASCII word by it, so it is replaced first.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00aa")))
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def document_frequencies(worded: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the phrases occurs: at most as many numbers as the phrases have words."""
    met = worded.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("w"))
    return {r["w"]: r["n"] for r in met.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def rare_places(phrase: list[str], df: dict[str, int], entries: int = 2) -> list[int]:
    """Places in the phrase of its words of highest inverse document frequency, each word once; ties go to the first place."""
    first = {w: i for i, w in reversed(list(enumerate(phrase)))}
    return sorted(first.values(), key=lambda i: (df.get(phrase[i], 0), i))[:entries]


def _catalogue() -> tuple[list[list[str]], list[tuple[str, bool, list[tuple[int, int]]]]]:
    """The different key phrases as words, and per template its label, whether it is a base one, and (phrase, offset in the text) of its keys."""
    whole = [(label, base, p, [p]) for table, base in ((BASE_PHRASES, True), (PHRASES, False)) for p, label in table.items()]
    whole += [(label, False, text, keys) for label, (text, keys) in TEMPLATES.items()]
    number = {p: i for i, p in enumerate(dict.fromkeys(p for *_, keys in whole for p in keys))}
    offset = lambda text, p: f" {text} ".index(f" {p} ")
    templates = [(label, base, [(number[p], len(text[:offset(text, p)].split())) for p in keys]) for label, base, text, keys in whole]
    return [p.split() for p in number], templates


def _found(phrases: list[list[str]], df: dict[str, int]) -> tuple[Column, Column]:
    """The indexed words, and from ``hits`` every (phrase, start) at which a phrase stands: votes intersected, then verified."""
    postings: dict[str, list[tuple[int, int, bool, bool]]] = {}
    for k, p in enumerate(phrases):
        places = rare_places(p, df)
        for i in places:
            postings.setdefault(p[i], []).append((k, i, i == places[0], i == places[-1]))
    posting = lambda x: F.struct(F.lit(x[0]).alias("phrase"), F.lit(x[1]).alias("at"), F.lit(x[2]).alias("first"), F.lit(x[3]).alias("second"))
    index = F.map_from_arrays(F.array(*map(F.lit, postings)), F.array(*[F.array(*map(posting, xs)) for xs in postings.values()]))

    def votes(of: str) -> Column:
        mine = F.transform("hits", lambda h: F.transform(F.filter(index[h["w"]], lambda x: x[of]), lambda x: F.struct(x["phrase"].alias("phrase"), (h["i"] - x["at"]).alias("start"))))
        return F.flatten(mine)

    words = F.array(*[F.array(*map(F.lit, p)) for p in phrases])

    def stands(v: Column) -> Column:
        phrase = F.element_at(words, v["phrase"] + 1)
        return (v["start"] >= 0) & (F.slice("words", F.greatest(v["start"], F.lit(0)) + 1, F.size(phrase)) == phrase)

    return F.array(*map(F.lit, postings)), F.filter(F.array_intersect(votes("first"), votes("second")), stands)


def _holds(keys: list[tuple[int, int]]) -> Column:
    """Whether ``found`` has all key phrases of a template, at about their distances from the first."""
    (k0, at0), others = keys[0], keys[1:]

    def near(a: Column, k: int, gap: int) -> Column:
        return F.exists("found", lambda b: (b["phrase"] == k) & (F.abs(b["start"] - a["start"] - gap) <= DRIFT))

    return F.exists("found", lambda a: reduce(Column.__and__, [near(a, k, at - at0) for k, at in others], a["phrase"] == k0))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base phrases, ``first_word`` and
    ``last_word`` are the least and greatest of their starts (null if none),
    ``labels`` has the base labels, those of ``PHRASES`` (templates that are one key phrase)
    and of ``TEMPLATES``. ``score`` is n / (n + 2) for the n key words of the largest template
    found, else 0. Which words are indexed decides speed only. Null texts are empty; repeated
    rows are rows of their own; extra columns are ignored. Two passes over the texts, no shuffle of them.
    """
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    phrases, templates = _catalogue()
    entries, found = _found(phrases, document_frequencies(worded, sorted({w for p in phrases for w in p})))
    here = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(entries, h["w"]))
    hit = worded.withColumn("hits", F.when(F.arrays_overlap("words", entries), here))
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    placed = hit.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("hits") > 0, found).otherwise(none("phrase: int, start: int")).alias("found"))
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(sum(len(phrases[k]) for k, _ in keys)).alias("n"), _holds(keys).alias("holds")) for label, base, keys in templates])
    met = placed.withColumn("met", F.when(F.size("found") > 0, F.filter(each, lambda x: x["holds"])).otherwise(none("label: string, base: boolean, n: int, holds: boolean")))
    base_keys = F.array(*[F.lit(k) for _, base, keys in templates if base for k, _ in keys])
    met = met.withColumn("places", F.transform(F.filter("found", lambda f: F.array_contains(base_keys, f["phrase"])), lambda f: f["start"]))
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    longest = F.coalesce(F.array_max(F.transform("met", lambda x: x["n"])), F.lit(0)).cast("double")
    return met.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        labels(F.filter("met", lambda x: x["base"])).alias("base_labels"),
        labels(F.col("met")).alias("labels"),
        F.when(longest > 0, longest / (longest + 2)).otherwise(F.lit(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """The same result in DuckDB's SQL, from a plain search of every phrase at every word."""
    phrases, templates = _catalogue()

    def starts(p: list[str]) -> str:
        words = ", ".join(f"'{w}'" for w in p)
        return f"CASE WHEN contains(line, ' {' '.join(p)} ') THEN list_filter(range(0, len(w) - {len(p) - 1}), lambda i: w[i + 1] = '{p[0]}' AND w[i + 1:i + {len(p)}] = [{words}]) ELSE [] END"

    def holds(keys: list[tuple[int, int]]) -> str:
        (k0, at0), others = keys[0], keys[1:]
        near = "".join(f" AND len(list_filter(p{k}, lambda b: abs(b - a - ({at - at0})) <= {DRIFT})) > 0" for k, at in others)
        return f"len(list_filter(p{k0}, lambda a: true{near})) > 0"

    at = ", ".join(f"{starts(p)} AS p{k}" for k, p in enumerate(phrases))
    found = ", ".join(f"{{'label': '{label}', 'base': {str(base).lower()}, 'n': {sum(len(phrases[k]) for k, _ in keys)}, 'holds': {holds(keys)}}}" for label, base, keys in templates)
    base_places = " || ".join(f"p{k}" for _, base, keys in templates if base for k, _ in keys)
    pattern = WORD.replace("'", "''")
    return f"""
        WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS w FROM documents),
        words AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM split),
        searched AS (SELECT doc_id, len(w) AS n_words, {at} FROM words),
        places AS (SELECT doc_id, n_words, {base_places} AS places, list_filter([{found}], lambda x: x.holds) AS met FROM searched)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
            CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
            array_to_string(list_sort(list_distinct(list_transform(list_filter(met, lambda x: x.base), lambda x: x.label))), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_transform(met, lambda x: x.label))), ',') AS labels,
            CASE WHEN len(met) = 0 THEN 0.0::DOUBLE ELSE list_max(list_transform(met, lambda x: x.n))::DOUBLE / (list_max(list_transform(met, lambda x: x.n)) + 2) END AS score
        FROM places"""
