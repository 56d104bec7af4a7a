"""Licence scans: exact phrases, and a set-similarity join of text blocks with licence templates.

The join is exact for containment: a block matches a template when it holds at least ``threshold`` of the template's
distinct words. Words of templates are ordered by their document counts in the whole corpus, rarest first. Only blocks
with enough template words (length filter) whose first words by that order meet the template's first words (prefix
filter) at places that leave room for the rest (positional filter) are compared in full.

Blocks are windows of ``BLOCK`` words, one from every half of that: lines and paragraphs don't matter, so a notice may be
wrapped anywhere, and any stretch of half a block stands in one block as a whole. Templates are a parameter of at most
``MAX_TEMPLATE_WORDS`` words, so their index is the only thing that is ever broadcast.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, ascii_lower, materialise

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and paragraphs of licence texts, by the label that they give.
TEMPLATES: dict[str, str | list[str]] = {
    "agpl-notice": [
        "this work is licensed under the gnu affero general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0-notice": [
        "licensed under the apache license version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-text": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by-nc-notice": "licensed under cc by nc 4.0",
    "cc-by-sa-notice": "licensed under cc by sa 4.0",
    "gpl-notice": [
        "this work is licensed under the gnu general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": [
        "this work is licensed under the gnu lesser general public license",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "mit-notice": "released under the mit license",
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-notice": [
        "this source code form is subject to the terms of the mozilla public license",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

#: Most words of all templates together.
MAX_TEMPLATE_WORDS = 20_000
THRESHOLD = 0.9
#: Words of a block; a template has at most half as many.
BLOCK = 256


def _words(low: Column | str) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _split(phrase: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in phrase.translate(str.maketrans(UPPER, LOWER))).split()


def template_sets(templates: dict[str, str | list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """``(label, distinct words)`` of each template that has words."""
    texts = [(label, t) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ([ts] if isinstance(ts, str) else ts)]
    if any(len(_split(t)) > BLOCK // 2 for _, t in texts):
        raise ValueError(f"a template has more than {BLOCK // 2} words")
    sets = [(label, sorted(set(_split(t)))) for label, t in texts if _split(t)]
    if sum(len(words) for _, words in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    return sets


def rarest_first(rows: DataFrame, sets: list[tuple[str, list[str]]]) -> list[str]:
    """The words of all templates, those in the fewest ``words`` arrays of ``rows`` first."""
    universe = sorted({w for _, words in sets for w in words})
    counted = rows.select(F.explode(F.array_intersect(F.array(*map(F.lit, universe)), "words")).alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in counted.collect()}  # bounded by the templates' words
    return sorted(universe, key=lambda w: (count.get(w, 0), w))


def prefix_index(sets: list[tuple[str, list[str]]], ranked: list[str], threshold: float) -> list[tuple[str, int, int, int, int]]:
    """``(word, template, at, size, need)`` of the words of each template's prefix: no block without any of them matches it."""
    rank, index = {w: i for i, w in enumerate(ranked)}, []
    for number, (_, words) in enumerate(sets):
        need = max(1, ceil(threshold * len(words) - 1e-9))
        ordered = sorted(words, key=rank.__getitem__)
        index += [(w, number, i, len(ordered), need) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    return index


def similar_blocks(blocks: DataFrame, templates: dict[str, str | list[str]] | None = None, threshold: float = THRESHOLD, key: tuple[str, ...] = ("doc_id", "block"), ranked: list[str] | None = None) -> DataFrame:
    """``key`` columns, ``label`` and ``containment`` of every block that holds at least ``threshold`` of a template's words.

    ``blocks`` has the key columns and ``words``, an array of words (null and repeated ones count once or not at all); a
    row for each block and template. ``ranked`` is the order of the templates' words where it is known already.
    """
    sets = template_sets(templates)
    spark = blocks.sparkSession
    if not sets:
        return blocks.select(*key, F.lit("").alias("label"), F.lit(0.0).alias("containment")).where("false")
    ranked = ranked or rarest_first(blocks, sets)
    index = prefix_index(sets, ranked, threshold)
    prefixes = spark.createDataFrame(index, "word string, template int, at int, size int, need int")
    whole = spark.createDataFrame([(i, label, words) for i, (label, words) in enumerate(sets)], "template int, label string, set array<string>")
    least = min(need for *_, need in index)
    ordered = blocks.select(*key, F.array_intersect(F.array(*map(F.lit, ranked)), "words").alias("own")).where(F.size("own") >= least)
    prefix = F.slice("own", 1, F.size("own") - least + 1)
    probes = ordered.select(*key, "own", F.posexplode(prefix).alias("place", "word"))
    room = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("own") - F.col("place") - 1)
    # The first word that block and template share stands in both prefixes; later ones need no probe of their own.
    met = probes.join(F.broadcast(prefixes), "word").where((F.size("own") >= F.col("need")) & (F.col("place") <= F.size("own") - F.col("need")) & (room >= F.col("need")))
    found = met.join(F.broadcast(whole), "template").withColumn("common", F.array_intersect("set", "own")).where(F.size("common") >= F.col("need"))
    first = F.array_min(F.transform("common", lambda w: F.array_position("own", w)))  # one row for each block and template
    return found.where(first == F.col("place") + 1).select(*key, "label", (F.size("common") / F.col("size")).alias("containment"))


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase in an array of words, from 0."""
    starts = F.sequence(F.lit(0), F.size(words) - len(phrase))
    here = lambda i: (F.get(words, i) == phrase[0]) & (F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.when(F.size(words) >= len(phrase), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def windows(words: Column, block: int = BLOCK) -> Column:
    """Stretches of ``block`` words, one from every ``block / 2`` words on."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / (block // 2)).cast("int")))
    return F.transform(starts, lambda i: F.slice(words, i * (block // 2) + 1, block))


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str | list[str]] | None = None, threshold: float = THRESHOLD, lines: int = 0) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of each row of ``docs`` (doc_id, text).

    ``n_base`` counts the places where a phrase's words stand consecutively in the words of the whole text;
    ``first_word`` and ``last_word`` are the smallest and largest start (null without any). ``labels`` adds those of
    templates that a block of the text contains to ``threshold``; ``score`` is 1 with a phrase, else the best
    containment found, else 0. With ``lines``, blocks are so many neighbouring lines instead of windows of words. Null and
    empty texts have no words. Every row is judged by its own text: repeated rows give a row each, rows without a doc_id
    or with one in common don't share labels. Other columns are ignored. An empty table gives no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    sets = template_sets(templates)
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower("text").alias("low"))
    rows = low.select("doc_id", "low", _words("low").alias("words"))
    ranked = rarest_first(rows, sets) if sets else []
    # A phrase needs its first and last word somewhere in the text: a cheap look before words are placed.
    split, none = {p: _split(p) for p in phrases}, F.array().cast("array<int>")
    per = {p: F.when(F.col("low").contains(ws[0]) & F.col("low").contains(ws[-1]) & F.arrays_overlap("words", F.array(F.lit(ws[-1]))), _places(F.col("words"), ws)).otherwise(none) for p, ws in split.items()}
    hits = F.filter(F.array(*(F.struct(F.lit(phrases[p]).alias("label"), per[p].alias("at")) for p in split)), lambda h: F.size(h["at"]) > 0)
    # Of texts with a word of some template's prefix: the templates' words in each block.
    rare = sorted({word for word, *_ in prefix_index(sets, ranked, threshold)})
    per_line = F.transform(F.split("low", "\n"), _words)
    parts = F.transform(per_line, lambda x, i: F.flatten(F.slice(per_line, i + 1, lines))) if lines else windows(F.col("words"))
    own = F.transform(parts, lambda w: F.array_intersect(F.array(*map(F.lit, ranked)), w)) if sets else F.array().cast("array<array<string>>")
    blocks = F.when(F.arrays_overlap("words", F.array(*map(F.lit, rare))), own) if sets else own
    base = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"), blocks.alias("blocks")))
    near = similar_blocks(base.select("row", F.posexplode("blocks").alias("block", "words")), templates, threshold, ("row", "block"), ranked)
    near = near.groupBy("row").agg(F.collect_set("label").alias("near"), F.max("containment").alias("best"))
    out = base.drop("blocks").withColumn("places", F.flatten("hits.at")).join(near, "row", "left")
    own = F.array_sort(F.array_distinct("hits.label"))
    every = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("near", F.array().cast("array<string>")))))
    n = F.size("places")
    return out.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(n > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
