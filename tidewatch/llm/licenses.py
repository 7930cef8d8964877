"""Licence scans: phrases, and an exact set-similarity join of text blocks with licence templates.

A block is a stretch of consecutive words, whatever lines they stand on: for templates of up to ``w`` words, ``w`` a power of
two, a block begins every ``w`` words and has ``2 w`` of them, so that any ``w`` words in a row lie in one. A template is found in a block that
holds at least the share ``threshold`` of the template's distinct words. Words are ordered by their frequency in the whole
corpus, rarest first. A block that meets the threshold must hold one of a template's first
``|T| - need + 1`` words (prefix filter), have ``need`` words at least (length filter) and, from the first
shared word on, have enough words left on both sides (positional filter). Survivors are verified.
Everything runs as native expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, text_of

#: The base phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences of public licence notices as templates, a label each.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)

#: Runs of characters outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]++"


def plain(text: Column) -> Column:
    """A-Z in lower case, and a blank for each run of characters that aren't of words.

    Letters beyond ASCII may change case too, which alters no word's place nor its equality with an ASCII word: the only two that have an ASCII
    letter in lower case, U+0130 and U+212A, give way to others first.
    """
    return F.regexp_replace(F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138"))), OTHER, " ")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def split_words(sentence: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in sentence.lower()).split()


def width_of(sentence: str) -> int:
    """The least power of two of as many words as the sentence has, or more."""
    return 1 << max(len(split_words(sentence)) - 1, 0).bit_length()


def template_words(sentence: str) -> list[str]:
    return list(dict.fromkeys(split_words(sentence)))


def _starts(w: Column, phrase: str) -> Column:
    """Positions in the array of words where the words of ``phrase`` stand."""
    first, *rest = phrase.split(" ")

    def here(x, i):
        hit = x == first
        for k, word in enumerate(rest, 1):
            hit = hit & F.coalesce(F.get(w, i + k) == word, F.lit(False))
        return F.when(hit, i)

    return F.filter(F.transform(w, here), lambda p: p.isNotNull())


def scan(docs: DataFrame, column: str = "text", phrases: dict = PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``blocks`` (first word, words, label, containment) for each document.

    ``score`` is 1 where a phrase stands, else the largest containment found, else 0. A null text counts as empty: no words,
    no labels; a very long text is scanned whole. Repeated rows are scanned one by one, an empty table gives no rows, other columns are left out.
    """
    spark = docs.sparkSession
    sets = [(label, template_words(sentence)) for label, sentence in templates]
    widths = [width_of(sentence) for _, sentence in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    text = plain(text_of(docs, column))
    # Global frequency: occurrences of each template word in all texts, combined before the shuffle.
    everything = docs.select(F.explode(F.split(text, " ")).alias("word")).where(F.col("word").isin(vocabulary))
    counts = dict(everything.groupBy("word").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = [(label, sorted(ws, key=rank.__getitem__)) for label, ws in sets]
    need = [math.ceil(threshold * len(ws) - 1e-9) for _, ws in ordered]
    prefixes = [ws[: len(ws) - n + 1] for (_, ws), n in zip(ordered, need, strict=True)]
    rare = F.array(*(F.lit(w) for w in sorted({w for p in prefixes for w in p}))) if templates else F.array().cast("array<string>")
    known = F.array(*(F.lit(w) for w in sorted(vocabulary, key=rank.__getitem__))) if vocabulary else F.array().cast("array<string>")

    def measured(w: Column) -> Column:
        """Counts and phrase places; a phrase is looked for only where its last word is there. Blocks that hold a rare word."""
        # A place knows its phrase by number, so that labels come from the places.
        names = list(phrases)
        empty = F.array().cast("array<int>")
        places = F.array(*(F.when(F.array_contains(w, p.split(" ")[-1]), _starts(w, p)).otherwise(empty) for p in names)) if names else F.array().cast("array<array<int>>")
        none = F.array().cast("array<struct<first:int,width:int,words:array<string>>>")

        def blocks(width: int) -> Column:
            starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(width))
            return F.transform(starts, lambda at: F.struct(at.alias("first"), F.lit(width).alias("width"), F.array_distinct(F.slice(w, at + 1, F.lit(2 * width))).alias("words")))

        cut = F.concat(none, *(F.filter(blocks(width), lambda b: F.arrays_overlap(b["words"], rare)) for width in sorted(set(widths))))
        return F.struct(F.size(w).cast("long").alias("n_words"), places.alias("places"), F.when(F.arrays_overlap(w, rare), cut).otherwise(none).alias("near"))

    base = docs.select(F.col("doc_id"), let(words_of(text), measured).alias("m"))
    base = stored(base.select("doc_id", F.monotonically_increasing_id().alias("uid"), "m.*"), "licenses")

    # The join: candidate blocks with templates by a shared prefix word. Templates are a fixed parameter, an index of some hundred rows at most.
    index = spark.createDataFrame(
        [(w, widths[t], t, label, pos, len(ws), need[t], ws) for t, (label, ws) in enumerate(ordered) for pos, w in enumerate(prefixes[t])],
        "word string, width int, t int, label string, pos int, size int, need int, template array<string>",
    )
    blocks = base.select("uid", F.explode("near").alias("b")).select("uid", "b.first", "b.width", "b.words", F.filter(known, lambda w: F.array_contains(F.col("b.words"), w)).alias("shared"))
    pairs = blocks.select("*", F.explode(F.array_intersect("shared", rare)).alias("word")).join(F.broadcast(index), ["word", "width"])
    pairs = pairs.where(F.size("words") >= F.col("need"))  # length
    pairs = pairs.where(~F.arrays_overlap(F.slice("template", F.lit(1), F.col("pos")), "words"))  # the first shared word alone
    left = F.least(F.col("size") - F.col("pos"), F.size("shared") - F.array_position("shared", F.col("word")) + 1)
    pairs = pairs.where(left >= F.col("need"))  # positions
    overlap = F.size(F.array_intersect("template", "words"))
    found = pairs.where(overlap >= F.col("need")).select("uid", "first", "width", "label", (overlap / F.col("size")).alias("containment"))
    found = found.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("first", (F.col("width") * 2).alias("words"), "label", "containment"))).alias("blocks"))

    places = F.flatten("places")
    named = F.array(*(F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values()))) if phrases else F.array().cast("array<string>")
    own = F.array_sort(F.array_distinct(F.array_compact(named)))
    theirs = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return base.join(found, "uid", "left").select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, theirs))), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "blocks",
    )
