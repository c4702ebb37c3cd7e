"""License scans: an exact set-similarity join of text blocks with notice templates.

A template is a notice as its set of words.  A document meets it if as many consecutive words as the
notice has, divided by the threshold, hold at least `threshold` of the template's words, all within
as many consecutive lines as the notice may be wrapped over (`reach_of`); words strewn over a long
line meet nothing.  The join works on blocks of so many lines.  Only words that stand in some
template can count, so lines are reduced to those at once, and blocks are put together from reduced
lines.  Words are ordered by their frequency over all blocks of the corpus, rarest first, and three
filters go before the count of a block's words:

* prefix: of n words with `need` required, a block must hold one of the first n - need + 1;
* length: the block must have `need` template words at all;
* positional: from the place of a shared word, enough words must remain on both sides.

Blocks that hold enough words are then read word by word: the best of the runs of consecutive words
that begin at a word of the template decides.

Beside it stands the phrase scan: places where a phrase's words follow each other, over the whole
document.  All of it is DataFrame work; the templates are a literal list, so their side is small
by construction and joins by broadcast.

Defined results: null text is empty; an empty text has no words, no labels and score 0; repeated
rows and null doc_ids keep their own result rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Everything but 0-9, a-z and non-ASCII characters parts words, once A-Z is lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that give a label by themselves (fixed values of the contract).
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and their labels (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
    ("proprietary", "No part of this publication may be reproduced without prior written permission"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies"),
)


def _words_of(notice: str) -> list[str]:
    return [w for w in re.split(GAP, notice.lower()) if w]


def reach_of(words: Sequence[str]) -> int:
    """Lines over which a notice of these words may be wrapped, with eight words a line at least."""
    return 1 + len(words) // 8


def run_of(words: Sequence[str], threshold: float) -> int:
    """Consecutive words that a notice of these words (repeats included) may be spread over."""
    return math.floor(len(words) / threshold + 1e-9)


def _need(n: int, threshold: float) -> int:
    """The fewest words that reach the threshold, safe from rounding."""
    return math.ceil(n * threshold - 1e-9)


def _starts(doubled: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, counted from 0.

    doubled has every word between two spaces of its own.  It is cut before each place, so that
    a walk over the cuts counts the words in front; only texts that hold the phrase are walked.
    """
    sought = "".join(f" {w} " for w in phrase.split())

    def step(acc, piece):
        found = F.when(piece.startswith(sought), F.array_append(acc["found"], acc["at"])).otherwise(acc["found"])
        return F.struct((acc["at"] + _count(piece)).alias("at"), found.alias("found"))

    none = F.array().cast("array<int>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))
    walked = F.aggregate(F.split(doubled, f"(?={sought})"), begin, step, lambda acc: acc["found"])
    return F.when(F.contains(doubled, F.lit(sought)), walked).otherwise(none)


def _count(doubled: Column) -> Column:
    """Words, by the spaces around them."""
    return F.floor((F.length(doubled) - F.length(F.replace(doubled, F.lit(" "), F.lit("")))) / 2).cast("int")


def _blocks(lines: Column, reach: int, least: int) -> Column:
    """Windows of `reach` reduced lines, each begun at a line with a template word, that hold `least` words."""
    of = lambda i: F.array_distinct(F.flatten(F.slice(lines, i + 1, F.lit(reach))))
    windows = F.transform(lines, lambda line, i: F.struct(i.alias("line"), F.when(F.size(line) > 0, of(i)).alias("words")))
    held = F.filter(windows, lambda b: F.size(b["words"]) >= least)
    return F.transform(held, lambda b: F.struct(F.lit(reach).alias("reach"), b["line"].alias("line"), b["words"].alias("words")))


def _line(line: Column, vocabulary: Sequence[str]) -> Column:
    """A line's number of words, and its template words with their places."""
    words = F.filter(F.split(line, GAP), lambda w: w != "")
    return F.transform(F.array(words), lambda own: F.struct(F.size(own).alias("n"), F.filter(F.transform(own, lambda w, k: F.struct(k.alias("at"), w.alias("word"))), lambda x: x["word"].isin(*vocabulary)).alias("held")))[0]


def _reduced(docs: DataFrame, phrases: Mapping[str, str], vocabulary: Sequence[str], needs: Mapping[int, int]) -> DataFrame:
    """One pass over the texts: word counts, phrase places, and the template words of each block."""
    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.withColumn("lines", F.transform(F.split("low", "\n"), lambda line: _line(line, vocabulary)))
    lines = F.transform("lines", lambda line: F.array_distinct(F.transform(line["held"], lambda x: x["word"])))
    # Bound to a variable, so that lines are reduced once for all reaches.
    blocks = F.transform(F.array(lines), lambda own: F.concat(*(_blocks(own, reach, least) for reach, least in sorted(needs.items()))))[0]
    doubled = F.concat(F.lit(" "), F.regexp_replace("low", GAP, "  "), F.lit(" "))
    # Gaps at either end leave spaces that surround nothing.
    trimmed = F.trim(doubled)
    rows = rows.select("doc_id", "lines", F.when(trimmed == "", "").otherwise(F.concat(F.lit(" "), trimmed, F.lit(" "))).alias("doubled"), blocks.alias("blocks"))
    places = F.array(*(F.struct(F.lit(label).alias("label"), _starts(F.col("doubled"), p).alias("starts")) for p, label in phrases.items()))
    return rows.select("doc_id", _count(F.col("doubled")).cast("long").alias("n_words"), places.alias("places"), "blocks", "lines")


def _with_base(rows: DataFrame) -> DataFrame:
    held = F.filter("places", lambda p: F.size(p["starts"]) > 0)
    return rows.withColumns({"base": F.sort_array(F.array_distinct(F.transform(held, lambda p: p["label"]))), "places": F.flatten(F.transform(held, lambda p: p["starts"]))})


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = BASE_PHRASES,
    threshold: float = 0.8,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    notices = [(label, sorted(set(words)), run_of(words, threshold)) for label, words in ((label, _words_of(notice)) for label, notice in templates)]
    vocabulary = sorted({w for _, words, _ in notices for w in words})
    needs: dict[int, int] = {}
    for _, words, _ in notices:
        needs[reach_of(words)] = min(needs.get(reach_of(words), len(words)), _need(len(words), threshold))
    reduced = _reduced(docs, phrases, vocabulary, needs).withColumn("row", F.monotonically_increasing_id())
    rows = stored(reduced, "license-blocks")
    found = _read(rows, _joined(rows, notices, vocabulary, threshold))
    best = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("contained").alias("contained"))
    none = F.array().cast("array<string>")
    out = _with_base(rows.drop("blocks", "lines")).join(best, "row", "left")
    labels = F.sort_array(F.array_union("base", F.coalesce("found", none)))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def _joined(rows: DataFrame, notices: list, vocabulary: list[str], threshold: float) -> DataFrame:
    """(row, line, reach, label, t_size, need, run, template_words) of every block with enough words of a template."""
    blocks = rows.select("row", F.inline("blocks")).withColumnRenamed("words", "block")
    counted = blocks.select(F.explode("block").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}  # at most the templates' own words
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for label, words, run in notices:
        ordered, need = sorted(words, key=rank.get), _need(len(words), threshold)
        prefixes += [(w, reach_of(words), label, k, len(words), need, run, ordered) for k, w in enumerate(ordered[: len(words) - need + 1])]
    schema = "word string, reach int, label string, t_at int, t_size int, need int, run int, template_words array<string>"
    prefix = F.broadcast(rows.sparkSession.createDataFrame(prefixes, schema))
    ordered_blocks = blocks.select("row", "line", "reach", F.array_intersect(F.array(*map(F.lit, order)), "block").alias("block"))
    probes = ordered_blocks.select("row", "line", "reach", "block", F.posexplode("block").alias("b_at", "word"))
    remaining = F.least(F.col("t_size") - F.col("t_at"), F.size("block") - F.col("b_at"))
    candidates = probes.join(prefix, ["word", "reach"]).where((F.size("block") >= F.col("need")) & (remaining >= F.col("need")))
    shared = F.size(F.array_intersect("block", "template_words"))
    return candidates.where(shared >= F.col("need")).select("row", "line", "reach", "label", "t_size", "need", "run", "template_words").distinct()


def _read(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(row, label, contained) of the blocks in which one run of consecutive words holds enough."""
    span = F.slice("lines", F.col("line") + 1, F.col("reach"))
    before = lambda j: F.aggregate(F.slice(span, F.lit(1), j), F.lit(0), lambda n, x: n + x["n"])
    own = lambda x, j: F.transform(F.filter(x["held"], lambda w: F.array_contains("template_words", w["word"])), lambda w: F.struct((w["at"] + before(j)).alias("at"), w["word"].alias("word")))
    read = met.join(rows.select("row", "lines"), "row").withColumn("held", F.flatten(F.transform(span, own)))
    within = lambda first, i: F.filter(F.slice("held", i + 1, F.col("run")), lambda w: w["at"] < first["at"] + F.col("run"))
    counts = F.transform("held", lambda first, i: F.size(F.array_distinct(F.transform(within(first, i), lambda w: w["word"]))))
    best = read.select("row", "label", "t_size", "need", F.array_max(counts).alias("best"))
    return best.where("best >= need").select("row", "label", (F.col("best") / F.col("t_size")).alias("contained"))
