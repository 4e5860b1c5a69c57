"""License scans by an exact containment join of text blocks with license templates, in DataFrame functions alone.

A block is a run of words, whatever lines they stand in: a template of n words is held against blocks of 2c words, a block each
c words, where c is the power of two not below n, so a whole copy lies in one block. A block matches a template if it holds at
least the threshold's share of the template's distinct words, and ``ORDER`` of its pairs of neighbouring words side by side; a short statement must stand in it
word by word. The join is exact: template words are
ordered by their frequency over all blocks, rarest first; a match must hold at least one word of a template's prefix
(length filter: as many distinct words as the threshold asks for; positional filter: enough template words left behind the
first one found). Before a text is cut into blocks it must hold enough words of some template. Beside that, phrases are
looked for word by word in the same scan.

Words are runs of ASCII letters and digits and of any non-ASCII characters; A-Z count as a-z. Null and empty texts have no
words and no labels. Labels are found row by row, whatever identifiers repeat. The template table is fixed and small, so it is broadcast.
"""

from __future__ import annotations

from itertools import groupby
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import materialize

GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Paragraphs of public licenses and statements, by label; words only.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": [
        "no part of this publication may be reproduced distributed or transmitted in any form or by any means including photocopying recording or other electronic or mechanical methods without the prior written permission of the publisher",
    ],
}

#: Statements of fewer distinct words must be there whole, one word after the other: the words of "released under the mit license" in any order are no license.
SHORT = 10
#: The share of a longer template's pairs of neighbouring words that must stand side by side: a fifth of its words changed breaks two fifths, the same words in another order hold next to none.
ORDER = 0.3


def _templates(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, list[str], int, int, list[str], int]]:
    """(label, distinct words, words a match must hold, half a block's words, passages between blanks, how many of them a match must hold)."""
    out = []
    for label, texts in templates.items():
        for t in texts:
            every = t.split()
            words, short = list(dict.fromkeys(every)), len(set(every)) < SHORT
            need = len(words) if short else max(1, ceil(round(threshold * len(words), 9)))
            passages = [f" {' '.join(every)} "] if short else list(dict.fromkeys(f" {a} {b} " for a, b in zip(every, every[1:])))
            out.append((label, words, need, 1 << max(3, (len(every) - 1).bit_length()), passages, ceil(ORDER * len(passages))))
    return out


def _strings(ws) -> Column:
    return F.expr(f"cast(array({', '.join(map(repr, ws))}) as array<string>)")


def _any_of(words: list[str]) -> str:
    """A pattern of any of the words, branching on the first letter first."""
    return "|".join(f"{a}(?:{'|'.join(w[1:] for w in ws)})" for a, ws in groupby(sorted(words), key=lambda w: w[0]))


def _blanks(s) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _opens_with(phrase: str):
    return lambda part: part.rlike(f"^(?i) {phrase}(?: |$)")


def _blocks(half: int, templates: list[tuple[list[str], int]]) -> Column:
    """(half, block, hits, text) of a text's blocks of 2 * half words with enough words of one of these templates."""
    own = _strings(sorted({w for ws, _ in templates for w in ws}))
    least = min(need for _, need in templates)
    numbers = F.sequence(F.lit(0), F.ceil(F.size("_words") / half).cast("int") - 1)
    cut = lambda i: F.struct(F.lit(half).alias("half"), i.alias("block"), F.array_intersect(F.slice("_words", i * half + 1, F.lit(2 * half)), own).alias("hits"))
    text = lambda i: F.concat(F.lit(" "), F.array_join(F.slice("_words", i * half + 1, F.lit(2 * half)), " "), F.lit(" "))
    found = F.filter(F.transform(numbers, cut), lambda b: F.size(b["hits"]) >= least)
    return F.transform(found, lambda b: F.struct(b["half"].alias("half"), b["block"].alias("block"), b["hits"].alias("hits"), text(b["block"]).alias("text")))


def _scanned(docs: DataFrame, known: list, id_col: str, text_col: str) -> DataFrame:
    """The one pass over the texts: (row, id, n_words, places of phrases, blocks) of each row.

    ``blocks``: (half, block, hits, text) of the blocks with enough words of some template; null in nearly all rows."""
    one = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), GAP + "+", " "))
    # two blanks in front: a place at the first word is then not at the very beginning, where split leaves out the empty part
    joined = docs.select(F.col(id_col).alias("id"), F.concat(F.lit("  "), one, F.lit(" ")).alias("_s")).withColumn(
        "n_words", F.when(F.length("_s") > 3, _blanks("_s") - 2).otherwise(0).cast("long")
    )
    any_phrase = "(?i) (?:" + "|".join(PHRASES) + ")(?= )"
    # what stands before each place, by word count: split keeps the text between places
    between = F.when(F.col("_s").rlike(any_phrase), F.split("_s", "(?i)(?= (?:" + "|".join(PHRASES) + ") )"))
    # a match lacks at most size - need words of its template, so it holds one of so many and one longest ones
    longest = sorted({w for _, ws, need, *_ in known for w in sorted(ws, key=lambda w: (-len(w), w))[: len(ws) - need + 1]})
    vocabulary = sorted({w for _, ws, *_ in known for w in ws})
    words = F.when(F.col("_s").rlike(f"(?i) (?:{_any_of(longest)})(?= )"), F.split(F.trim(F.translate("_s", UPPER, LOWER)), " ")) if known else F.lit(None).cast("array<string>")
    enough = [F.size(F.array_intersect("_hits", _strings(ws))) >= need for _, ws, need, *_ in known]
    able = F.array_contains(F.array(*enough), True) if known else F.lit(False)
    blocks = [_blocks(half, [(ws, need) for _, ws, need, h, *_ in known if h == half]) for half in sorted({h for _, _, _, h, *_ in known})]
    rows = joined.withColumns({"_parts": between, "_words": words}).withColumn("_hits", F.array_intersect("_words", _strings(vocabulary)))
    return materialize(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "n_words",
            F.when(F.col("_parts").isNull(), 0).otherwise(F.size("_parts") - 1).cast("long").alias("n_base"),
            (_blanks(F.element_at("_parts", 1)) - 1).cast("long").alias("first_word"),
            (F.col("n_words") + 1 - _blanks(F.element_at("_parts", -1))).cast("long").alias("last_word"),
            F.array_compact(
                F.array(*(F.when(F.exists(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), _opens_with(p)), F.lit(label)) for p, label in PHRASES.items()))
            ).alias("base"),
            F.when(F.size("_hits") > 0, F.when(able, F.concat(*blocks) if blocks else F.lit(None))).alias("blocks"),
        ),
        "scanned",
    )


def _matches(spark: SparkSession, scanned: DataFrame, known: list) -> DataFrame:
    """(row, half, block, label, containment) of every block and template that meet the threshold."""
    blocks = scanned.select("row", F.inline("blocks"))
    # bounded by the templates' vocabulary
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rows = []
    for t, (label, ws, need, half, passages, most) in enumerate(known):
        ordered = sorted(ws, key=lambda w: (counts.get(w, 0), w))
        rows += [(t, label, half, need, len(ws), ordered, passages, most, i, w) for i, w in enumerate(ordered[: len(ws) - need + 1])]
    index = spark.createDataFrame(rows, "t int, label string, half int, need int, size int, tokens array<string>, passages array<string>, must int, place int, w string")
    pairs = (
        blocks.select("row", "half", "block", "hits", "text", F.explode("hits").alias("w"))
        .join(F.broadcast(index), ["half", "w"])
        .where((F.size("hits") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need")))
    )
    verified = pairs.withColumn("n", F.size(F.array_intersect("hits", "tokens"))).where("n >= need")
    verified = verified.where(F.size(F.filter("passages", lambda p: F.contains(F.col("text"), p))) >= F.col("must"))
    return verified.groupBy("row", "half", "block", "t").agg(F.first("label").alias("label"), F.max(F.col("n") / F.col("size")).alias("containment")).drop("t")


def template_matches(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, block_words, label, containment) of every block and template that meet the threshold."""
    known = _templates(TEMPLATES if templates is None else templates, threshold)
    scanned = _scanned(docs, known, id_col, text_col)
    found = _matches(docs.sparkSession, scanned, known)
    return found.join(scanned.select("row", "id"), "row").select(
        F.col("id").alias(id_col), (F.col("block") * F.col("half")).cast("long").alias("first_word"), (2 * F.col("half")).alias("block_words"), "label", "containment"
    )


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    ``score`` is the largest containment among the row's matches, 1 where a phrase stands."""
    known = _templates(TEMPLATES if templates is None else templates, threshold)
    scanned = _scanned(docs, known, id_col, text_col)
    found = _matches(docs.sparkSession, scanned, known).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    plain = scanned.where("blocks IS NULL").drop("blocks").withColumns({"more": none, "best": F.lit(0.0)})
    rows = plain.unionByName(scanned.where("blocks IS NOT NULL").drop("blocks").join(found, "row", "left"))
    base = F.coalesce("base", none)
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
