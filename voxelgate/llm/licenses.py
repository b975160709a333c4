"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of a text's words, whatever lines they stand on. They come in a few
widths, each for templates of some length: what spans up to twice a template's words is whole in
one of its windows, and tokens that are far apart meet in none. Template tokens are ordered by how
many documents have them, rarest first. A block can only reach the containment threshold of a
template if it has one of the template's first tokens in that order (prefix: an index from these
tokens gives the candidates), enough tokens (length), and enough template tokens from the first
common one on (position); what passes is counted exactly. The templates are a bounded parameter,
so they travel in the plan and no text is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as they are published or commonly written, in lower case without punctuation. Fixed values.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    ],
    "all-rights-reserved": ["all rights reserved"],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "cc-by": ["licensed under cc by 4 0", "licensed under the creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under the creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under the creative commons attribution sharealike 4 0 international license"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
}
#: Words of a template up to which it belongs to a width of windows; longer ones have the width of the longest.
_WIDTHS = (4, 8, 16)
#: Letters of a word before its case is lowered, and what stands between words.
_IN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]
    need: int
    width: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


@dataclass(frozen=True)
class Index:
    """vocabulary: all template tokens in the global order, which the templates' tokens keep."""

    vocabulary: tuple[str, ...]
    templates: tuple[Template, ...]


def _words(text: Column) -> Column:
    """The words, and an empty string where the text begins or ends between words."""
    return F.split(text, f"{_OUT}+")


def _count_words(text: Column) -> Column:
    parts = F.transform(F.array(_words(text)), lambda x: F.size(x) - (F.get(x, F.lit(0)) == "").cast("int") - ((F.size(x) > 1) & (F.element_at(x, -1) == "")).cast("int"))
    return F.get(parts, F.lit(0)).cast("long")


def _has_all(lower: Column, words: list[str]) -> Column:
    """Whether the letters of the words stand somewhere: true for all texts with the words, and cheap."""
    out = F.lit(True)
    for w in sorted(words, key=len, reverse=True):
        out = out & F.contains(lower, F.lit(w))
    return out


def _strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def index_templates(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = 0.9) -> Index:
    """Templates with their tokens in the global order, by the documents that have them."""
    split = [(label, text.split()) for label, texts in (templates or TEMPLATES).items() for text in texts]
    given = [(label, sorted(set(words))) for label, words in split]
    vocabulary = sorted({t for _, tokens in given for t in tokens})
    found = docs.select(F.explode(F.array_intersect(_strings(vocabulary), _words(F.lower(F.col(text_col))))).alias("token"))
    frequency = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
    longest = max(len(words) for _, words in split)
    width = lambda words: next((w for w in _WIDTHS if len(words) <= w < longest), longest)
    return Index(tuple(order), tuple(Template(label, tuple(sorted(tokens, key=order.get)), math.ceil(threshold * len(tokens) - 1e-9), width(words)) for (label, tokens), (_, words) in zip(given, split, strict=True)))


def _found_in(words: Column, templates: list[Template], vocabulary: tuple[str, ...]) -> Column:
    """Structs (label, share) of what the windows of one width contain."""
    span = 2 * templates[0].width
    rare = sorted({x for t in templates for x in t.prefix})
    used = {x for t in templates for x in t.tokens}
    order = [x for x in vocabulary if x in used]
    least = min(t.need for t in templates)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(span)), lambda i: F.slice(words, i, F.lit(2 * span)))
    windows = F.filter(windows, lambda w: F.arrays_overlap(w, _strings(rare)))
    blocks = F.filter(F.transform(windows, lambda w: F.array_intersect(_strings(order), w)), lambda b: F.size(b) >= least)
    # the templates that have a token in their prefix
    index = F.create_map(*[x for t in rare for x in (F.lit(t), F.array(*[F.lit(i) for i, y in enumerate(templates) if t in y.prefix]))])
    given = F.array(*[F.struct(F.lit(t.label).alias("label"), _strings(t.tokens).alias("tokens"), _strings(t.prefix).alias("prefix"), F.lit(t.need).alias("need")) for t in templates])

    def hits(b: Column) -> Column:
        # b has the block's tokens in the global order
        asked = F.array_distinct(F.flatten(F.transform(F.array_intersect(_strings(rare), b), lambda t: F.element_at(index, t))))

        def share(t: Column) -> Column:
            room = F.size(b) - F.array_position(b, F.get(F.array_intersect(t["prefix"], b), F.lit(0))).cast("int") + 1
            overlap = F.when(room >= t["need"], F.size(F.array_intersect(t["tokens"], b))).otherwise(0)
            return F.struct(t["label"].alias("label"), F.when(overlap >= t["need"], overlap / F.size(t["tokens"])).otherwise(F.lit(0.0)).alias("share"))

        return F.filter(F.transform(asked, lambda i: share(F.get(given, i))), lambda x: x["share"] > 0)

    return F.flatten(F.transform(blocks, hits))


def _matches(lower: Column, index: Index) -> Column:
    """Structs (label, share) of the templates that some block of the text contains, each label once with its highest share."""
    by_width: dict[int, list[Template]] = {}
    for t in index.templates:
        by_width.setdefault(t.width, []).append(t)
    empty = F.array().cast("array<struct<label:string,share:double>>")

    def has_some(templates: list[Template]) -> Column:
        out = F.lit(False)
        for t in templates:
            # all of a template's tokens but so many that may be missing; its letters stand somewhere
            counted = F.lit(0)
            for x in t.tokens:
                counted = counted + F.contains(lower, F.lit(x)).cast("int")
            out = out | (_has_any(lower, t.prefix) & (counted >= t.need))
        return out

    def best(every: Column) -> Column:
        labels = F.array_distinct(F.transform(every, lambda x: x["label"]))
        return F.transform(labels, lambda k: F.struct(k.alias("label"), F.array_max(F.transform(F.filter(every, lambda x: x["label"] == k), lambda x: x["share"])).alias("share")))

    # the words are made once, and only for texts that have the letters of some template
    wanted = {w: has_some(ts) for w, ts in by_width.items()}
    some = F.lit(False)
    for x in wanted.values():
        some = some | x
    found = F.transform(F.array(_words(lower)), lambda words: F.concat(*[F.when(wanted[w], _found_in(words, ts, index.vocabulary)).otherwise(empty) for w, ts in by_width.items()]))
    return F.when(some, F.get(F.transform(found, best), F.lit(0)))


def _has_any(lower: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(lower, F.lit(w))
    return out


def scan(docs: DataFrame, index: Index, phrases: dict[str, str] | None = None, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs: row (struct of the carried columns), n_words, n_base, first_word, last_word, base_labels, found (array of structs label, share).

    A null text counts as empty: no words, no places, no labels. first_word and last_word are null
    without a place. Very long texts are scanned whole, window by window. Repeated rows are scanned
    once each, null ids are carried, an empty table gives no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    text = F.col("text")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("lower", F.lower("text"))
    gaps = []
    for i, phrase in enumerate(phrases):
        first, *rest = phrase.split()
        follow = "".join(rf"{_OUT}+{re.escape(w)}" for w in rest)
        place = rf"(?<!{_IN}){re.escape(first)}(?={follow}(?!{_IN}))"
        # the gaps before the places; each place takes its first word only
        gap = F.regexp_extract_all(text, F.lit(rf"(?s)(?i)\G(.*?){place}"), F.lit(1))
        out = out.withColumn(f"gaps_{i}", F.when(_has_all(F.col("lower"), phrase.split()) & text.rlike("(?i)" + place), gap))
        gaps.append(F.col(f"gaps_{i}"))
    out = out.withColumn("found", _matches(F.col("lower"), index)).withColumn("n_words", _count_words(text))
    count = [F.coalesce(F.size(F.coalesce(g, F.array().cast("array<string>"))), F.lit(0)).cast("long") for g in gaps]
    firsts = [F.when(g.isNotNull(), _count_words(F.get(g, F.lit(0)))) for g in gaps]
    lasts = [F.when(g.isNotNull(), F.aggregate(g, F.lit(-1).cast("long"), lambda s, x: s + _count_words(x) + 1)) for g in gaps]
    labels = F.array_compact(F.array(*[F.when(g.isNotNull(), F.lit(label)) for g, label in zip(gaps, phrases.values(), strict=True)]))
    return out.select("row", "n_words", sum(count[1:], count[0]).alias("n_base"), F.array_min(F.array(*firsts)).alias("first_word"), F.array_max(F.array(*lasts)).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base_labels"), F.coalesce("found", F.array().cast("array<struct<label:string,share:double>>")).alias("found"))
