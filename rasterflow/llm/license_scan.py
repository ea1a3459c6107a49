r"""License scans: exact containment join of text blocks with license templates.

A block is a run of consecutive words of a document, over line ends: for a template of m words, one of
``window(m)`` words, half as many again, so a notice may be wrapped and have some words more, but words scattered over a
long text are none. Blocks and templates are sets of words. A block
matches a template T when it holds at least ``needed(threshold, |T|)`` of T's words: the share ``threshold``, but
all words of a template of up to WHOLE words, as there any one of them may tell licenses apart; and, at any size, the words
that the template says must be there.
The join is the prefix-filtering one for sets whose elements are ordered by global
frequency, rarest first:

* prefix: with o words needed, one of the ``|T| - o + 1`` rarest words of T stands
  among the ``|B| - o + 1`` rarest of B;
* length: ``|B| >= o``;
* positional: a first common word at places i of T and j of B leaves room for at
  most ``1 + min(|T| - i - 1, |B| - j - 1)`` common words.

Words that no template holds cannot add to an overlap, so only template words are kept, with their places; their
frequencies are counted over all documents. Documents without a template's prefix word are left out first.
The join's blocks are stretches of twice the longest window, each beginning half-way in the one before, so every window
is in one of them; pairs that pass the filters are checked window by window. No filter loses a match.

Besides, phrases are searched as consecutive words of the whole document.

Everything is DataFrame expressions. The broadcast tables have a row for each
template word; templates and phrases are parameters written in code, not data.

Defined cases: a null or empty text has no words, no label and score 0; very long texts and lines are read whole;
templates that match equally well all give their labels; repeated rows
each get their own row; other columns of the input are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: (label, text, words that a block must hold in any case, as they tell the license apart)
TEMPLATES = [
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3", "gnu"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lesser"),
    ("agpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "affero"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache-notice", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", ""),
    ("mit-notice", "Released under the MIT License", "mit"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "noncommercial"),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0", "nc"),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0", "sa"),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related rights to this work", "waived"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("all-rights-reserved", "All rights reserved", ""),
    ("public-domain", "This work is in the public domain", ""),
]

THRESHOLD = 0.8
#: Templates of up to this number of distinct words match with all of them only.
WHOLE = 8
#: Rows of the template table up to which it is broadcast; beyond, Spark picks the join.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of words of lower-cased text, and their complement's, inside brackets.
INSIDE = r"^\x00-\x2F\x3A-\x60\x7B-\x7F"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def template_sets(templates) -> list[tuple[int, str, list[str], int, list[str]]]:
    """(number, label, distinct words, words of a window, words that must be there) of each template."""
    found = []
    for number, (label, text, *must) in enumerate(templates):
        words = words_of(text)
        obliged = sorted(set(words_of(" ".join(must))))
        if not set(obliged) <= set(words):
            raise ValueError(f"template {number} ({label}) must hold words that it hasn't: {obliged}")
        found.append((number, label, sorted(set(words)), window(len(words)), obliged))
    return [t for t in found if t[2]]


def window(n_words: int) -> int:
    """The words in a row in which a template's words must stand."""
    return n_words + n_words // 2


def needed(threshold: float, size: int) -> int:
    return size if size <= WHOLE else max(1, math.ceil(threshold * size - 1e-9))


def word_order(docs: DataFrame, sets) -> list[str]:
    """The templates' words, rarest first by the number of documents that hold them."""
    vocabulary = sorted({w for _, _, words, _, _ in sets for w in words})
    if not vocabulary:
        return []
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), F.split(F.translate("_text", UPPER, LOWER), GAP))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # at most a row for each template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def license_matches(docs: DataFrame, templates=None, threshold: float = THRESHOLD, keys=("_id", "_mark")) -> DataFrame:
    """(keys, block, template, label, containment): stretches and templates of which a window is over the threshold.

    ``docs`` has the key columns, which tell texts apart, and ``_text``. containment is that of the best window.
    """
    keys, spark = list(keys), docs.sparkSession
    sets = template_sets(TEMPLATES if templates is None else templates)
    if not sets:
        return docs.select(*keys).where(F.lit(False)).select(*keys, F.lit(0).alias("block"), F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(0.0).alias("containment"))
    order, half = word_order(docs, sets), max(t[3] for t in sets)
    rank = {w: k for k, w in enumerate(order)}
    prefix = []
    for number, label, words, width, must in sets:
        ranks = sorted(rank[w] for w in words)
        least = needed(threshold, len(ranks))
        prefix += [(ranks[k], number, label, ranks, len(ranks), least, k, width, sorted(rank[w] for w in must)) for k in range(len(ranks) - least + 1)]
    table = spark.createDataFrame(prefix, "rank int, template int, label string, t_words array<int>, t_size int, least int, t_pos int, width int, must array<int>")
    vocabulary = spark.createDataFrame(list(rank.items()), "word string, rank int")
    if len(prefix) + len(rank) <= BROADCAST_ROWS:
        table, vocabulary = F.broadcast(table), F.broadcast(vocabulary)
    fewest = min(p[5] for p in prefix)
    rare = "|".join(re.escape(order[r]) for r in sorted({p[0] for p in prefix}))
    near = docs.where(F.translate("_text", UPPER, LOWER).rlike(f"(?<![{INSIDE}])(?:{rare})(?![{INSIDE}])"))
    words = near.select(*keys, F.posexplode(_word_array(F.col("_text"))).alias("place", "word")).join(vocabulary, "word")
    dealt = words.withColumn("block", F.explode(F.expr(f"sequence(greatest(place div {half} - 1, 0), place div {half})")))
    # a stretch has at most 2 * half places; rows repeated with the same key fall together
    blocks = dealt.groupBy(*keys, "block").agg(F.collect_set(F.struct("place", "rank")).alias("places"))
    blocks = blocks.withColumn("b_words", F.array_sort(F.array_distinct(F.col("places.rank")))).withColumn("b_size", F.size("b_words"))
    entries = blocks.where(F.col("b_size") >= fewest).select(*keys, "block", "places", "b_words", "b_size", F.posexplode(F.expr(f"slice(b_words, 1, b_size - {fewest} + 1)")).alias("b_pos", "rank"))
    pairs = (
        entries.join(table, "rank")
        .where(F.col("b_size") >= F.col("least"))
        .where(F.col("b_pos") <= F.col("b_size") - F.col("least"))
        .where(1 + F.least(F.col("t_size") - F.col("t_pos") - 1, F.col("b_size") - F.col("b_pos") - 1) >= F.col("least"))
        .withColumn("common", F.array_intersect("t_words", "b_words"))
        .where(F.size("common") >= F.col("least"))
        .where(F.element_at("common", 1) == F.col("rank"))  # one row for each pair: its first common word
    )
    mine = F.filter("places", lambda p: F.array_contains("common", p["rank"]))
    pairs = pairs.withColumn("mine", mine)
    inside = lambda start: F.array_distinct(F.filter("mine", lambda p: (p["place"] >= start["place"]) & (p["place"] < start["place"] + F.col("width")))["rank"])
    held = F.transform(F.transform("mine", inside), lambda w: F.when(F.size(F.array_except("must", w)) == 0, F.size(w)).otherwise(0))
    pairs = pairs.withColumn("most", F.array_max(held)).where(F.col("most") >= F.col("least"))
    return pairs.select(*keys, "block", "template", "label", (F.col("most") / F.col("t_size")).alias("containment"))


def license_scan(docs: DataFrame, templates=None, phrases=None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases, first_word and last_word are the smallest and
    largest word index at which one starts; score is the largest containment, or 1 where a
    phrase stands.
    """
    phrases = PHRASES if phrases is None else phrases
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_mark", F.xxhash64("_text"))
    split = [(words_of(p), label) for p, label in phrases.items()]
    near = "(?i)(?:" + "|".join(RAW_GAP.join(map(re.escape, w)) for w, _ in split) + ")"

    def starts(words: list[str]) -> Column:
        test = " and ".join(f"_words[i{f' + {k}' if k else ''}] = '{w}'" for k, w in enumerate(words))
        return F.expr(f"filter(sequence(0, size(_words) - {len(words)}), i -> {test})")

    # only texts near a phrase are taken apart into words
    rows = rows.withColumn("_near", F.col("_text").rlike(near))
    base = rows.select("_id", "_mark", F.when(F.col("_near"), _word_array(F.col("_text"))).alias("_words"), F.when(~F.col("_near"), F.regexp_count("_text", F.lit(RAW_WORD))).alias("_count"))
    base = base.select(
        "_id", "_mark", F.coalesce("_count", F.size("_words")).cast("long").alias("n_words"),
        *[F.when(F.size("_words") >= len(w), starts(w)).alias(f"_s{k}") for k, (w, _) in enumerate(split)],
    )
    places = F.flatten(F.filter(F.array(*[f"_s{k}" for k in range(len(split))]), lambda a: a.isNotNull()))
    named = F.array(*[F.when(F.size(f"_s{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(split)])
    base = base.withColumn("_places", places).withColumn("_base", F.array_distinct(F.array_compact(named)))
    found = license_matches(rows, templates, threshold).groupBy("_id", "_mark").agg(F.collect_set("label").alias("_own"), F.max("containment").alias("_most"))
    same = base["_id"].eqNullSafe(found["_id"]) & (base["_mark"] == found["_mark"])
    own = F.coalesce(F.col("_own"), F.array().cast("array<string>"))
    return base.join(found, same, "left").select(
        base["_id"].alias(id_col),
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", own)), ",").alias("labels"),
        F.when(F.size("_places") > 0, 1.0).otherwise(F.coalesce("_most", F.lit(0.0))).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(templates=None, phrases=None, threshold: float = THRESHOLD) -> str:
    """Brute force over every window and template, without the filters."""
    phrases = PHRASES if phrases is None else phrases
    sets = template_sets(TEMPLATES if templates is None else templates)
    array = lambda words: "[" + ", ".join(map(_quoted, words)) + "]"
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    words = lambda c: f"regexp_extract_all({lower(c)}, '{WORD}')"
    values = ", ".join(f"({n}, {_quoted(label)}, {array(w)}, {needed(threshold, len(w))}, {width}, {array(must) if must else "[]::VARCHAR[]"})" for n, label, w, width, must in sets)
    places = " || ".join("list_filter(range(greatest(len(w) - {n} + 1, 0)::BIGINT), lambda i: {test})".format(n=len(p), test=" and ".join(f"w[i + {k + 1}] = {_quoted(x)}" for k, x in enumerate(p))) for p, _ in ((words_of(p), 0) for p in phrases))
    labels = " || ".join("case when len(list_filter(range(greatest(len(w) - {n} + 1, 0)::BIGINT), lambda i: {test})) > 0 then [{label}] else []::varchar[] end".format(n=len(q := words_of(p)), label=_quoted(label), test=" and ".join(f"w[i + {k + 1}] = {_quoted(x)}" for k, x in enumerate(q))) for p, label in phrases.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT r, doc_id, t, {words("t")} AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words, {places} AS places, list_distinct({labels}) AS base FROM b),
templates(n, label, tw, least, width, must) AS (VALUES {values}),
tw AS (SELECT n, unnest(tw) AS word FROM templates),
held AS (SELECT r, n, place, word FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS place FROM b) JOIN tw USING (word)),
m AS (SELECT h.r, h.n, h.place, count(DISTINCT o.word) AS common, count(DISTINCT CASE WHEN list_contains(must, o.word) THEN o.word END) AS obliged FROM held h JOIN templates USING (n) JOIN held o ON o.r = h.r AND o.n = h.n AND o.place >= h.place AND o.place < h.place + width GROUP BY ALL),
own AS (SELECT r, list(DISTINCT label) AS labels, max(common::DOUBLE / len(templates.tw)) AS most FROM m JOIN templates USING (n) WHERE common >= least AND obliged = len(must) GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(labels, []::varchar[]))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN own USING (r)
"""
