"""License scans by diagonal voting, on DataFrame operations alone.

Every word position of a text is joined to the template positions that hold
the same k-gram. A match at word ``i`` of the text and word ``j`` of the
template votes for diagonal ``i - j``. Votes are gathered for each diagonal,
as bit words so that a k-gram counts once; each diagonal is then merged with
those at most ``max_shift`` words beyond it (words inserted or left out), and
the span that results is verified against the share of the template that it
covers. A merge only adds votes, so a notice that repeats loses nothing.

Texts are read once: votes and one narrow row for each document are stored.

Defined cases: a null or empty text has no words and no spans; a repeated row
gets the same result on each of its copies; a null id is carried through;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, content_key, folded, stored, text_or_empty, word_array

TEXT = ["ck1", "ck2"]
#: k-grams of a template whose votes share one word of bits.
BITS = 62
# Phrases with their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of public license notices with their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool
    k: int


def default_templates() -> list[Template]:
    base = [Template(label, tuple(text.split()), True, 2) for text, label in BASE_PHRASES]
    return base + [Template(label, (w := tuple(text.split())), False, min(3, len(w))) for text, label in NOTICES]


def _grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """A row for each k-gram of each template: a constant, so it may be broadcast."""
    rows = []
    for n, t in enumerate(templates):
        if len(t.words) < 2:
            raise ValueError("a template has two words at least")
        for j in range(len(t.words) - t.k + 1):
            w = t.words[j : j + t.k]
            rows.append((n, j, w[0], w[1], w[2] if t.k > 2 else None))
    return spark.createDataFrame(rows, "template int, at int, g0 string, g1 string, g2 string")


def _templates(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = [(n, t.label, t.base, len(t.words) - t.k + 1, len(t.words)) for n, t in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, n_template int")


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """The stored votes: id, n_words, ck1, ck2, i, template, at. A row with n_words stands for a document, all others for a vote."""
    grams = F.broadcast(_grams(docs.sparkSession, templates or default_templates()))
    text = text_or_empty(text_col)
    words = docs.select(F.col(id_col).alias("id"), *content_key(text), word_array(folded(text)).alias("words"))
    # before the words an empty one, which matches nothing, for the document; outer: else the optimizer would add a filter that splits each text twice
    placed = words.select("id", *TEXT, "words", F.posexplode_outer(F.concat(F.array(F.lit("")), "words")).alias("nth", "w0"))
    placed = placed.withColumn("w1", F.get("words", F.col("nth")))
    voted = placed.join(
        grams,
        (F.xxhash64("w0", "w1") == F.xxhash64("g0", "g1"))
        & (F.col("w0") == F.col("g0"))
        & (F.col("w1") == F.col("g1"))
        & (F.col("g2").isNull() | (F.get("words", F.col("nth") + 1) == F.col("g2"))),
        "left",
    )
    document = F.col("nth") == 0
    rows = voted.where(document | F.col("template").isNotNull())
    return stored(rows.select(F.when(document, F.col("id")).alias("id"), F.when(document, F.size("words")).alias("n_words"), *TEXT, (F.col("nth") - 1).alias("i"), "template", "at"), "votes")


def license_spans(voted: DataFrame, templates: list[Template] | None = None, max_shift: int = 8, min_cover: float = 0.6) -> DataFrame:
    """Verified spans of :func:`votes`: ck1, ck2 (content key), label, base, start, stop, cover.

    ``max_shift`` is the largest distance of diagonals that are merged,
    ``min_cover`` the least share of a notice's k-grams that a span holds. Base
    phrases need every k-gram on one diagonal, so each is an exact occurrence.
    Of overlapping merges the best is a span, and so is every diagonal that
    suffices alone.
    """
    about = F.broadcast(_templates(voted.sparkSession, templates or default_templates()))
    diagonal, part = F.col("i") - F.col("at"), F.floor(F.col("at") / BITS)
    diagonals = (
        voted.where("template IS NOT NULL")
        .groupBy(*TEXT, "template", diagonal.alias("diagonal"), part.alias("part"))
        # copies of a text vote alike: a bit for each k-gram counts each once
        .agg(F.bit_or(F.expr(f"shiftleft(1L, at % {BITS})")).alias("bits"), F.min("i").alias("low"), F.max("i").alias("high"))
    )
    diagonals = stored(diagonals.join(about, "template"), "diagonals")  # read twice below
    own = diagonals.groupBy(*TEXT, "template", "label", "base", "n_grams", "n_template", "diagonal").agg(F.sum(F.bit_count("bits")).alias("own"))
    base = own.where("base AND own = n_grams").select(
        *TEXT, "label", "base", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("n_template")).cast("long").alias("stop"), F.lit(1.0).alias("cover")
    )
    # each diagonal counts for those at most max_shift words before it
    ahead = diagonals.where("NOT base").withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(max_shift))))
    mine = lambda c: F.when(F.col("shift") == 0, c)
    merged = (
        ahead.groupBy(*TEXT, "template", "label", "n_grams", "n_template", (F.col("diagonal") - F.col("shift")).alias("run"), "part")
        .agg(
            F.bit_count(F.bit_or("bits")).alias("all"), F.coalesce(F.bit_count(F.bit_or(mine(F.col("bits")))), F.lit(0)).alias("own"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.min(mine(F.col("low"))).alias("own_low"), F.max(mine(F.col("high"))).alias("own_high"),
        )
        .groupBy(*TEXT, "template", "label", "n_grams", "n_template", "run")
        .agg(F.sum("all").alias("all"), F.sum("own").alias("own"), *[f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.min, "own_low"), (F.max, "own_high"))])
        .withColumn("cover", F.col("all") / F.col("n_grams"))
        # verified: enough of the template
        .where((F.col("own") > 0) & (F.col("cover") >= min_cover))
    )
    near = Window.partitionBy(*TEXT, "template").orderBy("run").rangeBetween(-max_shift, max_shift)
    alone = F.col("own") / F.col("n_grams") >= min_cover
    rank = F.struct("all", (-F.col("run")).alias("first"))
    notices = merged.withColumn("best", F.max(rank).over(near) == rank).where(alone | F.col("best"))
    tail = F.col("n_template") - F.col("n_grams") + 1
    notices = notices.select(
        *TEXT, "label", F.lit(False).alias("base"), F.when(alone, F.col("own_low")).otherwise(F.col("low")).cast("long").alias("start"),
        (F.when(alone, F.col("own_high")).otherwise(F.col("high")) + tail).cast("long").alias("stop"), "cover",
    )
    return base.unionByName(notices)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, **options) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, n_spans.

    ``score`` is the largest share of a template that any span covers (1.0 for
    a base phrase, 0.0 without spans).
    """
    voted = votes(docs, id_col, text_col, templates)
    found = (
        license_spans(voted, templates, **options)
        .groupBy(*TEXT)
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("cover").alias("score"),
            F.count("*").alias("n_spans"),
        )
    )
    found = stored(found, "licenses")  # a stored side lets a join on a hot text be split
    rows = voted.where("n_words IS NOT NULL").select(F.col("id").alias(id_col), *TEXT, F.col("n_words").cast("long").alias("n_words"))
    return rows.join(bounded(found), TEXT, "left").select(
        id_col,
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
