"""Operator 5: license scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every text (2 words for the base phrases, GRAM words for
notices) is joined by hash with the positions that templates have it at; the words are
compared too, so no collision counts.  A hit votes for the diagonal ``text position -
template position`` and for the template's words it stands on.  Neighbouring diagonals
are merged (an inserted or a dropped word moves the rest of a template by one): the
template words that any of their hits stands on are counted once each.  A span is
verified by that count: as each hit was compared word for word, COVER of the
template's words stand in the text at their places, up to the drift.  A phrase whose
diagonal has every vote stands there word for word.

All hits of a text meet in one partition by (doc_id, hash of the text), which no
source, template or group of copies dominates; only hits are shuffled.

Cases: a null or empty text has no words, no places and score 0; rows with the
same doc_id and different texts are judged apart, fully equal rows are judged once
and returned as often as they occur; ties of score don't matter, as labels are a
set; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import ALNUM_BREAK, alnum_words

#: The base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and characteristic sentences of public licenses, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable "
     "for any damages arising from the use of this software", "zlib"),
    ("the accompanying program is provided under the terms of this eclipse public license", "epl"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under a creative commons attribution", "cc-by"),
)
#: Words of a notice's gram; a shorter notice is one gram.
GRAM = 4
#: Diagonals at most so far apart vote together.
DRIFT = 2
#: Share of a notice's words that must be verified.
COVER = 0.85
#: Templates come as a list in the program; beyond so many grams it's refused, so the broadcast stays small.
MOST_GRAMS = 1_000_000


def template_grams(spark: SparkSession, base: Iterable, notices: Iterable) -> DataFrame:
    """One row for each distinct gram: width, gram (its words), hash and uses, an array of struct(template, label, is_base, n_words, at)."""
    rows = []
    for number, (text, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in notices]):
        words = [w for w in re.split(ALNUM_BREAK, text.lower()) if w]
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        width = 2 if is_base else min(GRAM, len(words))
        rows += [(number, label, is_base, len(words), i, width, " ".join(words[i : i + width])) for i in range(len(words) - width + 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} grams of templates; {MOST_GRAMS} at most")
    names = "template int, label string, is_base boolean, n_template int, at int, width int, gram string"
    use = F.struct("template", "label", "is_base", "n_template", "at", "width")
    found = spark.createDataFrame(rows, names)
    return found.groupBy("width", "gram").agg(F.collect_list(use).alias("uses")).withColumn("hash", F.xxhash64("gram"))


def scan(docs: DataFrame, base=BASE_PHRASES, notices=NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matched spans.

    ``spans`` lists struct(label, first_word, n_words, verified, is_base), by label and first word.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, base, notices)
    widths = sorted({2} | {min(GRAM, len([w for w in re.split(ALNUM_BREAK, t.lower()) if w])) for t, _ in notices})
    words = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
        alnum_words(F.col(f"`{text}`")).alias("words"),
    )
    # Place -1 stands for the text itself; so a text without hits comes through, and one scan does.
    places = words.select(
        "doc_id", "text_hash", "words",
        F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - 2, F.lit(-1)))).alias("place"),
    )
    # The words end here: a row that went on with them would hold a copy of its whole text.
    there = lambda width: (F.col("place") >= 0) & (F.col("place") + width <= F.size("words"))
    gram = lambda width: F.when(there(width), F.array_join(F.slice("words", F.col("place") + 1, F.lit(width)), " "))
    places = places.select(
        "doc_id", "text_hash", "place", F.when(F.col("place") < 0, F.size("words")).alias("n_words"), *(gram(w).alias(f"gram_{w}") for w in widths)
    )
    for width in widths:
        own = grams.where(F.col("width") == width).select("hash", "gram", F.col("uses").alias(f"uses_{width}"))
        same = (F.xxhash64(f"gram_{width}") == F.col("hash")) & (F.col(f"gram_{width}") == F.col("gram"))
        places = places.join(F.broadcast(own), same, "left").drop("hash", "gram", f"gram_{width}")
    uses = F.flatten(F.array_compact(F.array(*(F.col(f"uses_{w}") for w in widths))))
    hits = (
        places.withColumn("uses", uses)
        .where("place < 0 OR size(uses) > 0")
        .select("doc_id", "text_hash", "n_words", "place", F.explode_outer("uses").alias("use"))
        .select("doc_id", "text_hash", "n_words", "place", "use.*")
        .repartition("doc_id", "text_hash")
    )
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    votes = hits.groupBy("doc_id", "text_hash", "template", "label", "is_base", "n_template", diagonal).agg(
        F.collect_set("at").alias("ats"), F.max("width").alias("width"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows")
    )
    near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    stood_on = lambda a: F.sequence(a, a + F.col("width") - 1)
    verified = F.size(F.array_distinct(F.flatten(F.transform(F.col("near_ats"), stood_on))))
    own_votes = F.size("ats")
    merged = (
        votes.withColumn("near_ats", F.array_distinct(F.flatten(F.collect_list("ats").over(near))))
        .withColumn("best", own_votes == F.max(own_votes).over(near))
        .withColumn("verified", F.when(F.col("template").isNotNull(), verified))
    )
    is_template = F.col("template").isNotNull()
    place = is_template & F.col("is_base") & (own_votes == F.col("n_template") - 1)
    found = is_template & F.when(F.col("is_base"), place).otherwise(F.col("best") & (F.col("verified") >= COVER * F.col("n_template")))
    span = F.struct(
        F.col("label"), F.col("diagonal").alias("first_word"), F.col("n_template").alias("n_words"), F.col("verified"), F.col("is_base")
    )
    cover = F.col("verified") / F.col("n_template")
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    one = merged.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        labels(place).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, cover)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
        F.max(F.when(~is_template, F.col("rows"))).alias("rows"),
    )
    # A row that occurs more than once was counted once, by distinct template positions; it is given back as often.
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop(
        "copy", "rows", "text_hash"
    )
