"""License scans by diagonal voting.

All rolling word pairs of a text are joined by hash to their positions in the templates (a few
fixed texts, broadcast), and each hit votes for its diagonal: text position minus template
position. Votes are counted per diagonal; diagonals of one template that lie within its ``slack``
are merged, so that an inserted or missing word doesn't split a passage; a merged span counts if
enough of the template's word pairs are covered, and a base phrase only if all are, on one diagonal.

Cases: a null or empty text has no words and no labels; a word is a run of ASCII digits, letters
and any characters beyond ASCII; repeated rows get the same result each; phrases may overlap and
all their places count; rows without doc_id are scanned like others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph.llm.common import texts_of
from loregraph.llm.native_text import keyed_texts, same, with_words, word_blocks

GRAM = 2
COVERED = 0.6

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Notices by which licenses are declared, as published with them.
NOTICES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", "gpl-notice"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-notice"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Released under the MIT License.", "mit-release"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files", "mit-notice"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", "bsd-notice"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc-notice"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
]
SLACK = 3


def template_grams(spark: SparkSession) -> DataFrame:
    """``gram_hash, one, two, label, base, at, grams, slack`` of every word pair of every template."""
    rows = []
    for base, texts in ((True, PHRASES), (False, NOTICES)):
        for text, label in texts:
            words = re.findall(r"[0-9a-z]+", text.lower())
            rows += [(words[i], words[i + 1], label, base, i, len(words) - 1, 0 if base else SLACK) for i in range(len(words) - 1)]
    table = spark.createDataFrame(rows, "one string, two string, label string, base boolean, at int, grams int, slack int")
    return table.withColumn("gram_hash", F.xxhash64("one", "two"))


def gram_hits(texts: DataFrame) -> DataFrame:
    """Word pairs that stand in a template: ``doc_id, h, label, base, grams, slack, at, place``."""
    spark = texts.sparkSession
    rows = with_words(keyed_texts(texts)).select("doc_id", "h", "skip", "n_words", "pieces")
    pairs = word_blocks(rows, "pieces", GRAM - 1)
    first, second = F.get("block", F.col("i")), F.get("block", F.col("i") + 1)
    place = F.col("base") + F.col("i") - F.col("skip")
    pairs = pairs.filter((place >= 0) & (place < F.col("n_words") - 1)).select(
        "doc_id", "h", place.alias("place"), first.alias("first"), second.alias("second"), F.xxhash64(first, second).alias("gram_hash"))
    # the templates are the fixed lists above, at most a few hundred pairs
    hits = pairs.join(F.broadcast(template_grams(spark)), "gram_hash")
    return hits.filter((F.col("first") == F.col("one")) & (F.col("second") == F.col("two"))).drop("gram_hash", "one", "two", "first", "second")


def license_spans(docs: DataFrame) -> DataFrame:
    """Verified spans: ``doc_id, h, label, base, first_word, last_word, covered``."""
    hits = gram_hits(texts_of(docs)).withColumn("diagonal", F.col("place") - F.col("at"))
    keys = ["doc_id", "h", "label", "base", "grams", "slack"]
    votes = hits.groupBy(*keys, "diagonal").agg(
        F.collect_set("at").alias("covered"), F.min("place").alias("low"), F.max("place").alias("high"))
    line = Window.partitionBy("doc_id", "h", "label").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.col("slack"), F.lit(True))
    votes = votes.withColumn("_apart", apart.cast("int")).withColumn("run", F.sum("_apart").over(line))
    spans = votes.groupBy(*keys, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"), F.min("low").alias("first_word"),
        (F.max("high") + 1).alias("last_word"))
    share = F.col("n") / F.col("grams")
    good = F.when(F.col("base"), F.col("n") == F.col("grams")).otherwise(share >= COVERED)
    return spans.filter(good).select("doc_id", "h", "label", "base", "first_word", "last_word", share.alias("covered"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per document with counts, places, labels and the best share of a template covered.

    The texts are read twice; between the reads only hits are shuffled, and a few numbers per
    document for the last join."""
    base = F.col("base")
    found = license_spans(docs).groupBy("doc_id", "h").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("covered").alias("score"))
    texts = with_words(keyed_texts(texts_of(docs))).select("doc_id", "h", "n_words")
    rows = texts.alias("t").join(found.alias("f"), same(["doc_id", "h"], "t", "f"), "left")
    return rows.select(
        F.col("t.doc_id").cast("long").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
