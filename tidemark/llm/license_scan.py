"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions of the same k-grams in the
license templates. A match votes for the diagonal text position minus template position; votes are
counted by text, template and diagonal. For the short phrases every k-gram has to vote on one
diagonal, which is the phrase itself. For the long templates neighbouring diagonals are merged
(words put in or left out shift the diagonal), and a merged span counts when the template
positions that voted cover enough of the template and the span is not much longer than it.

Every text adds one vote for an entry that all texts match, so that the same aggregation also
returns texts without a license, and texts are read and split once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

#: What lies between words, once A-Z is in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening or notice texts of public licenses.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

#: Words in a k-gram of the phrases, and of the templates.
PHRASE_K, TEMPLATE_K = 2, 4
#: Diagonals at most so far apart are merged.
NEIGHBOURS = 6
#: Share of a template's words that the votes of a span have to cover.
COVERAGE = 0.6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text):
    """Words of a text with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def rolling(df: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """keep, p (position; null for a text without words), word, and h2, h4: hashes of the k-grams that start there, with their last words, null beyond the end.

    Words become longs first, and a k-gram is a row of an array zipped with itself moved on, so
    that all that is done for each position runs in generated code."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    on = lambda c, i: F.col(c) if not i else F.slice(c, F.lit(i + 1), F.greatest(F.size(c) - i, F.lit(0)))
    parts = [on("_h", i).alias(f"w{i}") for i in range(TEMPLATE_K)] + [on(words, i).alias(f"s{i}") for i in (0, PHRASE_K - 1, TEMPLATE_K - 1)]
    zipped = df.select(*keep, words, h.alias("_h")).select(*keep, F.arrays_zip(*parts).alias("_z"))
    at = zipped.select(*keep, F.posexplode_outer("_z").alias("p", "z"))
    hash_ = lambda k: F.when(F.col(f"z.w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"z.w{i}") for i in range(k)]))
    gram = lambda k: F.struct(hash_(k).alias("h"), F.col(f"z.s{k - 1}").alias("last"))
    return at.select(*keep, "p", F.col("z.s0").alias("word"), gram(PHRASE_K).alias("h2"), gram(TEMPLATE_K).alias("h4"))


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """h, t (label), tp (position), first_ and last_ (words), tw (words in all), tg (k-grams), base."""
    texts = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in templates.items()]
    df = spark.createDataFrame(texts, "t string, text string, base boolean").withColumn("w", words_of(F.col("text")))
    k = F.when(F.col("base"), PHRASE_K).otherwise(TEMPLATE_K)
    df = df.select("t", "base", "w", F.size("w").alias("tw"), (F.size("w") - k + 1).alias("tg"))
    every = rolling(df, "w", ["t", "base", "tw", "tg"]).withColumn("g", F.when(F.col("base"), F.col("h2")).otherwise(F.col("h4")))
    known = every.filter("g.h IS NOT NULL").select("g.h", "t", F.col("p").alias("tp"), F.col("word").alias("first_"), F.col("g.last").alias("last_"), "tw", "tg", "base")
    all_texts = spark.createDataFrame([("", 0, None, None, 0, 0, False)], "t string, tp int, first_ string, last_ string, tw int, tg int, base boolean")
    return known.unionByName(all_texts.withColumn("h", F.xxhash64(F.lit("every text"))))


def scan(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    spans: label, first word, word count and score of every license found. score is the largest
    share of a template that a span covers, 1 for a phrase. A null text is the empty one: no
    words, no labels (empty strings), score 0. A null id is carried along; repeated rows give
    repeated rows; an empty table gives none; other columns are not read."""
    spark = df.sparkSession
    # Four phrases and six short texts: a bound set by the parameters.
    known = F.broadcast(template_grams(spark, phrases, templates))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), words_of(text_of(text_col)).alias("_w")).withColumn("_row", F.monotonically_increasing_id())
    named = rows.select("_row", "doc_id", F.size("_w").cast("long").alias("n_words"), "_w")
    at = rolling(named, "_w", ["_row", "doc_id", "n_words"])
    every = F.struct(F.when(F.coalesce(F.col("p"), F.lit(0)) == 0, F.xxhash64(F.lit("every text"))).alias("h"), F.lit(None).cast("string").alias("last"))
    hashed = at.select("_row", "doc_id", "n_words", F.coalesce("p", F.lit(0)).alias("p"), "word", F.explode(F.array("h2", "h4", every)).alias("g"))
    hashed = hashed.select("_row", "doc_id", "n_words", "p", "word", "g.h", "g.last")
    hits = hashed.join(known, "h").filter("t = '' OR (word = first_ AND last = last_)")
    by_diagonal = hits.groupBy("_row", "doc_id", "n_words", "t", "base", "tw", "tg", (F.col("p") - F.col("tp")).alias("d")).agg(
        F.count_distinct("tp").alias("votes"), F.min("tp").alias("lo"), F.max("tp").alias("hi"), F.collect_set("tp").alias("tps")
    )
    # Merge neighbouring diagonals of the long templates; a text's diagonals are few.
    near = Window.partitionBy("_row", "t").orderBy("d")
    gap = F.when(F.col("base") | F.lag("d").over(near).isNull() | (F.col("d") - F.lag("d").over(near) > NEIGHBOURS), 1).otherwise(0)
    island = by_diagonal.withColumn("_new", gap).withColumn("island", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy("_row", "doc_id", "n_words", "t", "base", "tw", "tg", "island").agg(
        F.min(F.col("d") + F.col("lo")).alias("first"),
        F.max(F.col("d") + F.col("hi")).alias("last"),
        F.max("votes").alias("votes"),
        F.flatten(F.collect_list("tps")).alias("tps"),
    )
    k = F.when(F.col("base"), PHRASE_K).otherwise(TEMPLATE_K)
    covered = F.size(F.array_distinct(F.flatten(F.transform("tps", lambda p: F.sequence(p, p + k - 1)))))
    share = F.when(F.col("tw") > 0, F.least(F.lit(1.0), covered / F.col("tw"))).otherwise(F.lit(0.0))
    length = F.col("last") + k - F.col("first")
    found = F.when(F.col("base"), F.col("votes") == F.col("tg")).otherwise((share >= coverage) & (length <= 2 * F.col("tw")))
    spans = spans.withColumn("_share", share).withColumn("_found", found & (F.col("t") != ""))
    yes, base = F.col("_found"), F.col("_found") & F.col("base")
    span = F.struct(F.col("t").alias("label"), F.col("first").alias("first_word"), length.alias("n_words"), F.col("_share").alias("score"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("t")))), ",")
    return (
        spans.groupBy("_row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first").cast("long"))).alias("first_word"),
            F.max(F.when(base, F.col("first").cast("long"))).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(yes).alias("labels"),
            F.coalesce(F.max(F.when(yes, F.col("_share"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(yes, span))).alias("spans"),
        )
        .drop("_row")
    )
