"""License scans with a positional index of rare licence words.

1. Over all documents: words, exact base phrases, and which licence words a document holds. The document
   frequencies of the licence words give their inverse document frequencies (IDF).
2. Each document looks up all its licence words in the postings (template, position) of the templates, so notices
   that stand side by side do not compete. A posting and a place in the document agree on an offset; the postings
   of a template that agree on one offset intersect, and their IDF adds up.
3. A template whose aligned words reach half of its weight is reported once its mandatory phrases stand there.

Native expressions only. Templates are a fixed list of some hundred words, so the index is a literal of fixed size.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.llm import shared
from fieldloom.llm.shared import Scratch

# Base phrases with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Characters that separate words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Public licence notices: label, notice, phrases that must stand in the text.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files, to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
     ["apache license", "version 2"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "as published by the Free Software Foundation, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "version 3"]),
    ("lgpl-3", "This library is licensed under the GNU Lesser General Public License, version 3.", ["gnu lesser general public license", "version 3"]),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license", "version 3"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["unencumbered software", "public domain"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights, CC0 1.0 Universal", ["cc0 1 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
]
COMMON = set("a all and any are as at be by can either for forms has in into is it may not of on or provided that the this to under use with you".split())
RARE = 12  # licence words of a template that make up its weight
LEAST = 3  # aligned words
SHARE = 0.5  # of a template's weight


def tokens(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, text.lower()) if w]


def postings() -> list[tuple[int, str, int]]:
    """template number, word, position."""
    return [(k, w, i) for k, (_, notice, _) in enumerate(TEMPLATES) for i, w in enumerate(tokens(notice)) if w not in COMMON]


def spaced(text: Column) -> Column:
    """The words of a text, each with one space before it and one after the last; a single space if there are none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # Full lower-casing is faster and equal on ASCII words, but for two letters that become ASCII ones.
    low = F.when(t.rlike("[\u0130\u212A]"), shared.ascii_lower(t)).otherwise(F.lower(t))
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(low, BREAKS, " "), "^ | $", ""), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(words: Column, n_words: Column, phrase: str) -> Column:
    """struct n, first, last of a phrase's places; null without any."""
    parts = F.split(words, f" {phrase}(?= )", -1)
    last = n_words - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())
    found = F.struct((F.size(parts) - 1).cast("long").alias("n"), _spaces(F.element_at(parts, 1)).cast("long").alias("first"),
                     last.cast("long").alias("last"))
    return F.when(F.contains(words, F.lit(f" {phrase} ")), found)


def scan_licenses(docs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score: one row per input row.

    * Null and empty texts have no words, no labels and score 0.
    * Rows are told apart by a hash of doc_id and text: null doc_ids are served, rows that repeat one another
      completely get equal results. Ties between templates do not matter, labels are a set.
    * Columns besides doc_id and text are ignored. An empty table gives an empty result.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "licenses")
    index = postings()
    vocabulary = F.array(*map(F.lit, sorted({w for _, w, _ in index})))
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("id"), spaced(F.col("text")).alias("words"))
    words = words.withColumn("n_words", F.when(F.col("words") == "  ", 0).otherwise(_spaces(F.col("words")) - 1).cast("long"))
    base = [_base(F.col("words"), F.col("n_words"), p).alias(label) for p, label in BASE.items()]
    held = F.array_intersect(F.split("words", " "), vocabulary)
    words = words.select("doc_id", "id", "n_words", "words", F.struct(*base).alias("base"), held.alias("held"))
    # Fewer than LEAST licence words cannot align, so such texts need not be kept.
    words = scratch.keep(words.withColumn("words", F.when(F.size("held") >= LEAST, F.col("words"))))

    n_docs = words.count()
    idf = words.select(F.explode("held").alias("word")).groupBy("word").agg(F.log1p(n_docs / F.count(F.lit(1))).alias("idf"))
    idf = scratch.keep(idf)  # at most one row per word of the templates
    post = spark.createDataFrame(index, "template int, word string, at int").join(idf, "word")
    best = W.partitionBy("template").orderBy(F.desc("idf"), "word")
    rarest = post.groupBy("template", "word").agg(F.first("idf").alias("idf")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= RARE)
    post = post.join(rarest.groupBy("template").agg(F.sum("idf").alias("weight")), "template")
    post = F.broadcast(scratch.keep(post))  # a row per word of the templates at most

    candidates = words.filter("words IS NOT NULL").dropDuplicates(["id"])
    # positions of the licence words, then their postings; offsets on which postings agree
    places = candidates.select("id", F.posexplode(F.split(F.expr("btrim(words)"), " ")).alias("pos", "word"))
    aligned = places.join(post, "word").groupBy("id", "template", (F.col("pos") - F.col("at")).alias("offset")).agg(
        F.count_distinct("word").alias("n"), F.sum("idf").alias("found"), F.first("weight").alias("weight")
    )
    share = F.least(F.col("found") / F.col("weight"), F.lit(1.0))
    top = aligned.filter(F.col("n") >= LEAST).groupBy("id", "template").agg(F.max(share).alias("share")).filter(F.col("share") >= SHARE)
    top = top.groupBy("id").agg(F.collect_list(F.struct("template", "share")).alias("hits"))  # one per template at most

    def verified(h: Column) -> Column:
        ok = lambda k, phrases: (h["template"] == k) & reduce(lambda a, b: a & b, [F.contains("words", F.lit(f" {p} ")) for p in phrases])
        return reduce(lambda a, b: a | b, [ok(k, phrases) for k, (_, _, phrases) in enumerate(TEMPLATES)])

    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    hits = candidates.join(top, "id").select("id", F.filter("hits", verified).alias("hits"))
    hits = hits.select("id", F.transform("hits", lambda h: F.element_at(labels, h["template"] + 1)).alias("own"),
                       F.array_max(F.transform("hits", lambda h: h["share"])).alias("share"))
    each = [F.col(f"base.`{label}`") for label in BASE.values()]
    base_labels = F.array_sort(F.filter(F.array(*[F.when(c.isNotNull(), F.lit(k)) for c, k in zip(each, BASE.values())]), lambda x: x.isNotNull()))
    return words.join(hits, "id", "left").select(
        "doc_id", "n_words",
        reduce(lambda a, b: a + b, [F.coalesce(c["n"], F.lit(0)) for c in each]).cast("long").alias("n_base"),
        F.least(*[c["first"] for c in each]).alias("first_word"), F.greatest(*[c["last"] for c in each]).alias("last_word"),
        base_labels.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce("own", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce(F.round("share", 6), F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(shared.table(spark, sf_dir, "documents"), spark)
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
