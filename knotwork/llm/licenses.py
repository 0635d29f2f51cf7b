"""Operator 12: license scans by diagonal voting, with DataFrame functions alone.

Documents and templates become words; every run of k words is a rolling gram with a hash. The grams of all documents are joined to the
positions of equal grams in the templates, by hash and by the words themselves, so no vote rests on a hash alone. A match
votes for its diagonal, the place in the document minus the place in the template. Votes are summed by diagonal; diagonals of a
template that are at most ``DRIFT`` apart and touch each other (words were inserted or left out) are merged; a merged span is
verified if the grams that it covers are enough of the template and it is not much longer than the template.

Base phrases are templates of their own with grams of two words, one diagonal, and every gram needed, so that a verified span
is a place where the words stand consecutively. Other templates have grams of three words.

Scale. Words are taken ``CHUNK`` at a time, each chunk overlapping the next by a gram, so a long text never is one array of grams. The
templates are broadcast; their size is checked against ``MOST_GRAMS``. Only grams that meet a template, and one row for each document,
leave the scan; they are counted before they are shuffled. Rows with equal doc_id and text are counted as one and repeated at the end.

Defined results. Null and empty texts, and texts without words: no words, no labels, score 0. No place: first_word and last_word are null, lists
of labels are empty strings. Null doc_id: rows of their own, one for each row. Repeated rows: each has the result. Texts of any
length are read whole. Ties do not arise: places are counted, labels are distinct. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits, letters and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Common notices by the label that they add.
TEMPLATES = (
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
GRAM, BASE_GRAM = 3, 2
#: Words that a merged span may gain or lose between its diagonals, and the share of a template's grams that verifies it.
DRIFT, COVER = 3, 0.7
CHUNK, MOST_GRAMS, SEED = 4096, 100_000, 12


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams(words: Column, k: int, start: Column, most: int | None = None) -> Column:
    """(at, gram) of the runs of k words of an array whose first word has the place ``start``; the first ``most`` of them."""
    n = F.size(words) - k + 1
    n = n if most is None else F.least(n, F.lit(most))
    run = lambda i: F.struct((start + i).cast("long").alias("at"), F.array_join(F.slice(words, i + 1, k), " ").alias("gram"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), run)).otherwise(F.array().cast("array<struct<at:bigint,gram:string>>"))


def template_grams(spark: SparkSession, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(template, label, base, grams, place, gram, hash): a row for each gram of each template."""
    rows = [(i, label, text, True) for i, (text, label) in enumerate(phrases.items())]
    rows += [(len(rows) + i, label, text, False) for i, (label, text) in enumerate(templates)]
    length = sum(len(text.split()) for _, _, text, _ in rows)
    if length > MOST_GRAMS:
        raise ValueError(f"templates of {length} words; at most {MOST_GRAMS} are broadcast")
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(base).alias("base")) for i, label, text, base in rows])
    t = spark.range(1).select(F.inline(listed)).withColumn("words", words_of(F.col("text")))
    t = t.withColumn("g", F.when(F.col("base"), grams(F.col("words"), BASE_GRAM, F.lit(0))).otherwise(grams(F.col("words"), GRAM, F.lit(0))))
    t = t.select("template", "label", "base", F.size("g").alias("grams"), F.inline("g")).withColumnRenamed("at", "place")
    return t.withColumn("hash", F.xxhash64("gram"))


KEY = ["doc_id", "h1", "h2", "n_words"]


def matches(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """A row for each gram of a document at each place of a template, and one with a null template for each document."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(SEED), "text").alias("h2"), words_of(F.col("text")).alias("words"))
    x = x.withColumn("n_words", F.size("words").cast("long"))
    starts = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), (F.col("n_words") - 1).cast("int"), F.lit(CHUNK))).otherwise(F.array(F.lit(0)))
    chunks = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("words", s + 1, CHUNK + max(GRAM, BASE_GRAM) - 1).alias("w")))
    x = x.select(*KEY, F.inline(chunks))
    itself = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("gram")))
    none = F.array().cast("array<struct<at:bigint,gram:string>>")
    each = F.concat(F.when(F.col("s") == 0, itself).otherwise(none), grams(F.col("w"), BASE_GRAM, F.col("s"), CHUNK), grams(F.col("w"), GRAM, F.col("s"), CHUNK))
    x = x.select(*KEY, F.inline(each)).withColumn("hash", F.xxhash64("gram"))
    met = x.join(F.broadcast(templates), ["hash", "gram"], "left")
    return met.where(F.col("template").isNotNull() | (F.col("at") < 0)).select(*KEY, "template", "label", "base", "grams", "at", "place")


def spans(found: DataFrame) -> DataFrame:
    """(doc key, template, label, base, copies, votes, first, last, cover, verified) of merged diagonals; ``copies`` is set in the row of
    the document itself, whose template is null. ``votes`` count every repeated row of the document."""
    about = ["template", "label", "base", "grams"]
    diagonal = found.groupBy(*KEY, *about, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT) | (F.col("first") - F.lag("last").over(w) > DRIFT + GRAM) | (F.lag("first").over(w) - F.col("last") > DRIFT + GRAM), F.lit(True))
    x = diagonal.withColumn("apart", apart.cast("int"))
    x = x.withColumn("span", F.sum("apart").over(w))
    return x.groupBy(*KEY, *about, "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found of every document.

    ``score`` is the largest share of a template that a verified span covers; ``found`` lists the verified spans (label, first and last
    word, cover) in order.
    """
    x = spans(matches(docs, template_grams(docs.sparkSession, phrases, templates)))
    copies = F.max(F.when(F.col("template").isNull(), F.col("votes"))).over(Window.partitionBy(*KEY))
    x = x.withColumn("copies", copies)
    cover = F.least(F.lit(1.0), F.col("votes") / (F.col("grams") * F.col("copies")))
    fits = F.col("last") - F.col("first") < F.col("grams") + DRIFT
    x = x.withColumn("cover", cover).withColumn("ok", F.coalesce(F.when(F.col("base"), F.col("cover") >= 1).otherwise((F.col("cover") >= COVER) & fits), F.lit(False)))
    base = F.col("ok") & F.col("base")
    size = F.when(F.col("base"), F.lit(BASE_GRAM)).otherwise(F.lit(GRAM))
    span = F.struct(F.col("first").alias("first_word"), (F.col("last") + size - 1).alias("last_word"), "label", "cover")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = x.groupBy(*KEY, "copies").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(F.col("ok"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("cover"))), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("found"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")
