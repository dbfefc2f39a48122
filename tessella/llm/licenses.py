"""License scans by diagonal voting (operator 11), in DataFrame functions only.

All rolling hashes of GRAM words (and of PHRASE_GRAM words, for phrases) of a
text are joined with the places where they stand in the templates. A hit at
word i of the text and word j of a template votes for the diagonal i - j: the
text's word at which the template would begin. Votes are gathered for each
diagonal; neighbouring diagonals, which words put in or left out tell apart,
are merged; and a span is verified by the share of the template's words that
hits cover. Each hit is checked word for word, so a hash only finds it.

A phrase counts where all its grams vote for one diagonal, so its words stand
there one after the other. Only hits are shuffled, dealt by the text's row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_GRAM, GRAM = 2, 3
#: Words of all templates at most, as their grams are broadcast.
MOST_WORDS = 10_000

# Phrases and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# The notices of public licenses, as they stand in files.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _gram_hash(size: int, word) -> Column:
    """The hash of the words word(0) ... word(size - 1); other sizes give other hashes."""
    return F.xxhash64(F.lit(size), *[word(i) for i in range(size)])


def _rolling(words: Column, size: int) -> Column:
    """The hashes of all runs of size words."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: _gram_hash(size, lambda k: F.get(words, i + k)))).otherwise(F.array().cast("array<long>"))


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """hash, template, label, phrase, place, size, length, gram of every gram of the templates; template -1 is the mark of a row."""
    rows = []
    for number, (label, text) in enumerate((*phrases, *notices)):
        phrase, words = number < len(phrases), text.split()
        size = PHRASE_GRAM if phrase else GRAM
        if len(words) < size:
            raise ValueError(f"a template needs {size} words: {text}")
        rows += [(number, label, phrase, place, size, len(words), words[place : place + size]) for place in range(len(words) - size + 1)]
    if len(rows) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words are not broadcast")
    names = ("template", "label", "phrase", "place", "size", "length", "gram")
    listed = json.dumps([dict(zip(names, row, strict=True)) for row in (*rows, (-1, "", False, 0, 0, 1, []))])
    grams = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<template:int,label:string,phrase:boolean,place:int,size:int,length:int,gram:array<string>>>")))
    word = lambda k: F.get("gram", F.lit(k))
    hash_ = F.when(F.col("template") < 0, F.lit(0)).when(F.col("phrase"), _gram_hash(PHRASE_GRAM, word)).otherwise(_gram_hash(GRAM, word))
    return grams.select(hash_.cast("long").alias("hash"), *names)


def _hits(docs: DataFrame, templates: DataFrame, doc_id: str, text: str) -> DataFrame:
    """uid, doc_id, n_words, the template's columns and diagonal of every hit, and one row (template -1) of every row of docs; dealt by uid."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), words_of(text_or_empty(text)).alias("words"))
    n = F.size("words")
    # In front of the grams stands the row's own mark, then phrases' grams, then notices'.
    hashes = F.concat(F.array(F.lit(0).cast("long")), _rolling(F.col("words"), PHRASE_GRAM), _rolling(F.col("words"), GRAM))
    spread = rows.select("uid", "doc_id", "words", F.posexplode(hashes).alias("i", "hash"))
    long_from = F.greatest(n - PHRASE_GRAM + 1, F.lit(0)) + 1
    met = spread.join(F.broadcast(templates), "hash")
    at = F.when(F.col("size") == GRAM, F.col("i") - long_from).otherwise(F.col("i") - 1)
    own = F.when(F.col("template") < 0, F.col("i") == 0).otherwise((F.col("i") > 0) & (at >= 0) & (F.slice("words", at + 1, F.col("size")) == F.col("gram")))
    hits = met.where(own).select("uid", "doc_id", n.alias("n_words"), "template", "label", "phrase", "place", "size", "length", (at - F.col("place")).alias("diagonal"))
    return hits.repartition("uid")


def _spans(hits: DataFrame, gap: int, least: float) -> DataFrame:
    """A row for each merged group of diagonals, for each single diagonal, and (template -1) for each row: first, end, coverage, verified."""
    name, about = ["uid", "template"], ["doc_id", "n_words", "label", "phrase", "length", "size"]
    covered = lambda places: F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("size") - 1)))))
    # Places are collected in sets of at most a template's words.
    lines = hits.groupBy(*name, "diagonal").agg(*[F.first(c).alias(c) for c in about], F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("place").alias("places"))
    ordered = Window.partitionBy(*name).orderBy("diagonal")
    apart = F.coalesce((F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(ordered) > gap)).cast("int"), F.lit(0))
    begin, end = F.col("diagonal") + F.col("low"), F.col("diagonal") + F.col("high") + F.col("size")
    grouped = lines.withColumn("apart", apart).withColumn("group", F.sum("apart").over(ordered)).withColumn("line", F.struct(covered(F.col("places")).alias("words"), (-begin).alias("back"), end.alias("end")))
    # The fullest single diagonal of a group counts by itself: a chain of repeats may be too long for a span.
    merged = grouped.groupBy(*name, "group").agg(
        *[F.first(c).alias(c) for c in about], F.min(begin).alias("first"), F.max(end).alias("end"), F.flatten(F.collect_set("places")).alias("places"), F.max("line").alias("single")
    )
    fits = F.col("end") - F.col("first") <= 2 * F.col("length")
    words = F.when(fits, covered(F.array_distinct("places"))).otherwise(F.col("single.words"))
    scored = merged.select(*name, "doc_id", "n_words", "label", "phrase", F.when(fits, F.col("first")).otherwise(-F.col("single.back")).alias("first"), F.when(fits, F.col("end")).otherwise(F.col("single.end")).alias("end"), (words / F.col("length")).alias("coverage"))
    return scored.withColumn("verified", (F.col("template") >= 0) & (F.col("coverage") >= F.when(F.col("phrase"), 1.0).otherwise(least)))


def license_spans(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, gap: int = 3, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, label, phrase, first, end, coverage of every verified span; words are counted from 0, end is behind the last. See scan_licenses."""
    spans = _spans(_hits(docs, template_grams(docs.sparkSession, phrases, notices), doc_id, text), gap, least)
    return spans.where("verified").select("doc_id", "label", "phrase", "first", "end", "coverage")


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, gap: int = 3, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    n_base: places of phrases; first_word, last_word: the least and greatest of
    these; labels: those of phrases and of notices of which hits on diagonals
    at most gap apart cover least of the words; score: the greatest share of
    the words of a phrase or notice that a text covers in one place.

    A null text is empty. A text without any place has empty labels, no first
    and last word and, without a hit, score 0. Rows that repeat an id stand
    each. Empty table: no rows. Other columns are not read. A text's hits meet
    in one task, at most a few times its own words.
    """
    spans = _spans(_hits(docs, template_grams(docs.sparkSession, phrases, notices), doc_id, text), gap, least)
    base = F.col("verified") & F.col("phrase")
    listed = lambda own: F.array_join(F.array_sort(F.collect_set(F.when(own, F.col("label")))), ",")
    return spans.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("verified")).alias("labels"), F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).drop("uid")
