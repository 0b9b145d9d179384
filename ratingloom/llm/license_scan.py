"""License scan over a positional index of rare licence words.

A first pass counts in how many files each word of the templates stands; that is its rarity (inverse document frequency),
measured over the whole corpus. Each template is then looked up by the rarest word of its mandatory key phrase: no
alignment can count without that phrase, so none is missed, and words that every text has are never looked up. A second
pass makes postings of these words alone, (file, position, word) with the words around it. A posting and its word's place
in the template say where the template would begin; the alignment counts once the key phrase stands there word for word
and the words found at their places make up LEAST_COVER of the template, each weighed by its rarity. Three base phrases
are looked up at every place.

Only DataFrame functions are used. The frequencies of the templates' words, some hundred numbers, pass through the driver;
texts are never shuffled. The broadcast tables hold the templates and phrases.

Defined cases: a null or empty text has no words, labels '' and score 0; texts are read whole; each repeated row gets
its own result row, and copies of a file are scored alike; of words equally rare the one first in the alphabet is looked
up; several alignments of one template count as their best one; an empty table gives no rows; only the two named columns
are read, so further columns can have any names. Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases whose every place is reported, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, template words, mandatory key phrase inside them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "without warranties or conditions of any kind"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc", "licensed under cc by nc 4 0", "licensed under cc by"),
    ("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright and related"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("boost", "distributed under the boost software license", "boost software license"),
]

#: Share of a template's words, weighed by rarity, that an alignment must hit.
LEAST_COVER = 0.2


def words_of(text: Column) -> Column:
    """Words in order, A-Z in lower case; the separator's empty ends are gone."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def rarity(words: DataFrame, n_files: int) -> dict[str, float]:
    """Inverse document frequency of every word of the templates, over the files' `words`."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    seen = {r[0]: r[1] for r in words.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count().collect()}
    return {w: math.log(1 + n_files / (seen.get(w, 0) + 0.5)) for w in vocabulary()}


def template_rows(weight: dict[str, float]) -> list[tuple]:
    """For each template: its label, the word it is looked up by, that word's place, its words with their weights, the key phrase's place and words."""
    rows = []
    for label, text, key in TEMPLATES:
        words, key_words = text.split(), key.split()
        at = next(p for p in range(len(words)) if words[p : p + len(key_words)] == key_words)
        rare = min(key_words, key=lambda w: (-weight[w], w))
        rows.append((label, rare, at + key_words.index(rare), [(w, weight[w]) for w in words], at, key_words))
    return rows


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    body = F.col(text_column).cast("string")
    keyed = docs.select(F.col(id_column).alias("row_id"), F.xxhash64(F.col(id_column), body).alias("row_key"), words_of(body).alias("words"))
    templates = template_rows(rarity(keyed, docs.count()))

    # What phrases and templates are compared with travels with the posting: its neighbourhood, as long as any template reaches.
    looked_up = sorted({t[1] for t in templates} | {p.split()[0] for p in BASE_PHRASES})
    reach = max(len(text.split()) for _, text, _ in TEMPLATES)
    begin = F.greatest(F.col("pos") - reach, F.lit(0))
    postings = scratch.keep(
        keyed.select("row_key", "words", F.posexplode("words").alias("pos", "word")).filter(F.col("word").isin(looked_up))
        .select("row_key", F.col("pos").cast("long").alias("pos"), "word", begin.cast("long").alias("near_from"), F.slice("words", begin + 1, F.lit(2 * reach + 1)).alias("near")),
        "postings",
    )
    once = postings.dropDuplicates(["row_key", "pos"])  # repeated rows share a key

    # Base phrases, at every place.
    phrases = spark.createDataFrame([(p.split()[0], p.split(), label) for p, label in BASE_PHRASES.items()], "word string, phrase array<string>, label string")
    here = lambda start, size: F.slice("near", (start - F.col("near_from") + 1).cast("int"), size)
    base = once.join(F.broadcast(phrases), "word").filter(here(F.col("pos"), F.size("phrase")) == F.col("phrase"))
    base = base.groupBy("row_key").agg(F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), F.collect_set("label").alias("base_found"))

    # Templates, where their rarest key words say they begin.
    known = spark.createDataFrame(templates, "label string, word string, t_pos long, t_words array<struct<word:string,weight:double>>, key_at long, key array<string>")
    start = F.col("pos") - F.col("t_pos")
    key_start = start + F.col("key_at")
    verified = (key_start >= F.col("near_from")) & (here(F.greatest(key_start, F.col("near_from")), F.size("key")) == F.col("key"))
    zero = F.lit(0.0)
    found_at = F.transform("t_words", lambda w, p: F.when(F.get("near", (start + p - F.col("near_from")).cast("int")) == w["word"], w["weight"]).otherwise(zero))
    total = lambda weights: F.aggregate(weights, zero, lambda a, w: a + w)
    cover = total(found_at) / total(F.transform("t_words", lambda w: w["weight"]))
    aligned = once.join(F.broadcast(known), "word").filter(verified).select("row_key", "label", cover.alias("cover")).filter(F.col("cover") >= LEAST_COVER)
    found = aligned.groupBy("row_key").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))

    none = F.array().cast("array<string>")
    sizes = keyed.select("row_id", "row_key", F.size("words").cast("long").alias("n_words"))
    return (
        sizes.join(base.join(found, "row_key", "full"), "row_key", "left")
        .select(
            F.col("row_id").alias(id_column), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
            F.array_join(F.array_sort(F.coalesce("base_found", none)), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(F.coalesce("base_found", none), F.coalesce("found", none))), ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
        )
    )
