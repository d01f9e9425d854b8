"""License scans: license notices in texts, by exact phrases and by similarity to templates.

Method: exact set-similarity join. Tokens are ordered by their document frequency in the corpus, rarest first. A
block (any stretch of a template's ``block`` words, twice its own number and ``BLOCK`` at least) meets the template if it holds at least ``threshold`` of
the template's distinct words; then it holds one of the template's first |T| - ceil(threshold |T|) + 1 tokens,
so only those are joined. Where one stands, the words of all blocks that hold it go on; a length and a positional bound on them come before the exact
count, which slides a block over them.

Native: DataFrame functions only; a text's words are split once, exploded and probed in one fused stage, so the work is linear in its length. The templates, whole
licences and the notices that name them, are a constant of this package, so broadcasting their tokens has a fixed bound.

Defined cases: null and empty texts have no words, no labels, score 0; null first and last words where no phrase
stands; results are keyed by the text's digest, so repeated rows and ids do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import WORD_RE, cut, fold, fresh, own_words, raw_words, row_key, text_key
from kelpline.llm.license_texts import TEXTS

#: Phrases that count wherever their words stand together.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and grants that common licenses open with, as words.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Words of a block for short templates; longer ones have blocks of twice their own number.
BLOCK = 64


def _words(text: str) -> list[str]:
    return re.findall(WORD_RE, text.lower())


#: (label, number of words, distinct words) of each template.
TEMPLATES = [(label, len(_words(t)), sorted(set(_words(t)))) for label, t in (*NOTICES, *TEXTS)]


def block_of(words: int) -> int:
    return max(BLOCK, 2 * words)


def _templates(docs: DataFrame, threshold: float) -> DataFrame:
    """(label, template, tokens, need, block): the templates by number, tokens in global order."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, _, words in TEMPLATES for w in words})
    present = F.array_intersect(own_words(F.col("text")), F.lit(vocabulary))
    counts = docs.select(F.explode_outer(present).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rows = [(label, i, w, math.ceil(threshold * len(words)), block_of(n)) for i, (label, n, words) in enumerate(TEMPLATES) for w in words]
    table = spark.createDataFrame(rows, "label string, template int, word string, need int, block int")
    ordered = table.join(counts, "word", "left").groupBy("label", "template", "need", "block").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("o"))
    return ordered.select("label", "template", "need", "block", F.transform("o", lambda x: x["word"]).alias("tokens"))


def blocks_like_templates(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(key, label, containment): the templates that blocks of a text meet, by the text's digest."""
    templates = cut(_templates(docs, threshold), "license-templates")
    prefix = templates.select("template", "need", "block", F.size("tokens").alias("n"), F.posexplode("tokens").alias("rank", "word")).where(F.col("rank") <= F.col("n") - F.col("need"))
    texts = docs.select(text_key(F.col("text")).alias("key"), own_words(F.col("text")).alias("all"))
    words = texts.select("key", "all", F.posexplode_outer("all").alias("pos", "word"))
    first = F.greatest(F.lit(0), F.col("pos") - (F.col("block") - 1))
    near = F.slice("all", first + 1, F.col("pos") - first + F.col("block"))
    hit = words.join(F.broadcast(prefix), "word").select("key", "template", "rank", (F.col("pos") - first).alias("last"), near.alias("near"))
    hit = hit.where(F.size("near") > 0).distinct().join(F.broadcast(templates), "template").withColumn("part", F.array_distinct("near"))
    rest = F.slice("tokens", F.col("rank") + 1, F.size("tokens"))
    met = (
        hit.where(F.size("part") >= F.col("need"))  # length
        .where(F.size(F.array_intersect(rest, F.col("part"))) >= F.col("need") - F.col("rank"))  # position
        .where(F.size(F.array_intersect("tokens", "part")) >= F.col("need"))
        .select("key", "label", "tokens", "need", "block", "last", "near")
    )
    # written, so that the slide is planned on the few rows left
    met = cut(met, "license-places").withColumn(
        "shared", F.array_max(F.transform(F.sequence(F.lit(0), F.col("last")), lambda s: F.size(F.array_intersect("tokens", F.slice("near", s + 1, F.col("block"))))))
    )
    met = met.where(F.col("shared") >= F.col("need"))
    return met.select("key", "label", (F.col("shared") / F.size("tokens")).alias("containment")).distinct()


def _spaces(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame) -> DataFrame:
    """(key, n_base, first_word, last_word, base): the texts in which a base phrase stands."""
    own = own_words(F.col("text"))
    line = F.concat(F.lit(" "), F.array_join("own", " "), F.lit(" "))
    texts = docs.where(fold(F.col("text")).contains("license")).select("text", own.alias("own")).select("text", line.alias("line"))
    places = []
    for phrase, label in PHRASES.items():
        width = len(phrase.split())
        places.append(
            F.when(
                F.col("line").contains(f" {phrase} "),
                F.struct(
                    F.lit(label).alias("label"),
                    F.regexp_count("line", F.lit(f"(?<= ){phrase}(?= )")).cast("long").alias("n"),
                    (F.size(F.split(F.substring_index("line", f" {phrase} ", 1), " ")) - 1).cast("long").alias("first"),
                    (_spaces(F.col("line")) - 1 - width - _spaces(F.substring_index("line", f" {phrase} ", -1))).cast("long").alias("last"),
                ),
            )
        )
    found = texts.select(text_key(F.col("text")).alias("key"), F.array_compact(F.array(*places)).alias("p")).where(F.size("p") > 0)
    total = F.aggregate(F.transform("p", lambda x: x["n"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "key",
        total.alias("n_base"),
        F.array_min(F.transform("p", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("p", lambda x: x["last"])).alias("last_word"),
        F.transform("p", lambda x: x["label"]).alias("base"),
    ).distinct()


def scan_licenses(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    score: the largest containment among the blocks that meet a template, 1 where a base phrase stands, else 0.
    Result columns replace same-named ones.
    """
    k, v = fresh(docs, "key", "found")
    like = blocks_like_templates(docs, threshold).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = phrase_places(docs).join(like, "key", "full").select(F.col("key").alias(k), F.struct("n_base", "first_word", "last_word", "base", "more", "best").alias(v))
    none = F.expr("cast(array() as array<string>)")
    base, more = F.coalesce(F.col(v)["base"], none), F.coalesce(F.col(v)["more"], none)
    out = {
        "n_base": F.coalesce(F.col(v)["n_base"], F.lit(0)).cast("long"),
        "first_word": F.col(v)["first_word"],
        "last_word": F.col(v)["last_word"],
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
        "labels": F.array_join(F.array_sort(F.array_union(base, more)), ","),
        "score": F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.col(v)["best"], F.lit(0.0))),
    }
    counted = docs.withColumns({k: row_key(docs), "n_words": F.size(raw_words(F.col("text"))).cast("long")})
    return counted.join(cut(both, "license-texts"), k, "left").withColumns(out).drop(k, v)
