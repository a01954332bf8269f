"""License scans by diagonal voting.

Every rolling word 3-gram of every text is hashed and joined to the positions of the same 3-gram in the templates. A
hit at word p of a text and word j of a template votes for diagonal p - j. Votes are added by (text, template,
diagonal); diagonals that lie within `GAP` words of the next are one span, so that inserted or missing words don't
tear it apart; a span counts if its hits cover enough of the template's words, each compared as text, not as hash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

K, GAP, COVERED = 3, 2, 0.7
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the contract (fixed values); they count only where all words stand consecutively.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Statements that the method looks for beside them; each may be met in part.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("reserved", "all rights reserved"),
]


def template_grams(spark: SparkSession, base: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """One row for each 3-gram position of each template, and a row without template that every text meets once.

    Its size is that of the templates, a constant of the caller; so it is broadcast.
    """
    rows = [("", -1, 0, 0, "", False)]
    for t, (label, text, exact) in enumerate([(v, k, True) for k, v in base.items()] + [(*x, False) for x in templates]):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text)
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(" ".join(w[j : j + K]), t, j, len(w), label, exact) for j in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "gram string, t int, j int, t_words int, label string, exact boolean").withColumn(
        "h", F.xxhash64("gram"))


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: list[tuple[str, str]] | None = None,
                 covered: float = COVERED, gap: int = GAP) -> DataFrame:
    """Places of the base phrases and license labels of every document.

    Null texts count as empty and give no labels ('' in both label columns, null places, score 0); repeated rows give a
    row each; an empty table gives an empty result; further columns of `docs` are ignored. Texts of any length are read
    whole. The score is the largest share of a template's words that one span covers, 1 where a base phrase stands.
    """
    grams_of = template_grams(docs.sparkSession, base, TEMPLATES if templates is None else templates)
    w = common.lower_words_text(F.col("text"))
    d = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.array_remove(F.split(w, WORD_GAP), "").alias("w"))
    gram = lambda i: F.concat_ws(" ", *[F.get("w", i + k) for k in range(K)])
    grams = F.when(F.size("w") >= K, F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0))), gram)).otherwise(
        F.array().cast("array<string>"))
    d = d.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.array_append(grams, F.lit("")).alias("grams"))
    each = d.select("rid", "doc_id", "n_words", F.posexplode("grams").alias("p", "text_gram")).withColumn(
        "text_h", F.xxhash64("text_gram"))
    hits = each.join(F.broadcast(grams_of), (F.col("text_h") == F.col("h")) & (F.col("text_gram") == F.col("gram")))
    # a diagonal of one template holds each of its grams once at most
    lines = hits.groupBy("rid", "doc_id", "n_words", "t", "t_words", "label", "exact", (F.col("p") - F.col("j")).alias("d")).agg(
        F.collect_set("j").alias("js"))
    by = W.partitionBy("rid", "t").orderBy("d")
    lines = lines.withColumn("new", (F.col("exact") | (F.col("d") - F.lag("d").over(by) > gap)).cast("int"))
    lines = lines.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(by))
    spans = lines.groupBy("rid", "doc_id", "n_words", "t", "t_words", "label", "exact", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.min("d").alias("d"))
    cover: Column = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.array(*[j + k for k in range(K)])))))
    spans = spans.withColumn("share", F.when(F.col("t") >= 0, cover / F.col("t_words")))
    whole = F.col("exact") & (F.col("share") == 1.0)
    found = ~F.col("exact") & (F.col("share") >= covered)
    label = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    place = F.when(whole, F.col("d").cast("long"))
    return spans.groupBy("rid", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        label(whole).alias("base_labels"), label(whole | found).alias("labels"),
        F.coalesce(F.max(F.when(whole | ~F.col("exact"), F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("rid")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.documents(spark, sf_dir))
