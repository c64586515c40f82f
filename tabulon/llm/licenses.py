"""License scan: exact phrases, and notices found by a set-similarity join.

Phrases are found in every whole text.  Notices are found by an exact
containment join between text blocks and license templates.  A template is
held where a run of consecutive words, at most a quarter longer than the
template (``run_words``), contains enough of its different words; line breaks
and line lengths do not matter.  Blocks of twice the longest run, one every
longest run, hold every run whole.  Tokens are put in one global order, rarest
first, by their frequency over the blocks of the corpus; a block meets a
template only where their prefixes share a token and the length and positional
filters allow enough common tokens; the survivors are verified run by run.
Only built-in column functions run.

Blocks are first reduced to the tokens that occur in any template: other
tokens cannot count towards a containment, so the join stays exact.

Defined results: a null text is an empty text; equal rows get equal results,
rows that share a ``doc_id`` but not the text are scanned by themselves; null
ids are allowed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licenses publish them.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.8
# Template tokens up to this number travel to every task; more are joined by shuffle.
BROADCAST_TOKENS = 100_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_tokens(text: str) -> list[str]:
    return sorted(set(template_words(text)))


def needed(n_tokens: int, containment: float) -> int:
    """Common tokens that reach the containment threshold."""
    return max(1, math.ceil(containment * n_tokens - 1e-9))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_columns(flat: Column, n_words: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """``flat``: the words, each with one space before and one after."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        found = F.contains(flat, F.lit(f" {phrase} "))
        pieces = F.split(flat, f"(?<= )(?={re.escape(phrase)} )", -1)
        counts.append(F.when(found, (F.size(pieces) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(found, _spaces(F.element_at(pieces, 1)) - 1))
        lasts.append(F.when(found, n_words - _spaces(F.element_at(pieces, -1))))
        labels.append(F.when(found, F.lit(label)))
    some = lambda f, cols: cols[0] if len(cols) == 1 else f(*cols)
    return {"n_base": reduce(lambda a, b: a + b, counts), "first_word": some(F.least, firsts),
            "last_word": some(F.greatest, lasts), "_tl_base": F.array_compact(F.array(*labels))}


def run_words(text: str, containment: float) -> int:
    """Words of the runs in which a template is looked for."""
    return math.ceil(len(template_words(text)) / containment - 1e-9)


def _words_of(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(text, SEPARATORS, " ")), " ")


def notice_hits(texts: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``texts``: columns _tl_doc, _tl_hash and _tl_lower (lower-cased text).
    One row per (document, block, template) with a run whose containment reaches the threshold."""
    spark = texts.sparkSession
    sets = [(label, template_tokens(text), run_words(text, containment)) for label, text in templates]
    vocabulary = sorted({t for _, ts, _ in sets for t in ts})
    least = min(needed(len(ts), containment) for _, ts, _ in sets)
    step = max(run for _, _, run in sets)
    words = F.array(*[F.lit(t) for t in vocabulary])

    # Texts without enough known tokens for any template hold none.
    cut = texts.select("_tl_doc", "_tl_hash", _words_of(F.col("_tl_lower")).alias("_tl_words")) \
        .where(F.size(F.array_intersect(words, "_tl_words")) >= least)
    starts = F.sequence(F.lit(0), F.size("_tl_words") - 1, F.lit(step))
    blocks = cut.select("_tl_doc", "_tl_hash", F.posexplode(F.transform(
        starts, lambda i: F.slice("_tl_words", i + 1, F.lit(2 * step)))).alias("_tl_block", "w"))
    known = blocks.select(F.explode(F.array_intersect(words, "w")).alias("token"))
    counted = known.groupBy("token").count()
    # Rarest first; tokens that never occur come before all others.
    order = counted.agg(F.transform(F.sort_array(F.collect_list(F.struct("count", "token"))), lambda x: x["token"]).alias("seen")) \
        .select(F.concat(F.array_except(words, F.col("seen")), F.col("seen")).alias("tokens")).scalar()

    blocks = blocks.withColumn("b", F.array_intersect(order, F.col("w"))).where(F.size("b") >= least)
    probes = blocks.select("_tl_doc", "_tl_hash", "_tl_block", "w", "b", F.posexplode(
        F.slice("b", F.lit(1), F.size("b") - least + 1)).alias("j", "token"))

    side = spark.createDataFrame([(i, label, ts, needed(len(ts), containment), run) for i, (label, ts, run) in enumerate(sets)],
                                 "template int, label string, raw array<string>, alpha int, run int")
    index = side.select("template", "label", "alpha", "run", F.array_intersect(order, F.col("raw")).alias("t")).select(
        "template", "label", "alpha", "run", "t", F.posexplode(F.slice("t", F.lit(1), F.size("t") - F.col("alpha") + 1)).alias("i", "token"))
    if sum(len(ts) for _, ts, _ in sets) <= BROADCAST_TOKENS:
        index = F.broadcast(index)

    size_b, size_t = F.size("b"), F.size("t")
    met = probes.join(index, "token").where(
        (size_b >= F.col("alpha")) & (F.col("j") <= size_b - F.col("alpha"))                      # length, block's own prefix
        & (F.least(size_t - F.col("i"), size_b - F.col("j")) >= F.col("alpha"))                   # position
        # The first common token only: one candidate for each block and template.
        & (F.size(F.array_intersect(F.slice("b", F.lit(1), F.col("j")), F.slice("t", F.lit(1), F.col("i")))) == 0)
        & (F.size(F.array_intersect("b", "t")) >= F.col("alpha")))
    # Verification: the most template tokens in a run of the block's words; runs begin with a token of the template.
    begins = F.filter(F.sequence(F.lit(1), F.size("w")), lambda k: F.array_contains("t", F.get("w", k - 1)))
    common = F.array_max(F.transform(begins, lambda k: F.size(F.array_intersect(F.slice("w", k, F.col("run")), F.col("t")))))
    return met.select("_tl_doc", "_tl_hash", "_tl_block", "template", "label", size_t.alias("n"), "alpha", common.alias("common")) \
        .where(F.col("common") >= F.col("alpha")).withColumn("containment", F.col("common") / F.col("n")).drop("common", "alpha", "n")


def license_report(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES,
                   containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: phrase places and labels, and the labels with those of the notices."""
    text = text_or_empty()
    keyed = docs.select(F.col("doc_id").alias("_tl_doc"), F.xxhash64(text).alias("_tl_hash"),
                        lower_ascii(text).alias("_tl_lower"))
    hits = notice_hits(keyed, templates, containment).groupBy("_tl_doc", "_tl_hash").agg(
        F.collect_set("label").alias("_tl_found"), F.max("containment").alias("_tl_best"))

    flat = keyed.withColumn("_tl_core", F.btrim(F.regexp_replace("_tl_lower", SEPARATORS, " "))) \
        .withColumn("_tl_flat", F.concat(F.lit(" "), F.col("_tl_core"), F.lit(" "))) \
        .withColumn("n_words", F.when(F.col("_tl_core") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("_tl_core")) + 1))
    base = flat.select("_tl_doc", "_tl_hash", "n_words",
                       *[c.alias(n) for n, c in phrase_columns(F.col("_tl_flat"), F.col("n_words"), phrases).items()])
    b, h = base.alias("b"), hits.alias("h")
    rows = b.join(h, F.col("b._tl_doc").eqNullSafe(F.col("h._tl_doc")) & (F.col("b._tl_hash") == F.col("h._tl_hash")), "left")
    found = F.coalesce(F.col("h._tl_found"), F.array().cast("array<string>"))
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select(
        F.col("b._tl_doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        listed(F.col("_tl_base")).alias("base_labels"), listed(F.concat(F.col("_tl_base"), found)).alias("labels"),
        F.greatest(F.coalesce("h._tl_best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))
