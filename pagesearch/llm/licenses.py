"""License scan: exact containment join of text blocks with license templates.

A text is cut into overlapping blocks of words. Tokens are put in one global order, rarest in the corpus
first. A block holds at least the share ``threshold`` of a template's distinct tokens only if they share
one of the template's rarest tokens (prefix filter), the block has tokens enough (length filter), and
enough tokens follow on both sides (positional filter). The pairs left are verified, so nothing is missed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesearch.llm.common import ascii_lower, let, texts, words_of
from pagesearch.session import materialize

# Words, and the phrases whose places are counted
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# The phrases that the query's own labels are found by; the places of its base are those of PHRASES alone
NOTICES = {**PHRASES, "mit": "mit license"}

# Label and text of the templates: usual notices, as their licenses word them
TEMPLATES = [
    ("agpl-3", "GNU Affero General Public License version 3"),
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"
            " provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee"
            " is hereby granted"),
    ("lgpl-3", "GNU Lesser General Public License version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
PERCENT = 90        # of a template's distinct tokens that a block must hold
BLOCK, STEP = 64, 32


def template_table(spark, templates=None) -> DataFrame:
    """``template, label, tokens``: the distinct tokens of each template."""
    rows = [(i, label, text) for i, (label, text) in enumerate(TEMPLATES if templates is None else templates)]
    named = spark.createDataFrame(rows, "template int, label string, text string")
    return named.select("template", "label", F.array_distinct(words_of(ascii_lower(F.col("text")), TOKEN)).alias("tokens"))


def blocks_of(words: Column) -> Column:
    """Blocks of BLOCK words, one every STEP words: any STEP words in a row stand together in one of them."""
    count = F.greatest(F.ceil((F.size(words) - (BLOCK - STEP)) / STEP), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.struct(
        b.alias("block"), F.array_distinct(F.slice(words, b * STEP + 1, BLOCK)).alias("tokens")))


def containment_join(blocks: DataFrame, templates: DataFrame, frequencies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``block_id, template, label, share`` of every block that holds ``percent`` of a template's tokens.

    ``blocks(block_id, tokens)`` and ``templates(template, label, tokens)`` hold distinct tokens;
    ``frequencies(token, docs)`` gives the global order. Templates without tokens match nothing.
    """
    rarest = F.row_number().over(Window.orderBy(F.coalesce("docs", F.lit(0)), "token"))  # one row per template token
    ranks = (templates.select(F.explode("tokens").alias("token")).distinct().join(frequencies, "token", "left")
             .select("token", rarest.alias("rank")))
    ordered = (templates.select("template", "label", F.explode("tokens").alias("token")).join(ranks, "token")
               .groupBy("template", "label").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
               .withColumn("size", F.size("ranks"))
               .withColumn("need", F.ceil(F.col("size") * percent / 100).cast("int")))
    prefixes = materialize(ordered.select("template", "label", "ranks", "size", "need",
                                          F.posexplode(F.slice("ranks", F.lit(1), F.col("size") - F.col("need") + 1))
                                          .alias("t_place", "rank")), "prefixes")
    known = (blocks.select("block_id", F.explode("tokens").alias("token")).join(ranks, "token")
             .groupBy("block_id").agg(F.sort_array(F.collect_list("rank")).alias("b_ranks")))
    probes = known.select("block_id", "b_ranks", F.posexplode("b_ranks").alias("b_place", "rank"))
    remaining = F.least(F.col("size") - F.col("t_place"), F.size("b_ranks") - F.col("b_place"))
    pairs = (probes.join(prefixes, "rank")
             .where((F.size("b_ranks") >= F.col("need")) & (remaining >= F.col("need"))))
    common = F.size(F.array_intersect("b_ranks", "ranks"))
    return (pairs.withColumn("common", common).where("common >= need")
            .groupBy("block_id", "template", "label").agg(F.max(F.col("common") / F.col("size")).alias("share")))


def _phrase_starts(words: Column, phrase: str) -> Column:
    wanted = phrase.split()
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def stands(i: Column) -> Column:
        place = F.lit(True)
        for k, word in enumerate(wanted):
            place = place & (F.get(words, i + k) == word)
        return place

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(wanted)), stands)
    return F.when(joined.contains(f" {phrase} "), places).otherwise(F.array().cast("array<int>"))


def _starts(words: Column, phrases: Mapping[str, str]) -> Column:
    """``n, first, last`` of all places where one of the phrases starts."""
    places = F.concat(*[_phrase_starts(words, phrase) for phrase in phrases.values()])
    return let(places, lambda s: F.struct(F.size(s).cast("long").alias("n"), F.array_min(s).cast("long").alias("first"),
                                          F.array_max(s).cast("long").alias("last")))


def _labels_of(words: Column, phrases: Mapping[str, str]) -> Column:
    """The labels of the phrases that stand in the words."""
    found = F.array(*[F.when(F.size(_phrase_starts(words, phrase)) > 0, F.lit(label)) for label, phrase in phrases.items()])
    return F.filter(found, lambda x: x.isNotNull())


def scan(docs: DataFrame, templates: DataFrame | None = None, percent: int = PERCENT,
         notices: Mapping[str, str] = PHRASES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``; see ``op1_license_scan`` for the columns.

    A null or empty text has no words and no labels; repeated rows each get theirs; an empty table gives
    no rows; other columns are ignored. The phrases of ``notices`` add their labels, and ``n_notices``, ``first_notice`` and
    ``last_notice`` say where they stand. The score is 1 where a phrase stands, else the greatest share of a
    template that a block holds, 0 below the threshold.
    """
    spark = docs.sparkSession
    templates = materialize(template_table(spark) if templates is None else templates, "templates")
    read = texts(docs).select("doc_id", words_of(ascii_lower(F.col("text")), TOKEN).alias("words"))
    # the templates are a parameter, so their tokens are few; the corpus stays where it is
    vocabulary = [r.token for r in templates.select(F.explode("tokens").alias("token")).distinct().collect()]
    known = F.array(*[F.lit(token) for token in sorted(vocabulary)]).cast("array<string>")
    # how many documents hold each template token; map-side sums leave one row per token and task
    seen = (read.select(F.explode(F.array_intersect("words", known)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("docs")))
    frequencies = materialize(seen, "token-documents")
    # a block can only match when it holds a prefix token of some template
    needs = F.size("tokens") - F.ceil(F.size("tokens") * percent / 100).cast("int") + 1
    ranked = (templates.select("template", needs.alias("prefix"), F.explode("tokens").alias("token"))
              .join(frequencies, "token", "left")
              .withColumn("place", F.row_number().over(Window.partitionBy("template").orderBy(F.coalesce("docs", F.lit(0)), "token"))))
    tokens = [r.token for r in ranked.where("place <= prefix").select("token").distinct().collect()]
    rare = F.array(*[F.lit(token) for token in sorted(tokens)]).cast("array<string>")
    candidates = F.when(F.arrays_overlap("words", rare), F.filter(
        blocks_of(F.col("words")), lambda b: F.arrays_overlap(b["tokens"], rare))).otherwise(F.array())
    rows = materialize(read.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.size("words").cast("long").alias("n_words"),
        _starts(F.col("words"), PHRASES).alias("base"), _labels_of(F.col("words"), PHRASES).alias("base_labels"),
        _starts(F.col("words"), notices).alias("notices"), _labels_of(F.col("words"), notices).alias("notice_labels"),
        candidates.alias("blocks")), "license-rows")
    exploded = rows.select("row_id", F.explode("blocks").alias("b")).select(
        F.struct("row_id", F.col("b.block").alias("block")).alias("block_id"), F.col("b.tokens").alias("tokens"))
    matched = (containment_join(exploded, templates, frequencies, percent).groupBy(F.col("block_id.row_id").alias("row_id"))
               .agg(F.collect_set("label").alias("found"), F.max("share").alias("share")))
    labels = F.array_sort(F.array_union(F.array_union("base_labels", "notice_labels"), F.coalesce("found", F.array().cast("array<string>"))))
    return rows.join(matched, "row_id", "left").select(
        "doc_id", "n_words", F.col("base.n").alias("n_base"), F.col("base.first").alias("first_word"),
        F.col("base.last").alias("last_word"), F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when((F.size("base_labels") > 0) | (F.size("notice_labels") > 0), 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.col("notices.n").alias("n_notices"), F.col("notices.first").alias("first_notice"), F.col("notices.last").alias("last_notice"))


def op1_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs, notices=NOTICES)


def _sql() -> str:
    quoted = ", ".join("('" + label + "', '" + text.lower().replace("'", "''") + "')" for label, text in TEMPLATES)
    places, notices = (" UNION ALL ".join(
        f"""(SELECT rid, '{label}' AS label, i - 1 AS start FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM t)
     WHERE {" AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))})"""
        for label, phrase in phrases.items()) for phrases in (PHRASES, NOTICES))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS ({places}),
b AS (SELECT rid, count(*) AS n, min(start) AS first, max(start) AS last, list_sort(list(DISTINCT label)) AS base FROM p GROUP BY rid),
o AS ({notices}),
a AS (SELECT rid, count(*) AS n_notices, min(start) AS first_notice, max(start) AS last_notice, list(DISTINCT label) AS noticed FROM o GROUP BY rid),
l AS (SELECT label, list_distinct(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS tokens
      FROM (VALUES {quoted}) v(label, text)),
k AS (SELECT rid, w[s:s + {BLOCK - 1}] AS block FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {STEP}, 1) + 1, {STEP})) AS s FROM t)),
m AS (SELECT rid, label, len(list_intersect(tokens, block)) / len(tokens) AS share, len(list_intersect(tokens, block)) AS c, len(tokens) AS n FROM k, l),
f AS (SELECT rid, list(DISTINCT label) AS found, max(share) AS share FROM m WHERE 100 * c >= {PERCENT} * n GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(list_concat(base, noticed), found))), ','), '') AS labels,
       CASE WHEN n > 0 OR n_notices > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score,
       coalesce(n_notices, 0)::BIGINT AS n_notices, first_notice::BIGINT AS first_notice, last_notice::BIGINT AS last_notice
FROM t LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN f USING (rid)
"""


SQL = _sql()
