"""License scans by diagonal voting, in DataFrame operations alone.

Every pair of neighbouring words of every text is hashed and joined to the positions of such pairs in the templates.
A hit at word p of a text and pair q of a template votes for the diagonal p - q; votes are gathered as bits per
(text, template, diagonal), 63 pairs to a number and so many numbers as a template needs, and diagonals at most MERGE
apart are merged. A merged span is verified: by its share of the template's pairs, by that of its best diagonal, and by
the words of the text that it takes up, which the template must be SHARE of at least (so diagonals can't drift far).
Base phrases count where one diagonal has all of the phrase's pairs: their words stand consecutively there. The words
themselves are compared beside their hash, so every vote is of equal words and hashes that clash give none.

Templates are a parameter of ``scan``; their pairs are sent to all tasks if there are at most SENT_PAIRS of them, and
joined by shuffle beyond. Hits never meet across texts.

Defined cases: null texts are empty and have no words; rows that repeat id and text get the same result each; null ids
are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, table

#: Base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that the method adds, by label.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "copyright all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
#: Pairs of all templates that are sent to all tasks at most (some 10 MB).
SENT_PAIRS = 100_000
SHARE, BEST_SHARE, MERGE = 0.75, 0.5, 2
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_WIDTH = 63  # pairs in one number of votes


def template_pairs(notices=NOTICES) -> list[tuple[int, str, bool, int, str, str, int]]:
    """(template, label, is a base phrase, pair number, first word, second word, number of pairs). notices: (label,
    words in lower case with single spaces), of two words at least."""
    out = []
    for i, (label, text, base) in enumerate([*((v, k, True) for k, v in BASE.items()), *((k, v, False) for k, v in notices)]):
        words = text.split()
        out += [(i, label, base, q, a, b, len(words) - 1) for q, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def _values() -> str:
    """The templates' pairs as rows of SQL; they are words and numbers only."""
    return ", ".join(str(row).replace("True", "true").replace("False", "false") for row in template_pairs())


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row a row of docs."""
    spark = docs.sparkSession
    found = template_pairs(notices)
    if notices is NOTICES:
        pairs = spark.sql(f"SELECT * FROM VALUES {_values()} AS t(tpl, label, base, q, a, b, n)")
    else:
        pairs = spark.createDataFrame(found, "tpl int, label string, base boolean, q int, a string, b string, n int")
    pairs = pairs.withColumn("h", F.xxhash64("a", "b"))
    pairs = F.broadcast(pairs) if len(found) <= SENT_PAIRS else pairs
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.split(F.translate(text, _UPPER, _LOWER), _BREAK).alias("w"))
    lead = (F.col("w")[0] == "").cast("int")
    tail = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    counted = rows.select("doc_id", "key", (F.size("w") - lead - tail).cast("long").alias("n_words"))
    each = rows.select("doc_id", "key", "w", F.posexplode("w").alias("p", "x"))
    each = each.select("doc_id", "key", (F.col("p") - lead).alias("p"), "x", F.get("w", F.col("p") + 1).alias("y"))
    each = each.select("*", F.xxhash64("x", "y").alias("h"))
    hits = each.join(pairs, (each.h == pairs.h) & (each.x == pairs.a) & (each.y == pairs.b))
    d, seg = (F.col("p") - F.col("q")).alias("d"), F.expr(f"q div {_WIDTH}").alias("seg")
    votes = hits.groupBy("doc_id", "key", "tpl", "label", "base", "n", d, seg).agg(F.bit_or(F.expr(f"shiftleft(1L, q % {_WIDTH})")).alias("bits"), F.min("p").alias("low"), F.max("p").alias("high"))
    by = Window.partitionBy("doc_id", "key", "tpl")
    order = by.orderBy("d", "seg")
    fresh = F.coalesce((F.col("d") - F.lag("d").over(order) > MERGE).cast("int"), F.lit(1))
    of_diagonal = F.sum(F.bit_count("bits")).over(Window.partitionBy("doc_id", "key", "tpl", "d"))
    island = votes.select("*", fresh.alias("fresh"), of_diagonal.alias("many")).select("*", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    whole = (F.col("many") == F.col("n")) & (F.col("seg") == 0)
    words = island.groupBy("doc_id", "key", "tpl", "label", "base", "n", "island", "seg").agg(
        F.bit_count(F.bit_or("bits")).alias("pairs"),
        F.max("many").alias("most"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.count(F.when(whole, 1)).alias("places"),
        F.min(F.when(whole, F.col("d"))).alias("first"),
        F.max(F.when(whole, F.col("d"))).alias("last"),
    )
    spans = words.groupBy("doc_id", "key", "tpl", "label", "base", "n", "island").agg(
        (F.sum("pairs") / F.col("n")).alias("share"),
        F.max("most").alias("most"),
        (F.max("high") - F.min("low") + 2).alias("taken"),
        F.sum("places").alias("places"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    verified = (F.col("share") >= SHARE) & (F.col("most") / F.col("n") >= BEST_SHARE) & (F.col("n") + 1 >= SHARE * F.col("taken"))
    spans = spans.where(F.when(F.col("base"), F.col("places") > 0).otherwise(verified))
    names = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    base = F.col("base")
    found = spans.groupBy("doc_id", "key").agg(
        F.sum(F.when(base, F.col("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("last"))).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.lit(True)).alias("labels"),
        F.max("share").alias("score"),
    )
    f = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = counted.join(f, counted.doc_id.eqNullSafe(f._id) & (counted.key == f._key), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = rf"""
WITH t(tpl, label, base, q, a, b, n) AS (VALUES {_values()}),
d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), p AS (
  SELECT row, unnest(range(len(w) - 1)) AS p, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM d
), v AS (
  SELECT row, t.tpl, label, base, n, p - q AS d, q // {_WIDTH} AS seg, bit_or(1::BIGINT << (q % {_WIDTH})) AS bits, min(p) AS low, max(p) AS high
  FROM p JOIN t ON p.a = t.a AND p.b = t.b GROUP BY ALL
), f AS (
  SELECT *, CASE WHEN d - lag(d) OVER w <= {MERGE} THEN 0 ELSE 1 END AS fresh, sum(bit_count(bits)) OVER (PARTITION BY row, tpl, d) AS many
  FROM v WINDOW w AS (PARTITION BY row, tpl ORDER BY d, seg)
), i AS (
  SELECT *, sum(fresh) OVER (PARTITION BY row, tpl ORDER BY d, seg ROWS UNBOUNDED PRECEDING) AS island, many = n AND seg = 0 AS whole FROM f
), m AS (
  SELECT row, tpl, label, base, n, island, seg, bit_count(bit_or(bits)) AS pairs, max(many) AS most, min(low) AS low, max(high) AS high,
    count(*) FILTER (whole) AS places, min(d) FILTER (whole) AS first, max(d) FILTER (whole) AS last
  FROM i GROUP BY row, tpl, label, base, n, island, seg
), s AS (
  SELECT row, tpl, label, base, n, sum(pairs) / n AS share, max(most) AS most, max(high) - min(low) + 2 AS taken, sum(places) AS places, min(first) AS first, max(last) AS last
  FROM m GROUP BY row, tpl, label, base, n, island
), g AS (
  SELECT row, CAST(coalesce(sum(places) FILTER (base), 0) AS BIGINT) AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM s WHERE CASE WHEN base THEN places > 0 ELSE share >= {SHARE} AND most / n >= {BEST_SHARE} AND n + 1 >= {SHARE} * taken END GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (row)
"""
