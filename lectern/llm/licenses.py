"""License scans by diagonal voting, in DataFrame functions only.

Every pair of neighbouring words of every text is hashed and joined with the same pairs of the
templates. A match of text word i with template word j votes for the diagonal i - j. Votes are counted
by text, template and diagonal; diagonals next to each other (words put in or left out) are merged; a
merged span is verified by the share of the template that its distinct places cover and by its extent.

A base phrase stands where all its pairs vote for one diagonal. Pairs match on 96 bits of hash.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; overlapping
places of a phrase all count; a license named twice gives its label once; repeated rows and null keys
are scanned one by one; an empty table gives an empty result; further columns cannot clash, as only key
and text are read. No text is joined or shuffled: only matches are, and one row a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources import table

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the method, in lower case, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
#: Share of a template's pairs that a span must hold, and the diagonals that one step may be apart.
LEAST_COVERAGE, NEAR = 0.75, 2
_OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_grams(spark: SparkSession, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(template, label, is_base, n_pairs, j, h, h2): every pair of words of every template, and a row
    of template -1 that every text's marker meets."""
    rows = [(k, phrase, label, k < len(base)) for k, (phrase, label) in enumerate([*base.items(), *templates.items()])]
    named = ("template", "phrase", "label", "is_base")
    listed = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(named, row, strict=True))) for row in rows))
    phrases = spark.range(1).select(F.inline(listed))
    words = F.split("phrase", " ")
    pairs = phrases.select("template", "label", "is_base", (F.size(words) - 1).alias("n_pairs"), F.posexplode(_pairs(words)).alias("j", "pair"))
    marker = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("is_base"), F.lit(0).alias("n_pairs"), F.lit(0).alias("j"), F.lit(0).cast("bigint").alias("h"), F.lit(-1).alias("h2"))
    return pairs.select("template", "label", "is_base", "n_pairs", "j", "pair.h", "pair.h2").unionByName(marker)


def _pairs(words):
    """Two hashes of each word with its successor."""
    one = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("h2"))
    pair = lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1)).alias("h"), F.hash(w, F.get(words, i + 1)).alias("h2"))
    return F.when(F.size(words) > 1, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), pair)).otherwise(F.array_except(F.array(one), F.array(one)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE_PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Votes by text, template and diagonal; a row of template -1 stands for each text itself."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    words = F.filter(F.split(lower, _OTHER), lambda w: w != "")
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("words"))
    # One marker a text carries its number of words through the join, so the texts are read once.
    marker = F.array(F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(-1).alias("h2")))
    hashed = read.select("row", "key", F.size("words").alias("n_words"), F.concat(marker, _pairs(F.col("words"))).alias("pairs"))
    pairs = hashed.select("row", "key", "n_words", F.posexplode("pairs").alias("i", "pair")).select("row", "key", "n_words", (F.col("i") - 1).alias("i"), "pair.h", "pair.h2")
    # The templates are a fixed list of this module's or the caller's: a few hundred rows.
    met = pairs.join(F.broadcast(template_grams(docs.sparkSession, base, templates)), ["h", "h2"])
    # Dealt by text once: votes, spans and labels are all within a text.
    dealt = met.select("row", "key", "n_words", "template", "label", "is_base", "n_pairs", "i", "j", (F.col("i") - F.col("j")).alias("diagonal")).repartition("row")
    return dealt.groupBy("row", "key", "n_words", "template", "label", "is_base", "n_pairs", "diagonal").agg(F.collect_set("j").alias("places"), F.min("i").alias("low"), F.max("i").alias("high"))


def merged_spans(votes: DataFrame, least: float = LEAST_COVERAGE, near: int = NEAR) -> DataFrame:
    """The verified spans of ``votes``, and for each text its marker (template -1)."""
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    # A base phrase has no gaps: each of its diagonals is a span of its own.
    apart = F.col("is_base") | (F.col("template") < 0) | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own), F.lit(near + 1)) > near)
    numbered = votes.withColumn("island", F.sum(apart.cast("int")).over(own))
    spans = numbered.groupBy("row", "key", "n_words", "template", "label", "is_base", "n_pairs", "island").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("start"), (F.max("high") + 2).alias("end"), F.min("diagonal").alias("diagonal"))
    coverage = F.size("places") / F.greatest(F.col("n_pairs"), F.lit(1))
    whole = F.when(F.col("is_base"), coverage == 1).otherwise((coverage >= least) & (F.col("end") - F.col("start") <= 2 * (F.col("n_pairs") + 1)))
    return spans.withColumn("coverage", coverage).where(whole | (F.col("template") < 0))


def labelled(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a text: counts and places of base phrases, labels of both kinds, and the best coverage."""
    is_base, found = F.col("is_base"), F.col("template") >= 0
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.first("key").alias(key),
        F.first("n_words").cast("bigint").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal"))).cast("bigint").alias("first_word"),
        F.max(F.when(is_base, F.col("diagonal"))).cast("bigint").alias("last_word"),
        names(is_base).alias("base_labels"),
        names(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(merged_spans(scan(table(spark, folder, "documents"))))


def oracle() -> str:
    """The same result in DuckDB: word pairs met with template pairs, by diagonal."""
    rows = ", ".join(f"({k}, '{phrase}', '{label}', {k < len(BASE_PHRASES)})" for k, (phrase, label) in enumerate([*BASE_PHRASES.items(), *TEMPLATES.items()]))
    return f"""
WITH t(template, phrase, label, is_base) AS (VALUES {rows}),
tw AS (SELECT *, string_split(phrase, ' ') AS w FROM t),
tg AS (SELECT template, label, is_base, len(w) - 1 AS n_pairs, unnest(list_zip(range(0, len(w) - 1), w[1:-2], w[2:])) AS z FROM tw),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(list_zip(range(0, len(w) - 1), w[1:-2], w[2:])) AS z FROM d WHERE len(w) > 1),
m AS (SELECT p.r, tg.template, tg.label, tg.is_base, tg.n_pairs, p.z[1] AS i, tg.z[1] AS j, p.z[1] - tg.z[1] AS diagonal FROM p JOIN tg ON p.z[2] = tg.z[2] AND p.z[3] = tg.z[3]),
v AS (SELECT r, template, label, is_base, n_pairs, diagonal, list(DISTINCT j) AS places, min(i) AS low, max(i) AS high FROM m GROUP BY r, template, label, is_base, n_pairs, diagonal),
a AS (SELECT *, CASE WHEN is_base OR coalesce(diagonal - lag(diagonal) OVER o, {NEAR} + 1) > {NEAR} THEN 1 ELSE 0 END AS cut FROM v WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM a),
g AS (SELECT r, template, label, is_base, n_pairs, island, list_distinct(flatten(list(places))) AS places, min(low) AS b, max(high) + 2 AS e, min(diagonal) AS diagonal FROM i GROUP BY r, template, label, is_base, n_pairs, island),
s AS (SELECT *, len(places) / n_pairs AS coverage FROM g),
k AS (SELECT * FROM s WHERE CASE WHEN is_base THEN coverage = 1 ELSE coverage >= {LEAST_COVERAGE} AND e - b <= 2 * (n_pairs + 1) END)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE k.is_base) AS n_base,
       CAST(min(k.diagonal) FILTER (WHERE k.is_base) AS BIGINT) AS first_word, CAST(max(k.diagonal) FILTER (WHERE k.is_base) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT k.label) FILTER (WHERE k.is_base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT k.label) FILTER (WHERE k.label IS NOT NULL)), ','), '') AS labels,
       coalesce(max(k.coverage), 0.0) AS score
FROM d LEFT JOIN k USING (r) GROUP BY d.r, d.doc_id
"""
