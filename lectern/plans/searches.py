"""Queries over a stored index of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.stems import stem_sql, stop_words_sql
from lectern.operators.text_index import TextIndex, write_index
from lectern.plans.registry import query
from lectern.sources import fresh_path, table

_WORDS_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, x, unnest(x) AS word, unnest(range(len(x))) AS place FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text || ' ' || coalesce(source, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS x FROM documents)),
stems AS MATERIALIZED (SELECT word, {stem_sql('word')} AS term FROM (SELECT DISTINCT word FROM w) WHERE word NOT IN {stop_words_sql()}),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS n FROM w JOIN stems USING (word) GROUP BY ALL)
"""


def _index(spark: SparkSession, folder: str) -> TextIndex:
    path = fresh_path(spark, "text-index")
    write_index(table(spark, folder, "documents"), path, "doc_id", ["text", "source"])
    return TextIndex(spark, path)


@query(_WORDS_SQL + "SELECT term, count(*) AS n_texts, sum(n)::BIGINT AS n_places FROM p GROUP BY ALL")
def text_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The stems of all documents, with the texts and places they occur in."""
    return _index(spark, folder).vocabulary()


@query(_WORDS_SQL + f"""
, q AS (SELECT DISTINCT item_id, CASE WHEN word IN (SELECT word FROM stems) THEN (SELECT term FROM stems s WHERE s.word = b.word) ELSE {stem_sql('word')} END AS prefix FROM (
    SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(array_to_string(string_split(text, ' ')[3:4], ' ')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS word FROM benchmark) b WHERE word NOT IN {stop_words_sql()}),
need AS (SELECT item_id, count(*) AS need FROM q GROUP BY ALL),
hits AS (SELECT item_id, doc_id, prefix, sum(n) AS n FROM q JOIN p ON starts_with(term, prefix) GROUP BY ALL),
sizes AS (SELECT doc_id, max(len(x)) AS words FROM w GROUP BY ALL)
SELECT item_id AS query_id, doc_id, round(sum(n) / max(words), 9) AS rank FROM hits JOIN need USING (item_id) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id, need HAVING count(*) = need
""")
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that two words of each benchmark item find, through the stored index."""
    words = F.array_join(F.slice(F.split("text", " "), 3, 2), " ")
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("query"))
    return _index(spark, folder).search(queries).select("query_id", F.col("key").alias("doc_id"), F.round("rank", 9).alias("rank"))
