"""Queries over ingestion: documents' lines as elements, chunked and stored in two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ingest import Ingestion, ingest, line_elements
from lectern.plans.registry import query
from lectern.plans.texts import _SA, _SEGMENTS_SQL, _grouped_sql, _words, spaced
from lectern.sources import fresh_path, stored

_FIRST_RUN = 5
_INGEST_SQL = f"""
WITH RECURSIVE {_SEGMENTS_SQL},
e AS (SELECT doc_id, pos, content, chapter, word_count, len(regexp_extract_all(content, '[#*$%&|<>]')) >= 3 AS is_code, heading,
        CASE WHEN {_SA} THEN 'sa' ELSE 'en' END AS language FROM f),
kept AS (SELECT doc_id, pos, content, chapter, word_count, language FROM e JOIN (SELECT doc_id, content FROM s GROUP BY ALL) USING (doc_id, content) WHERE NOT is_code AND heading IS NULL),
{_grouped_sql('(SELECT * FROM kept WHERE word_count > 400)', 'doc_id, pos')},
made AS (
    SELECT doc_id, pos, 0 AS part, 'code' AS chunk_type, content, chapter, word_count, 'en' AS language FROM e WHERE is_code
    UNION ALL SELECT doc_id, pos, 0, 'text', content, chapter, word_count, language FROM kept WHERE word_count <= 400
    UNION ALL SELECT doc_id, pos, part, 'text', content, chapter, {_words('content')},
        CASE WHEN {_SA} THEN 'sa' ELSE 'en' END FROM long_parts)
"""


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents; those with three signs or more count as code."""
    return line_elements(spaced(spark, folder), F.regexp_count("content", F.lit(r"[#*$%&|<>]")) >= 3)


def _two_runs(spark: SparkSession, folder: str) -> Ingestion:
    """The first run stops after some elements of each document; the second does the rest."""
    elements, path = stored(_elements(spark, folder), "elements"), fresh_path(spark, "ingestion")  # both runs start from them, each several times
    Ingestion(spark, path).step(elements, 0, _FIRST_RUN)
    return ingest(elements, path)


@query(_INGEST_SQL + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS chunk_index, chunk_type, md5(content) AS content, chapter, word_count::BIGINT AS word_count, language FROM made
""")
def ingested_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all documents, stored in two runs, the second going on from the first one's marks."""
    return _two_runs(spark, folder).chunks().withColumn("content", F.md5("content"))


@query(_INGEST_SQL + """
SELECT doc_id, count(DISTINCT e.pos) AS done, count(DISTINCT e.pos) AS total, count(m.part) AS next_index, 'generating' AS status FROM e LEFT JOIN made m USING (doc_id, pos) GROUP BY doc_id
""")
def ingestion_marks(spark: SparkSession, folder: str) -> DataFrame:
    """How far each document has come after both runs."""
    work = _two_runs(spark, folder)
    return work.marks().join(work.statuses(), "doc_id")
