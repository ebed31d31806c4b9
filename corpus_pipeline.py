"""A corpus pipeline of five stages: quality, language, near duplicates, repeated passages, packing.

Each stage takes the documents that its predecessor kept, as read from parquet; all but the last return the columns of
``documents``. ``run`` writes every stage to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard, langid, packing, quality, substrings
from lectern.llm.text import small_batches
from lectern.sources import collected, remove, stored, table


_scratch: list[str] = []


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's result is written before the next stage begins: what the former one left for it can go."""

    @small_batches
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _scratch:
            remove(spark, _scratch.pop())
        with collected() as paths:
            out = stage(spark, docs, sf_dir)
        _scratch.extend(paths)
        return out

    return run_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject; null and empty texts are among those."""
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not recognised; learned from the stage's own input."""
    return langid.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; documents of which nothing is left go.

    ``n_chars`` follows the text.
    """
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), True, 1)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", _tidy(quality_stage)),
    ("language", _tidy(language_stage)),
    ("near_duplicates", _tidy(near_duplicate_stage)),
    ("passages", _tidy(passage_stage)),
    ("packing", _tidy(packing_stage)),
]

#: Trees of suffixes, profiles and tokenizers are beyond SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
