"""Readers of the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; any file system that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_tasks(rows: DataFrame, each: int) -> int:
    """How many tasks to deal something to that grows with ``rows`` (a stored table, counted by its footers), so that a task has the part of ``each`` rows.

    Left to themselves, shuffles are cut by compressed bytes, and a task's memory by what these unfold to.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
