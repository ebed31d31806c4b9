"""Who may see which rows, and sets of pages and chapters that readers choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_through_parent(rows: DataFrame, parents: DataFrame, readers: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``reader``: those whose parent (key, user_id, public) belongs to a reader (user_id), for that reader, and
    those whose parent is public and no reader's own, for anyone (null). Rows without a parent are seen by no one."""
    owned = parents.join(readers.select("user_id", F.lit(True).alias("_reads")), "user_id", "left")
    seen = owned.where(F.col("_reads").isNotNull() | F.col("public")).select(key, F.when(F.col("_reads").isNotNull(), F.col("user_id")).alias("reader"))
    return rows.join(seen, key)


def toggled(chosen: Column, clicked: Column) -> Column:
    """The members of one set but not the other; nulls are no members."""
    both = [F.array_compact(x) for x in (chosen, clicked)]
    return F.array_union(F.array_except(*both), F.array_except(*reversed(both)))


def on_new_pages(cards: DataFrame, loaded: DataFrame) -> DataFrame:
    """(user_id, page) of cards (user_id, page) that are not among the loaded pages, each once."""
    return cards.select("user_id", "page").distinct().join(loaded.select("user_id", "page"), ["user_id", "page"], "left_anti")
