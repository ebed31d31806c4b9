"""Copies of catalogue books in readers' libraries: chunks and cards that are there already are not made again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.numbering import running_sums


def new_wishes(wishes: DataFrame, owned: DataFrame) -> DataFrame:
    """The wishes (user_id, book_id, document_id, …) for books a reader does not own; of repeated ones that of the least document_id."""
    first = Window.partitionBy("user_id", "book_id").orderBy("document_id")
    asked = wishes.join(owned.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
    return asked.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def copied_chunks(wishes: DataFrame, chunks: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """(document_id, user_id, catalog_chunk_id, chunk_index) of the copies that each wish gets.

    ``wishes``: user_id, document_id, book_id, chunk_interval. ``chunks``: book_id, chunk_id, chunk_index,
    chunk_type; every ``chunk_interval``-th of a book's texts and code is copied. ``there`` (document_id,
    chunk_index) are chunks that a document has: copies are numbered after the last of them, else from 0.
    Contents stay where they are and are joined by ``catalog_chunk_id`` when they are stored.
    """
    listed = chunks.where(F.col("chunk_type").isin("text", "code")).select("book_id", F.col("chunk_id").alias("catalog_chunk_id"), "chunk_index")
    placed = running_sums(listed, ["book_id"], "chunk_index", nth=F.lit(1)).select("book_id", "catalog_chunk_id", (F.col("nth") - 1).alias("_i"))
    every = F.greatest(F.col("chunk_interval"), F.lit(1))
    asked = wishes.select("user_id", "document_id", "book_id", every.alias("_every"))
    if there is None:
        asked = asked.withColumn("_last", F.lit(-1))
    else:
        last = there.groupBy("document_id").agg(F.max("chunk_index").alias("_last"))
        asked = asked.join(last, "document_id", "left").withColumn("_last", F.coalesce("_last", F.lit(-1)))
    rows = asked.join(placed, "book_id").where("_i % _every = 0")
    return rows.select("document_id", "user_id", "catalog_chunk_id", F.expr("CAST(_last + 1 + _i div _every AS BIGINT)").alias("chunk_index"))


def copied_cards(wishes: DataFrame, copies: DataFrame, cards: DataFrame) -> DataFrame:
    """The catalogue's cards (chunk_id, card_type, …) on the copies, of the types wished for (``card_types`` of a wish)."""
    types = wishes.select("document_id", F.explode(F.array_distinct("card_types")).alias("card_type"))
    return copies.join(cards.withColumnRenamed("chunk_id", "catalog_chunk_id"), "catalog_chunk_id").join(types, ["document_id", "card_type"], "left_semi")


def copy_status(wishes: DataFrame, copies: DataFrame, cards: DataFrame) -> DataFrame:
    """(document_id, chunk_count, card_count, status): ``ready`` where each copied chunk could have a card of each type, else ``generating``."""
    counted = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    rows = wishes.select("document_id", F.size("card_types").alias("_types")).join(counted(copies, "chunk_count"), "document_id", "left").join(counted(cards, "card_count"), "document_id", "left")
    rows = rows.fillna(0, ["chunk_count", "card_count"])
    status = F.when(F.col("card_count") >= F.col("chunk_count") * F.col("_types"), "ready").otherwise("generating")
    return rows.select("document_id", "chunk_count", "card_count", status.alias("status"))
