"""Pages of a feed that goes round: each page leaves out all before it, and after the last the first comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(cards: DataFrame, order: list) -> DataFrame:
    """``cards`` (user_id, ...) with ``place`` from 1 in ``order`` and ``n``, the number of the user's cards."""
    own = Window.partitionBy("user_id")
    return cards.withColumns({"place": F.row_number().over(own.orderBy(*order)).cast("bigint"), "n": F.count(F.lit(1)).over(own)})


def rotated(cards: DataFrame, pages: DataFrame, size: int) -> DataFrame:
    """The cards of each user's page (user_id, page from 1), with ``rotation`` (rounds gone by) and ``nth`` on the page.

    ``cards``: what ``ranked`` gives. Leaving out all earlier pages is going on in the ranking, and clearing what was left
    out once nothing is left is starting anew: page k begins at place (k - 1) * size of the round, whose pages are
    ceil(n / size). No page is made to get the next. Users without cards have no page; a page number below 1 neither.
    """
    rounds = F.ceil(F.col("n") / size)
    both = cards.join(pages.where("page >= 1").select("user_id", "page"), "user_id").withColumn("_at", F.col("page") - 1)
    first = (F.col("_at") % rounds) * size
    on_page = (F.col("place") > first) & (F.col("place") <= first + size)
    return both.where(on_page).withColumns({"rotation": F.floor(F.col("_at") / rounds), "nth": F.col("place") - first}).drop("_at")
