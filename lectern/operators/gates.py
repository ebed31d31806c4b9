"""Who may be shown what: mastery, prerequisites, cooldown, goals, collections, ownership.

Every gate is decided for all users at once: one aggregate by (user, chunk) or (user, card), then a
join, never a look-up for each card.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scores import cooled_down
from lectern.functions.values import MASTERED_ENGAGEMENTS, MASTERED_REPETITIONS, RECENT_EVENTS, REVIEW_TYPES


def is_review(column: str = "card_type"):
    return F.col(column).isin(*REVIEW_TYPES)


def chunk_mastery(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """(user_id, chunk_id, mastered) of every chunk with cards.

    With review cards a chunk is mastered once one of them is repeated often enough; without, once all
    its cards were engaged with often enough. A card without a chunk is in none.
    """
    rows = cards.where(F.col("chunk_id").isNotNull()).join(scores.select("user_id", "card_id", "sr_repetition", "times_engaged"), ["user_id", "card_id"], "left")
    flags = rows.groupBy("user_id", "chunk_id").agg(
        F.bool_or(is_review()).alias("has_review"),
        F.bool_or(is_review() & (F.coalesce("sr_repetition", F.lit(0)) >= MASTERED_REPETITIONS)).alias("review_done"),
        F.bool_and(F.coalesce("times_engaged", F.lit(0)) >= MASTERED_ENGAGEMENTS).alias("all_engaged"),
    )
    return flags.select("user_id", "chunk_id", F.when(F.col("has_review"), F.col("review_done")).otherwise(F.col("all_engaged")).alias("mastered"))


def not_mastered(cards: DataFrame, mastery: DataFrame) -> DataFrame:
    return cards.join(mastery.where("mastered").select("user_id", "chunk_id"), ["user_id", "chunk_id"], "left_anti")


def introduced_chunks(cards: DataFrame, events: DataFrame, actions: DataFrame) -> DataFrame:
    """(user_id, chunk_id) where a card that is no review card was looked at, or liked."""
    seen = events.where(F.col("event_type").isin("glanced", "engaged")).select("user_id", "card_id")
    liked = actions.where(F.col("action") == "like").select("user_id", "card_id")
    met = seen.unionByName(liked).distinct()
    return cards.where(~is_review() & F.col("chunk_id").isNotNull()).join(met, ["user_id", "card_id"], "left_semi").select("user_id", "chunk_id").distinct()


def prerequisites_met(cards: DataFrame, introduced: DataFrame) -> DataFrame:
    """Without the review cards of chunks that their reader has not been introduced to."""
    marked = cards.join(introduced.withColumn("_met", F.lit(True)), ["user_id", "chunk_id"], "left")
    return marked.where(~is_review() | F.col("_met")).drop("_met")


def rested(cards: DataFrame, scores: DataFrame, as_of) -> DataFrame:
    """Without the cards shown too lately; ones never scored, or due, stay."""
    own = scores.select("user_id", "card_id", "last_shown_at", "times_engaged", "times_skipped", "sr_due_at")
    joined = cards.join(own, ["user_id", "card_id"], "left")
    return joined.where(cooled_down(F.col("last_shown_at"), F.col("times_engaged"), F.col("times_skipped"), F.col("sr_due_at"), as_of)).select(*cards.columns)


def suits_goal(cards: DataFrame) -> DataFrame:
    """Without review cards of documents read casually; a missing goal is not casual."""
    return cards.where(~F.col("reading_goal").eqNullSafe("casual") | ~is_review())


def in_collections(cards: DataFrame, members: DataFrame, collections: DataFrame, names: list[str]) -> DataFrame:
    """The cards of documents in the named collections of their own user."""
    own = collections.where(F.col("name").isin(*names)).select("collection_id", "user_id")
    inside = members.join(own, "collection_id").select("user_id", "document_id").distinct()
    return cards.join(inside, ["user_id", "document_id"], "left_semi")


def recent_events(events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    """The last ``n`` events (not cards) of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def excluded_cards(events: DataFrame, actions: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """(user_id, card_id) not to be shown: lately seen, dismissed, or loaded by the client already."""
    lately = recent_events(events).where(F.col("card_id").isNotNull()).select("user_id", "card_id")
    out = lately.unionByName(actions.where(F.col("action") == "dismiss").select("user_id", "card_id"))
    if loaded is not None:
        out = out.unionByName(loaded.select("user_id", "card_id"))
    return out.distinct()


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def own_rows(rows: DataFrame, user_id) -> DataFrame:
    """The rows of one user; pushed down to the scan."""
    return rows.where(F.col("user_id") == user_id)
