"""Cards over all documents."""

from pyspark.sql import functions as F

from lectern.plans.catalog import QUERIES
from lectern.plans.views import MANY, Views, WholeViews

SF = "/root/testdata/sf0.001"


def test_cards_reach_every_document(spark):
    v = WholeViews(spark, SF, MANY)
    placed = v.placed_cards()
    assert placed.select("chunk_id").distinct().count() == v.chunks().count() > Views(spark, SF, MANY).placed_cards().select("chunk_id").distinct().count()
    # Every event's card is one of its user's.
    assert v.feed_events().join(v.cards(), ["user_id", "card_id"], "left_anti").count() == 0
    assert placed.count() == v.cards().count() == v.cards().select("user_id", "card_id").distinct().count()


def test_goals_reject(spark):
    v = WholeViews(spark, SF)
    kept = QUERIES["casual_filter"](spark, SF)
    assert 0 < kept.count() < v.cards().count()
    books = v.books().count()
    assert QUERIES["chunks_with_cards"](spark, SF).count() == books
    assert QUERIES["reading_progress"](spark, SF).select("book_id").distinct().count() > books // 2
    assert 0 < QUERIES["collection_filter"](spark, SF).count() < v.cards().count()
    assert QUERIES["missing_card_types"](spark, SF).agg(F.count_distinct("chunk_id")).head()[0] > MANY // 5
