"""Queries that place cards on documents run over cards of all documents.

The modules define them over ``Views``, where each user has a few cards by number; under the same names they are
registered here over ``WholeViews``, beside the same SQL over its tables, so that they meet every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import engagement, feed, library
from lectern.plans.registry import ORACLE_SQL, Query, query
from lectern.plans.views import FEW, MANY, StoredViews, WholeViews, views_sql, whole_views_sql


def _whole(base: Query, n_cards: int = FEW, views: type[WholeViews] = WholeViews) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return base(spark, folder, views=views)

    run.__name__, run.__doc__ = base.__name__, base.__doc__
    given = ORACLE_SQL[base.__name__]
    assert given.startswith(views_sql(n_cards))
    query(whole_views_sql() + given.removeprefix(views_sql(n_cards)))(run)


for _base in (engagement.casual_filter, engagement.sr_due, engagement.reading_progress, engagement.saved_cards, library.chunks_with_cards, library.library_counts):
    _whole(_base)
for _base in (engagement.collection_filter, engagement.missing_card_types):
    _whole(_base, MANY)
_whole(feed.feed_page, MANY, StoredViews)
