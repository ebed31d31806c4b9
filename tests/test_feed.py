"""The feed over odd tables, the states of cards from one shuffle, and how often a feed's cards are moved."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import events as ev
from lectern.plans.catalog import ORACLE_SQL, QUERIES
from lectern.plans.views import MANY, WholeViews
from lectern.sources import collected

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events without a user or a card, a user with a third of them, none of some cards' chunks, and repeated reviews."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    events = f"""SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 7 WHEN event_id % 50 = 1 THEN NULL ELSE user_id END AS user_id, event_type, value, CASE WHEN event_id % 40 = 2 THEN NULL ELSE props END AS props FROM '{SF}/events.parquet'
        UNION ALL SELECT event_id + 1000000, ts + INTERVAL 1 MINUTE, user_id, CASE WHEN event_id % 2 = 0 THEN 'purchase' ELSE 'view' END, value, props FROM '{SF}/events.parquet' WHERE event_id % 5 = 0"""
    con.execute(f"COPY ({events}) TO '{folder}/events.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SF}/documents.parquet' WHERE doc_id % 7 <> 3) TO '{folder}/documents.parquet'")
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["feed_page", "feed_response"])
def test_feed_over_odd_tables(spark, odd, name):
    folder, con = odd
    text = lambda rows: sorted(tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in rows)
    got = QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert text(got.collect()) == text(want) and len(want) > 10


def test_card_states_are_counters_reviews_and_actions(spark, odd):
    v = WholeViews(spark, odd[0], MANY)
    got = ev.card_states(v.cards(), v.impressions(), v.actions(), 3).where("user_id IS NOT NULL AND card_id IS NOT NULL")
    acted = v.card_actions().groupBy("user_id", "card_id").agg(F.array_sort(F.collect_list("action")).alias("actions"))
    want = v.cards().join(v.scores(), ["user_id", "card_id"], "full").join(acted, ["user_id", "card_id"], "full").fillna({"sr_repetition": 0, "times_shown": 0, "times_engaged": 0, "times_skipped": 0}).where("user_id IS NOT NULL AND card_id IS NOT NULL")
    want = want.withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))
    own = ["user_id", "card_id", "chunk_id", "card_type", "times_shown", "times_engaged", "times_skipped", "last_shown_at", "sr_repetition", "sr_due_at", "actions"]
    found, wanted = (sorted(map(str, df.select(*own).collect())) for df in (got, want))
    assert found == wanted and any("sr_repetition=2" in r for r in found) and any("dismiss" in r for r in found)


def test_cards_of_a_feed_are_moved_twice(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        with collected() as written:
            page = QUERIES["feed_page"](spark, SF)
        plan = page._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any(name in path for path in written for name in ("cards", "candidates", "pool", "pairs", "scores"))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(user_id" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in dealt) == 2 and len(dealt) <= 6, plan
