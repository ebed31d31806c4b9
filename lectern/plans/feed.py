"""The feed: what every user is shown next, for all users in one plan.

Candidates are cards of allowed types that pass the gates. Due reviews come first, each after a card
that introduces its chunk; the rest is drawn at random (by a digest, so that a run can be repeated),
scored and cut to the page; where nothing is left the gates on time are dropped; review cards drawn
without an introduction get one. Limits hold within each user, so every window is by user and none
gathers more than a user's cards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scores as sc
from lectern.functions.values import CARD_TYPE_ORDER, COMPANION_TYPES, FEED_LIMIT, INTRO_TYPES, MASTERED_ENGAGEMENTS, MASTERED_REPETITIONS, OTHER_TYPE_ORDER, OVER_FETCH
from lectern.operators import events as ev
from lectern.operators import gates
from lectern.operators.events import counters
from lectern.operators.search import featured
from lectern.plans.engagement import _COOLDOWN, _MASTERY, _PREREQUISITE, affinity
from lectern.plans.registry import query
from lectern.plans.views import MANY, Views, as_of, with_views
from lectern.sources import table
from lectern.sources.tables import n_tasks

KEYS = ["user_id", "card_id"]
EVENTS_A_TASK = 100_000


def _type_order(column: str = "card_type"):
    return F.coalesce(*(F.when(F.col(column) == t, k) for t, k in CARD_TYPE_ORDER.items()), F.lit(OTHER_TYPE_ORDER))


def offered(v: Views) -> DataFrame:
    """Cards with what decides about them: may (passes the gates), excluded, dismissed, due, rested, draw and score; and whether they introduce their chunk.

    What is known of a card meets in one shuffle, what is known of a user in a second one; gates and shares
    are windows within a chunk, a type or a user there. Left out are cards that do not pass and are not the
    oldest of their chunk's cards that may introduce it either.
    """
    tasks = n_tasks(table(v.spark, v.folder, "events"), EVENTS_A_TASK)
    states = ev.card_states(v.shelved_cards(), v.impressions(), v.actions(), tasks).where("user_id IS NOT NULL")
    recent = gates.recent_events(v.impressions().select(*KEYS, "created_at", "event_id")).groupBy("user_id").agg(F.collect_set("card_id").alias("recent"))
    rows = states.repartition(tasks, "user_id").join(recent, "user_id", "left")
    of_type, user, chunk = (Window.partitionBy("user_id", *more) for more in (["card_type"], [], ["chunk_id"]))
    liking = F.when(F.sum("times_shown").over(of_type) > 0, F.sum("times_engaged").over(of_type) / F.sum("times_shown").over(of_type))
    rows = rows.withColumn("affinity", liking).withColumn("seen", F.count(F.when(F.col("times_shown") > 0, True)).over(user)).where("book_id IS NOT NULL AND seen > 0")
    over = lambda agg: agg.over(chunk)
    mastered = F.when(over(F.bool_or(gates.is_review())), over(F.bool_or(gates.is_review() & (F.col("sr_repetition") >= MASTERED_REPETITIONS)))).otherwise(over(F.bool_and(F.col("times_engaged") >= MASTERED_ENGAGEMENTS)))
    introduced = over(F.bool_or(~gates.is_review() & ((F.col("times_looked_at") > 0) | F.array_contains("actions", "like"))))
    suited = ~gates.is_review() | (introduced & ~F.col("reading_goal").eqNullSafe("casual"))
    oldest = lambda types: F.col("card_type").isin(*types) & (over(F.min(F.when(F.col("card_type").isin(*types), F.struct("created_at", "card_id"))))["card_id"] == F.col("card_id"))
    flags = {
        "may": ~mastered & suited & F.array_contains(sc.eligible_types(F.col("seen")), F.col("card_type")),
        "is_companion": oldest(COMPANION_TYPES), "is_oldest": oldest(INTRO_TYPES), "dismissed": F.array_contains("actions", "dismiss"), "lately": F.coalesce(F.array_contains("recent", F.col("card_id")), F.lit(False)),
    }
    rows = rows.withColumns(flags).where("may OR is_companion OR is_oldest")
    rested = sc.cooled_down(F.col("last_shown_at"), F.col("times_engaged"), F.col("times_skipped"), F.col("sr_due_at"), as_of())
    draw = lambda name: sc.jitter(F.lit(name), F.col("user_id").cast("string"), F.col("card_id").cast("string"))
    return rows.select(
        *KEYS, "chunk_id", "book_id", "card_type", "created_at", "last_shown_at", "sr_due_at", "actions", "may", "is_companion", "is_oldest", "dismissed", (F.col("dismissed") | F.col("lately")).alias("excluded"),
        rested.alias("rested"), (gates.is_review() & F.coalesce(F.col("sr_due_at") <= as_of(), F.lit(False))).alias("due"), draw("order").alias("draw"), sc.feed_score(F.col("affinity"), F.col("times_shown"), draw("score")).alias("score"),
    )


def pages(v: Views, limit: int = FEED_LIMIT) -> DataFrame:
    """``feed`` with book_id, created_at and actions of its cards. All steps are ranks and marks within a user or a chunk of theirs, so rows stay where ``offered`` has dealt them."""
    user, chunk = Window.partitionBy("user_id"), Window.partitionBy("user_id", "chunk_id")
    nth = lambda flag, *order: F.when(F.col(flag), F.row_number().over(user.orderBy(F.desc(flag), *order)))
    true = lambda c: F.coalesce(c, F.lit(False))
    is_intro, place = F.col("card_type").isin(*INTRO_TYPES), F.col("place")
    # Due reviews, up to a third of the page, each chunk's first after the oldest card that introduces it.
    rows = offered(v).withColumn("asked", F.col("may") & F.col("due") & ~F.col("excluded")).withColumn("nth", nth("asked", "sr_due_at", "card_id"))
    rows = rows.withColumn("nth", F.when(F.col("nth") <= -(-limit // 3), F.col("nth"))).withColumn("is_sr_due", F.col("nth").isNotNull())
    rows = rows.withColumn("pair", F.when(F.col("is_sr_due"), F.col("nth")).when(F.col("is_companion"), F.min("nth").over(chunk)))
    # The others at random, three times as many as there is room for (the pool), then by score.
    rows = rows.withColumn("slots", limit - F.count("pair").over(user)).withColumn("free", F.col("may") & F.col("rested") & ~F.col("excluded") & F.col("pair").isNull())
    rows = rows.withColumn("pooled", true(nth("free", "draw", "card_id") <= OVER_FETCH * F.col("slots"))).withColumn("place", nth("pooled", F.desc("score"), "card_id"))
    rows = rows.withColumn("chosen", true(place <= F.col("slots"))).withColumn("served", F.bool_or(F.col("pair").isNotNull() | F.col("chosen")).over(user))
    # Where nothing is left, those shown longest ago.
    rows = rows.withColumn("left", F.col("may") & ~F.col("dismissed") & ~F.col("served")).withColumn("lru", nth("left", F.asc_nulls_first("last_shown_at"), "card_id"))
    rows = rows.withColumn("fallback", true(F.col("lru") <= limit)).withColumn("regular", F.col("chosen") | F.col("fallback")).withColumn("batch", F.col("regular") | F.col("pair").isNotNull())
    rows = rows.where("batch OR pooled OR is_oldest")
    # Review cards without an introduction get one: the best of the pool, else the oldest.
    lacking = F.bool_or(F.col("batch") & gates.is_review()).over(chunk) & ~F.bool_or(F.col("batch") & is_intro).over(chunk)
    first = F.min(F.when(F.col("pooled") & is_intro, place)).over(chunk)
    rows = rows.withColumns({"lacking": lacking, "first": first})
    from_pool = F.col("lacking") & true(F.col("pooled") & is_intro & (place == F.col("first")))
    rows = rows.withColumn("from_pool", from_pool).withColumn("added", F.col("from_pool") | (F.col("lacking") & F.col("first").isNull() & F.col("is_oldest"))).where("batch OR added")
    at = lambda part, n: F.struct(F.lit(part).alias("part"), n.cast("bigint").alias("nth"))
    is_pair = F.col("pair").isNotNull()
    rows = rows.withColumn("at", F.when(is_pair, None).when(F.col("chosen"), at(0, place)).when(F.col("fallback"), at(0, F.col("lru"))).when(F.col("from_pool"), at(1, place)).otherwise(at(2, F.col("chunk_id"))))
    order = {
        "section": F.when(is_pair, 0).otherwise(1), "o1": F.when(is_pair, at(0, F.col("pair"))).otherwise(F.min("at").over(chunk)), "o2": F.when(is_pair, F.col("is_sr_due").cast("int")).otherwise(_type_order()), "o3": F.coalesce("at", at(0, F.lit(0))),
        "score": F.when(F.col("chosen") | F.col("from_pool"), F.round("score", 6)).otherwise(0.0),
    }
    position = F.row_number().over(user.orderBy("section", "o1", "o2", "o3", "card_id")).cast("bigint")
    return rows.withColumns(order).select("user_id", position.alias("position"), "card_id", "chunk_id", "card_type", "is_sr_due", "score", "book_id", "created_at", "actions")


def feed(v: Views, limit: int = FEED_LIMIT) -> DataFrame:
    """(user_id, position, card_id, chunk_id, card_type, is_sr_due, score) for all users."""
    return pages(v, limit).drop("book_id", "created_at", "actions")


_DIGEST = "CAST(('0x' || substr(md5('{0}:' || c.user_id || ':' || c.card_id), 1, 8)) AS BIGINT) / 4294967296.0"
_FEED_SQL = f"""
, seen AS (SELECT user_id, count(*) AS n FROM card_scores GROUP BY ALL),
liking AS (SELECT user_id, card_type, CAST(sum(times_engaged) AS DOUBLE) / sum(times_shown) AS affinity FROM card_scores JOIN cards USING (user_id, card_id) GROUP BY ALL),
recent AS (SELECT user_id, card_id FROM feed_events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) <= 20),
ok AS MATERIALIZED (SELECT c.*, s.last_shown_at, s.sr_due_at, (c.user_id, c.card_id) IN (SELECT (user_id, card_id) FROM card_actions WHERE action = 'dismiss') AS dismissed,
    (c.user_id, c.card_id) IN (SELECT (user_id, card_id) FROM recent UNION SELECT (user_id, card_id) FROM card_actions WHERE action = 'dismiss') AS excluded,
    {_COOLDOWN} AS rested, c.card_type IN ('flashcard', 'quiz') AND coalesce(s.sr_due_at <= {{as_of}}, false) AS due,
    {_DIGEST.format('order')} AS draw,
    coalesce(l.affinity, 0.7) * CASE WHEN coalesce(s.times_shown, 0) = 0 THEN 1.5 ELSE 1 END * (0.5 + {_DIGEST.format('score')}) AS score
    FROM placed_cards c JOIN seen t ON t.user_id = c.user_id LEFT JOIN card_scores s ON s.user_id = c.user_id AND s.card_id = c.card_id LEFT JOIN liking l ON l.user_id = c.user_id AND l.card_type = c.card_type
    WHERE (c.reading_goal IS DISTINCT FROM 'casual' OR c.card_type NOT IN ('flashcard', 'quiz')) AND {_MASTERY} AND {_PREREQUISITE}
      AND (c.card_type IN ('discover', 'raw_commentary', 'passage') OR (t.n > 30 AND c.card_type IN ('flashcard', 'glossary', 'contrast')) OR (t.n > 80 AND c.card_type = 'quiz'))),
due AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sr_due_at, card_id) AS nth FROM ok WHERE due AND NOT excluded QUALIFY nth <= 4),
companion AS (SELECT DISTINCT ON (p.user_id, p.chunk_id) p.user_id, p.card_id, p.chunk_id, p.card_type, d.nth FROM placed_cards p JOIN (SELECT user_id, chunk_id, min(nth) AS nth FROM due GROUP BY ALL) d ON d.user_id = p.user_id AND d.chunk_id = p.chunk_id
    WHERE p.card_type IN ('discover', 'raw_commentary', 'passage', 'glossary') ORDER BY p.user_id, p.chunk_id, p.created_at, p.card_id),
pairs AS (SELECT user_id, card_id, chunk_id, card_type, nth, 1 AS part, true AS is_sr_due FROM due UNION ALL SELECT user_id, card_id, chunk_id, card_type, nth, 0, false FROM companion),
pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, card_id) AS place FROM (
    SELECT o.*, 10 - coalesce(u.used, 0) AS slots FROM ok o LEFT JOIN (SELECT user_id, count(*) AS used FROM pairs GROUP BY ALL) u ON u.user_id = o.user_id
    WHERE rested AND NOT excluded AND (o.user_id, o.card_id) NOT IN (SELECT (user_id, card_id) FROM pairs)
    QUALIFY row_number() OVER (PARTITION BY o.user_id ORDER BY draw, o.card_id) <= 3 * (10 - coalesce(u.used, 0)))),
regular AS MATERIALIZED (SELECT user_id, card_id, chunk_id, card_type, score, place FROM pool WHERE place <= slots
    UNION ALL SELECT user_id, card_id, chunk_id, card_type, 0.0, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_shown_at ASC NULLS FIRST, card_id) AS place FROM ok
        WHERE NOT dismissed AND user_id NOT IN (SELECT user_id FROM pairs) AND user_id NOT IN (SELECT user_id FROM pool WHERE place <= slots)) WHERE place <= 10),
lacking AS (SELECT user_id, chunk_id FROM (SELECT user_id, chunk_id, card_type FROM regular UNION ALL SELECT user_id, chunk_id, card_type FROM pairs) GROUP BY ALL
    HAVING bool_or(card_type IN ('quiz', 'flashcard')) AND NOT bool_or(card_type IN ('discover', 'raw_commentary', 'passage'))),
pooled AS (SELECT DISTINCT ON (p.user_id, p.chunk_id) p.* FROM pool p JOIN lacking USING (user_id, chunk_id) WHERE card_type IN ('discover', 'raw_commentary', 'passage') ORDER BY p.user_id, p.chunk_id, place),
oldest AS (SELECT DISTINCT ON (p.user_id, p.chunk_id) p.* FROM placed_cards p JOIN lacking l ON l.user_id = p.user_id AND l.chunk_id = p.chunk_id
    WHERE card_type IN ('discover', 'raw_commentary', 'passage') AND NOT EXISTS (SELECT 1 FROM pooled q WHERE q.user_id = p.user_id AND q.chunk_id = p.chunk_id) ORDER BY p.user_id, p.chunk_id, created_at, card_id),
listed AS (SELECT user_id, card_id, chunk_id, card_type, score, place FROM regular UNION ALL SELECT user_id, card_id, chunk_id, card_type, score, 1000000 + place FROM pooled UNION ALL SELECT user_id, card_id, chunk_id, card_type, 0.0, 2000000 + chunk_id FROM oldest),
final AS (SELECT user_id, card_id, chunk_id, card_type, false AS is_sr_due, score, 1 AS section, min(place) OVER (PARTITION BY user_id, chunk_id) AS o1,
        CASE card_type WHEN 'discover' THEN 0 WHEN 'raw_commentary' THEN 1 WHEN 'passage' THEN 2 WHEN 'glossary' THEN 3 WHEN 'contrast' THEN 4 WHEN 'connect' THEN 5 WHEN 'flashcard' THEN 6 ELSE 7 END AS o2, place AS o3 FROM listed
    UNION ALL SELECT user_id, card_id, chunk_id, card_type, is_sr_due, 0.0, 0, nth, part, 0 FROM pairs)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY section, o1, o2, o3, card_id) AS position, card_id, chunk_id, card_type, is_sr_due, round(CAST(score AS DOUBLE), 6) AS score FROM final
"""


@query(with_views(_FEED_SQL, MANY))
def feed_page(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """The next page of every user."""
    return feed(views(spark, folder, MANY))


@query(with_views("""
, liking AS (SELECT user_id, card_type, CAST(sum(times_engaged) AS DOUBLE) / sum(times_shown) AS affinity FROM counters JOIN cards USING (user_id, card_id) GROUP BY ALL),
scored AS (SELECT c.user_id, c.card_id, coalesce(l.affinity, 0.7) * CASE WHEN coalesce(s.times_shown, 0) = 0 THEN 1.5 ELSE 1 END * (0.5 + """ + _DIGEST.format("score") + """) AS score
    FROM cards c LEFT JOIN counters s ON s.user_id = c.user_id AND s.card_id = c.card_id LEFT JOIN liking l ON l.user_id = c.user_id AND l.card_type = c.card_type)
SELECT user_id, card_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, card_id) AS place FROM scored) WHERE place <= 10
""", MANY))
def feed_scored(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best cards of each user by score alone."""
    v = Views(spark, folder, MANY)
    scores = counters(v.feed_events())
    liking = affinity(scores, v.cards()).select("user_id", "card_type", "affinity")
    draw = sc.jitter(F.lit("score"), F.col("user_id").cast("string"), F.col("card_id").cast("string"))
    rows = v.cards().join(scores.select(*KEYS, "times_shown"), KEYS, "left").join(liking, ["user_id", "card_type"], "left").select(*KEYS, sc.feed_score(F.col("affinity"), F.col("times_shown"), draw).alias("score"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "card_id")).cast("bigint")).where("place <= 10")
    return placed.select(*KEYS, F.round("score", 6).alias("score"), "place")


@query("""
SELECT p_type, p_partkey, p_name, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 10
""")
def featured_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten titles of each category."""
    rows = table(spark, folder, "part").select("p_type", "p_partkey", "p_name", "p_retailprice")
    return featured(rows, "p_type", [F.desc("p_retailprice"), "p_partkey"]).select("p_type", "p_partkey", "p_name", "rank")
