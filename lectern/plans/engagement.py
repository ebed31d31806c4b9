"""Queries over impressions, actions and review states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scores as sc
from lectern.functions.cards import strategy
from lectern.operators import events as ev
from lectern.operators import gates
from lectern.operators.scheduler import budgets, missing_types
from lectern.functions.values import COMPANION_TYPES, FEED_LIMIT, FEED_MAX
from lectern.plans.registry import query
from lectern.plans.views import MANY, Views, as_of, with_views

_SHOWN = """
SELECT event_type, CAST(time_of_day AS INTEGER) AS time_of_day, day_of_week, count(*) AS n, sum(dwell_ms)::BIGINT AS dwell_ms, count(self_grade) AS graded FROM feed_events GROUP BY ALL
"""


@query(with_views(_SHOWN))
def event_classification(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of engagement by hour and day of week."""
    rows = Views(spark, folder).feed_events()
    return rows.groupBy("event_type", "time_of_day", "day_of_week").agg(F.count(F.lit(1)).alias("n"), F.sum("dwell_ms").alias("dwell_ms"), F.count("self_grade").alias("graded"))


@query(with_views("""
SELECT user_id, card_type, sum(times_shown)::BIGINT AS shown, sum(times_engaged)::BIGINT AS engaged, round(sum(times_engaged) / sum(times_shown), 6) AS affinity
FROM card_scores JOIN cards USING (user_id, card_id) GROUP BY ALL HAVING sum(times_shown) > 0
"""))
def type_affinity(spark: SparkSession, folder: str) -> DataFrame:
    """How often each user engages with each card type."""
    v = Views(spark, folder)
    return affinity(ev.counters(v.feed_events()), v.cards()).withColumn("affinity", F.round("affinity", 6))


def affinity(scores: DataFrame, cards: DataFrame) -> DataFrame:
    """(user_id, card_type, shown, engaged, affinity) of the types that were shown."""
    sums = scores.join(cards.select("user_id", "card_id", "card_type"), ["user_id", "card_id"]).groupBy("user_id", "card_type").agg(F.sum("times_shown").alias("shown"), F.sum("times_engaged").alias("engaged"))
    return sums.where("shown > 0").withColumn("affinity", F.col("engaged") / F.col("shown"))


@query(with_views("""
SELECT user_id, seen, CASE WHEN seen <= 30 THEN 'EARLY' WHEN seen <= 80 THEN 'MID' ELSE 'ALL' END AS tier,
       CASE WHEN seen <= 30 THEN 3 WHEN seen <= 80 THEN 6 ELSE 7 END AS n_types
FROM (SELECT user_id, count(DISTINCT card_id) AS seen FROM feed_events GROUP BY ALL)
""", MANY))
def cold_start_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Which card types a user may see yet, by the number of distinct cards seen."""
    seen = Views(spark, folder, MANY).feed_events().groupBy("user_id").agg(F.count_distinct("card_id").alias("seen"))
    return seen.select("user_id", "seen", sc.tier(F.col("seen")).alias("tier"), F.size(sc.eligible_types(F.col("seen"))).alias("n_types"))


@query(with_views("SELECT * FROM counters"))
def card_counters(spark: SparkSession, folder: str) -> DataFrame:
    """How often each card was shown, engaged with and skipped."""
    return ev.counters(Views(spark, folder).feed_events())


@query(with_views("SELECT * FROM counters"))
def merged_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The same counters from two halves of the log, one merged into the other."""
    rows = Views(spark, folder).feed_events()
    old, new = (ev.counters(rows.where(F.col("event_id") % 2 == k)) for k in (0, 1))
    return ev.merged_counters(old, new)


@query(with_views("SELECT * FROM card_actions"))
def active_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Likes, bookmarks and dismissals that are switched on."""
    return Views(spark, folder).card_actions()


@query(with_views("""
SELECT user_id, card_id, saved_at, nth, card_type, book_id, actions FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, card_id) AS nth FROM (
        SELECT user_id, card_id, max(a.created_at) FILTER (a.action IN ('like', 'bookmark')) AS saved_at, string_agg(a.action, ',' ORDER BY a.action) AS actions FROM card_actions a GROUP BY ALL)
    JOIN (SELECT user_id, card_id, card_type, book_id FROM placed_cards) USING (user_id, card_id) WHERE saved_at IS NOT NULL)
WHERE nth BETWEEN 6 AND 15
"""))
def saved_cards(spark: SparkSession, folder: str, limit: int = 10, offset: int = 5, views: type[Views] = Views) -> DataFrame:
    """Every user's page of liked or bookmarked cards, the latest first, each with all its actions."""
    v = views(spark, folder)
    saving = F.when(F.col("action").isin("like", "bookmark"), F.col("created_at"))
    saved = v.card_actions().groupBy("user_id", "card_id").agg(F.max(saving).alias("saved_at"), F.array_join(F.array_sort(F.collect_list("action")), ",").alias("actions")).where("saved_at IS NOT NULL")
    rows = saved.join(v.placed_cards().select("user_id", "card_id", "card_type", "book_id"), ["user_id", "card_id"])
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("saved_at"), "card_id")).cast("bigint"))
    return numbered.where(F.col("nth").between(offset + 1, offset + limit)).select("user_id", "card_id", "saved_at", "nth", "card_type", "book_id", "actions")


@query(with_views("""
SELECT user_id, event_id, card_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS nth FROM feed_events) WHERE nth <= 20
"""))
def recent_20(spark: SparkSession, folder: str) -> DataFrame:
    """The last twenty events of each user."""
    return gates.recent_events(Views(spark, folder).feed_events()).select("user_id", "event_id", "card_id", F.col("nth").cast("bigint").alias("nth"))


@query(with_views("SELECT user_id, card_id FROM card_actions WHERE action = 'dismiss'"))
def dismissed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that their user has dismissed."""
    return Views(spark, folder).card_actions().where("action = 'dismiss'").select("user_id", "card_id")


@query(with_views("""
SELECT user_id, card_id FROM (SELECT user_id, card_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS nth FROM feed_events) WHERE nth <= 20
UNION SELECT user_id, card_id FROM card_actions WHERE action = 'dismiss'
UNION SELECT user_id, card_id FROM cards WHERE card_id < 2
"""))
def exclusion_union(spark: SparkSession, folder: str) -> DataFrame:
    """Cards not to be shown next: lately seen, dismissed, or already loaded (here the first two of each user)."""
    v = Views(spark, folder)
    return gates.excluded_cards(v.feed_events(), v.card_actions(), v.cards().where("card_id < 2"))


@query(with_views("SELECT user_id, card_id, sr_repetition, round(sr_interval_days, 4) AS sr_interval_days, round(sr_ease_factor, 4) AS sr_ease_factor, sr_due_at FROM review_states"))
def sm2_state(spark: SparkSession, folder: str) -> DataFrame:
    """Review states after all reviews, in order."""
    rows = Views(spark, folder).review_states()
    return rows.withColumns({c: F.round(c, 4) for c in ("sr_interval_days", "sr_ease_factor")})


@query(with_views("""
SELECT p.user_id, p.card_id, p.card_type FROM placed_cards p WHERE (p.reading_goal IS NULL OR p.reading_goal <> 'casual') AND p.card_type IN ('flashcard', 'quiz')
AND EXISTS (SELECT 1 FROM card_scores s WHERE s.user_id = p.user_id AND s.card_id = p.card_id AND s.sr_due_at <= {as_of})
"""))
def sr_due(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """Review cards that are due, but for books read casually."""
    v = views(spark, folder)
    due = v.scores().where(F.col("sr_due_at") <= as_of()).select("user_id", "card_id")
    cards = v.placed_cards().where(gates.is_review() & (F.col("reading_goal").isNull() | (F.col("reading_goal") != "casual")))
    return cards.join(due, ["user_id", "card_id"], "left_semi").select("user_id", "card_id", "card_type")


@query(with_views("""
SELECT DISTINCT ON (user_id, chunk_id) user_id, chunk_id, card_id, card_type FROM cards WHERE card_type IN ('discover', 'raw_commentary', 'passage', 'glossary') ORDER BY user_id, chunk_id, created_at, card_id
"""))
def companions_first(spark: SparkSession, folder: str) -> DataFrame:
    """The oldest card of each chunk that can introduce it."""
    cards = Views(spark, folder).cards().where(F.col("card_type").isin(*COMPANION_TYPES))
    return gates.first_by(cards, ["user_id", "chunk_id"], "created_at", "card_id").select("user_id", "chunk_id", "card_id", "card_type")


@query(with_views("SELECT DISTINCT ON (user_id, card_type) user_id, card_type, card_id, chunk_id FROM cards ORDER BY user_id, card_type, created_at DESC, card_id DESC"))
def latest_per_type(spark: SparkSession, folder: str) -> DataFrame:
    """The newest card of each type."""
    rows = gates.first_by(Views(spark, folder).cards(), ["user_id", "card_type"], F.desc("created_at"), F.desc("card_id"))
    return rows.select("user_id", "card_type", "card_id", "chunk_id")


_MASTERY = """NOT EXISTS (
    SELECT 1 FROM (SELECT chunk_id, bool_or(card_type IN ('flashcard', 'quiz')) AS has_review FROM cards a WHERE a.chunk_id = c.chunk_id AND a.user_id = c.user_id GROUP BY chunk_id) i
    WHERE CASE WHEN i.has_review THEN EXISTS (SELECT 1 FROM cards r JOIN card_scores s ON s.card_id = r.card_id AND s.user_id = r.user_id
                 WHERE r.chunk_id = c.chunk_id AND r.user_id = c.user_id AND r.card_type IN ('flashcard', 'quiz') AND s.sr_repetition >= 3)
          ELSE NOT EXISTS (SELECT 1 FROM cards n LEFT JOIN card_scores s ON s.card_id = n.card_id AND s.user_id = n.user_id
                 WHERE n.chunk_id = c.chunk_id AND n.user_id = c.user_id AND (s.times_engaged IS NULL OR s.times_engaged < 3)) END)"""
_PREREQUISITE = """(c.card_type NOT IN ('quiz', 'flashcard')
    OR EXISTS (SELECT 1 FROM feed_events f JOIN cards x ON x.card_id = f.card_id AND x.user_id = f.user_id
               WHERE x.chunk_id = c.chunk_id AND x.user_id = c.user_id AND x.card_type NOT IN ('quiz', 'flashcard') AND f.event_type IN ('glanced', 'engaged'))
    OR EXISTS (SELECT 1 FROM card_actions f JOIN cards x ON x.card_id = f.card_id AND x.user_id = f.user_id
               WHERE x.chunk_id = c.chunk_id AND x.user_id = c.user_id AND x.card_type NOT IN ('quiz', 'flashcard') AND f.action = 'like'))"""
_COOLDOWN = """(NOT EXISTS (SELECT 1 FROM card_scores s WHERE s.card_id = c.card_id AND s.user_id = c.user_id)
    OR EXISTS (SELECT 1 FROM card_scores s WHERE s.card_id = c.card_id AND s.user_id = c.user_id AND (s.last_shown_at IS NULL
        OR s.last_shown_at < {as_of} - to_days(CASE WHEN s.times_skipped > s.times_engaged THEN 14 WHEN s.times_engaged > 0 THEN 7 ELSE 3 END) OR s.sr_due_at <= {as_of})))"""


@query(with_views(f"SELECT user_id, card_id FROM cards c WHERE {_MASTERY}"))
def mastery_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Cards of chunks that are not mastered yet."""
    v = Views(spark, folder)
    return gates.not_mastered(v.cards(), gates.chunk_mastery(v.cards(), v.scores())).select("user_id", "card_id")


@query(with_views("""
SELECT c.user_id, c.card_id FROM cards c LEFT JOIN (
    SELECT DISTINCT x.user_id, x.chunk_id FROM cards x JOIN (
        SELECT user_id, card_id FROM feed_events WHERE event_type IN ('glanced', 'engaged') UNION SELECT user_id, card_id FROM card_actions WHERE action = 'like'
    ) f ON f.user_id = x.user_id AND f.card_id = x.card_id WHERE x.card_type NOT IN ('quiz', 'flashcard')
) m ON m.user_id = c.user_id AND m.chunk_id = c.chunk_id
WHERE c.card_type NOT IN ('quiz', 'flashcard') OR m.chunk_id IS NOT NULL
""", MANY))
def prerequisite_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Cards but for review cards of chunks that their user has not met."""
    v = Views(spark, folder, MANY)
    return gates.prerequisites_met(v.cards(), gates.introduced_chunks(v.cards(), v.feed_events(), v.card_actions())).select("user_id", "card_id")


@query(with_views(f"SELECT user_id, card_id FROM cards c WHERE {_COOLDOWN}"))
def cooldown_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that were not shown too lately."""
    v = Views(spark, folder)
    return gates.rested(v.cards(), v.scores(), as_of()).select("user_id", "card_id")


@query(with_views("SELECT user_id, card_id, document_type FROM placed_cards WHERE reading_goal IS DISTINCT FROM 'casual' OR card_type NOT IN ('flashcard', 'quiz')"))
def casual_filter(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """Cards without the review cards of books read casually."""
    return gates.suits_goal(views(spark, folder).placed_cards()).select("user_id", "card_id", "document_type")


@query(with_views("""
SELECT user_id, card_id FROM placed_cards p WHERE book_id IN (SELECT m.book_id FROM collection_books m JOIN collections o ON o.collection_id = m.collection_id WHERE o.user_id = p.user_id AND o.name IN ('list 0', 'list 1'))
""", MANY))
def collection_filter(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """Cards of books in two of their user's collections."""
    v = views(spark, folder, MANY)
    collections, members = v.collections()
    rows = v.placed_cards().withColumnRenamed("book_id", "document_id")
    return gates.in_collections(rows, members.withColumnRenamed("book_id", "document_id"), collections, ["list 0", "list 1"]).select("user_id", "card_id")


@query(with_views("""
SELECT c.user_id, c.chunk_id FROM cards c GROUP BY c.user_id, c.chunk_id
HAVING count(*) = count(*) FILTER (WHERE EXISTS (SELECT 1 FROM card_scores s WHERE s.user_id = c.user_id AND s.card_id = c.card_id AND s.times_engaged >= 3)) AND NOT bool_or(card_type IN ('flashcard', 'quiz'))
""", 8))
def engagement_mastered(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks without review cards all of whose cards were engaged with three times."""
    v = Views(spark, folder, 8)
    rows = v.cards().join(ev.counters(v.feed_events()).select("user_id", "card_id", "times_engaged"), ["user_id", "card_id"], "left")
    flags = rows.groupBy("user_id", "chunk_id").agg(F.bool_and(F.coalesce("times_engaged", F.lit(0)) >= 3).alias("done"), F.bool_or(gates.is_review()).alias("has_review"))
    return flags.where("done AND NOT has_review").select("user_id", "chunk_id")


@query(with_views("""
SELECT p.user_id, p.book_id, count(DISTINCT chunk_id) AS chunks_read FROM feed_events f JOIN placed_cards p ON p.user_id = f.user_id AND p.card_id = f.card_id WHERE f.event_type <> 'scrolled_past' GROUP BY ALL
"""))
def reading_progress(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """Chunks of each book that a user has looked at."""
    v = views(spark, folder)
    seen = v.feed_events().where("event_type <> 'scrolled_past'").select("user_id", "card_id").distinct()
    return v.placed_cards().select("user_id", "card_id", "book_id", "chunk_id").join(seen, ["user_id", "card_id"], "left_semi").groupBy("user_id", "book_id").agg(F.count_distinct("chunk_id").alias("chunks_read"))


@query(with_views("""
SELECT u.user_id, u.chunk_id, CASE WHEN m.chunk_id IS NOT NULL THEN 'mastered' WHEN s.chunk_id IS NOT NULL THEN 'seen' ELSE 'has cards' END AS status
FROM (SELECT DISTINCT user_id, chunk_id FROM cards) u
LEFT JOIN (SELECT user_id, chunk_id FROM cards JOIN card_scores USING (user_id, card_id) GROUP BY ALL HAVING max(sr_repetition) >= 3
           UNION SELECT user_id, chunk_id FROM cards LEFT JOIN card_scores USING (user_id, card_id) GROUP BY ALL HAVING bool_and(coalesce(times_engaged, 0) >= 3) AND NOT bool_or(card_type IN ('flashcard', 'quiz'))) m USING (user_id, chunk_id)
LEFT JOIN (SELECT DISTINCT user_id, chunk_id FROM cards JOIN feed_events USING (user_id, card_id)) s USING (user_id, chunk_id)
"""))
def chunk_status(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's state for each user: mastered before seen before having cards."""
    v = Views(spark, folder)
    own = v.scores().select("user_id", "card_id", "sr_repetition", "times_engaged", F.lit(1).alias("seen"))
    flags = v.cards().join(own, ["user_id", "card_id"], "left").groupBy("user_id", "chunk_id").agg(
        (F.coalesce(F.max("sr_repetition"), F.lit(0)) >= 3).alias("repeated"), (F.bool_and(F.coalesce("times_engaged", F.lit(0)) >= 3) & ~F.bool_or(gates.is_review())).alias("engaged"), F.max("seen").alias("seen")
    )
    return flags.select("user_id", "chunk_id", F.when(F.col("repeated") | F.col("engaged"), "mastered").when(F.col("seen") == 1, "seen").otherwise("has cards").alias("status"))


@query(with_views(f"""
, tiers AS (SELECT user_id, count(DISTINCT card_id) AS seen FROM feed_events GROUP BY ALL)
SELECT c.user_id, count(*) AS n FROM cards c JOIN tiers t ON t.user_id = c.user_id LEFT JOIN card_scores s ON s.card_id = c.card_id AND s.user_id = c.user_id
WHERE (s.times_shown IS NULL OR s.times_shown = 0) AND {_MASTERY}
  AND list_contains(CASE WHEN t.seen <= 30 THEN ['discover', 'raw_commentary', 'passage'] WHEN t.seen <= 80 THEN ['discover', 'raw_commentary', 'passage', 'flashcard', 'glossary', 'contrast']
                    ELSE ['discover', 'raw_commentary', 'passage', 'flashcard', 'glossary', 'contrast', 'quiz'] END, c.card_type) GROUP BY ALL
""", MANY))
def unseen_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that wait to be shown: of a type the user may see, in chunks not mastered."""
    return unseen(Views(spark, folder, MANY))


def unseen(v: Views) -> DataFrame:
    """(user_id, n) for users with cards that wait."""
    scores, cards = v.scores(), v.cards()
    tiers = scores.groupBy("user_id").agg(sc.eligible_types(F.count(F.lit(1))).alias("types"))
    fresh = cards.join(scores.where("times_shown > 0").select("user_id", "card_id"), ["user_id", "card_id"], "left_anti")
    open_ = gates.not_mastered(fresh, gates.chunk_mastery(cards, scores)).join(tiers, "user_id")
    return open_.where(F.array_contains("types", F.col("card_type"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("""
, used AS (SELECT user_id, sum(quantity)::BIGINT AS used FROM usage_events WHERE occurred_at >= TIMESTAMP '2024-01-25' GROUP BY ALL)
SELECT u.user_id, tier, coalesce(used, 0) AS used, greatest(CASE tier WHEN 'free' THEN 100 ELSE 500 END - coalesce(used, 0), 0)::BIGINT AS budget,
       least(100, floor(coalesce(used, 0) / CASE tier WHEN 'free' THEN 100 ELSE 500 END * 100 + 0.5))::BIGINT AS percent FROM users u LEFT JOIN used USING (user_id)
"""))
def daily_quota(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each user's day, seen at noon of a day with events."""
    v = Views(spark, folder)
    none = v.users().select("user_id", F.lit(0).alias("n")).where("false")
    rows = budgets(v.users(), v.usage(), none, F.lit("2024-01-25 12:00:00").cast("timestamp_ntz"))
    limit = F.when(F.col("tier") == "free", 100).otherwise(500)
    return rows.withColumn("percent", sc.percent(F.col("used"), limit))


@query(with_views("""
SELECT c.user_id, c.chunk_id, array_to_string(list_sort(list_filter(CASE WHEN b.document_type = 'fiction' THEN CASE coalesce(b.reading_goal, 'reflective') WHEN 'casual' THEN ['passage'] WHEN 'study' THEN ['discover', 'passage', 'glossary'] ELSE ['discover', 'passage'] END
    WHEN b.document_type = 'scripture' THEN CASE coalesce(b.reading_goal, 'reflective') WHEN 'casual' THEN ['passage'] WHEN 'study' THEN ['discover', 'passage', 'raw_commentary', 'glossary'] ELSE ['discover', 'passage', 'raw_commentary'] END
    WHEN b.document_type = 'manual' THEN CASE coalesce(b.reading_goal, 'reflective') WHEN 'casual' THEN ['discover', 'raw_commentary', 'flashcard'] WHEN 'study' THEN ['discover', 'raw_commentary', 'flashcard', 'quiz', 'glossary', 'contrast'] ELSE ['discover', 'raw_commentary', 'flashcard', 'quiz'] END
    ELSE CASE coalesce(b.reading_goal, 'reflective') WHEN 'study' THEN ['discover', 'raw_commentary', 'flashcard', 'glossary', 'contrast'] ELSE ['discover', 'raw_commentary', 'flashcard'] END END, lambda t: NOT list_contains(c.have, t))), ',') AS missing
FROM (SELECT user_id, chunk_id, book_id, list(DISTINCT card_type) AS have FROM placed_cards GROUP BY ALL) c JOIN books b USING (book_id) WHERE missing <> ''
""", MANY))
def missing_card_types(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """Card types that a book's strategy asks for and a chunk has no card of."""
    v = views(spark, folder, MANY)
    placed = v.placed_cards()
    wanted = placed.groupBy("user_id", "chunk_id").agg(F.any_value("document_type").alias("document_type"), F.any_value("reading_goal").alias("reading_goal"))
    chunks = wanted.select("user_id", "chunk_id", strategy(F.col("document_type"), F.col("reading_goal"))["card_types"].alias("card_types"))
    return missing_types(chunks, placed).withColumn("missing", F.array_join("missing", ","))


@query(with_views("""
SELECT user_id, card_id, event_id, created_at, CAST((epoch_us(lead(created_at) OVER (PARTITION BY user_id ORDER BY created_at, event_id)) - epoch_us(created_at)) // 1000 AS BIGINT) AS dwell_ms FROM (
    SELECT *, lag(card_id) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS before FROM feed_events) WHERE before IS DISTINCT FROM card_id
""", 3))
def dwell_ownership(spark: SparkSession, folder: str) -> DataFrame:
    """How long each card held its user's view, from the order of events alone."""
    return ev.dwell_times(Views(spark, folder, 3).feed_events().select("user_id", "card_id", "event_id", "created_at"))


@query(with_views("""
SELECT user_id, count(*) AS n, max(dwell_ms) AS longest FROM feed_events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 10 OFFSET 5
"""))
def busiest_readers(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the users with the most events; a limit given as text is clamped."""
    limit = spark.range(1).select(sc.clamped_number(F.lit("10"), FEED_LIMIT, FEED_MAX).alias("n")).head()["n"]
    rows = Views(spark, folder).feed_events().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("dwell_ms").alias("longest"))
    return rows.orderBy(F.desc("n"), "user_id").offset(5).limit(limit)
