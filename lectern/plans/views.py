"""The tables of a reading service, derived from the folder's tables; and the same in DuckDB's SQL.

``events`` are impressions of cards; every user has ``cards`` 0..n-1, five to a chunk, four chunks to a
book. A chunk's text is that of the document with its number. Chunks whose number leaves 1 when divided
by 3 have no review cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scores import jitter
from lectern.functions.text import count_words
from lectern.operators import events as ev
from lectern.sources import stored, table

AS_OF = "2024-01-31 00:00:00"
FEW, MANY = 20, 100
_TYPES = ("discover", "raw_commentary", "flashcard", "quiz", "glossary", "contrast", "passage")
_PLAIN_TYPES = ("discover", "raw_commentary", "passage", "glossary", "contrast")
_BOOK_TYPES = ("book", "paper", "article", "manual", "note", "scripture", "other", "fiction")
_GOALS = (None, "casual", "reflective", "study")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _pick(values: tuple, index):
    """The value at an index of a short fixed list."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


class Views:
    """The derived tables of one folder; ``n_cards`` is the number of cards of each user."""

    def __init__(self, spark: SparkSession, folder: str, n_cards: int = FEW):
        self.spark, self.folder, self.n_cards = spark, folder, n_cards

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _events(self) -> DataFrame:
        return self._table("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    def _card(self):
        """The card of an event."""
        return F.col("k") % self.n_cards

    def _owned(self) -> DataFrame:
        """(user_id, card_id) of every card."""
        return self.users().select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.n_cards - 1).cast("bigint"))).alias("card_id"))

    def impressions(self) -> DataFrame:
        kind = F.col("event_type")
        return self._events().select(
            "event_id", "user_id", self._card().alias("card_id"), F.col("ts").alias("created_at"), F.round(F.col("value") * 100).cast("bigint").alias("dwell_ms"),
            (kind == "view").alias("was_sr_due"), F.when(kind == "purchase", F.col("k") % 8).alias("self_grade"), F.when(kind == "click", F.col("k") % 4).alias("quiz_selected_index"),
        )

    def feed_events(self) -> DataFrame:
        return ev.classified(self.impressions())

    def users(self) -> DataFrame:
        """All users of the event log; ids divisible by 4 have the larger tier."""
        ids = table(self.spark, self.folder, "events").select("user_id").distinct()
        return ids.select("user_id", F.when(F.col("user_id") % 4 == 0, "plus").otherwise("free").alias("tier"))

    def _typed(self, rows: DataFrame, *others: str) -> DataFrame:
        """``rows`` (user_id, card_id, chunk_id) with what a card's number tells."""
        kind = F.when(F.col("chunk_id") % 3 == 1, _pick(_PLAIN_TYPES, F.col("card_id") % 5)).otherwise(_pick(_TYPES, (F.col("card_id") * 3 + F.col("chunk_id")) % 7))
        return rows.select("user_id", "card_id", "chunk_id", kind.alias("card_type"), (F.col("card_id") % 4).alias("right_choice"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("card_id").cast("int"))).alias("created_at"), *others)

    def cards(self) -> DataFrame:
        return self._typed(self._owned().withColumn("chunk_id", F.expr("card_id div 5")))

    def _shelf(self) -> DataFrame:
        """(chunk_id, book_id, reading_goal) of every chunk in a book."""
        return self.chunks().select("chunk_id", "book_id").join(self.books().select("book_id", "reading_goal"), "book_id")

    def shelved_cards(self) -> DataFrame:
        """All cards with the book and goal of their chunk, null where it has none."""
        return self.cards().join(self._shelf(), "chunk_id", "left")

    def chunks(self) -> DataFrame:
        """One for each document: chunk_id, book_id, chunk_index, content, word_count, chunk_type, language."""
        docs = table(self.spark, self.folder, "documents")
        return docs.select(
            F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 4").alias("book_id"), (F.col("doc_id") % 4).alias("chunk_index"), F.col("text").alias("content"), count_words(F.col("text")).cast("bigint").alias("word_count"),
            F.when(F.col("doc_id") % 11 == 0, "code").when(F.col("doc_id") % 13 == 0, "image").otherwise("text").alias("chunk_type"), F.col("lang").alias("language"), "source",
        )

    def books(self) -> DataFrame:
        """One for every four documents: book_id, title, document_type, reading_goal (or null)."""
        ids = table(self.spark, self.folder, "documents").select(F.expr("doc_id div 4").alias("book_id")).distinct()
        return ids.select("book_id", F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("title"), _pick(_BOOK_TYPES, F.col("book_id") % 8).alias("document_type"), _pick(_GOALS, F.col("book_id") % 4).alias("reading_goal"))

    def placed_cards(self) -> DataFrame:
        """Cards with their chunk and book: the inner join that the feed starts from. Only ids and kinds are read of the chunks."""
        chunks = self.chunks().select("chunk_id", "book_id")
        return self.cards().join(chunks, "chunk_id").join(self.books(), "book_id")

    def actions(self) -> DataFrame:
        kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(a)) for e, a in (("click", "like"), ("purchase", "bookmark"), ("error", "dismiss"))))
        return self._events().select("event_id", "user_id", self._card().alias("card_id"), kind.alias("action"), F.col("ts").alias("created_at")).where("action IS NOT NULL")

    def card_actions(self) -> DataFrame:
        return ev.active_actions(self.actions())

    def review_states(self) -> DataFrame:
        return ev.review_states(ev.reviews(self.impressions(), self.cards()))

    def scores(self) -> DataFrame:
        return ev.scores(self.feed_events(), self.review_states())

    def usage(self) -> DataFrame:
        return self._events().where("event_type = 'signup'").select("user_id", F.lit("cards_generated").alias("event_type"), F.col("k").alias("quantity"), F.col("ts").alias("occurred_at"))

    def collections(self) -> tuple[DataFrame, DataFrame]:
        """(collections, their books): a collection for each user and each of the sources 0 to 2 by number."""
        owned = self.users().select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("n"))
        collections = owned.select((F.col("user_id") * 3 + F.col("n")).alias("collection_id"), "user_id", F.concat(F.lit("list "), F.col("n").cast("string")).alias("name"))
        members = owned.select((F.col("user_id") * 3 + F.col("n")).alias("collection_id"), F.explode(F.array(F.col("n"), F.col("n") + 2)).alias("book_id"))
        return collections, members


class WholeViews(Views):
    """The same tables with cards over all documents: they grow with users, events and documents.

    An event's ``k`` is the card ``k % 5`` of a chunk that the digest of user and ``k div 5`` picks among
    all documents; each document also has one user, picked by its own digest, so that none is without
    cards. A user has the five cards of each of these chunks, and three collections of the books of them,
    by number. Numbers are picked from the range of the ids; those that no row has get no cards.
    """

    def _picked(self, name: str, column: str, *by) -> tuple[DataFrame, Column]:
        """One row (_lo, _n) with the range of a table's ids, and the id in it that a digest picks."""
        ids = table(self.spark, self.folder, name).agg(F.min(column).alias("_lo"), (F.max(column) - F.min(column) + 1).alias("_n"))
        return F.broadcast(ids), F.col("_lo") + F.floor(jitter(F.lit(name), *(b.cast("string") for b in by)) * F.col("_n"))

    def _events(self) -> DataFrame:
        ids, chunk = self._picked("documents", "doc_id", F.col("user_id"), F.expr("k div 5"))
        return super()._events().join(ids).withColumn("card_id", chunk * 5 + F.col("k") % 5).drop("_lo", "_n")

    def _card(self):
        return F.col("card_id")

    def _met(self) -> DataFrame:
        """(user_id, chunk_id) of every chunk that a user has cards of."""
        ids, user = self._picked("events", "user_id", F.col("doc_id"))
        given = table(self.spark, self.folder, "documents").select("doc_id").join(ids).select(user.alias("user_id"), F.col("doc_id").alias("chunk_id")).join(self.users().select("user_id"), "user_id", "left_semi")
        met = self._events().where("card_id IS NOT NULL").select("user_id", F.expr("card_id div 5").alias("chunk_id"))
        return given.unionByName(met).distinct()

    def _five(self, chunks: DataFrame, *others: str) -> DataFrame:
        """The five cards of each row's chunk."""
        five = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))
        return chunks.select("user_id", "chunk_id", *others, five.alias("j")).select("user_id", (F.col("chunk_id") * 5 + F.col("j")).alias("card_id"), "chunk_id", *others)

    def _owned(self) -> DataFrame:
        return self._five(self._met()).select("user_id", "card_id")

    def shelved_cards(self) -> DataFrame:
        # Books are met by chunks, a fifth of the cards.
        return self._typed(self._five(self._met().join(self._shelf(), "chunk_id", "left"), "book_id", "reading_goal"), "book_id", "reading_goal")

    def collections(self) -> tuple[DataFrame, DataFrame]:
        collections, _ = super().collections()
        return collections, self.placed_cards().select((F.col("user_id") * 3 + F.col("book_id") % 3).alias("collection_id"), "book_id").distinct()


class StoredViews(WholeViews):
    """The same tables, those that a plan starts from many times written once: events with their cards, cards, placed cards, users."""

    def __init__(self, spark: SparkSession, folder: str, n_cards: int = FEW):
        super().__init__(spark, folder, n_cards)
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = stored(make(), name)
        return self._made[name]

    def _events(self) -> DataFrame:
        return self._once("card-events", super()._events)

    def users(self) -> DataFrame:
        return self._once("users", super().users)

    def cards(self) -> DataFrame:
        return self._once("cards", super().cards)

    def placed_cards(self) -> DataFrame:
        return self._once("placed-cards", super().placed_cards)


def views_sql(n_cards: int = FEW) -> str:
    """The same tables as common table expressions, to stand before a query: ``WITH RECURSIVE`` included."""
    return _views_sql("e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)", f"k % {n_cards} AS card_id", f"users, range({n_cards}) r(card_id)", "SELECT user_id * 3 + n AS collection_id, unnest([n, n + 2]) AS book_id FROM users, range(3) r(n)")


def whole_views_sql() -> str:
    """The tables of ``WholeViews``."""
    picked = lambda name, column, by: f"(SELECT min({column}) FROM {name}) + CAST(floor(CAST(('0x' || substr(md5('{name}:' || {by}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * (SELECT max({column}) - min({column}) + 1 FROM {name})) AS BIGINT)"
    return _views_sql(
        f"""n AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
e AS MATERIALIZED (SELECT *, ({picked("documents", "doc_id", "user_id || ':' || (k // 5)")}) * 5 + k % 5 AS card_id FROM n),
owned AS MATERIALIZED (SELECT {picked("events", "user_id", "doc_id")} AS user_id, doc_id AS chunk_id FROM documents WHERE user_id IN (SELECT user_id FROM events) UNION SELECT user_id, card_id // 5 FROM e WHERE card_id IS NOT NULL)""",
        "card_id", "(SELECT user_id, chunk_id * 5 + j AS card_id FROM owned, range(5) r(j))", "SELECT DISTINCT user_id * 3 + book_id % 3 AS collection_id, book_id FROM placed_cards",
    )


def _views_sql(events: str, card: str, owned: str, members: str) -> str:
    listed = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
    return f"""
WITH RECURSIVE {events},
impressions AS (SELECT event_id, user_id, {card}, ts AS created_at, CAST(round(value * 100) AS BIGINT) AS dwell_ms, event_type = 'view' AS was_sr_due,
    CASE WHEN event_type = 'purchase' THEN k % 8 END AS self_grade, CASE WHEN event_type = 'click' THEN k % 4 END AS quiz_selected_index FROM e),
feed_events AS (SELECT event_id, user_id, card_id, created_at, dwell_ms, CASE WHEN dwell_ms < 1500 THEN 'scrolled_past' WHEN dwell_ms < 4000 THEN 'glanced' ELSE 'engaged' END AS event_type,
    CAST(CASE WHEN self_grade BETWEEN 0 AND 5 THEN self_grade END AS INTEGER) AS self_grade, CAST(hour(created_at) AS INTEGER) AS time_of_day, CAST(dayofweek(created_at) AS INTEGER) AS day_of_week FROM impressions),
users AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN 'plus' ELSE 'free' END AS tier FROM events),
cards AS (SELECT user_id, card_id, card_id // 5 AS chunk_id,
    CASE WHEN (card_id // 5) % 3 = 1 THEN {listed(_PLAIN_TYPES)}[card_id % 5 + 1] ELSE {listed(_TYPES)}[(card_id * 3 + card_id // 5) % 7 + 1] END AS card_type,
    card_id % 4 AS right_choice, TIMESTAMP '2024-01-01' + to_minutes(CAST(card_id AS INTEGER)) AS created_at FROM {owned}),
chunks AS (SELECT doc_id AS chunk_id, doc_id // 4 AS book_id, doc_id % 4 AS chunk_index, text AS content, CAST(len(list_filter(regexp_split_to_array(text, '[\\t-\\r \\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')) AS BIGINT) AS word_count,
    CASE WHEN doc_id % 11 = 0 THEN 'code' WHEN doc_id % 13 = 0 THEN 'image' ELSE 'text' END AS chunk_type, lang AS language, source FROM documents),
books AS (SELECT DISTINCT book_id, 'Book ' || book_id AS title, {listed(_BOOK_TYPES)}[book_id % 8 + 1] AS document_type, {listed(_GOALS)}[book_id % 4 + 1] AS reading_goal FROM (SELECT doc_id // 4 AS book_id FROM documents)),
placed_cards AS (SELECT c.*, h.book_id, b.title, b.document_type, b.reading_goal FROM cards c JOIN chunks h USING (chunk_id) JOIN books b USING (book_id)),
actions AS (SELECT event_id, user_id, {card}, CASE event_type WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'bookmark' WHEN 'error' THEN 'dismiss' END AS action, ts AS created_at FROM e WHERE event_type IN ('click', 'purchase', 'error')),
card_actions AS (SELECT user_id, card_id, action, max(created_at) AS created_at FROM actions GROUP BY ALL HAVING count(*) % 2 = 1),
graded AS (SELECT i.user_id, i.card_id, i.created_at, row_number() OVER (PARTITION BY i.user_id, i.card_id ORDER BY i.created_at, i.event_id) AS nth,
    CASE WHEN self_grade BETWEEN 0 AND 5 THEN self_grade WHEN card_type = 'quiz' AND quiz_selected_index IS NOT NULL THEN CASE WHEN quiz_selected_index = right_choice THEN 5 ELSE 1 END
         WHEN dwell_ms < 1500 THEN 0 WHEN dwell_ms < 4000 THEN 2 ELSE 4 END AS grade
    FROM impressions i JOIN cards c ON c.user_id = i.user_id AND c.card_id = i.card_id
    WHERE card_type IN ('flashcard', 'quiz') AND (was_sr_due OR self_grade IS NOT NULL OR quiz_selected_index IS NOT NULL)),
sm2(user_id, card_id, nth, reviewed, n, i, ef) AS (
    SELECT DISTINCT user_id, card_id, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), 0, CAST(1 AS DOUBLE), CAST(2.5 AS DOUBLE) FROM graded
    UNION ALL
    SELECT g.user_id, g.card_id, g.nth, g.created_at, CASE WHEN grade >= 3 THEN n + 1 ELSE 0 END,
        CAST(CASE WHEN grade < 3 OR n = 0 THEN 1 WHEN n = 1 THEN 6 ELSE floor(i * ef + 0.5) END AS DOUBLE), greatest(CAST(1.3 AS DOUBLE), ef + (CAST(0.1 AS DOUBLE) - (5 - grade) * (CAST(0.08 AS DOUBLE) + (5 - grade) * CAST(0.02 AS DOUBLE))))
    FROM sm2 s JOIN graded g ON g.user_id = s.user_id AND g.card_id = s.card_id AND g.nth = s.nth + 1),
review_states AS (SELECT user_id, card_id, n AS sr_repetition, i AS sr_interval_days, ef AS sr_ease_factor, reviewed + to_days(CAST(i AS INTEGER)) AS sr_due_at
    FROM sm2 QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY nth DESC) = 1),
counters AS (SELECT user_id, card_id, count(*) AS times_shown, count(*) FILTER (event_type = 'engaged') AS times_engaged, count(*) FILTER (event_type = 'scrolled_past') AS times_skipped, max(created_at) AS last_shown_at FROM feed_events GROUP BY ALL),
card_scores AS (SELECT c.*, coalesce(r.sr_repetition, 0) AS sr_repetition, r.sr_interval_days, r.sr_ease_factor, r.sr_due_at FROM counters c LEFT JOIN review_states r ON r.user_id = c.user_id AND r.card_id = c.card_id),
usage_events AS (SELECT user_id, 'cards_generated' AS event_type, k AS quantity, ts AS occurred_at FROM e WHERE event_type = 'signup'),
collections AS (SELECT user_id * 3 + n AS collection_id, user_id, 'list ' || n AS name FROM users, range(3) r(n)),
collection_books AS ({members})
"""


def with_views(sql: str, n_cards: int = FEW) -> str:
    """``sql`` after the derived tables; ``{as_of}`` in it is the time of the query."""
    return views_sql(n_cards) + sql.replace("{as_of}", f"TIMESTAMP '{AS_OF}'")
