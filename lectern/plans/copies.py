"""Queries over copies of catalogue books, and over what readers do with cards in view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.cards import shuffled, strategy
from lectern.functions.scores import own_grade
from lectern.functions.text import count_words
from lectern.operators import copies as cp
from lectern.operators.events import marked
from lectern.operators.search import names_with
from lectern.operators.toc import label_differences
from lectern.plans.registry import query
from lectern.plans.views import WholeViews, whole_views_sql
from lectern.sources import table

_COPIES_SQL = (
    whole_views_sql()
    + """,
strategies AS (SELECT book_id, coalesce(reading_goal, '') AS goal, CASE WHEN document_type IN ('fiction', 'scripture', 'manual') THEN document_type ELSE 'other' END AS kind FROM books),
wished AS (SELECT user_id, book_id, min(event_id) AS document_id FROM (SELECT user_id, event_id, card_id // 20 AS book_id FROM e WHERE event_type <> 'signup') v
    WHERE NOT EXISTS (SELECT 1 FROM e s WHERE s.event_type = 'signup' AND s.user_id = v.user_id AND s.card_id // 20 = v.book_id) GROUP BY ALL),
wishes AS (SELECT w.*, CASE WHEN goal = 'casual' THEN CASE WHEN kind = 'manual' THEN 2 ELSE 3 END WHEN goal = 'study' THEN CASE WHEN kind = 'fiction' THEN 2 ELSE 1 END WHEN kind = 'fiction' THEN 3 WHEN kind = 'other' THEN 2 ELSE 1 END AS step,
    CASE kind WHEN 'fiction' THEN CASE goal WHEN 'casual' THEN ['passage'] WHEN 'study' THEN ['discover', 'passage', 'glossary'] ELSE ['discover', 'passage'] END
    WHEN 'scripture' THEN CASE goal WHEN 'casual' THEN ['passage'] WHEN 'study' THEN ['discover', 'passage', 'raw_commentary', 'glossary'] ELSE ['discover', 'passage', 'raw_commentary'] END
    WHEN 'manual' THEN CASE goal WHEN 'casual' THEN ['discover', 'raw_commentary', 'flashcard'] WHEN 'study' THEN ['discover', 'raw_commentary', 'flashcard', 'quiz', 'glossary', 'contrast'] ELSE ['discover', 'raw_commentary', 'flashcard', 'quiz'] END
    ELSE CASE goal WHEN 'study' THEN ['discover', 'raw_commentary', 'flashcard', 'glossary', 'contrast'] ELSE ['discover', 'raw_commentary', 'flashcard'] END END AS types
    FROM wished w JOIN strategies USING (book_id)),
numbered AS (SELECT book_id, chunk_id, row_number() OVER (PARTITION BY book_id ORDER BY chunk_index) - 1 AS i FROM chunks WHERE chunk_type <> 'image'),
there AS (SELECT document_id, max(document_id % 3) AS last FROM wishes WHERE document_id % 2 = 0 GROUP BY ALL),
copied AS (SELECT document_id, user_id, chunk_id, types, (row_number() OVER (PARTITION BY document_id ORDER BY i) + coalesce(last, -1))::BIGINT AS chunk_index
    FROM wishes JOIN numbered USING (book_id) LEFT JOIN there USING (document_id) WHERE i % step = 0),
catalog_cards AS (SELECT DISTINCT chunk_id, card_id, card_type FROM cards)
"""
)


def _copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wishes, copied chunks, copied cards): readers wish for the books of the cards they met and own those of their signups.

    Documents with an even number have chunks already, up to the remainder of the number by 3.
    """
    v = WholeViews(spark, folder)
    met = v._events().where("card_id IS NOT NULL").select("user_id", F.expr("card_id div 20").alias("book_id"), F.col("event_id").alias("document_id"), "event_type")
    wished = cp.new_wishes(met.where("event_type <> 'signup'").drop("event_type"), met.where("event_type = 'signup'"))
    made = strategy(F.col("document_type"), F.col("reading_goal"))
    wishes = wished.join(v.books().select("book_id", made["card_types"].alias("card_types"), made["chunk_interval"].alias("chunk_interval")), "book_id")
    there = wishes.where("document_id % 2 = 0").select("document_id", (F.col("document_id") % 3).alias("chunk_index"))
    copied = cp.copied_chunks(wishes, v.chunks().select("book_id", "chunk_id", "chunk_index", "chunk_type"), there)
    cards = cp.copied_cards(wishes, copied, v.cards().select("chunk_id", "card_id", "card_type").distinct())
    return wishes, copied, cards


@query(_COPIES_SQL + "SELECT document_id, user_id, chunk_id AS catalog_chunk_id, chunk_index, card_id, card_type FROM copied JOIN catalog_cards USING (chunk_id) WHERE list_contains(types, card_type)")
def copied_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards of the catalogue on readers' copies of its chunks."""
    return _copies(spark, folder)[2].select("document_id", "user_id", "catalog_chunk_id", "chunk_index", "card_id", "card_type")


@query(_COPIES_SQL + """
SELECT document_id, chunk_count, card_count, CASE WHEN card_count >= chunk_count * len(types) THEN 'ready' ELSE 'generating' END AS status FROM (
    SELECT w.document_id, w.types, (SELECT count(*) FROM copied c WHERE c.document_id = w.document_id) AS chunk_count,
        (SELECT count(*) FROM copied c JOIN catalog_cards k USING (chunk_id) WHERE c.document_id = w.document_id AND list_contains(c.types, card_type)) AS card_count FROM wishes w)
""")
def copy_status(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and cards that each copy got, and whether it is ready."""
    return cp.copy_status(*_copies(spark, folder))


@query("""
WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
m AS (SELECT *, k % 5 AS card_id, event_type IN ('purchase', 'click') AS is_mark FROM e),
s AS (SELECT event_id, user_id, card_id, ts, lag(ts) OVER w AS ts0, lag(event_id) OVER w AS id0 FROM m WHERE NOT is_mark WINDOW w AS (PARTITION BY user_id, card_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN g IS NOT NULL THEN g WHEN revealed THEN 3 END::INTEGER AS grade FROM (
    SELECT s.event_id, arg_max(CASE WHEN event_type = 'purchase' AND k % 8 <= 5 THEN k % 8 END, (m.ts, m.event_id)) FILTER (event_type = 'purchase' AND k % 8 <= 5) AS g, coalesce(bool_or(event_type = 'click'), false) AS revealed
    FROM s LEFT JOIN m ON is_mark AND m.user_id = s.user_id AND m.card_id = s.card_id AND m.ts <= s.ts AND (s.ts0 IS NULL OR m.ts > s.ts0) GROUP BY ALL)
""")
def revealed_grades(spark: SparkSession, folder: str) -> DataFrame:
    """The grade of each impression: that given while the card was in view (a purchase), else 3 if it was revealed (a click), else none."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    rows = table(spark, folder, "events").select("event_id", "user_id", (k % 5).alias("card_id"), F.col("ts").alias("created_at"), kind, F.when((kind == "purchase") & (k % 8 <= 5), k % 8).alias("self_grade"), (kind == "click").alias("revealed"))
    is_mark = kind.isin("purchase", "click")
    grade = own_grade(F.col("self_grade"), F.lit(None), F.col("revealed"))
    return marked(rows.where(~is_mark), rows.where(is_mark)).select("event_id", grade.alias("grade"))


@query("""
SELECT p_partkey, array_to_string(list_transform(o, lambda x: ['name', 'brand', 'type', 'size'][x + 1]), ' ') AS shown, (list_position(o, p_partkey % 4) - 1)::BIGINT AS place FROM (
    SELECT p_partkey, list_transform(list_sort(list_transform(range(4), lambda i: {'d': md5(p_partkey || ':' || i), 'i': i})), lambda x: x.i) AS o FROM part)
""")
def quiz_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Options of a question about each part in the order shown, and the place of the right one."""
    options = F.array(*map(F.lit, ("name", "brand", "type", "size")))
    rows = table(spark, folder, "part").select("p_partkey", shuffled(options, F.col("p_partkey").cast("string")).alias("o"))
    return rows.select("p_partkey", F.array_join(F.transform("o", lambda i: F.get(options, i)), " ").alias("shown"), (F.array_position("o", (F.col("p_partkey") % 4).cast("int")) - 1).cast("bigint").alias("place"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'mer#0000') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def names_to_add(spark: SparkSession, folder: str) -> DataFrame:
    """Customers found by a part of the name who have no open order."""
    members = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return names_with(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", "Mer#0000", members, "c_custkey")


@query("""
SELECT doc_id, before, after FROM (SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(list_filter(regexp_split_to_array(text, '[\\t-\\r \\x{85}\\p{Z}]+'), lambda w: w <> '')) < 60 THEN 'front' ELSE 'main' END AS before FROM documents)
JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'main' ELSE 'front' END AS after FROM labels) USING (doc_id) WHERE before IS DISTINCT FROM after
""")
def label_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the given labels place elsewhere than a rule on their length does."""
    rule = table(spark, folder, "documents").select("doc_id", F.when(F.col("text").isNull(), None).when(count_words(F.col("text")) < 60, "front").otherwise("main").alias("label"))
    given = table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "main").otherwise("front").alias("label"))
    return label_differences(rule, given, ["doc_id"], "label")
