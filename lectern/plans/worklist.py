"""Queries of what is to be worked on and who may see it: eligible documents, users with work, own rows, retries, pages and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import elements as el
from lectern.operators import layout
from lectern.operators.events import liked_reviews
from lectern.operators.gates import first_by
from lectern.operators.scheduler import MAX_RETRIES, affine_first, status_after_error, waiting_documents
from lectern.operators.visibility import on_new_pages, own_through_parent, toggled
from lectern.plans.registry import query
from lectern.plans.texts import _RUNS_SQL, _TOC_SQL, RUNS_A_TASK, contents, runs
from lectern.plans.views import AS_OF, WholeViews, as_of, whole_views_sql
from lectern.sources import table
from lectern.sources.tables import n_tasks

_STATUSES = ("pending", "chunking", "generating", "ready", "error")


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as documents with status, pause and lock."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("document_id"), F.col("o_custkey").alias("user_id"), _pick(_STATUSES, key % 5).alias("status"), (key % 7 == 0).alias("paused"), _pick((None, "me", "other"), key % 3).alias("locked_by"),
        (as_of() - F.make_dt_interval(mins=(key % 20).cast("int"))).alias("locked_at"), (key % 11).cast("double").alias("virtual_time"),
    )


_DOCUMENTS_SQL = f"""
docs AS (SELECT o_orderkey AS document_id, o_custkey AS user_id, ['pending', 'chunking', 'generating', 'ready', 'error'][o_orderkey % 5 + 1] AS status, o_orderkey % 7 = 0 AS paused, [NULL, 'me', 'other'][o_orderkey % 3 + 1] AS locked_by,
    TIMESTAMP '{AS_OF}' - to_minutes(CAST(o_orderkey % 20 AS INTEGER)) AS locked_at, CAST(o_orderkey % 11 AS DOUBLE) AS virtual_time FROM orders),
waiting AS (SELECT * FROM docs WHERE status IN ('chunking', 'generating') AND NOT paused AND (locked_by IS NULL OR locked_by = 'me' OR locked_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE))
"""


@query(f"WITH {_DOCUMENTS_SQL} SELECT document_id, user_id, status, locked_by FROM waiting")
def eligible_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to be worked on: not paused, and free, one's own, or left by a machine that is gone."""
    return waiting_documents(_documents(spark, folder), "me", as_of()).select("document_id", "user_id", "status", "locked_by")


@query(f"""
WITH {_DOCUMENTS_SQL} SELECT DISTINCT w.user_id, c.c_name, CASE WHEN c.c_custkey % 4 = 0 THEN 'plus' ELSE 'free' END AS tier FROM waiting w JOIN customer c ON c.c_custkey = w.user_id
""")
def users_with_work(spark: SparkSession, folder: str) -> DataFrame:
    """Users that have a document to be worked on, each once."""
    profiles = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", F.when(F.col("c_custkey") % 4 == 0, "plus").otherwise("free").alias("tier"))
    users = waiting_documents(_documents(spark, folder), "me", as_of()).select("user_id").distinct()
    return users.join(profiles, "user_id")


@query(f"""
WITH {_DOCUMENTS_SQL} SELECT user_id, document_id, virtual_time FROM waiting QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY virtual_time, CASE WHEN document_id % 2 = 0 THEN 0 ELSE 1 END, document_id) = 1
""")
def next_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's next document: that of least virtual time, one that its machine knows already among equals."""
    waiting = waiting_documents(_documents(spark, folder), "me", as_of())
    return first_by(waiting, ["user_id"], *affine_first(F.col("document_id") % 2 == 0, "document_id")).select("user_id", "document_id", "virtual_time")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey AS reader FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_custkey % 10 = 3 AND EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = l.l_orderkey AND p.o_custkey = o.o_custkey)
UNION ALL SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, NULL FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = l.l_orderkey AND p.o_orderpriority = '1-URGENT' AND p.o_custkey % 10 <> 3)
""")
def visible_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What some readers may see: items of their own orders, by the parent row; and items of public orders, for anyone."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parents = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), (F.col("o_orderpriority") == "1-URGENT").alias("public"))
    readers = parents.select("user_id").where("user_id % 10 = 3").distinct()
    return own_through_parent(items, parents, readers, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "reader")


@query(whole_views_sql() + """
SELECT a.user_id, a.card_id, a.event_id, a.created_at, 5 AS grade FROM actions a JOIN cards c ON c.user_id = a.user_id AND c.card_id = a.card_id WHERE action = 'like' AND c.card_type IN ('flashcard', 'quiz')
""")
def like_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Likes of cards to be reviewed, as reviews of the best grade."""
    v = WholeViews(spark, folder)
    return liked_reviews(v.actions(), v.cards())


_ERRORS = ("worker exited 137", "fetch failed", "HTTP 429", "no such file", "read ECONNRESET", "bad json")


@query("""
SELECT o_orderkey AS document_id, CASE WHEN regexp_matches(error, '(?i)exited null|exited 137|exited 139|SIGKILL|SIGTERM|ENOMEM|ENOSPC|ETIMEDOUT|ECONNRESET|ECONNREFUSED|fetch failed|rate limit|Too Many Requests|429|Service Unavailable|503') AND retries < 3 THEN status ELSE 'error' END AS status,
    CASE WHEN regexp_matches(error, '(?i)exited null|exited 137|exited 139|SIGKILL|SIGTERM|ENOMEM|ENOSPC|ETIMEDOUT|ECONNRESET|ECONNREFUSED|fetch failed|rate limit|Too Many Requests|429|Service Unavailable|503') AND retries < 3 THEN retries + 1 ELSE retries END AS retries FROM (
    SELECT o_orderkey, ['chunking', 'generating'][o_orderkey % 2 + 1] AS status, ['worker exited 137', 'fetch failed', 'HTTP 429', 'no such file', 'read ECONNRESET', 'bad json'][o_orderkey % 6 + 1] AS error, o_orderkey % 5 AS retries FROM orders)
""")
def retry_states(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after an error: still in work if it may pass and was not tried too often, else failed."""
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(key.alias("document_id"), _pick(("chunking", "generating"), key % 2).alias("before"), _pick(_ERRORS, key % 6).alias("error"), (key % 5).alias("retries"))
    after = rows.withColumn("status", status_after_error(F.col("before"), F.col("error"), F.col("retries")))
    return after.select("document_id", "status", F.when((F.col("status") != "error") & (F.col("retries") < MAX_RETRIES), F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"))


@query(f"""
WITH RECURSIVE {_RUNS_SQL},
b AS (SELECT *, CASE WHEN is_mono IS DISTINCT FROM lag(is_mono) OVER (PARTITION BY page ORDER BY line) THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY line) AS block FROM b)
SELECT page, block::BIGINT AS block, CASE WHEN is_mono THEN 'code' ELSE 'text' END AS type, CASE WHEN is_mono THEN string_agg(text, chr(10) ORDER BY line) END AS content FROM g GROUP BY page, block, is_mono
""")
def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages cut into code and prose; what the code is (the prose is that of ``pdf_paragraphs``)."""
    blocks = layout.code_and_prose(layout.merged_runs(runs(spark, folder), ["page"]), ["page"])
    return blocks.select("page", F.col("block").cast("bigint").alias("block"), "type", F.when(F.col("type") == "code", F.col("content")).alias("content"))


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    """Items of orders as elements of documents: their line is the spine index, their part the page."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("pos"), F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("type"), F.concat(F.lit("Page "), (F.col("l_partkey") % 5).cast("string")).alias("chapter"), F.col("l_linenumber").cast("int").alias("spine_index")
    )


@query("""
SELECT l_orderkey AS doc_id, greatest(CASE WHEN l_orderkey % 2 = 0 THEN max(l_linenumber) ELSE count(DISTINCT CASE WHEN l_returnflag = 'R' THEN 1 ELSE l_partkey % 5 END) END, 1)::BIGINT AS pages FROM lineitem GROUP BY l_orderkey
""")
def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of documents: the last spine index of an EPUB, else the distinct pages."""
    rows = _elements(spark, folder)
    ext = rows.select("doc_id").distinct().withColumn("ext", F.when(F.col("doc_id") % 2 == 0, ".epub").otherwise(".pdf"))
    return el.page_counts(rows, ext, n_tasks(table(spark, folder, "lineitem"), RUNS_A_TASK))


@query("""
WITH c AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, ' Chapter ' || (l_partkey % 6) AS chapter FROM lineitem),
f AS (SELECT doc_id, min(pos) AS first FROM c WHERE lower(trim(chapter)) IN ('chapter 2', 'chapter 4') GROUP BY ALL)
SELECT doc_id, pos::INTEGER AS pos, chapter FROM c LEFT JOIN f USING (doc_id) WHERE first IS NULL OR pos < first
""")
def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a document before the first whose chapter is one of the main matter's."""
    items = table(spark, folder, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    chunks = items.select(F.col("l_orderkey").alias("doc_id"), (F.row_number().over(order) - 1).alias("pos"), F.concat(F.lit(" Chapter "), (F.col("l_partkey") % 6).cast("string")).alias("chapter"))
    titles = items.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(F.lit("CHAPTER 2"), F.lit("chapter 4 "))).alias("title")).distinct()
    return el.front_chunks(chunks, titles)


@query(f"""
WITH {_TOC_SQL},
e AS (SELECT a.doc_id, a.idx, a.page, coalesce((SELECT b.page - 1 FROM t b WHERE b.doc_id = a.doc_id AND b.idx > a.idx AND b.level <= a.level ORDER BY b.idx LIMIT 1), 1000) AS end_page FROM t a)
SELECT doc_id, min(page) AS first_page, max(end_page) AS last_page FROM e WHERE idx % 3 = 1 GROUP BY ALL
""")
def selected_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The first and last page of the entries that a reader has chosen."""
    toc = contents(spark, folder)
    total = toc.select("doc_id").distinct().withColumn("total_pages", F.lit(1000))
    return el.page_bounds(toc, total, F.col("idx") % 3 == 1)


@query(f"""
WITH {_TOC_SQL},
s AS (SELECT doc_id, list(idx) FILTER (idx % 3 = 1) AS chosen, list(idx) FILTER (level = 1) AS clicked FROM t GROUP BY ALL)
SELECT doc_id, array_to_string(list_sort(list_concat(list_filter(coalesce(chosen, []), lambda x: NOT list_contains(coalesce(clicked, []), x)), list_filter(coalesce(clicked, []), lambda x: NOT list_contains(coalesce(chosen, []), x)))), ',') AS chosen FROM s
""")
def toggled_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters that are chosen after each of some was clicked once."""
    lists = contents(spark, folder).groupBy("doc_id").agg(F.collect_list(F.when(F.col("idx") % 3 == 1, F.col("idx"))).alias("chosen"), F.collect_list(F.when(F.col("level") == 1, F.col("idx"))).alias("clicked"))
    both = F.array_sort(toggled(F.col("chosen"), F.col("clicked")))
    return lists.select("doc_id", F.array_join(F.transform(both, lambda i: i.cast("string")), ",").alias("chosen"))


@query("""
WITH c AS (SELECT o_custkey AS user_id, o_orderkey AS card_id, o_orderkey % 9 AS page FROM orders), seen AS (SELECT DISTINCT user_id, page FROM c WHERE card_id % 2 = 0)
SELECT DISTINCT user_id, page FROM c WHERE card_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.page = c.page)
""")
def pages_to_load(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that new cards lie on and that a reader has not loaded."""
    cards = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("card_id"), (F.col("o_orderkey") % 9).alias("page"))
    return on_new_pages(cards.where("card_id % 2 = 1"), cards.where("card_id % 2 = 0").select("user_id", "page"))


@query("""
SELECT p_partkey, 'https://books.example/cache/epub/' || p_partkey || '/pg' || p_partkey || '.cover.medium.jpg' AS cover_url, 'https://books.example/cache/epub/' || p_partkey || '/pg' || p_partkey || '-images.epub' AS epub_url FROM part
""")
def catalog_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Where a catalog's covers and books are found."""
    place = F.format_string("https://books.example/cache/epub/%1$d/pg%1$d", "p_partkey")
    return table(spark, folder, "part").select("p_partkey", F.concat(place, F.lit(".cover.medium.jpg")).alias("cover_url"), F.concat(place, F.lit("-images.epub")).alias("epub_url"))
