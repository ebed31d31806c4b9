"""Queries over books, chunks and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scores as sc
from lectern.functions.cards import described, strategy
from lectern.functions.text import parsed_size, shown_size
from lectern.operators import elements as el
from lectern.operators.numbering import running_sums
from lectern.operators.scheduler import advanced, estimated_chunks, fair_order, main_first, next_status, turns
from lectern.operators.search import search, search_many
from lectern.plans.registry import query
from lectern.plans.views import Views, with_views
from lectern.sources import table
from lectern.sources.sinks import cascade_deleted, insert_new, parents_unset, updated_where


@query(with_views("SELECT document_type, count(*) AS n, count(reading_goal) AS with_goal FROM books GROUP BY ALL"))
def doc_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Books by type."""
    return Views(spark, folder).books().groupBy("document_type").agg(F.count(F.lit(1)).alias("n"), F.count("reading_goal").alias("with_goal"))


@query(with_views("SELECT book_id, count(DISTINCT chunk_id) AS chunks, count(*) AS cards FROM placed_cards GROUP BY ALL"))
def chunks_with_cards(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """Chunks of each book that have cards, and the cards."""
    return views(spark, folder).placed_cards().groupBy("book_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("cards"))


@query(with_views("SELECT source, count(*) AS n, coalesce(sum(strlen(content)), 0)::BIGINT AS n_bytes, sum(strlen(content)) > 100000 AS over FROM chunks GROUP BY ALL"))
def storage_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes stored by source, and whether they are over a (small) quota."""
    rows = Views(spark, folder).chunks().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n_bytes"))
    return rows.withColumn("over", F.col("n_bytes") > 100_000)


@query(with_views("""
SELECT b.book_id, b.title, coalesce(h.chunks, 0) AS chunks, coalesce(c.cards, 0) AS cards, coalesce(h.words, 0)::BIGINT AS words FROM books b
LEFT JOIN (SELECT book_id, count(*) AS chunks, sum(word_count) AS words FROM chunks GROUP BY ALL) h USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS cards FROM placed_cards GROUP BY ALL) c USING (book_id)
"""))
def library_counts(spark: SparkSession, folder: str, views: type[Views] = Views) -> DataFrame:
    """Every book with its chunks, cards and words; those without any count 0."""
    v = views(spark, folder)
    chunks = v.chunks().groupBy("book_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("word_count").alias("words"))
    # Counted by chunk first, then brought to the books.
    cards = v.cards().groupBy("chunk_id").agg(F.count(F.lit(1)).alias("cards")).join(v.chunks().select("chunk_id", "book_id"), "chunk_id").groupBy("book_id").agg(F.sum("cards").alias("cards"))
    return v.books().select("book_id", "title").join(chunks, "book_id", "left").join(cards, "book_id", "left").fillna(0)


@query(with_views("SELECT o.collection_id, o.user_id, o.name, count(b.book_id) AS books FROM collections o LEFT JOIN collection_books m ON m.collection_id = o.collection_id LEFT JOIN books b ON b.book_id = m.book_id AND b.document_type <> 'manual' GROUP BY ALL"))
def collections_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every collection with the number of its books (manuals not counted); empty ones count 0."""
    v = Views(spark, folder)
    collections, members = v.collections()
    counts = members.join(v.books().where("document_type <> 'manual'"), "book_id").groupBy("collection_id").agg(F.count(F.lit(1)).alias("books"))
    return collections.join(counts, "collection_id", "left").fillna(0, ["books"])


@query(with_views("""
SELECT book_id, chunk_id FROM (SELECT h.book_id, chunk_id, row_number() OVER (PARTITION BY h.book_id ORDER BY chunk_index) - 1 AS i, CASE WHEN b.document_type IN ('fiction') THEN CASE WHEN b.reading_goal = 'study' THEN 2 ELSE 3 END
    WHEN b.document_type = 'scripture' THEN CASE WHEN b.reading_goal = 'casual' THEN 3 ELSE 1 END WHEN b.document_type = 'manual' THEN CASE WHEN b.reading_goal = 'casual' THEN 2 ELSE 1 END
    ELSE CASE coalesce(b.reading_goal, '') WHEN 'casual' THEN 3 WHEN 'study' THEN 1 ELSE 2 END END AS step
    FROM chunks h JOIN books b USING (book_id) WHERE chunk_type <> 'image') WHERE i % step = 0
"""))
def nth_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that a book's strategy makes cards of."""
    v = Views(spark, folder)
    steps = v.books().select("book_id", strategy(F.col("document_type"), F.col("reading_goal"))["chunk_interval"].alias("step"))
    rows = v.chunks().select(F.col("book_id").alias("doc_id"), F.col("chunk_index").alias("pos"), "chunk_id", "chunk_type", "book_id").join(steps, "book_id")
    return el.every_nth(rows, F.col("step")).select("book_id", "chunk_id")


@query(with_views("""
SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY part, chunk_id) AS nth FROM (
    SELECT source, chunk_id, CASE WHEN word_count < 30 THEN 1 WHEN sum(CASE WHEN word_count < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY chunk_id) <= 10 THEN 0 ELSE 2 END AS part FROM chunks)
"""))
def main_first_order(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks in working order: ten of the main matter, then front matter (here the short ones), then the rest."""
    rows = Views(spark, folder).chunks().select(F.col("source").alias("doc_id"), F.col("chunk_id").alias("pos"), "word_count")
    return main_first(rows, F.col("word_count") < 30).select(F.col("doc_id").alias("source"), F.col("pos").alias("chunk_id"), F.col("nth").cast("bigint").alias("nth"))


@query(with_views("""
SELECT source, chunk_id, i FROM (SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY chunk_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM chunks) WHERE n <= 20 OR i * 20 // n <> (i - 1) * 20 // n OR i = 0
"""))
def sampled_map(spark: SparkSession, folder: str) -> DataFrame:
    """At most twenty evenly spaced chunks of each source."""
    return sampled(Views(spark, folder).chunks().select("source", "chunk_id"), ["source"], "chunk_id", 20).withColumn("i", F.col("i").cast("bigint"))


def sampled(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in order, numbered ``i`` as among all."""
    placed = running_sums(rows, keys, order, _nth=F.lit(1)).withColumnsRenamed({"_nth_total": "_n"}).withColumn("i", F.col("_nth") - 1).drop("_nth")
    step = lambda i: F.floor(i * most / F.col("_n"))
    return placed.where((F.col("_n") <= most) | (F.col("i") == 0) | (step(F.col("i")) != step(F.col("i") - 1))).drop("_n")


@query(with_views("""
SELECT chunk_id, lag(chunk_id) OVER w AS before, lead(chunk_id) OVER w AS after, coalesce(lag(word_count) OVER w, 0) AS words_before FROM chunks WINDOW w AS (PARTITION BY book_id ORDER BY chunk_index)
"""))
def adjacent_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with its neighbours in the book."""
    w = Window.partitionBy("book_id").orderBy("chunk_index")
    rows = Views(spark, folder).chunks().select("chunk_id", "book_id", "chunk_index", "word_count")
    return rows.select("chunk_id", F.lag("chunk_id").over(w).alias("before"), F.lead("chunk_id").over(w).alias("after"), F.coalesce(F.lag("word_count").over(w), F.lit(0)).alias("words_before"))


@query(with_views("""
SELECT book_id, document_type, reading_goal, CASE document_type
    WHEN 'fiction' THEN CASE coalesce(reading_goal, 'reflective') WHEN 'casual' THEN 'Passage cards, every 3rd passage' WHEN 'study' THEN 'Discover + Passage + Glossary cards, every 2nd passage' ELSE 'Discover + Passage cards, every 3rd passage' END
    WHEN 'scripture' THEN CASE coalesce(reading_goal, 'reflective') WHEN 'casual' THEN 'Passage cards, every 3rd passage' WHEN 'study' THEN 'Discover + Passage + Notes + Glossary cards, every passage' ELSE 'Discover + Passage + Notes cards, every passage' END
    WHEN 'manual' THEN CASE coalesce(reading_goal, 'reflective') WHEN 'casual' THEN 'Discover + Notes + Flashcard cards, every 2nd passage' WHEN 'study' THEN 'Discover + Notes + Flashcard + Quiz + Glossary + Contrast cards, every passage' ELSE 'Discover + Notes + Flashcard + Quiz cards, every passage' END
    ELSE CASE coalesce(reading_goal, 'reflective') WHEN 'casual' THEN 'Discover + Notes + Flashcard cards, every 3rd passage' WHEN 'study' THEN 'Discover + Notes + Flashcard + Glossary + Contrast cards, every passage' ELSE 'Discover + Notes + Flashcard cards, every 2nd passage' END END AS strategy FROM books
"""))
def strategies(spark: SparkSession, folder: str) -> DataFrame:
    """What is made of each book, in words."""
    found = strategy(F.col("document_type"), F.col("reading_goal"))
    return Views(spark, folder).books().select("book_id", "document_type", "reading_goal", described(found["card_types"], found["chunk_interval"]).alias("strategy"))


@query("""
SELECT p_partkey, p_name, p_brand, p_type, round(matched / len(t), 6) AS rank FROM (SELECT *, len(list_filter(t, lambda x: starts_with(x, 're') OR starts_with(x, 'eco'))) AS matched FROM (
    SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM part))
WHERE len(list_filter(t, lambda x: starts_with(x, 're'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'eco'))) > 0
""")
def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    """Titles with a word for each prefix of a search, with their rank."""
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return search(rows, "RE, eco", ["p_name", "p_brand", "p_type"]).withColumn("rank", F.round("rank", 6))


@query("""
WITH q AS (SELECT r_regionkey AS query_id, lower(substr(r_name, 1, 1)) AS prefix FROM region UNION ALL SELECT r_regionkey, 'cust' FROM region),
w AS (SELECT DISTINCT c_custkey, unnest(list_filter(regexp_split_to_array(lower(c_name || ' ' || c_mktsegment), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM customer),
n AS (SELECT query_id, count(DISTINCT prefix) AS need FROM q GROUP BY ALL),
m AS (SELECT query_id, c_custkey, count(DISTINCT prefix) AS matched FROM q JOIN w ON starts_with(t, prefix) GROUP BY ALL)
SELECT m.* FROM m JOIN n USING (query_id) WHERE matched = need
""")
def catalog_search_many(spark: SparkSession, folder: str) -> DataFrame:
    """Many searches at once: each region's first letter, and "cust"."""
    queries = table(spark, folder, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.substring("r_name", 1, 1), F.lit(" cust")).alias("query"))
    return search_many(table(spark, folder, "customer"), queries, "c_custkey", ["c_name", "c_mktsegment"])


@query("""
SELECT conv_id, model, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(tokens_in * p_in + tokens_out * p_out + thinking * p_out) / 1000000, 9) AS cost FROM (
    SELECT conv_id, ['gemini-2.0-flash', 'gemini-2.5-flash', 'gemini-2.5-pro', 'another'][conv_id % 4 + 1] AS model, [0.10, 0.30, 1.25, NULL][conv_id % 4 + 1]::DOUBLE AS p_in, [0.40, 2.50, 10.00, NULL][conv_id % 4 + 1]::DOUBLE AS p_out,
        length(text) AS tokens_in, strlen(text) AS tokens_out, CASE WHEN turn % 2 = 1 THEN 7 ELSE 0 END AS thinking FROM conversations WHERE role = 'assistant') GROUP BY ALL
""")
def ai_cost(spark: SparkSession, folder: str) -> DataFrame:
    """What the assistant's turns would have cost, by conversation; null for a model without a price."""
    turns_ = table(spark, folder, "conversations").where("role = 'assistant'")
    model = F.get(F.array(*map(F.lit, ("gemini-2.0-flash", "gemini-2.5-flash", "gemini-2.5-pro", "another"))), (F.col("conv_id") % 4).cast("int"))
    rows = turns_.select("conv_id", model.alias("model"), F.length("text").alias("tokens_in"), F.octet_length("text").alias("tokens_out"), F.when(F.col("turn") % 2 == 1, 7).alias("thinking"))
    cost = sc.ai_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), F.col("thinking"))
    return rows.groupBy("conv_id", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 9).alias("cost"))


_TURNS_SQL = """
WITH d AS (SELECT o_custkey AS user_id, o_orderkey AS document_id, CAST(o_orderkey % 3 AS DOUBLE) AS vt, CAST(5 + o_orderkey % 17 AS BIGINT) AS available,
        CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey % 3, o_orderkey) = 1 THEN 3 ELSE 1 END AS weight FROM orders),
slots AS (SELECT user_id, document_id, vt + k * 10 / weight AS due, least(10, available - k * 10) AS size FROM d, range(3) r(k) WHERE k * 10 < least(available, 40)),
summed AS (SELECT *, row_number() OVER w AS turn, coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY due, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM slots WINDOW w AS (PARTITION BY user_id ORDER BY due, document_id)),
made AS (SELECT user_id, turn, document_id, least(size, 40 - before)::BIGINT AS cards FROM summed WHERE before < 40)
"""


@query(_TURNS_SQL + "SELECT * FROM made")
def scheduler_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of fair scheduling over orders as documents, each customer with a budget of 40 cards."""
    key = F.col("o_orderkey")
    priority = F.get(F.array(F.lit("pinned"), F.lit("active"), F.lit("normal")), (key % 3).cast("int"))
    documents = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), key.alias("document_id"), priority.alias("priority"), (key % 3).cast("double").alias("virtual_time"), (5 + key % 17).alias("available"))
    budget = documents.select("user_id").distinct().withColumn("budget", F.lit(40).cast("bigint"))
    return turns(documents, budget)


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users: those divisible by 4 have the larger tier; their virtual times are a few cards apart."""
    key = F.col("o_custkey")
    return table(spark, folder, "orders").select(key.alias("user_id")).distinct().select("user_id", F.when(F.col("user_id") % 4 == 0, "plus").otherwise("free").alias("tier"), (F.col("user_id") % 7).cast("double").alias("virtual_time"))


_FAIR_SQL = _TURNS_SQL + """,
u AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 2 ELSE 1 END AS weight, CAST(user_id % 7 AS DOUBLE) AS vt FROM (SELECT DISTINCT user_id FROM d))
"""


@query(_FAIR_SQL + """
SELECT user_id, turn, document_id, cards, starts_at, row_number() OVER (ORDER BY starts_at, user_id) AS place FROM (
    SELECT m.*, vt + coalesce(sum(cards) OVER (PARTITION BY m.user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / weight AS starts_at FROM made m JOIN u ON u.user_id = m.user_id)
""")
def fair_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """All users' turns in one order: users by virtual time, two to one by tier, and their documents three to one within."""
    return fair_order(_customers(spark, folder), scheduler_turns(spark, folder))


@query(_FAIR_SQL + """
, after AS (SELECT u.user_id, CASE WHEN weight = 2 THEN 'plus' ELSE 'free' END AS tier, vt + coalesce(m.n, 0) / weight AS vt FROM u LEFT JOIN (SELECT user_id, sum(cards) AS n FROM made GROUP BY ALL) m USING (user_id))
SELECT user_id, tier, vt - (SELECT CASE WHEN min(vt) > 10000 THEN min(vt) ELSE 0 END FROM after) AS virtual_time FROM after
""")
def virtual_times(spark: SparkSession, folder: str) -> DataFrame:
    """Users' virtual times once all turns are taken."""
    made = scheduler_turns(spark, folder).groupBy("user_id").agg(F.sum("cards").alias("made"))
    return advanced(_customers(spark, folder), made)


@query("""
SELECT o_orderkey, CASE WHEN status IN ('pending', 'error') THEN status WHEN done < total THEN 'chunking' WHEN missing > 0 THEN 'generating' ELSE 'ready' END AS status,
    (CASE WHEN done > 0 AND done < total THEN floor(chunks * total / done + 0.5) ELSE chunks END)::BIGINT AS estimated, (CASE WHEN total = 0 THEN 0 ELSE least(100, floor(done / total * 100 + 0.5)) END)::BIGINT AS percent FROM (
    SELECT o_orderkey, ['pending', 'chunking', 'generating', 'ready', 'error'][o_orderkey % 5 + 1] AS status, o_orderkey % 40 AS total, o_orderkey % 37 AS done, o_orderkey % 11 AS chunks, o_orderkey % 2 AS missing FROM orders)
""")
def document_status(spark: SparkSession, folder: str) -> DataFrame:
    """State, estimated chunks and progress of documents (orders stand for them)."""
    key = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("pending", "chunking", "generating", "ready", "error"))), (key % 5).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", status.alias("s"), (key % 40).alias("total"), (key % 37).alias("done"), (key % 11).alias("chunks"), (key % 2).alias("missing"))
    return rows.select("o_orderkey", next_status(F.col("s"), F.col("total"), F.col("done"), F.col("missing")).alias("status"), estimated_chunks(F.col("chunks"), F.col("total"), F.col("done")).alias("estimated"), sc.percent(F.col("done"), F.col("total")).alias("percent"))


@query("""
WITH i AS (SELECT p_partkey, p_type AS format, p_size * 1024 AS n_bytes, p_retailprice AS pixels FROM part)
SELECT format, count(*) AS n, sum(n_bytes)::BIGINT AS n_bytes, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share, (sum(CAST(floor(pixels) AS BIGINT)) // count(*))::BIGINT AS mean_pixels FROM i GROUP BY format
""")
def image_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, bytes, share and mean size by format (parts stand for images)."""
    rows = table(spark, folder, "part").select(F.col("p_type").alias("format"), parsed_size(F.concat(F.col("p_size").cast("string"), F.lit("K"))).alias("n_bytes"), F.floor("p_retailprice").alias("pixels"))
    return inventory(rows, "format").drop("shown").withColumn("share", F.round("share", 6))


def inventory(images: DataFrame, by: str) -> DataFrame:
    """by, n, n_bytes, share (per cent of all), mean_pixels, shown (bytes as text). Only one row a value is gathered for the total."""
    counts = images.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"), F.sum("pixels").alias("pixels"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(by, "n", "n_bytes", (F.col("n") * 100 / F.col("total")).alias("share"), F.expr("pixels div n").alias("mean_pixels"), shown_size(F.col("n_bytes")).alias("shown"))


@query("""
SELECT 'cards' AS table_name, count(*) AS n FROM events WHERE user_id % 7 <> 0 UNION ALL SELECT 'usage', count(*) FROM events UNION ALL SELECT 'usage without user', count(*) FROM events WHERE user_id % 7 = 0
""")
def deleted_users(spark: SparkSession, folder: str) -> DataFrame:
    """What is left when every seventh user is deleted: their rows go, but the usage log stays without its user."""
    rows = table(spark, folder, "events").select("user_id", "event_id")
    gone = rows.where("user_id % 7 = 0").select("user_id").distinct()
    cards = cascade_deleted(rows, gone, "user_id")
    usage = parents_unset(rows, gone, "user_id")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
    return one(cards, "cards").unionByName(one(usage, "usage")).unionByName(one(usage.where("user_id IS NULL"), "usage without user"))


@query("""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS event_id FROM events GROUP BY ALL
""")
def inserted_once(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each user and day, inserted in two batches (even ids, then odd): what is there already stays."""
    rows = table(spark, folder, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    there = insert_new(rows.where("false"), rows.where("event_id % 2 = 0"), ["user_id", "day"], ["event_id"])
    return insert_new(there, rows.where("event_id % 2 = 1"), ["user_id", "day"], ["event_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def updated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """An update by a predicate, as a rewrite of the table."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return updated_where(rows, F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("F"), "o_totalprice": F.lit(0.0)})
