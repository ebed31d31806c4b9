"""Requests taken in batch by batch, affinity that ends, resumable ingestion, fair order."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions.text import count_words
from lectern.operators import ingest as ig
from lectern.operators.events import classified, counters, review_states, reviews, scores
from lectern.operators.scheduler import fair_order
from lectern.plans.catalog import ORACLE_SQL, QUERIES
from lectern.streaming import affinity
from lectern.streaming.affinity import affine_documents, affine_lists, affine_touches
from lectern.streaming.feed_sync import FeedSync, accepted, arriving, flushed, run_to_end

START = dt.datetime(2024, 3, 1)
IMPRESSION = "event_id bigint, user_id bigint, card_id bigint, created_at timestamp_ntz, dwell_ms bigint, was_sr_due boolean, self_grade bigint, quiz_selected_index bigint"


def impressions_of(spark, n, seconds, seed=1, users=3, cards=4):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(users), rng.randrange(cards), START + dt.timedelta(seconds=rng.randrange(seconds)), rng.choice([100, 2000, 9000]), rng.random() < 0.5, rng.choice([None, 0, 3, 5, 9]), rng.choice([None, 1])) for i in range(n)]
    return spark.createDataFrame(rows, IMPRESSION)


@pytest.fixture
def cards(spark):
    rows = [(u, c, ("flashcard", "quiz", "discover", "quiz")[c], c % 3) for u in range(3) for c in range(4)]
    return spark.createDataFrame(rows, "user_id bigint, card_id bigint, card_type string, right_choice bigint")


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_clients_send_at_twenty_items_or_ten_seconds(spark):
    at = [0, 1, 9, 10, 11] + [20 + k / 100 for k in range(45)]
    rows = [(i, 1, 1, START + dt.timedelta(seconds=s), 100, False, None, None) for i, s in enumerate(at)]
    found = flushed(spark.createDataFrame(rows, IMPRESSION)).orderBy("tick", "part").collect()
    assert [[x.event_id for x in r.impressions] for r in found] == [[0, 1, 2], [3, 4], list(range(5, 25)), list(range(25, 45)), list(range(45, 50))]
    assert flushed(spark.createDataFrame([], IMPRESSION)).count() == 0


def test_a_request_brings_fifty_impressions_at_most(spark):
    requests = flushed(impressions_of(spark, 70, 5, users=1), items=100)
    assert requests.count() == 1 and accepted(requests).count() == 50


@pytest.mark.parametrize("keep", [2, 16])
def test_batches_give_what_one_batch_gives_and_replays_change_nothing(spark, tmp_path, cards, keep):
    sync = FeedSync(spark, f"file://{tmp_path}", cards, keep=keep)
    whole = impressions_of(spark, 300, 70).cache()
    requests = flushed(whole).cache()
    for batch in range(7):
        part = requests.where(f"tick - {requests.agg(F.min('tick')).head()[0]} = {batch}")
        sync.step(part, batch)
        before = rows_of(sync.current()), sync.log().count()
        sync.step(part, batch)
        assert (rows_of(sync.current()), sync.log().count()) == before
    taken = accepted(requests)
    want = scores(classified(taken), review_states(reviews(taken, cards)))
    assert rows_of(sync.current()) == rows_of(want) and sync.log().count() == 300
    kept = [x for x in os.listdir(f"{tmp_path}/state") if x.startswith("batch=")]
    assert len(kept) == (8 if keep == 16 else 2)


def test_a_stream_takes_a_few_files_a_batch(spark, tmp_path, cards):
    requests = flushed(impressions_of(spark, 100, 100))
    for k in range(5):
        requests.where(F.pmod("tick", F.lit(5)) == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    sizes = []
    sync = FeedSync(spark, f"file://{tmp_path}/out", cards)

    def step(rows, batch):
        sizes.append(len(rows.inputFiles()) or len(rows.select(F.input_file_name()).distinct().collect()))
        sync.step(rows, batch)

    run_to_end(arriving(spark, f"file://{tmp_path}/in", requests.schema, files=2), step, f"file://{tmp_path}/at", seconds=1)
    assert sizes == [2, 2, 1]
    run_to_end(arriving(spark, f"file://{tmp_path}/in", requests.schema, files=2), step, f"file://{tmp_path}/at")
    assert sizes == [2, 2, 1]
    assert rows_of(sync.current().select("user_id", "card_id", "times_shown")) == rows_of(counters(classified(accepted(requests))).select("user_id", "card_id", "times_shown"))


def test_affinity_ends_after_its_time(spark):
    rng = random.Random(2)
    minutes = [0, 15, 15 + 1 / 60, 30, 30, 61] + [rng.randrange(300) for _ in range(60)]
    rows = [(i, rng.randrange(2), rng.randrange(5), START + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    rows += [(900, None, 1, START), (901, 1, None, START), (902, 1, 1, None)]
    touches = spark.createDataFrame(rows, "event_id bigint, machine_id bigint, doc_id bigint, at timestamp")
    found = {r.event_id: (r.n_affine, r.documents) for r in affine_documents(affine_touches(touches)).collect()}
    want = {}
    for i, m, d, t in rows[:-3]:
        near = sorted({d2 for _, m2, d2, t2 in rows[:-3] if m2 == m and dt.timedelta(0) <= t - t2 <= dt.timedelta(minutes=15)})
        want[i] = (len(near), ",".join(map(str, near)))
    assert found == want


def test_affinity_of_a_stream_that_is_late(spark, tmp_path):
    schema = "event_id bigint, machine_id bigint, doc_id bigint, at timestamp"
    at = lambda m: START + dt.timedelta(minutes=m)
    source = f"file://{tmp_path}/in"
    parts = [[(0, 1, 7, at(0)), (1, 1, 8, at(20))], [(2, 1, 9, at(10))], [(3, 1, 7, at(200)), (4, 1, 5, at(201))]]
    for part in parts:  # the second batch brings an event that lies before the first batch's last
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        touches = spark.readStream.schema(schema).parquet(source)
        run = affine_touches(touches).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
        run.awaitTermination()
    found = {r.event_id: r.documents for r in affine_documents(spark.read.parquet(f"file://{tmp_path}/out")).collect()}
    assert found == {0: "7", 1: "8,9", 2: "7,9", 3: "7", 4: "5,7"}


def test_ingestion_goes_on_where_it_stopped(spark, tmp_path):
    text = "\n\n".join(["Chapter One", "if x: pass $ % # #"] + [f"line {k} " + "of words that go on " * (3 if k % 3 else 90) for k in range(9)])
    docs = spark.createDataFrame([(1, text), (2, text[:200]), (3, None), (4, "")], "doc_id bigint, text string")
    elements = ig.line_elements(docs, F.regexp_count("content", F.lit("[#$%]")) >= 3)
    at_once = ig.ingest(elements, f"file://{tmp_path}/once")
    slowly = ig.Ingestion(spark, f"file://{tmp_path}/slowly")
    for n in range(3):
        slowly.step(elements, n, 2)
        slowly.step(elements, n, 2)  # again after a failure
    assert not slowly.finished()
    ended = ig.ingest(elements, f"file://{tmp_path}/slowly", 3)
    assert rows_of(ended.chunks()) == rows_of(at_once.chunks()) and ended.finished()
    rows = at_once.chunks().where("doc_id = 1").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].chunk_type == "code" and {r.chapter for r in rows} == {"Chapter One"}
    assert {r.doc_id: (r.done, r.total) for r in ended.marks().collect()}[1] == (11, 11)
    words = elements.where("doc_id = 1 AND (type = 'code' OR content LIKE 'line%')").agg(F.sum(count_words(F.col("content")))).head()[0]
    assert sum(r.word_count for r in rows) == words
    ended.step(elements, 99)  # nothing is left
    assert rows_of(ended.chunks()) == rows_of(at_once.chunks())


@pytest.mark.parametrize("visit", [1, 2, None])
def test_fair_order_is_that_of_a_loop(spark, visit):
    rng = random.Random(4)
    users = [(u, rng.choice(["plus", "free"]), float(rng.randrange(3))) for u in range(12)]
    turns = [(u, t, t % 3, rng.randint(1, 10)) for u, _, _ in users for t in range(1, rng.randint(1, 9))]
    left = {u: [t for t in turns if t[0] == u] for u, _, _ in users}
    time, weight, want = {u: v for u, _, v in users}, {u: 2 if t == "plus" else 1 for u, t, _ in users}, []
    while any(left.values()):
        u = min((u for u in left if left[u]), key=lambda u: (time[u], u))
        now = left[u][: visit or 99]
        left[u] = left[u][len(now) :]
        want += [(u, t[1], time[u]) for t in now]
        time[u] += sum(t[3] for t in now) / weight[u]
    found = fair_order(spark.createDataFrame(users, "user_id bigint, tier string, virtual_time double"), spark.createDataFrame(turns, "user_id bigint, turn bigint, document_id bigint, cards bigint"), visit).orderBy("place").collect()
    assert [(r.user_id, r.turn, r.starts_at) for r in found] == want and [r.place for r in found] == list(range(1, len(want) + 1))


def test_affine_lists_like_the_join(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([*range(9), None]), START + dt.timedelta(minutes=rng.randrange(90))) for i in range(300)]
    touches = spark.createDataFrame(rows, "event_id bigint, machine_id bigint, doc_id bigint, at timestamp")
    lists = affine_lists(touches)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # the touches are dealt once, their pairs never
    assert sorted(lists.collect()) == sorted(affine_documents(affine_touches(touches)).collect())


def test_lines_are_elements_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, "a b\n\n# One\n\nc\n\nd\n\nCHAPTER TWO\n\ne"), (2, "f"), (3, ""), (4, None)], "doc_id bigint, text string")
    rows = ig.line_elements(texts, F.col("content") == "d")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = [(0, "text", "a b", None), (1, "text", "# One", "One"), (2, "text", "c", "One"), (3, "code", "d", "One"), (4, "text", "CHAPTER TWO", "CHAPTER TWO"), (5, "text", "e", "CHAPTER TWO")]
    assert sorted((r.doc_id, r.pos, r.type, r.content, r.chapter) for r in rows.collect()) == [*((1, *w) for w in want), (2, 0, "text", "f", None)]


def test_affine_lists_at_the_ends_of_slices(spark, monkeypatch):
    monkeypatch.setattr(affinity, "TOUCHES_A_TASK", 50)
    monkeypatch.setattr(affinity, "_BATCH_BYTES", 200)
    rng = random.Random(6)
    zero, tick = dt.datetime(1969, 12, 31, 23), dt.timedelta(microseconds=1)
    times = [zero + dt.timedelta(minutes=rng.choice([0, 1, 14, 15, 16, 29, 30, 45, 60, 75])) + rng.choice([-1, 0, 0, 1]) * tick for _ in range(400)]
    rows = [(i if i % 7 else None, rng.randrange(2), rng.choice([-3, 5, 40, 10**12, *range(100, 160)]), t) for i, t in enumerate(times)]
    lists = affine_lists(spark.createDataFrame(rows, "event_id bigint, machine_id int, doc_id bigint, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp")))
    assert dict(lists.dtypes) == {"event_id": "bigint", "machine_id": "int", "n_affine": "bigint", "documents": "string"}
    assert "hashpartitioning(machine_id" in (plan := lists._jdf.queryExecution().executedPlan().toString()) and ", 8)" in plan and "REPARTITION_BY_NUM" in plan  # 400 touches in tasks of 50
    near = [sorted({d2 for _, m2, d2, t2 in rows if m2 == m and dt.timedelta(0) <= t - t2 <= dt.timedelta(minutes=15)}) for _, m, _, t in rows]
    want = [(e, m, len(n), ",".join(map(str, n))) for (e, m, _, _), n in zip(rows, near)]
    assert sorted(map(tuple, lists.collect()), key=str) == sorted(want, key=str)


def test_lists_of_a_busy_machine_are_small_files(spark, tmp_path):
    spark.range(3000).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, id div 3 * 0.9) AS ts", "id * 4 AS user_id", "'view' AS event_type", "1D AS value", "'{\"k\": 3}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(100000).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    QUERIES["affine_at_events"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = "event_id, machine_id, n_affine, documents"
    got = con.execute(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet' ORDER BY event_id").fetchall()
    assert got == con.execute(f"SELECT {columns} FROM ({ORACLE_SQL['affine_at_events']}) ORDER BY event_id").fetchall()
    text = sum(len(r[3]) for r in got)
    assert text > 20_000_000 and sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < text / 20


def test_a_session_keeps_the_codec_it_names(spark):
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "gzip")
    try:
        QUERIES["affine_at_events"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "gzip"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
