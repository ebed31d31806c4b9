"""Copies of catalogue books, sums along an order, marks, shuffles, names and label differences on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lectern.functions.cards import shuffled
from lectern.functions.scores import own_grade
from lectern.operators import copies as cp
from lectern.operators import numbering, scheduler
from lectern.operators.events import dwell_times, marked
from lectern.operators.search import names_with
from lectern.operators.toc import label_differences
from lectern.plans.library import sampled


def test_running_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SPAN", 7)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(5)) for i in rng.sample(range(-50, 200), 150)] + [("a", None, 2)]
    got = {(r.k, r.o): (r.s, r.s_total) for r in numbering.running_sums(spark.createDataFrame(rows, "k string, o bigint, x int"), ["k"], "o", s=F.col("x")).collect()}
    assert len(got) == len(rows)
    for k, o, _ in rows:
        same = [r for r in rows if r[0] == k]
        up_to = [r for r in same if r[1] is None or (o is not None and r[1] <= o)]
        assert got[k, o] == (sum(r[2] for r in up_to), sum(r[2] for r in same))


def test_numbering_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SPAN", 5)
    fronts = [i % 3 == 0 for i in range(40)]
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate(fronts)], "doc_id bigint, pos bigint, f boolean")
    got = [r.pos for r in scheduler.main_first(rows, F.col("f"), 4).orderBy("nth").collect()]
    main, front = [i for i in range(40) if not fronts[i]], [i for i in range(40) if fronts[i]]
    assert got == main[:4] + front + main[4:]
    # Fewer rows of the main matter than come first, and a front that is not known.
    few = spark.createDataFrame([(1, 0, True), (1, 1, None), (1, 2, True)], "doc_id bigint, pos bigint, f boolean")
    assert [r.pos for r in scheduler.main_first(few, F.col("f"), 4).orderBy("nth").collect()] == [1, 0, 2]
    assert [r.i for r in sampled(rows, ["doc_id"], "pos", 4).orderBy("i").collect()] == [0, 10, 20, 30]


def test_copies(spark):
    wishes = spark.createDataFrame([(1, 9, 10, ["quiz", "discover"], 2), (1, 9, 11, ["quiz"], 1), (2, 9, 12, ["quiz"], 1), (3, 9, 13, ["quiz"], 1), (3, 8, 14, ["quiz"], 1)], "user_id int, book_id int, document_id int, card_types array<string>, chunk_interval int")
    owned = spark.createDataFrame([(3, 9)], "user_id int, book_id int")
    new = cp.new_wishes(wishes, owned)
    assert sorted(r.document_id for r in new.collect()) == [10, 12, 14]
    chunks = spark.createDataFrame([(9, 100 + i, i, "image" if i == 1 else "code" if i == 3 else "text") for i in range(6)], "book_id int, chunk_id int, chunk_index int, chunk_type string")
    there = spark.createDataFrame([(12, 4), (12, 2)], "document_id int, chunk_index int")
    copied = cp.copied_chunks(new, chunks, there)
    assert sorted(map(tuple, copied.select("document_id", "catalog_chunk_id", "chunk_index").collect())) == [(10, 100, 0), (10, 103, 1), (10, 105, 2), (12, 100, 5), (12, 102, 6), (12, 103, 7), (12, 104, 8), (12, 105, 9)]
    assert copied.where("document_id = 10").select("chunk_index").exceptAll(cp.copied_chunks(new, chunks).where("document_id = 10").select("chunk_index")).count() == 0
    cards = spark.createDataFrame([(c, t) for c in (100, 102, 103, 104, 105) for t in ("quiz", "passage")] + [(100, "discover")], "chunk_id int, card_type string")
    taken = cp.copied_cards(new, copied, cards)
    assert {tuple(r) for r in cp.copy_status(new, copied, taken).collect()} == {(10, 3, 4, "generating"), (12, 5, 5, "ready"), (14, 0, 0, "ready")}
    nothing = wishes.limit(0)
    assert cp.copy_status(nothing, cp.copied_chunks(nothing, chunks), taken).count() == 0


def test_marks_are_used_once(spark):
    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    shown = spark.createDataFrame([(1, 5, 10, t(10)), (1, 5, 20, t(20)), (1, 5, 30, t(30)), (1, 6, 40, t(10))], "user_id int, card_id int, event_id int, created_at timestamp_ntz")
    marks = [(1, 5, 1, t(1), 2, False), (1, 5, 2, t(2), 4, True), (1, 5, 3, t(20), None, True), (1, 5, 4, t(40), 5, None), (1, 6, 5, t(11), 1, True)]
    got = marked(shown, spark.createDataFrame(marks, "user_id int, card_id int, event_id int, created_at timestamp_ntz, self_grade int, revealed boolean"))
    grades = got.select("event_id", own_grade(F.col("self_grade"), F.lit(None), F.col("revealed")).alias("g")).collect()
    assert {r.event_id: r.g for r in grades} == {10: 4, 20: 3, 30: None, 40: None}
    chosen = spark.range(1).select(own_grade(F.lit(None).cast("int"), F.lit(2), F.lit(True)).alias("g")).head().g
    assert chosen is None


def test_shuffled(spark):
    rows = spark.range(400).select("id", shuffled(F.array(*map(F.lit, "abcd")), F.col("id").cast("string")).alias("o")).collect()
    assert all(sorted(r.o) == [0, 1, 2, 3] for r in rows) and len({tuple(r.o) for r in rows}) == 24
    assert {r.o.index(0) for r in rows} == {0, 1, 2, 3}
    assert spark.range(1).select(shuffled(F.array().cast("array<string>"), F.lit("x")).alias("o")).head().o == []


def test_names_and_labels(spark):
    names = spark.createDataFrame([(1, "Old Tea"), (2, "TEAM"), (3, "Ink"), (4, None), (5, "tea")], "k int, name string")
    members = spark.createDataFrame([(5,), (None,)], "k int")
    assert sorted(r.k for r in names_with(names, "name", "tEa", members, "k").collect()) == [1, 2]
    assert sorted(r.k for r in names_with(names, "name", "", members, "k").collect()) == [1, 2, 3]
    first = spark.createDataFrame([(1, "main"), (2, "front"), (3, None), (4, None)], "k int, l string")
    second = spark.createDataFrame([(1, "main"), (2, "back"), (3, "main"), (4, None)], "k int, l string")
    assert {tuple(r) for r in label_differences(first, second, ["k"], "l").collect()} == {(2, "front", "back"), (3, None, "main")}


def test_dwell_over_hours(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([7, 7, 8, None]), i, start + dt.timedelta(minutes=rng.randrange(600))) for i in range(200)]
    rows += [(3, 7, 500, start), (3, 7, 501, start + dt.timedelta(hours=9)), (3, 8, 502, start + dt.timedelta(hours=20))]
    want = {}
    for user in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[3], r[2]))
        changes = [r for i, r in enumerate(mine) if i == 0 or r[1] != mine[i - 1][1]]
        for r, after in zip(changes, [*changes[1:], None]):
            want[r[2]] = after and round((after[3] - r[3]).total_seconds() * 1000)
    owners = spark.createDataFrame(rows, "user_id int, card_id int, event_id int, created_at timestamp_ntz")
    assert {r.event_id: r.dwell_ms for r in dwell_times(owners).collect()} == want
    assert dwell_times(owners.limit(0)).count() == 0
