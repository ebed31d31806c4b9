"""Stems, and the stored index against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.stems import RULES, stem, stem_of
from lectern.operators import text_index
from lectern.operators.text_index import TextIndex, postings, write_index

PAIRS = {
    "running": "run", "runs": "run", "run": "run", "hopping": "hop", "hoping": "hope", "hope": "hope", "making": "make", "eating": "eat", "eats": "eat", "cities": "citi", "city": "citi", "caresses": "caress", "ponies": "poni", "agreed": "agree", "agree": "agree",
    "corpus": "corpus", "glass": "glass", "relational": "relat", "related": "relat", "conflated": "conflat", "organization": "organ", "organizing": "organ", "hopeful": "hope", "goodness": "good", "happily": "happili", "happy": "happi", "sky": "sky",
    "adjustment": "adjust", "adjusted": "adjust", "adoption": "adopt", "adopting": "adopt", "controlling": "control", "control": "control", "falling": "fall", "sing": "sing", "red": "red", "is": "is", "naïveté": "naïveté", "x1s": "x1s",
}


def test_words_of_one_stem_meet(spark):
    words = spark.createDataFrame([(w, s) for w, s in PAIRS.items()], "word string, want string").withColumn("stem", stem(F.col("word")))
    found = {r.word: r.stem for r in words.collect()}
    assert {w: s for w, s in found.items() if s != PAIRS[w]} == {}
    assert len(RULES) > 60


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(1, "The Running of the Runners", "X"), (2, "He runs", None), (3, "walks and WALKING, walked", "runic"), (4, None, None), (5, "", "the of and"), (None, "run", "run")]
    folder = f"file://{tmp_path_factory.mktemp('index')}"
    write_index(spark.createDataFrame(rows, "id bigint, title string, author string"), folder, "id", ["title", "author"])
    return TextIndex(spark, folder)


def test_postings_have_places(index):
    rows = {(r.key, r.term): r.places for r in index.postings.collect()}
    assert rows == {(1, "run"): [1], (1, "runner"): [4], (1, "x"): [5], (2, "run"): [1], (3, "walk"): [0, 2, 3], (3, "runic"): [4], (None, "run"): [0, 1]}


def test_searches(spark, index):
    queries = [(1, "running"), (2, "walk RUN"), (3, "the of"), (4, ""), (5, None), (6, "ru"), (7, "runner runs"), (8, "absent")]
    found = index.search(spark.createDataFrame(queries, "query_id int, query string")).collect()
    assert sorted((r.query_id, r.key, round(r.rank, 4)) for r in found) == [(1, 1, 0.3333), (1, 2, 0.5), (1, 3, 0.2), (2, 3, 0.8), (6, 1, 0.3333), (6, 2, 0.5), (6, 3, 0.2), (7, 1, 0.5)]


def test_prefixes_reach_the_files(index):
    plan = index.starting("run")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,run)" in plan and index.starting("run").count() == 5


def test_stems_of_single_words(spark):
    rng = random.Random(2)
    endings = ["", "s", "sses", "ies", "eed", "ed", "ing", "y", "ational", "ization", "iveness", "ful", "ement", "ion", "e", "ll", "ingly"]
    words = [*PAIRS, *("".join(rng.choice("aeiouybdlnrstwxz") for _ in range(rng.randrange(8))) + rng.choice(endings) for _ in range(3000)), "Run", "ran1", "\u0131ng", "\u00fcberings"]
    found = spark.createDataFrame([(w,) for w in words], "word string").withColumn("stem", stem(F.col("word"))).collect()
    assert [r.stem for r in found] == [stem_of(r.word) for r in found]


def test_postings_are_made_where_texts_lie(spark, monkeypatch):
    monkeypatch.setattr(text_index, "_WORDS", 7)  # cuts batches between texts; one of more words stays whole
    texts = [None, "", "the", "a cat and cats, Cat", "dogs " * 20, "x", "cat dog"] * 5
    rows = postings(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), "id", ["text"])
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {3: {"cat": [1, 3, 4]}, 4: {"dog": list(range(20))}, 5: {"x": [0]}, 6: {"cat": [0], "dog": [1]}}
    assert sorted((r.key, r.term, r.places) for r in rows.collect()) == sorted((i, t, p) for i in range(35) for t, p in want.get(i % 7, {}).items())
