"""Whole texts through the parsing of replies, against plain Python."""

import hashlib

from pyspark.sql import functions as F

from lectern.functions.cards import reply_cards
from lectern.plans.catalog import QUERIES

TEXTS = ["a\\b and \\frac{1}{2}", "\\", 'say "hi"\\', "line\nnext\ttab\r\x01\x00", "```json\n[1]\n```", "\\u0041 \\n \\\\", "[{]} 😀é", "", "x", ("long \\theta \"é\" [1]\n" * 20_000)]


def _folder(spark, path):
    spark.createDataFrame([(0, k, "user", t) for k, t in enumerate(TEXTS)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_whole_turns_come_back(spark, tmp_path):
    got = {(r.turn, r.nth): (r.card_type, r.n_chars, r.body) for r in QUERIES["whole_parsed_replies"](spark, _folder(spark, tmp_path)).collect()}
    want = lambda t: (len(t), hashlib.md5((t + r" $\frac{1}{2}$ \theta").encode()).hexdigest())
    assert got == {(k, n): (kind, *want(t)) for k, t in enumerate(TEXTS) for n, kind in enumerate(("discover", "quiz"))}


def test_first_characters_keep_backslashes(spark, tmp_path):
    got = {(r.turn, r.nth): r.body for r in QUERIES["parsed_replies"](spark, _folder(spark, tmp_path)).collect()}
    assert got == {(k, n): t.replace("\n", " ").replace('"', "")[:10] for k, t in enumerate(TEXTS) for n in (0, 1)}


def test_short_escapes_stay_as_written(spark):
    """By to_json a tab is a backslash and a letter, which could be a formula's: it is kept so."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS) if "```" not in t and "\x01" not in t], "k int, text string")
    reply = F.concat(F.lit('[{"type": "quiz", "content": '), F.to_json(F.struct("text")), F.lit("}]"))
    found = rows.select("k", F.get_json_object(reply_cards(reply, F.array(F.lit("quiz")))[0]["content"], "$.text").alias("body"))
    assert {r.k: r.body for r in found.collect()} == {k: t.replace("\n", "\\n") for k, t in enumerate(TEXTS) if "```" not in t and "\x01" not in t}
