"""Formulas' escapes, marked runs, rotating pages, usage of model calls, the shared folder."""

import math
import types

import pytest
from pyspark.sql import functions as F

from lectern.functions.math_text import restored_commands, written_escapes
from lectern.operators import generate, layout
from lectern.operators.rotation import ranked, rotated
from lectern.operators.usage import log_usage, retries, thinking_tokens, usage_rows
from lectern.sources import shared


def test_written_escapes_leave_commands(spark):
    cases = {
        r"one\ntwo\tthree": "one\ntwo\tthree", r"\nu outside": "\nu outside", r"$\nu$": r"$\nu$", r"$a\nb$": "$a\nb$", r"$$\nabla\n\theta\t x$$": "$$\\nabla\n\\theta\t x$$", r"$\nub$": "$\nub$", r"$\not=$ and $\note$": "$\\not=$ and $\note$",
        r"cost $5\n and $6\n": "cost $5\n and $6\n", r"a $ b\n": "a $ b\n", r"$\$\nu$\n": "$\\$\\nu$\n", "": "", r"$$": "$$", r"\\n": "\\\n",
    }
    rows = spark.createDataFrame([(t, w) for t, w in cases.items()] + [(None, None)], "text string, want string").select("text", "want", written_escapes(F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in rows if r.got != r.want] == []


def test_commands_are_restored_in_formulas_only(spark):
    cases = {"$\times x$": r"$\times x$", "\times": "\times", "$\n P$": "$\n P$", "$\beta\rho\frac12\nu$": r"$\beta\rho\frac12\nu$", "$$\tau\n$$": "$$\\tau\n$$"}
    rows = spark.createDataFrame(list(cases.items()), "text string, want string").select("want", restored_commands(F.col("text")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows


def test_neighbours_of_one_style_share_their_marks(spark):
    runs = [(1, 1, 1, "a", True, False, "Bold "), (1, 1, 2, "b", True, False, "too "), (1, 1, 3, "a", False, False, "plain "), (1, 1, 4, "a", True, True, " both"), (1, 1, 5, "m", True, False, "code"), (1, 1, 6, "a", False, True, "  "), (1, 1, 7, "a", False, True, None), (1, 2, 1, "p", True, False, "x"), (1, 3, 1, "p", True, False, "y")]
    fonts = [(1, None, "a", "Times"), (1, None, "m", "ABCDEF+CourierNew"), (1, 2, "p", "Menlo"), (2, None, "a", "Courier")]
    df = spark.createDataFrame(runs, "doc_id int, page int, nth int, font string, bold boolean, italic boolean, text string")
    styled = layout.styled_runs(df, spark.createDataFrame(fonts, "doc_id int, page int, font string, family string"))
    assert styled.count() == len(runs)
    rows = {r.page: r.text for r in layout.marked_lines(styled, ["doc_id", "page"]).collect()}
    assert rows == {1: "**Bold too** plain  ***both***code  ", 2: "x", 3: "**y**"}


@pytest.mark.parametrize("size", [1, 3, 5])
def test_pages_rotate_like_a_client_that_leaves_out_what_it_had(spark, size):
    cards = [(u, c) for u in range(4) for c in range((0, 1, 5, 7)[u])]
    asked = [(u, k) for u in range(4) for k in range(-1, 16)]
    want = {}
    for u in range(4):
        left_out, page, rounds = [], 1, 0
        own = [c for x, c in sorted(cards, key=lambda x: -x[1]) if x == u]
        while own and page < 16:
            batch = [c for c in own if c not in left_out][:size]
            if not batch:
                left_out, rounds = [], rounds + 1
                continue
            want[u, page] = (rounds, batch)
            left_out += batch
            page += 1
    placed = ranked(spark.createDataFrame(cards, "user_id int, card_id int"), [F.desc("card_id")])
    found = {}
    for r in rotated(placed, spark.createDataFrame(asked, "user_id int, page int"), size).orderBy("user_id", "page", "nth").collect():
        found.setdefault((r.user_id, r.page), (r.rotation, []))[1].append(r.card_id)
    assert found == want and math.ceil(7 / size) <= 15


def test_usage_keeps_errors_and_thinking(spark, tmp_path, monkeypatch):
    class _Moody:
        name, model = "moody", "gemini-2.5-flash"

        def generate(self, prompt):
            if "late" in prompt:
                raise TimeoutError("fetch failed")
            if "bad" in prompt:
                raise ValueError("no such prompt")
            return (prompt.upper(), 10, 20, 5) if "think" in prompt else (prompt.upper(), 10, 20)

    monkeypatch.setitem(generate.PROVIDERS, "moody", _Moody)
    prompts = spark.createDataFrame([(1, 1, 1, "go"), (1, 1, 2, "think"), (1, 1, 3, "late"), (1, 2, 4, "bad")], "user_id bigint, document_id bigint, chunk_id bigint, prompt string")
    calls = prompts.withColumn("answer", generate.replies("moody")(F.col("prompt")))
    rows = usage_rows(calls, "card_generation", "moody")
    seen = log_usage(rows, f"file://{tmp_path}/log")
    assert (seen["calls"], seen["failed"], seen["prompt_tokens"], seen["thinking_tokens"]) == (4, 2, 20, 5)
    log = spark.read.parquet(f"file://{tmp_path}/log")
    found = {r.chunk_id: r for r in log.collect()}
    assert found[2].thinking_tokens == 5 and found[2].total_tokens == 35 and found[1].thinking_tokens is None and found[1].estimated_cost == pytest.approx((10 * 0.30 + 20 * 2.50) / 1e6)
    assert found[3].error == "TimeoutError: fetch failed" and found[3].estimated_cost is None
    assert {r.chunk_id: r.worth_retrying for r in retries(log).collect()} == {3: True, 4: False}
    assert spark.range(1).select(thinking_tokens(F.lit('{"thoughtsTokenCount": 12}')).alias("n"), thinking_tokens(F.lit("x")).alias("m")).head() == (12, None)


def test_a_log_that_cannot_be_written_fails_nothing(spark, tmp_path):
    (tmp_path / "log").write_text("a file where the folder should be")
    rows = spark.createDataFrame([], "error string, prompt_tokens bigint, completion_tokens bigint, thinking_tokens bigint, estimated_cost double")
    with pytest.warns(UserWarning, match="usage was not logged"):
        assert log_usage(rows, f"file://{tmp_path}/log") is None


def test_no_local_folder_on_a_cluster():
    def session(master, folder):
        conf = types.SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": folder, "spark.master": master}.get(key) or default)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getConf=lambda: conf, setCheckpointDir=lambda path: None))

    assert shared.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared.shared_dir(session("local[4]", None)).startswith("file:///tmp/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master, None))
