"""Operators on small tables: documents, pages, contents, scheduling, streams."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import elements as el
from lectern.operators import gates, layout, scheduler, segment
from lectern.operators import events as ev
from lectern.operators.generate import PROVIDERS, generated_cards
from lectern.operators.html import SCHEMA, html_elements
from lectern.operators.search import search
from lectern.operators.toc import toc_labels
from lectern.streaming.sync import running_counters

WORDS = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew tea".split()


def prose(n, end="."):
    return " ".join(WORDS[i % len(WORDS)] for i in range(n)) + end


@pytest.fixture
def texts(spark):
    return lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string")


def _segments(texts, text):
    return segment.segments(texts(text)).orderBy("segment_index").collect()


def _chunks(texts, text, least=200, most=400):
    return segment.chunks(segment.segments(texts(text)), least=least, most=most).orderBy("chunk_index").collect()


def test_empty_texts_give_nothing(texts):
    assert segment.chunks(segment.segments(texts("", "  \n\n ", None))).count() == 0


def test_segments_carry_their_chapter(texts):
    rows = _segments(texts, "\n\n".join(["# Intro", prose(12), "short one", prose(15), "PART TWO", prose(20), "# PART TWO", prose(11)]))
    assert [(r.chapter, r.is_chapter_start, r.word_count) for r in rows] == [("Intro", True, 12), ("Intro", False, 15), ("PART TWO", True, 20), ("PART TWO", False, 11)]
    assert [r.segment_index for r in rows] == [0, 1, 2, 3]


def test_headings_start_chunks(texts):
    rows = _chunks(texts, "\n\n".join(["Chapter 1: One", prose(30), prose(30), "# Two", prose(30)]))
    assert [(r.chapter, r.word_count, r.chunk_index) for r in rows] == [("Chapter 1: One", 60, 0), ("Two", 30, 1)]
    assert rows[0].content == prose(30) + "\n\n" + prose(30)


def test_chunks_stay_within_bounds(texts):
    rows = _chunks(texts, "\n\n".join([prose(50)] * 20), 1, 400)
    assert [r.word_count for r in rows] == [400, 400, 200]
    assert [r.word_count for r in _chunks(texts, prose(199) + "\n\n" + prose(400))] == [599]


def _plain_chunks(counts, starts, least, most):
    out, open_ = [], 0
    for n, start in zip(counts, starts, strict=True):
        if start or n > most or (open_ + n > most and open_ >= least):
            open_ = 0
        if open_ == 0:
            out.append(0)
        out[-1] += n
        open_ = 0 if n > most else open_ + n
    return out


def test_packing_like_a_plain_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(30):
        counts = [rng.choice([10, 60, 150, 250, 390, 401, 700]) for _ in range(rng.randint(1, 25))]
        starts = [i == 0 or rng.random() < 0.15 for i in range(len(counts))]
        rows += [(d, i, n, s) for i, (n, s) in enumerate(zip(counts, starts, strict=True))]
        want[d] = _plain_chunks(counts, starts, 200, 400)
    parts = spark.createDataFrame(rows, "doc_id bigint, segment_index bigint, word_count bigint, is_chapter_start boolean")
    got = segment.packing(parts).join(parts, ["doc_id", "segment_index"]).groupBy("doc_id", "chunk").agg(F.sum("word_count").alias("n")).orderBy("doc_id", "chunk").collect()
    assert {d: [r.n for r in got if r.doc_id == d] for d in want} == want


def test_long_segments_are_cut_between_sentences(texts):
    long = " ".join(prose(90).capitalize() for _ in range(8))
    rows = _chunks(texts, prose(50) + "\n\n" + long + "\n\n" + prose(20))
    assert [r.word_count for r in rows] == [50, 360, 360, 20]
    assert " ".join(r.content for r in rows[1:3]) == long
    assert [r.word_count for r in _chunks(texts, prose(500))] == [500]


def test_windows_and_regrouping(spark):
    parts = spark.range(40).selectExpr("1L AS doc_id", "id AS segment_index", "concat('s', id) AS content", "1L AS word_count", "'c' AS chapter", "'en' AS language")
    shown = {w: sorted(r.segment_index for r in segment.windows(parts).collect() if r.window == w) for w in range(4)}
    assert shown == {0: list(range(15)), 1: list(range(12, 27)), 2: list(range(24, 39)), 3: list(range(36, 40))}
    replies = spark.createDataFrame([(1, 0, [[0, 1], list(range(2, 15))]), (1, 1, [[12, 13, 14, 15], list(range(16, 27))]), (1, 2, [list(range(24, 39))]), (1, 3, [[36, 37, 38], [39]])], "doc_id bigint, window bigint, groups array<array<int>>")
    rows = segment.regrouped(parts, replies).orderBy("chunk_index").collect()
    assert [r.word_count for r in rows] == [2, 13, 1, 11, 12, 1] and rows[0].content == "s0\n\ns1"


def _elements(spark, html):
    rows = html_elements(spark.createDataFrame([(1, html)], "page_id bigint, html string")).orderBy("pos").collect()
    return [tuple(x for x in (r.type, r.content, r.chapter, r.language, r.alt, r.file, r.anchor_id) if x is not None) for r in rows]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One <b>two</b> <i>three</i> <code>a b</code></p>", [("text", "One **two** *three* `a b`")]),
        ("<h1 id='c1'>Top</h1><p>x</p><h2>Low <em>er</em></h2><p>y</p>", [("text", "x", "Top", "c1"), ("text", "y", "Low *er*", "c1")]),
        ("<ul><li>a<li>b <ol><li>c</li></ol></li></ul><p>d</p>", [("text", "- a\n- b c\n\nd")]),
        ("<ol><li>a</li><li></li><li>b</li></ol>", [("text", "1. a\n2. b")]),
        ("<blockquote><p>q</p></blockquote>", [("text", "> q")]),
        ("<pre class='language-Python'>x = 1\n  y</pre>", [("code", "x = 1\n  y", "python")]),
        ("<pre><code class='sql'>SELECT</code></pre><pre> </pre>", [("code", "SELECT", "sql")]),
        ("<p>a <img src='i.png' alt=' z '> b</p>", [("text", "a b"), ("image", "z", "i.png")]),
        ("<script>var t='</p>';</script><nav><p>no</p></nav><style>p{}</style><p>yes", [("text", "yes")]),
        ("<p>one<p>two<div>plain<p>three</p></div>", [("text", "one\n\ntwo\n\nthree")]),
        ("<p><b>one<p>two</b> three", [("text", "**one**\n\n**two** three")]),
        ("<html><head><title>t</title></head><body>  </body></html>", []),
        ("", []),
        (None, []),
    ],
)
def test_html(spark, html, want):
    assert _elements(spark, html) == want


def test_contents_labels(spark):
    cases = {
        "Title Page|0 Dedication|0 One|0 Acknowledgments|1 Two|0 Index|0": "front front main main main back",
        "Preface|0 A note|1 One|0": "front front main",
        "One|0 Appendix A|0 Data|1 Deeper|2 B|0": "main back back back main",
        "Foreword|0 Index|1 One|0 Preface|0": "front back main main",
        "": "",
    }
    for toc, want in cases.items():
        entries = [(t.rpartition("|")[0], int(t[-1])) for t in re.findall(r"\S.*?\|\d", toc)]
        row = spark.createDataFrame([(entries,)], "toc array<struct<title:string,level:int>>")
        assert row.select(toc_labels(F.col("toc")).alias("v")).head()["v"] == want.split()


def _rows(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([(1, *(r.get(n) for n in names)) for r in rows], f"doc_id bigint, {SCHEMA}")


def test_merged_and_folded_code(spark):
    rows = [{"pos": 0, "type": "code", "content": "a", "chapter": "x"}, {"pos": 1, "type": "code", "content": "b", "chapter": "x"}, {"pos": 2, "type": "code", "content": "c", "chapter": None}, {"pos": 3, "type": "code", "content": "d", "chapter": None}, {"pos": 4, "type": "text", "content": "t"}, {"pos": 5, "type": "text", "content": "u"}]
    got = el.merged_code(_rows(spark, rows)).orderBy("pos").collect()
    assert [(r.pos, r.content) for r in got] == [(0, "a\nb"), (2, "c\nd"), (4, "t"), (5, "u")]
    chunks = [(1, 0, "code", "k", 5, ["i0"]), (1, 1, "code", "l", 5, ["i1"]), (1, 2, "text", "t", 9, ["i2"]), (1, 3, "code", "m", 5, []), (1, 4, "code", "big", 80, []), (1, 5, "code", "n", 5, []), (1, 6, "image", "", 0, [])]
    folded = el.folded_code(spark.createDataFrame(chunks, "doc_id bigint, pos int, chunk_type string, content string, word_count int, images array<string>")).orderBy("pos").collect()
    block = lambda c: f"\n\n```\n{c}\n```\n\n"
    assert [(r.pos, r.content, r.word_count, r.images) for r in folded] == [(0, "k", 5, ["i0"]), (2, block("l") + "t" + block("m"), 19, ["i2", "i1"]), (4, "big", 80, []), (5, "n", 5, []), (6, "", 0, [])]


def test_pages_and_contents(spark):
    rows = _rows(spark, [{"pos": i, "type": t, "chapter": c, "spine_index": s, "anchor_id": a} for i, (t, c, s, a) in enumerate([("text", "Page 1", 1, None), ("image", None, 1, "a"), ("text", "page 3", 2, "a"), ("code", "Page 4", 2, "b"), ("text", None, 3, "c")])])
    at = lambda df: [r.pos for r in df.orderBy("pos").collect()]
    assert at(el.in_pages(rows, F.lit(".pdf"), F.lit(1), F.lit(1))) == [0, 1, 4] and at(el.in_pages(rows, F.lit(".epub"), F.lit(2), F.lit(3))) == [2, 3, 4] and at(el.in_pages(rows, F.lit(".txt"), F.lit(9), F.lit(9))) == [0, 1, 2, 3, 4]
    ranges = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, page int, end_page int, fragment string, end_fragment string")
    ext = lambda e: spark.createDataFrame([(1, e)], "doc_id bigint, ext string")
    assert at(el.selected_by_toc(rows, ranges((1, 3, 3, None, None)), ext(".pdf"))) == [2]
    assert at(el.selected_by_toc(rows, ranges((1, 1, 1, None, None)), ext(".pdf"))) == [0, 1]
    assert at(el.selected_by_toc(rows, ranges((1, 2, 2, "a", "b")), ext(".epub"))) == [2]
    assert at(el.selected_by_toc(rows, ranges((1, 2, 2, "missing", None)), ext(".epub"))) == [2, 3]
    assert el.page_counts(rows, ext(".epub")).head()["pages"] == 3 and el.page_counts(rows, ext(".pdf")).head()["pages"] == 3


def test_figures(spark):
    rows = _rows(spark, [{"pos": i, "type": t, "chapter": c, "alt": a, "file": f} for i, (t, c, a, f) in enumerate([("image", None, "figure on page 2", None), ("image", None, "page 2 again", None), ("text", "Page 1", None, None), ("image", None, "page 5", "kept.png"), ("text", "Page 4", None, None)])])
    figures = spark.createDataFrame([(1, 2, 0, "f2a", "2a", "m"), (1, 2, 1, "f2b", "2b", "m"), (1, 3, 0, "f3", "3", "m"), (1, 9, 0, "f9", "9", "m")], "doc_id bigint, page int, nth int, alt string, file string, mime string")
    got = el.with_figures(rows, figures).orderBy("pos").collect()
    assert [r.file or r.chapter for r in got] == ["2a", "2b", "Page 1", "kept.png", "3", "Page 4", "9"] and [r.pos for r in got] == list(range(7))


def test_front_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, None), (1, 1, "Preface"), (1, 2, " ONE "), (1, 3, "Preface"), (2, 0, "x")], "doc_id bigint, pos int, chapter string")
    titles = spark.createDataFrame([(1, "One")], "doc_id bigint, title string")
    assert sorted((r.doc_id, r.pos) for r in el.front_chunks(chunks, titles).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_layout(spark):
    runs = [(1, i, *r) for i, r in enumerate([(100, 18.0, False, "A Heading"), (130, 12.0, False, "first "), (132, 12.0, True, "x"), (150, 12.0, False, "second"), (210, 12.0, False, "third"), (230, 12.0, True, "code()"), (250, 12.0, True, "more()")])]
    lines = layout.merged_runs(spark.createDataFrame(runs, "page int, nth int, top int, font_size double, is_mono boolean, text string"), ["page"])
    assert [(r.top, r.is_mono, r.text) for r in lines.orderBy("line").collect()] == [(100, False, "A Heading"), (130, False, "first x"), (150, False, "second"), (210, False, "third"), (230, True, "code()"), (250, True, "more()")]
    assert layout.paragraph_text(lines.where("NOT is_mono"), ["page"]).head()["text"] == "## A Heading\n\nfirst x second\n\nthird"
    assert [(r.type, r.content) for r in layout.code_and_prose(lines, ["page"]).orderBy("block").collect()] == [("text", "## A Heading\n\nfirst x second\n\nthird"), ("code", "code()\nmore()")]


def test_mastery(spark):
    cards = spark.createDataFrame([(1, 1, 1, "quiz"), (1, 2, 1, "discover"), (1, 3, 2, "discover"), (1, 4, 2, "passage"), (1, 5, 3, "passage"), (1, 6, None, "quiz")], "user_id int, card_id int, chunk_id int, card_type string")
    scores = spark.createDataFrame([(1, 1, 3, 0), (1, 3, 0, 3), (1, 5, 0, 4), (1, 6, 9, 9)], "user_id int, card_id int, sr_repetition int, times_engaged int")
    assert sorted(r.card_id for r in gates.not_mastered(cards, gates.chunk_mastery(cards, scores)).collect()) == [3, 4, 6]


def test_actions_toggle(spark):
    rows = spark.sql("SELECT 1 AS user_id, * FROM VALUES (1, 'like', 1), (1, 'like', 2), (1, 'like', 3), (2, 'like', 4), (2, 'like', 5), (2, 'dismiss', 6) t(card_id, action, s)").withColumn("created_at", F.timestamp_seconds("s"))
    assert sorted((r.card_id, r.action) for r in ev.active_actions(rows).collect()) == [(1, "like"), (2, "dismiss")]


def test_likes_are_reviews_of_the_best_grade(spark):
    cards = spark.sql("SELECT 1 AS user_id, 1 AS card_id, 'quiz' AS card_type UNION ALL SELECT 1, 2, 'passage'")
    actions = spark.sql("SELECT 1 AS user_id, id AS card_id, id AS event_id, current_timestamp() AS created_at, 'like' AS action FROM range(1, 3)")
    assert [(r.card_id, r.grade) for r in ev.liked_reviews(actions, cards).collect()] == [(1, 5)]


def _plain_turns(docs, budget):
    first = min(docs, key=lambda d: (d[1], d[2], d[0]))
    state = {d[0]: [d[2], d[3], 3 if d is first else 1] for d in docs}
    out = []
    while budget > 0 and any(a for _, a, _ in state.values()):
        key = min((k for k in state if state[k][1]), key=lambda k: (state[k][0], k))
        n = min(10, state[key][1], budget)
        out.append((key, n))
        state[key][0] += 10 / state[key][2]
        state[key][1] -= min(10, state[key][1])
        budget -= n
    return out


def test_fair_turns_like_a_plain_loop(spark):
    rng = random.Random(11)
    names = ["pinned", "active", "normal"]
    docs = {u: [(d, rng.randrange(3), float(rng.randrange(5)), rng.randrange(0, 60)) for d in range(rng.randint(1, 6))] for u in range(12)}
    rows = [(u, d, names[p], v, a) for u, x in docs.items() for d, p, v, a in x]
    budget = {u: rng.choice([0, 7, 40, 100]) for u in docs}
    got = scheduler.turns(spark.createDataFrame(rows, "user_id int, document_id int, priority string, virtual_time double, available int"), spark.createDataFrame(list(budget.items()), "user_id int, budget int")).orderBy("user_id", "turn").collect()
    assert {u: [(r.document_id, r.cards) for r in got if r.user_id == u] for u in docs} == {u: _plain_turns(docs[u], budget[u]) for u in docs}


def test_errors_and_states(spark):
    errors = ["process exited 137", "Rate Limit reached", "HTTP 503", "bad file", "ECONNRESET"]
    rows = spark.createDataFrame([(e,) for e in errors], "e string")
    assert [r.v for r in rows.select(scheduler.is_transient(F.col("e")).alias("v")).collect()] == [True, True, True, False, True]
    status = lambda r: scheduler.status_after_error(F.lit("chunking"), F.col("e"), F.lit(r))
    assert [r.v for r in rows.select(status(0).alias("v")).collect()][3] == "error" and rows.select(status(3).alias("v")).head()["v"] == "error" and rows.select(status(2).alias("v")).head()["v"] == "chunking"


def test_virtual_times_are_lowered_when_large(spark):
    users = spark.createDataFrame([(1, "plus", 20000.0), (2, "free", 20010.0)], "user_id int, tier string, virtual_time double")
    made = spark.createDataFrame([(1, 10)], "user_id int, made int")
    assert sorted((r.user_id, r.virtual_time) for r in scheduler.advanced(users, made).collect()) == [(1, 0.0), (2, 5.0)]


def test_search(spark):
    rows = spark.createDataFrame([(1, "War and Peace", "Tolstoy"), (2, "Peace", None), (3, "Warfare; Étude", "x")], "id int, title string, author string")
    found = lambda q: sorted(r.id for r in search(rows, q, ["title", "author"]).collect())
    assert found("war pea") == [1] and found("étu") == [3] and found("") == [] and found("WAR") == [1, 3]


def test_a_model_that_fails_costs_no_row(spark):
    class Broken:
        name = model = "broken"

        def generate(self, prompt):
            raise RuntimeError("down")

    PROVIDERS["broken"] = Broken
    chunks = spark.sql("SELECT 1L AS doc_id, 0 AS pos, 'text' AS chunk_type, 'some text' AS content, 'en' AS language, 't' AS title, array('quiz') AS card_types, cast(array() AS array<struct<alt:string>>) AS images, cast(array() AS array<string>) AS summaries")
    assert generated_cards(chunks, "broken").count() == 0
    assert [r.card_type for r in generated_cards(chunks).collect()] == ["quiz"]


def test_a_stream_counts_like_a_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS event_id", "id % 3 AS user_id", "id % 5 AS card_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS created_at", "id * 37 % 6000 AS dwell_ms", "false AS was_sr_due", "id % 9 AS self_grade", "cast(null AS bigint) AS quiz_selected_index")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = running_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("counted")) == key(ev.counters(ev.classified(rows)))


def test_pages_nest_to_any_depth():
    from lectern.operators.html import Reader

    deep = "<div>" * 20_000 + "<p>a<b>b<i>c</i></b></p>" + "</div>" * 20_000 + "<p>x<code>y<b>z</b></code></p>" + "<b>" * 3_000 + "<p>m"
    found = Reader().read(deep)
    assert [x["type"] for x in found] == ["text"] and found[0]["content"].startswith("a**b*c***\n\nx`yz`")


def test_page_bounds_and_sets(spark):
    from lectern.operators.visibility import on_new_pages, own_through_parent, toggled

    toc = spark.createDataFrame([(1, 0, 3, 0), (1, 1, 5, 1), (1, 2, 5, 0), (1, 3, 9, 2), (2, 0, 1, 0)], "doc_id int, idx int, page int, level int")
    total = spark.createDataFrame([(1, 20), (2, 7)], "doc_id int, total_pages int")
    assert sorted(map(tuple, el.page_bounds(toc, total, F.col("idx") < 2).collect())) == [(1, 3, 4), (2, 1, 7)]
    assert [tuple(r) for r in el.page_bounds(toc, total, F.col("idx") == 3).collect()] == [(1, 9, 20)]
    sets = spark.createDataFrame([([1, 2, None], [2, 3]), ([], [1]), ([], [])], "a array<int>, b array<int>")
    assert [sorted(r[0]) for r in sets.select(toggled(F.col("a"), F.col("b"))).collect()] == [[1, 3], [1], []]
    cards = spark.createDataFrame([(1, 4), (1, 4), (1, 5), (2, 4)], "user_id int, page int")
    assert sorted(map(tuple, on_new_pages(cards, cards.where("user_id = 1 AND page = 5")).collect())) == [(1, 4), (2, 4)]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    parents = spark.createDataFrame([(1, 7, True), (2, 8, True), (3, 8, False)], "k int, user_id int, public boolean")
    found = own_through_parent(rows, parents, spark.createDataFrame([(7,)], "user_id int"), "k")
    assert sorted((r.k, r.reader) for r in found.collect()) == [(1, 7), (2, None)]


def test_references_that_were_cut(spark):
    pages = spark.createDataFrame([(1, "<h1>a &amp; b &amp</h1><p>c && d &lt;e&gt &#x27;f&#39 &notit; &copy=1</p>")], "page_id bigint, html string")
    row = html_elements(pages, lenient=False).head()
    assert (row["chapter"], row["content"]) == ("a & b &amp", "c && d <e&gt 'f&#39 &notit; &copy=1")
    assert html_elements(pages).head()["chapter"] == "a & b &"


def test_a_line_of_just_the_heading_size_is_none(spark):
    lines = spark.createDataFrame([(1, 0, 10, 12.0, False, "body text of many letters"), (1, 1, 30, 14.4, False, "no heading"), (1, 2, 50, 14.5, False, "a heading")], "page int, line int, top int, font_size double, is_mono boolean, text string")
    assert layout.paragraph_text(lines, ["page"]).head()["text"] == "body text of many letters no heading\n\n## a heading"


def test_contents_are_dealt_once(spark, tmp_path):
    texts = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven\n\n" * 30) for i in range(4)], "doc_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no side were small
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = segment.chunks(segment.segments(texts))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and made.count() == 4
        parts = spark.createDataFrame([(k, i, f"{k}-{i}", 5, None, "en") for k in range(3) for i in range(4)], "doc_id bigint, segment_index bigint, content string, word_count bigint, chapter string, language string")
        replies = spark.createDataFrame([(k, 0, [[0, 9], [1, 2], [8]]) for k in range(2)], "doc_id bigint, window bigint, groups array<array<int>>")
        found = segment.regrouped(parts, replies)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one of each side
        assert sorted((r.doc_id, r.content, r.word_count) for r in found.collect()) == [(k, c, n) for k in range(2) for c, n in ((f"{k}-0", 5), (f"{k}-1\n\n{k}-2", 10))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_model_gets_a_few_megabytes_at_a_time(spark, monkeypatch):
    class Counting:
        model = "counting"

        def generate(self, prompt):
            import sys

            batch = sys._getframe(1).f_locals["batch"]
            return json.dumps([{"type": "discover", "content": {"title": "t", "body": str(batch.nbytes)}}]), 1, 1

    monkeypatch.setitem(PROVIDERS, "counting", Counting)
    chunks = spark.range(1500).coalesce(1).selectExpr("id AS doc_id", "0 AS pos", "'text' AS chunk_type", "repeat('word ', 4000) AS content", "'en' AS language", "'b' AS title", "array('discover') AS card_types", "CAST(array() AS array<struct<alt:string>>) AS images", "CAST(array() AS array<string>) AS summaries")
    most = generated_cards(chunks, "counting").select(F.max(F.get_json_object("content", "$.body").cast("bigint"))).head()[0]
    assert 0 < most < 8 << 20
