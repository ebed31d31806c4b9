"""Column functions, value by value."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import cards, paths, scores
from lectern.functions import text as tx
from lectern.streaming.sync import reviewed

PROSE = "The river ran past the old mill and under a low stone bridge."


@pytest.fixture
def value(spark):
    """The value of a function of one literal."""

    def get(make, *literals):
        cells = [F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for x in literals]
        return spark.range(1).select(make(*cells).alias("v")).head()["v"]

    return get


@pytest.fixture
def values(spark):
    """The values of a function for each of some texts."""

    def get(make, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]

    return get


def test_paragraphs_and_words(values):
    assert values(tx.paragraphs, ["a\n\n b \r\n\r\n\n\nc", " \n\n ", "", None]) == [["a", "b", "c"], [], [], None]
    assert values(tx.count_words, ["a  b c d\n", "", "  ", "x​y"]) == [4, 0, 0, 1]


def test_headings(values):
    found = {
        "# One": "One", "### Two words ": "Two words", "Chapter 1: A start": "Chapter 1: A start", "PART ONE": "PART ONE", "epilogue": "epilogue", "E = MC² here": None, "E = MC²": None, "DNA is": None, "DNA": None, "": None,
        "chapter " + "x" * 80: None, "Part of it is prose": "Part of it is prose", "ÜBER ALLES\nand more": "ÜBER ALLES", "TWO WORDS " + "X" * 60: None, "ORDINARY Sentence": None,
    }
    assert values(tx.heading, list(found)) == list(found.values())


def test_noise_and_language(values):
    layout = "Output\n\n   CAR       PERSON   ANIMAL    TREE   HOUSE"
    assert values(tx.is_layout_noise, [PROSE, layout, "a\nb\nc d\ne f g", "", PROSE + "    " + PROSE]) == [False, True, True, True, False]
    assert values(tx.is_figure_noise, [PROSE * 3, "x\ny\nz\n1 2", "", "a" * 40 + "\n" + "b" * 40 + "\n" + "c" * 30]) == [False, True, True, True]
    assert values(tx.language, ["धर्मक्षेत्रे कुरुक्षेत्रे", PROSE, "", PROSE + " धर्म", None]) == ["sa", "en", "en", "en", None]


def test_sentences(values):
    assert values(tx.sentences, ["He saw Dr. Smith. He left! why? Then. no", "One.  Two. Three", "", "A. B. C"]) == [["He saw Dr.", "Smith.", "He left! why?", "Then. no"], ["One.  Two.", "Three"], [], ["A.", "B.", "C"]]


def test_pages(values):
    page = "7\n" + PROSE + "\n" + PROSE + "\n 42 "
    assert values(tx.without_page_numbers, [page, "12", "1\n2", "3\n\n4"]) == [PROSE + "\n" + PROSE, "", "", ""]
    assert values(tx.clean_page, [page, "too short", "12"]) == [PROSE + "\n" + PROSE, "", ""]


def test_fonts_and_code_languages(values):
    assert values(tx.is_mono_font, ["EBBBMO+Courier", "EBANNE+Sabon", "Fira Code", None]) == [True, False, True, None]
    assert values(tx.code_language, ["language-Python x", "sourceCode rust", "hl js", "note SQL", "highlight-js", "lang-", None]) == ["python", "rust", None, "sql", "js", None, None]


def test_replies(spark, values, value):
    assert values(tx.protected_escapes, [r"a\theta \\n \"q\" \/ é \x"]) == [r"a\\theta \\n \"q\" \/ é \\x"]
    types = F.array(F.lit("discover"), F.lit("quiz"))
    found = values(lambda t: cards.reply_cards(t, types), ['```json\n[{"type":"discover","content":{"body":"$\\theta$"}}]\n```', 'Sure: [{"type":"quiz","content":{"q":[1]}},{"type":"glossary","content":{}},{"type":"quiz","content":[1]},{"type":"quiz"},7] done', "none", '{"type":"quiz","content":{}}', "[]", "[1,"])
    assert [[(c.card_type, c.content) for c in x] for x in found] == [[("discover", '{"body":"$\\\\theta$"}')], [("quiz", '{"q":[1]}')], [], [], [], []]
    groups = values(lambda t: cards.reply_groups(t, F.lit(2), F.lit(5)), ["[[4,5],[2]]", "```json\n[[2,3,4,5]]```", "[[2,9]]", "no", "[]", '{"a":1}', "[[5,2]]"])
    own = [[2], [3], [4], [5]]
    assert groups == [[[2], [3], [4, 5]], [[2, 3, 4, 5]], own, own, own, own, [[3], [4], [5, 2]]]
    labels = values(lambda t: cards.reply_labels(t, F.lit(2), F.array(F.lit("f"))), ['["front","main"]', '```json\n["main","back"]\n```', '["main"]', '["main","side"]', "oops"])
    assert labels == [["front", "main"], ["main", "back"], ["f"], ["f"], ["f"]]
    assert value(cards.gathered, ["a", "b"], [1, 5, -1, 0]) == ["b", "a"]
    assert values(cards.image_indices, ['{"images":[0,2]}', '{"a":1}', None]) == [[0, 2], [], []]


def test_cards_in_words(values, value):
    made = lambda kind: lambda c: cards.summary(F.lit(kind), c)
    assert values(made("discover"), ['{"body":"b\\nc"}', '{"title":"t","body":"b"}']) == ["discover: b c", "discover: t"]
    assert values(made("contrast"), ['{"itemA":"a","itemB":"' + "b" * 40 + '"}']) == ["contrast: a vs " + "b" * 30 + "…"]
    assert values(made("other"), ["{}"]) == ["other: (card)"]
    assert value(cards.strategy, "note", "casual").card_types == ["discover", "raw_commentary", "flashcard"] and value(cards.strategy, "fiction", "study").chunk_interval == 2
    assert value(cards.described, [], 1).startswith("No cards") and value(cards.described, ["quiz"], 4) == "Quiz cards, every 4th passage"


def test_prompts(spark):
    chunk = F.struct(F.lit("x = 1").alias("content"), F.lit("code").alias("chunk_type"), F.lit("python").alias("language"))
    before = F.struct(F.lit("").alias("content"), F.lit("image").alias("chunk_type"), F.lit(None).cast("string").alias("language"))
    made = cards.prompt(chunk, before, F.lit(None).cast("string"), F.array(F.lit("quiz")), F.array(F.lit("a graph")), F.array(F.lit("quiz: y")))
    text = spark.range(1).select(made.alias("p")).head()["p"]
    assert text.startswith("[An image came before: no description]") and '"Untitled"' in text and "```python\nx = 1\n```" in text and "[0] a graph" in text and "  - quiz: y" in text and "Types: quiz" in text


def test_small_texts(values):
    assert values(tx.listed, ["a; b;;  ;c", ""]) == [["a", "b", "c"], []]
    assert values(tx.clean_title, ["A\r\nB ", "  ", None]) == ["A B", "Untitled", "Untitled"]
    assert values(tx.parsed_size, ["1.5K", "2M", "17", "3GB", "x"]) == [1536, 2097152, 17, 3221225472, None]
    assert values(tx.escaped_html, ['<a href="x">&']) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert tx.query_prefixes(" War, & Peace ") == ["war", "peace"]


def test_paths(values, value):
    assert values(paths.extension, ["/a/b.TXT", "x.tar.gz", ".hidden", "none"]) == ["txt", "gz", "", ""]
    assert values(paths.title_of, ["/a/the_old-book.epub"]) == ["the old book"]
    assert values(paths.media_type, ["a.JPG", "b"]) == ["image/jpeg", "application/octet-stream"]
    assert value(paths.resolved, "OEBPS/text", "../img/./a.png") == "OEBPS/img/a.png"
    assert value(paths.is_own, "u1/x.png", "u1") and not value(paths.is_own, "u12/x.png", "u1")


def test_engagement_and_grades(values, spark):
    assert values(lambda t: scores.engagement(t.cast("int")), ["1499", "1500", "3999", "4000"]) == ["scrolled_past", "glanced", "glanced", "engaged"]
    rows = spark.createDataFrame([(7, 1, 1, True, 100), (2, 1, 1, True, 100), (None, 1, 1, True, 100), (None, 0, 1, True, 9000), (None, 1, 1, False, 2000), (None, None, 1, True, 4000)], "g int, q int, r int, quiz boolean, ms int")
    found = rows.select(scores.review_grade(F.col("g"), F.col("q"), F.col("r"), F.col("quiz"), F.col("ms")).alias("v")).collect()
    assert [r.v for r in found] == [5, 2, 5, 1, 2, 4]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=25))
def test_reviews_in_columns_and_in_python_agree(spark, grades):
    folded = F.aggregate(F.array(*map(F.lit, grades)), scores.first_state(), scores.repeated)
    state = (0, 1.0, 2.5)
    for g in grades:
        state = reviewed(*state, g)
    got = spark.range(1).select(folded.alias("s")).head()["s"]
    assert tuple(got) == state and state[2] >= 1.3


def test_cooldown(spark):
    rows = spark.sql("SELECT * FROM VALUES (10, 0, 1, null), (15, 0, 1, null), (6, 1, 0, null), (8, 1, 0, null), (2, 0, 0, null), (4, 0, 0, null), (1, 0, 9, 0), (null, null, null, null) t(days, engaged, skipped, due)")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    ago = lambda c: now - F.make_dt_interval(F.col(c))
    assert [r.v for r in rows.select(scores.cooled_down(ago("days"), F.col("engaged"), F.col("skipped"), ago("due"), now).alias("v")).collect()] == [False, True, False, True, False, True, True, True]


def test_types_by_cards_seen(values):
    assert values(lambda t: F.size(scores.eligible_types(t.cast("int"))), ["0", "30", "31", "80", "81"]) == [3, 3, 6, 6, 7]


def test_numbers(value, values):
    assert value(scores.percent, 1, 3) == 33 and value(scores.percent, 5, 0) == 0 and value(scores.percent, 9, 3) == 100
    assert values(lambda t: scores.clamped_number(t, 10, 50), ["7", "99", "x", None]) == [7, 50, 10, 10]
    assert value(scores.ai_cost, "gemini-2.5-pro", 1000, 10, 5) == pytest.approx((1000 * 1.25 + 15 * 10) / 1e6) and value(scores.ai_cost, "unknown", 1, 1, 1) is None


def test_a_fold_gives_a_value_for_each_item(spark):
    from lectern.functions.folds import BLOCK, running

    sums = lambda c: running(c, F.lit(0).cast("bigint"), "bigint", lambda s, x: (s + x, s + x))
    rows = spark.createDataFrame([(n,) for n in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 5)], "n bigint")
    found = rows.select("n", sums(F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("bigint"), "n")).otherwise(F.array().cast("array<bigint>"))).alias("s")).collect()
    assert all(r.s == [k * (k + 1) // 2 for k in range(1, r.n + 1)] for r in found)
    assert rows.select(sums(F.lit(None).cast("array<bigint>")).alias("s")).head().s is None
