"""Pages and documents are dealt once, to tasks whose number grows with the rows."""

import pytest

from lectern.operators import elements as el
from lectern.operators import layout
from lectern.plans import texts, worklist
from lectern.plans.catalog import QUERIES
from lectern.sources import table
from lectern.sources.tables import n_tasks

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_rows(spark):
    rows = table(spark, SF, "lineitem")
    n = rows.count()
    assert n_tasks(rows, n) == 4 and n_tasks(rows, n // 50) in (50, 51)


@pytest.mark.parametrize("name", ["pdf_lines", "pdf_paragraphs", "page_blocks"])
def test_pages_are_dealt_once(spark, monkeypatch, name):
    monkeypatch.setattr(texts, "RUNS_A_TASK", 1000)
    plan = _plan(QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_elements_are_counted_where_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(worklist, "RUNS_A_TASK", 1000)
    page = QUERIES["document_pages"](spark, SF)
    first = _plan(page).index("Aggregate")
    assert "Join" in _plan(page)[:first] and "REPARTITION_BY_NUM" in _plan(page)
    rows = spark.createDataFrame([(1, "text", "Page 2", None), (1, "image", "Page 9", 3), (2, "text", None, 5), (3, "text", "Page 1", 1)], "doc_id int, type string, chapter string, spine_index int")
    ext = spark.createDataFrame([(1, ".pdf"), (2, ".epub"), (4, ".pdf")], "doc_id int, ext string")
    assert {r.doc_id: r.pages for r in el.page_counts(rows, ext, 3).collect()} == {1: 2, 2: 5} == {r.doc_id: r.pages for r in el.page_counts(rows, ext).collect()}


def test_blocks_with_ties_gaps_and_missing_kinds(spark):
    lines = [(1, 0, 10, 12.0, False, "a b"), (1, 1, 20, 10.0, False, "cde"), (1, 2, 32, 12.0, False, ""), (1, 3, 60, 20.0, False, "Hd"), (1, 4, 70, 10.0, True, " x"), (1, 5, 80, 10.0, True, ""), (1, 6, 90, 10.0, True, "y"), (1, 7, 95, 9.0, None, "lost"), (1, 8, 99, 9.0, False, "end")]
    df = spark.createDataFrame(lines, "page int, line int, top int, font_size double, is_mono boolean, text string")
    got = [(r.block, r.type, r.content) for r in layout.code_and_prose(df, ["page"]).orderBy("block").collect()]
    assert got == [(1, "text", "a b cde \n\n## Hd"), (2, "code", " x\n\ny"), (4, "text", "end")]
