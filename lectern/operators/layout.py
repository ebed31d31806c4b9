"""Pages as laid out: text runs to lines, lines to paragraphs and headings, code told from prose.

Runs: page keys, nth (order on the page), top, font_size, is_mono, text.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.folds import running
from lectern.functions.scores import rounded
from lectern.functions.text import count_words, is_mono_font, strip

#: A decimal, so that a line of just 1.2 times the body's size (14.4 to 12) is no heading.
HEADING_SIZE = Decimal("1.2")
NEAR_PIXELS, PARAGRAPH_GAP, HEADING_WORDS = 3, 1.5, 15


def line_numbers(tops: Column) -> Column:
    """The line of each run: a run within ``NEAR_PIXELS`` of its line's first run belongs to that line."""
    first = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("top"))

    def step(s: Column, top: Column) -> tuple[Column, Column]:
        new = (s["line"] < 0) | (F.abs(top - s["top"]) > NEAR_PIXELS)
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(line.alias("line"), F.when(new, top).otherwise(s["top"]).alias("top")), line

    return running(tops, first, "int", step)


def merged_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, top, font_size (mean by characters), is_mono (of most characters), text. A page's runs are folded in one array."""
    run = F.struct("nth", F.col("top").cast("int").alias("top"), F.col("font_size").cast("double").alias("font_size"), "is_mono", "text")
    pages = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(run)).alias("r"))
    rows = pages.select(*keys, F.explode(F.arrays_zip("r", line_numbers(F.col("r.top")).alias("line"))).alias("x")).select(*keys, "x.line", "x.r.*")
    size = F.octet_length("text")
    lines = rows.groupBy(*keys, "line").agg(
        F.min_by("top", "nth").alias("top"),
        F.sum(F.col("font_size") * size).alias("weighted"), F.sum(size).alias("total"), F.sum(F.when(F.col("is_mono"), size).otherwise(0)).alias("mono"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    return lines.select(*keys, "line", "top", F.when(F.col("total") > 0, F.col("weighted") / F.col("total")).otherwise(0.0).alias("font_size"), (F.col("mono") * 2 > F.col("total")).alias("is_mono"), "text")


def _pieces(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``piece``: what each adds to its text. Ranks and sums are windows within the keys, so that lines dealt by some of them stay where they are."""
    all_, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("line")
    rows = lines.withColumns({"gap": F.col("top") - F.lag("top").over(order), "size": rounded(F.col("font_size"))})
    rows = rows.withColumn("n", F.sum(F.octet_length("text")).over(Window.partitionBy(*keys, "size"))).withColumn("body", F.max_by("size", F.struct(F.col("n"), -F.col("size"))).over(all_))
    positive = F.coalesce(F.col("gap") > 0, F.lit(False))
    rows = rows.withColumns({"nth": F.row_number().over(all_.orderBy(F.desc(positive), "gap")), "n_gaps": F.count(F.when(positive, True)).over(all_)})
    usual = F.coalesce(F.max(F.when(positive & (F.col("nth") == F.floor(F.col("n_gaps") / 2) + 1), F.col("gap"))).over(all_), F.lit(0))
    rows = rows.withColumn("threshold", F.floor(usual * PARAGRAPH_GAP))
    is_heading = (F.col("font_size") > (F.col("body") * F.lit(HEADING_SIZE)).cast("double")) & (count_words(F.col("text")) <= HEADING_WORDS)
    rows = rows.withColumn("is_heading", is_heading)
    breaks = F.col("is_heading") | F.coalesce(F.lag("is_heading").over(order), F.lit(False)) | ((F.col("threshold") > 0) & (F.col("gap") > F.col("threshold")))
    before = F.when(F.lag("line").over(order).isNull(), "").when(breaks, "\n\n").otherwise(" ")
    return rows.withColumn("piece", F.concat(before, F.when(F.col("is_heading"), "## ").otherwise(""), F.trim("text"))).select(*lines.columns, "piece")


def paragraph_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: lines joined by a blank, paragraphs by an empty line, headings marked with ``##``.

    The body's size is the one of most characters (the smaller of equal ones); the usual gap is the upper median.
    """
    return _pieces(lines, keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda x: x["piece"]), "").alias("text"))


def code_and_prose(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, type, content: neighbouring monospaced lines as code, the others as prose like that of ``paragraph_text``."""
    order = Window.partitionBy(*keys).orderBy("line")
    new = ~F.col("is_mono").eqNullSafe(F.lag("is_mono").over(order))
    rows = _pieces(lines.withColumn("block", F.sum(new.cast("int")).over(order)), [*keys, "block"]).where(F.col("is_mono").isNotNull())
    piece = F.when(F.col("is_mono"), F.col("text")).otherwise(F.col("piece"))
    both = rows.groupBy(*keys, "block", "is_mono").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", piece.alias("piece")))), lambda x: x["piece"]).alias("pieces"))
    content = F.when(F.col("is_mono"), F.array_join("pieces", "\n")).otherwise(F.array_join("pieces", ""))
    both = both.select(*keys, "block", F.when(F.col("is_mono"), "code").otherwise("text").alias("type"), content.alias("content"))
    return both.where(F.trim("content") != "")


def mono_fonts(fonts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page, font) of monospaced fonts (doc, page, font, family); a font of the whole document has page null."""
    return fonts.where(is_mono_font(F.col("family"))).select(doc, "page", "font").distinct()


def styled_runs(runs: DataFrame, fonts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``runs`` (doc, page, nth, font, text, ...) with ``is_mono``: its font is monospaced in its document or on its page."""
    mono = mono_fonts(fonts, doc)
    whole = mono.where("page IS NULL").select(F.col(doc).alias("_d"), F.col("font").alias("_f"), F.lit(True).alias("_whole"))
    own = mono.where("page IS NOT NULL").select(F.col(doc).alias("_d2"), F.col("page").alias("_p2"), F.col("font").alias("_f2"), F.lit(True).alias("_own"))
    rows = runs.join(whole, (runs[doc] == F.col("_d")) & (runs["font"] == F.col("_f")), "left")
    rows = rows.join(own, (runs[doc] == F.col("_d2")) & (runs["page"] == F.col("_p2")) & (runs["font"] == F.col("_f2")), "left")
    return rows.select(*runs.columns, (F.col("_whole").isNotNull() | F.col("_own").isNotNull()).alias("is_mono"))


def marked_lines(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: a line's runs (keys, nth, bold, italic, is_mono, text) joined, with marks around neighbours of one style.

    Bold stands between ``**``, italic between ``*``, both between ``***``; marks touch no blank, so they are
    balanced as a reader of them expects. Monospaced and blank stretches have no marks.
    """
    order = Window.partitionBy(*keys).orderBy("nth")
    style = F.when(F.col("is_mono"), "").otherwise(F.concat(F.when(F.col("bold"), "**").otherwise(""), F.when(F.col("italic"), "*").otherwise("")))
    rows = runs.withColumn("mark", style)
    changed = ~F.col("mark").eqNullSafe(F.lag("mark").over(order))
    stretches = rows.withColumn("stretch", F.sum(changed.cast("int")).over(order)).groupBy(*keys, "stretch", "mark").agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("text", F.lit("")).alias("text")))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["text"]), "")
    inner = strip(F.col("text"))
    around = lambda group: F.regexp_extract("text", r"(?s)\A(\s*)(.*?)(\s*)\z", group)
    marked = F.when((F.col("mark") == "") | (inner == ""), F.col("text")).otherwise(F.concat(around(1), F.col("mark"), around(2), F.col("mark"), around(3)))
    pieces = stretches.withColumn("text", text).select(*keys, "stretch", marked.alias("piece"))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "piece"))), lambda x: x["piece"]), "").alias("text"))
