"""Ordered elements of documents: merging, folding, attaching, and choosing by page or table of contents.

An element is a row: doc_id, pos (its place), type (text, code or image), content, chapter, language, alt,
file, mime, spine_index, anchor_id. Chunks to be folded have doc_id, pos, chunk_type, content, word_count, images.
All work is by document, in windows over ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.values import SMALL_CODE_WORDS



def _order():
    return Window.partitionBy("doc_id").orderBy("pos")


def _all():
    return Window.partitionBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def page_of(chapter: Column) -> Column:
    """The number of a chapter called "Page N", else null."""
    return F.regexp_extract(chapter, r"(?i)\APage\s+([0-9]+)\z", 1).try_cast("int")


def merged_code(elements: DataFrame) -> DataFrame:
    """Neighbouring code elements of one chapter as one, at the place of the first."""
    is_code = F.col("type") == "code"
    same = is_code & (F.lag("type").over(_order()) == "code") & F.col("chapter").eqNullSafe(F.lag("chapter").over(_order()))
    island = elements.withColumn("island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(_order()))
    rest = [c for c in elements.columns if c not in ("doc_id", "pos", "content")]
    firsts = [F.min_by(c, "pos").alias(c) for c in rest]
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    texts = F.when(F.min_by("type", "pos") == "code", content).otherwise(F.min_by("content", "pos"))
    return island.groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), texts.alias("content"), *firsts).select(*elements.columns)


def folded_code(chunks: DataFrame, least: int = SMALL_CODE_WORDS) -> DataFrame:
    """Code chunks of fewer than ``least`` words put into the text before them, else into the text right after.

    The text before is the last chunk that stays, so a row of small codes after a text all go to it;
    without one, only the code right before a text can go to that, the rest stay.
    """
    small = (F.col("chunk_type") == "code") & (F.col("word_count") < least)
    marked = chunks.withColumn("_small", small).withColumn("_run", F.sum(F.when(~small, 1).otherwise(0)).over(_order()))
    # A run: one chunk that is not small (none in run 0), and the small codes after it.
    run = Window.partitionBy("doc_id", "_run").orderBy("pos")
    head = F.first(F.when(~F.col("_small"), F.col("chunk_type")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to_next = F.col("_small") & ~head.eqNullSafe("text") & (F.lead("chunk_type").over(_order()) == "text")
    to_head = F.col("_small") & head.eqNullSafe("text")
    goal = F.when(to_head, F.col("_run")).when(F.coalesce(to_next, F.lit(False)), F.col("_run") + 1)
    moved = marked.withColumns({"_goal": F.coalesce(goal, F.when(~F.col("_small"), F.col("_run"))), "_stays": ~F.col("_small") | goal.isNull()})
    group = F.when(F.col("_goal").isNotNull(), F.concat(F.lit("r"), F.col("_goal").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("pos").cast("string")))
    block = F.when(F.col("_small") & F.col("_goal").isNotNull(), F.concat(F.lit("\n\n```\n"), F.col("content"), F.lit("\n```\n\n"))).otherwise(F.col("content"))
    rows = moved.withColumns({"_group": group, "content": block})
    # The images of a chunk come first, then those of what it takes in.
    pictures = F.array_sort(F.collect_list(F.struct((~F.col("_stays")).alias("late"), "pos", "images")))
    return rows.groupBy("doc_id", "_group").agg(
        F.min_by("pos", F.struct(~F.col("_stays"), F.col("pos"))).alias("pos"),
        F.min_by("chunk_type", F.struct(~F.col("_stays"), F.col("pos"))).alias("chunk_type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "").alias("content"),
        F.sum("word_count").alias("word_count"),
        F.flatten(F.transform(pictures, lambda x: x["images"])).alias("images"),
    ).drop("_group")


def attached_images(elements: DataFrame) -> DataFrame:
    """Text and code elements with ``images``: those since the element before; trailing ones go to the last element."""
    is_image = F.col("type") == "image"
    after = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = F.coalesce(F.first(F.when(~is_image, F.col("pos")), ignorenulls=True).over(after), F.max(F.when(~is_image, F.col("pos"))).over(_all()))
    rows = elements.withColumn("_to", own)
    pictures = F.array_sort(F.collect_list(F.when(F.col("type") == "image", F.struct("pos", "file", "alt", "mime"))))
    images = rows.groupBy("doc_id", F.col("_to").alias("pos")).agg(F.transform(pictures, lambda x: F.struct(x["file"].alias("file"), x["alt"].alias("alt"), x["mime"].alias("mime"))).alias("images"))
    return elements.where(~is_image).join(images, ["doc_id", "pos"])


def in_pages(elements: DataFrame, ext: Column, first: Column, last: Column) -> DataFrame:
    """The elements from page ``first`` to page ``last``. A page is that of the element's own chapter in a PDF, the
    spine index in an EPUB, 1 where there is none; plain texts are kept whole."""
    own = F.when(ext == ".pdf", F.coalesce(F.when(F.col("type") != "image", page_of(F.col("chapter"))), F.lit(1))).otherwise(F.coalesce("spine_index", F.lit(1)))
    return elements.where((ext == ".txt") | own.between(first, last))


def toc_ranges(toc: DataFrame, total: DataFrame) -> DataFrame:
    """Entries (doc_id, idx, title, page, level, fragment) with the page they end at and the fragment that ends them.

    An entry ends before the next one of its own or a higher level, else with the document (``total``:
    doc_id, total_pages). Tables of contents are short: the search runs in an array a document.
    """
    entry = F.struct("idx", "title", "page", "level", "fragment")
    lists = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("toc")).join(total, "doc_id")
    each = lists.select("doc_id", "total_pages", "toc", F.explode("toc").alias("e"))
    following = F.get(F.filter("toc", lambda x: (x["idx"] > F.col("e.idx")) & (x["level"] <= F.col("e.level"))), F.lit(0))
    found = each.withColumn("n", following)
    return found.select("doc_id", "e.*", F.when(F.col("n").isNotNull(), F.greatest(F.col("n.page") - 1, F.col("e.page"))).otherwise(F.col("total_pages")).alias("end_page"), F.col("n.fragment").alias("end_fragment"))


def page_bounds(toc: DataFrame, total: DataFrame, chosen: Column) -> DataFrame:
    """(doc_id, first_page, last_page) over the chosen entries of a table of contents.

    An entry ends a page before the next of its own or a higher level, even where that is before its own page.
    """
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    levels = range(1 + (toc.agg(F.max("level")).head()[0] or 0))  # headings nest a few levels deep
    after = F.coalesce(*(F.when(F.col("level") == n, F.first(F.when(F.col("level") <= n, F.col("page")), ignorenulls=True).over(order)) for n in levels), F.lit(None).cast("int"))
    ends = toc.withColumn("_after", after).join(total, "doc_id").withColumn("_end", F.coalesce(F.col("_after") - 1, F.col("total_pages")))
    return ends.where(chosen).groupBy("doc_id").agg(F.min("page").alias("first_page"), F.max("_end").alias("last_page"))


def selected_by_toc(elements: DataFrame, ranges: DataFrame, ext: DataFrame) -> DataFrame:
    """The elements within selected entries (``ranges``: rows of ``toc_ranges``; ``ext``: doc_id, ext).

    In an EPUB with fragments, elements count from an entry's anchor to the anchor that ends it; where no
    anchors are found there, and in other EPUBs, whole spine pages count; in a PDF the page carried
    forward from "Page N" chapters.
    """
    pages = ranges.select("doc_id", F.explode(F.when(F.col("end_page") >= F.col("page"), F.sequence("page", "end_page"))).alias("page")).distinct()
    marked = ranges.where(F.coalesce("fragment", F.lit("")) != "").groupBy("doc_id").agg(F.collect_set("fragment").alias("starts"), F.collect_set("end_fragment").alias("ends"), F.collect_set("page").alias("spine"))
    rows = elements.join(ext, "doc_id").withColumn("_spine", F.coalesce("spine_index", F.lit(0))).join(marked, "doc_id", "left")
    on_page = F.coalesce(F.array_contains("spine", F.col("_spine")), F.lit(False))
    start = on_page & F.coalesce(F.array_contains("starts", F.col("anchor_id")), F.lit(False))
    end = on_page & ~start & F.coalesce(F.array_contains("ends", F.col("anchor_id")), F.lit(False))
    state = F.last(F.when(start, True).when(end, False), ignorenulls=True).over(_order())
    rows = rows.withColumn("_inside", on_page & ~end & F.coalesce(state, F.lit(False)))
    rows = rows.withColumn("_any", F.bool_or("_inside").over(_all()))
    carried = F.coalesce(F.last(F.when(F.col("type") != "image", page_of(F.col("chapter"))), ignorenulls=True).over(_order()), F.lit(1))
    is_epub = F.col("ext").isin(".epub", ".kepub")
    rows = rows.withColumn("_page", F.when(is_epub, F.col("_spine")).otherwise(carried))
    by_page = rows.join(pages.select("doc_id", F.col("page").alias("_page"), F.lit(True).alias("_chosen")), ["doc_id", "_page"], "left")
    return by_page.where(F.when(is_epub & F.col("_any"), F.col("_inside")).otherwise(F.coalesce("_chosen", F.lit(False)))).select(*elements.columns)


def with_figures(elements: DataFrame, figures: DataFrame) -> DataFrame:
    """Elements and figures (doc_id, page, nth, alt, file, mime) in one order, numbered anew.

    A page's figures replace the first image without a file that names the page (others of that page go),
    unless an element of that or a later page came first: then they stand before it. Left over, they come last.
    """
    pages = figures.select("doc_id", F.col("page").alias("fig_page")).distinct()
    named = F.coalesce(F.regexp_extract("alt", r"(?i)page\s+([0-9]+)", 1).try_cast("int"), F.lit(0))
    own = F.when(F.col("type") == "image", F.when(F.col("file").isNull(), named)).otherwise(page_of(F.col("chapter")))
    rows = elements.withColumn("_page", own)
    by_name = rows.where((F.col("type") == "image") & F.col("file").isNull()).join(pages, (rows["doc_id"] == pages["doc_id"]) & (F.col("_page") == F.col("fig_page"))).select(rows["doc_id"], "fig_page", "pos", F.lit(True).alias("replaced"))
    # The first element of each page, and the least such place over all later pages: no pair of element and figure is made.
    first = rows.where(F.col("type") != "image").where(F.col("_page") > 0).groupBy("doc_id", F.col("_page").alias("page")).agg(F.min("pos").alias("pos"))
    line = first.select("doc_id", "page", "pos", F.lit(False).alias("is_figure")).unionByName(pages.select("doc_id", F.col("fig_page").alias("page"), F.lit(None).cast("int").alias("pos"), F.lit(True).alias("is_figure")))
    onward = Window.partitionBy("doc_id").orderBy(F.desc("page")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_page = line.withColumn("pos", F.min("pos").over(onward)).where("is_figure").select("doc_id", F.col("page").alias("fig_page"), "pos", F.lit(False).alias("replaced"))
    places = by_name.unionByName(by_page).groupBy("doc_id", "fig_page").agg(F.min(F.struct(F.coalesce("pos", F.lit(2147483647)).alias("pos"), "replaced")).alias("at"))
    gone = by_name.select("doc_id", "pos").distinct()
    kept = elements.join(gone, ["doc_id", "pos"], "left_anti").withColumns({"_sub": F.lit(1), "_fp": F.lit(0), "_nth": F.lit(0)})
    placed = figures.join(places, (figures["doc_id"] == places["doc_id"]) & (figures["page"] == F.col("fig_page")))
    extra = placed.select(figures["doc_id"], F.col("at.pos").alias("pos"), F.lit("image").alias("type"), "alt", "file", "mime", F.lit(0).alias("_sub"), F.col("fig_page").alias("_fp"), F.col("nth").alias("_nth"))
    both = kept.unionByName(extra, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("pos", "_sub", "_fp", "_nth")
    return both.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).select(*elements.columns)


def page_counts(elements: DataFrame, ext: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, pages): the largest spine index of an EPUB, else the number of distinct pages; 1 at least.

    Elements are dealt to so many ``tasks`` (Spark's own number, if none is given) and counted before they meet ``ext``.
    """
    own = F.coalesce(F.when(F.col("type") != "image", page_of(F.col("chapter"))), F.lit(1))
    rows = elements.select("doc_id", F.coalesce("spine_index", F.lit(0)).alias("spine"), own.alias("page"))
    counted = (rows.repartition(tasks, "doc_id") if tasks else rows).groupBy("doc_id").agg(F.max("spine").alias("spine"), F.count_distinct("page").alias("pages"))
    return counted.join(ext, "doc_id").select("doc_id", F.greatest(F.when(F.col("ext").isin(".epub", ".kepub"), F.col("spine")).otherwise(F.col("pages")), F.lit(1)).cast("bigint").alias("pages"))


def front_chunks(chunks: DataFrame, main_titles: DataFrame) -> DataFrame:
    """Chunks (doc_id, pos, chapter) before the first whose chapter is a title of the main matter (doc_id, title)."""
    norm = lambda c: F.lower(F.trim(c))
    titles = main_titles.select("doc_id", norm(F.col("title")).alias("_t")).distinct()
    marked = chunks.withColumn("_t", norm(F.col("chapter"))).join(titles.withColumn("_main", F.lit(1)), ["doc_id", "_t"], "left")
    return marked.withColumn("_seen", F.coalesce(F.max("_main").over(_order()), F.lit(0))).where("_seen = 0").select(*chunks.columns)


def every_nth(chunks: DataFrame, interval: Column) -> DataFrame:
    """Every ``interval``-th text or code chunk of a document, the first included; images are left out."""
    rows = chunks.where(F.col("chunk_type") != "image")
    return rows.withColumn("_i", F.row_number().over(_order()) - 1).where(F.col("_i") % interval == 0).drop("_i")
