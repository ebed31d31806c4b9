"""Texts to segments to chunks, with DataFrame functions only.

A text is cut into paragraphs in its own row. Paragraphs are dealt by document once; headings are carried
forward, segments numbered and chunks packed on that partitioning. Packing is greedy, so it runs as a fold
over a chapter's word counts (integers; the texts are not in the fold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.folds import running
from lectern.functions.text import count_words, heading, is_layout_noise, language, paragraphs, sentences
from lectern.functions.values import AI_OVERLAP, AI_WINDOW, CHUNK_LEAST, CHUNK_MOST, LEAST_SEGMENT_WORDS


def segments(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, segment_index, content, word_count, chapter, language, is_chapter_start.

    Headings name the chapter of what follows and are no segments, nor are short or noisy paragraphs.
    """
    cut = texts.select(key, F.posexplode(paragraphs(F.col(text))).alias("pos", "content"))
    measured = cut.select(key, "pos", "content", heading(F.col("content")).alias("heading"), count_words(F.col("content")).cast("bigint").alias("word_count"))
    wanted = F.col("heading").isNotNull() | ((F.col("word_count") >= LEAST_SEGMENT_WORDS) & ~is_layout_noise(F.col("content")))
    order = Window.partitionBy(key).orderBy("pos")
    filled = measured.where(wanted).withColumn("chapter", F.last("heading", ignorenulls=True).over(order)).where("heading IS NULL")
    number = F.row_number().over(order)
    starts = (number == 1) | ~F.col("chapter").eqNullSafe(F.lag("chapter").over(order))
    return filled.select(key, (number - 1).cast("bigint").alias("segment_index"), "content", "word_count", "chapter", language(F.col("content")).alias("language"), starts.alias("is_chapter_start"))


def packed_ids(counts: Column, starts: Column, least: int, most: int) -> Column:
    """For each segment the number of its chunk: a chunk is closed by a chapter's start, by a segment of more than
    ``most`` words (a chunk by itself), and by one that would overfill it once it has ``least`` words."""
    first = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("bigint").alias("words"), F.lit(True).alias("closed"))

    def step(state: Column, item: Column) -> tuple[Column, Column]:
        n, large = item["n"], item["n"] > most
        new = state["closed"] | item["start"] | large | ((state["words"] + n > most) & (state["words"] >= least))
        chunk = F.when(new, state["chunk"] + 1).otherwise(state["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, n).otherwise(state["words"] + n).alias("words"), large.alias("closed")), chunk

    return running(F.arrays_zip(counts.alias("n"), starts.alias("start")), first, "int", step)


def packing(parts: DataFrame, key: str = "doc_id", least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """key, segment_index, chunk: which chunk of its document each segment goes to (before long ones are split)."""
    row = F.struct("segment_index", "word_count", "is_chapter_start")
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("s"))
    ids = lists.select(key, packed_ids(F.col("s.word_count"), F.col("s.is_chapter_start"), least, most).alias("ids"))
    return ids.select(key, F.posexplode("ids").alias("segment_index", "chunk")).select(key, F.col("segment_index").cast("bigint").alias("segment_index"), F.col("chunk").cast("bigint").alias("chunk"))


def sentence_groups(text: Column, most: int = CHUNK_MOST) -> Column:
    """Sentences of a long segment in groups of at most ``most`` words; a longer sentence is a group by itself."""
    own = sentences(text)
    counts = F.transform(own, lambda s: count_words(s).cast("bigint"))
    first = F.struct(F.lit(-1).alias("group"), F.lit(0).cast("bigint").alias("words"))

    def step(state: Column, n: Column) -> tuple[Column, Column]:
        new = (state["group"] < 0) | (state["words"] + n > most)
        group = F.when(new, state["group"] + 1).otherwise(state["group"])
        return F.struct(group.alias("group"), F.when(new, n).otherwise(state["words"] + n).alias("words")), new

    begins = running(counts, first, "boolean", step)
    # Where each group begins, and the end: sentences from one to the next are joined.
    at = F.concat(F.filter(F.transform(begins, lambda new, i: F.when(new, i)), lambda i: i.isNotNull()), F.array(F.size(own)))
    pairs = F.arrays_zip(at.alias("a"), F.slice(at, 2, F.size(at)).alias("b"))
    groups = F.filter(pairs, lambda p: p["b"].isNotNull())
    return F.transform(groups, lambda p: F.array_join(F.slice(own, p["a"] + 1, p["b"] - p["a"]), " "))


def chunks(parts: DataFrame, key: str = "doc_id", least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """key, chunk_index, content, word_count, chapter, language from ``segments``."""
    # A text's segments are gathered once; what follows is by text too, so contents are dealt once.
    row = F.struct("segment_index", "word_count", "is_chapter_start", "content", "chapter")
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("s"))
    ids = packed_ids(F.col("s.word_count"), F.col("s.is_chapter_start"), least, most)
    placed = lists.select(key, F.explode(F.arrays_zip("s", ids.alias("chunk"))).alias("x")).select(key, "x.s.*", F.col("x.chunk").cast("bigint").alias("chunk"))
    packed = placed.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("segment_index", "content"))).alias("s"), F.sum("word_count").alias("words"), F.min_by("chapter", "segment_index").alias("chapter"))
    joined = F.array_join(F.col("s.content"), "\n\n")
    # Only a segment by itself can be over the limit without being packed so.
    long = (F.size("s") == 1) & (F.col("words") > most)
    split = packed.select(key, "chunk", "chapter", F.posexplode(F.when(long, sentence_groups(F.col("s.content")[0], most)).otherwise(F.array(joined))).alias("part", "content"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("chunk", "part"))
    return split.select(key, (number - 1).cast("bigint").alias("chunk_index"), "content", count_words(F.col("content")).cast("bigint").alias("word_count"), "chapter", language(F.col("content")).alias("language"))


def windows(parts: DataFrame, key: str = "doc_id", size: int = AI_WINDOW, overlap: int = AI_OVERLAP) -> DataFrame:
    """``parts`` with ``window``: the overlapping windows in which each segment is shown to a model.

    A window starts every ``size - overlap`` segments; a document that fits in one has only that.
    """
    step = size - overlap
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    i = F.col("segment_index")
    first = F.greatest(F.floor((i - size) / step) + 1, F.lit(0))
    all_ = F.sequence(first, F.floor(i / step))
    return parts.withColumn("_n", n).withColumn("window", F.explode(F.when(F.col("_n") <= size, F.array(F.lit(0).cast("bigint"))).otherwise(all_))).drop("_n")


def regrouped(parts: DataFrame, replies: DataFrame, key: str = "doc_id", size: int = AI_WINDOW, overlap: int = AI_OVERLAP) -> DataFrame:
    """Chunks from a model's groups: key, chunk_index, content, word_count, chapter, language.

    ``replies``: key, window, groups (arrays of segment indices). After the first window, indices in the
    overlap are left out, as the window before has placed them.
    """
    step = size - overlap
    fresh = F.when(F.col("window") == 0, 0).otherwise(F.col("window") * step + overlap)
    groups = replies.select(key, "window", F.posexplode("groups").alias("nth", "members")).where(F.element_at("members", -1) >= fresh).select(key, "window", "nth", F.filter("members", lambda i: i >= fresh).alias("members"))
    # Both sides are gathered by text and meet there, so contents are dealt once. A segment's index is its place among its text's.
    named = groups.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "nth", "members"))), lambda g: g["members"]).alias("groups"))
    row = F.struct("segment_index", "content", "word_count", "chapter", "language")
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("s"))
    own = lambda members: F.filter(F.transform(members, lambda i: F.get("s", i.cast("int"))), lambda x: x.isNotNull())

    def chunk(members: Column, nth: Column) -> Column:
        x = own(members)
        words = F.aggregate(x, F.lit(0).cast("bigint"), lambda n, y: n + y["word_count"])
        return F.struct(nth.cast("bigint").alias("chunk_index"), F.array_join(F.transform(x, lambda y: y["content"]), "\n\n").alias("content"), words.alias("word_count"), F.get(x, F.lit(0))["chapter"].alias("chapter"), F.get(x, F.lit(0))["language"].alias("language"), F.size(x).alias("n"))

    rows = lists.join(named, key).select(key, F.inline(F.transform("groups", chunk)))
    return rows.where("n > 0").drop("n")
