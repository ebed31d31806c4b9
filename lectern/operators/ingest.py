"""Documents' elements to stored chunks, step by step: what a step has done is never done again.

Tables under one folder: ``chunks`` has what each step added, ``marks`` a row for each document that a step worked on: how many of
its elements are done, how many there are, and the number of its next chunk. A step takes the next elements of each
document from its mark on, makes chunks of them and numbers these on. So documents may be done a part at a time, in
as many runs as it takes, with the same chunks as in one run. A step's files bear its number: a step that runs again after
a failure reads the marks of the steps before and writes over its own files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.folds import running
from lectern.functions.text import count_words, heading, paragraphs
from lectern.functions.values import CHUNK_LEAST, CHUNK_MOST
from lectern.operators import segment
from lectern.operators.numbering import running_sums
from lectern.operators.scheduler import next_status
from lectern.sources import discard, stored

CHUNK = "doc_id bigint, chunk_index bigint, chunk_type string, content string, chapter string, word_count bigint, language string"
MARK = "doc_id bigint, done bigint, total bigint, next_index bigint, step bigint"


def element_chunks(elements: DataFrame, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """(doc_id, pos, part, chunk_type, content, chapter, word_count, language) of elements (doc_id, pos, type, content, chapter, language).

    Code is a chunk as it stands, a text is cut into segments and these packed; an element's chapter is that of its
    chunks without one. Images make none. An element with nothing to read makes none.
    """
    code = elements.where("type = 'code'").select("doc_id", "pos", F.lit(0).cast("bigint").alias("part"), F.lit("code").alias("chunk_type"), "content", "chapter", count_words(F.col("content")).cast("bigint").alias("word_count"), F.coalesce("language", F.lit("en")).alias("language"))
    element = F.struct("doc_id", "pos", F.col("chapter").alias("of"))
    texts = elements.where("type = 'text'").select(element.alias("element"), "content")
    cut = segment.chunks(segment.segments(texts, "element", "content"), "element", least, most)
    made = cut.select("element.doc_id", "element.pos", F.col("chunk_index").alias("part"), F.lit("text").alias("chunk_type"), "content", F.coalesce("chapter", "element.of").alias("chapter"), "word_count", "language")
    return code.unionByName(made)


class Ingestion:
    """Chunks and marks under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name, schema in (("chunks", CHUNK), ("marks", MARK)):  # so that there is something to read from the start
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}/step=-1")

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(CHUNK).parquet(f"{self.folder}/chunks/step=*")

    def marks(self, before: int | None = None) -> DataFrame:
        """The last mark of each document (of the steps before ``before``)."""
        rows = self.spark.read.schema(MARK).parquet(f"{self.folder}/marks/step=*")
        if before is not None:
            rows = rows.where(F.col("step") < before)
        return rows.groupBy("doc_id").agg(F.max_by(F.struct("done", "total", "next_index"), "step").alias("m")).select("doc_id", "m.*")

    def statuses(self) -> DataFrame:
        """(doc_id, status): ``chunking`` until all elements are done, then ``generating``."""
        return self.marks().select("doc_id", next_status(F.lit("chunking"), F.col("total"), F.col("done"), F.lit(1)).alias("status"))

    def step(self, elements: DataFrame, number: int, limit: int | None = None, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> None:
        """Works on the next ``limit`` elements of each document (all that are left without it); ``pos`` counts a document's elements from 0."""
        totals = elements.groupBy("doc_id").agg((F.max("pos") + 1).alias("total"))
        marks = self.marks(number).select("doc_id", "done", "next_index")
        state = totals.join(marks, "doc_id", "left").select("doc_id", "total", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("next_index", F.lit(0)).alias("next_index")).where("done < total")
        until = F.col("total") if limit is None else F.least(F.col("done") + limit, F.col("total"))
        state = state.withColumn("until", until)
        remaining = elements.join(state.select("doc_id", "done", "until"), "doc_id").where("pos >= done AND pos < until").drop("done", "until")
        # Written before it is numbered: the numbers start from counts of it, and making it twice would cut each text twice.
        made = stored(element_chunks(remaining, least, most), "made-chunks")
        # Parts of an element before it count as well: an element's place is (pos, part).
        before = made.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"))
        placed = running_sums(before, ["doc_id"], "pos", upto=F.col("n")).join(state.select("doc_id", "next_index"), "doc_id")
        firsts = placed.select("doc_id", "pos", (F.col("next_index") + F.col("upto") - F.col("n")).alias("first"))
        rows = made.join(firsts, ["doc_id", "pos"]).select("doc_id", (F.col("first") + F.col("part")).alias("chunk_index"), "chunk_type", "content", "chapter", "word_count", "language")
        rows.write.mode("overwrite").parquet(f"{self.folder}/chunks/step={number}")
        discard(made)
        added = self.spark.read.schema(CHUNK).parquet(f"{self.folder}/chunks/step={number}").groupBy("doc_id").agg(F.count(F.lit(1)).alias("added"))
        marked = state.join(added, "doc_id", "left").select("doc_id", F.col("until").alias("done"), "total", (F.col("next_index") + F.coalesce("added", F.lit(0))).alias("next_index"), F.lit(number).cast("bigint").alias("step"))
        marked.write.mode("overwrite").parquet(f"{self.folder}/marks/step={number}")

    def finished(self) -> bool:
        """Whether no document that was begun has elements left."""
        return not self.marks().where("done < total").limit(1).count()


def ingest(elements: DataFrame, folder: str, limit: int | None = None) -> Ingestion:
    """Elements to stored chunks as one call: steps of ``limit`` elements of each document until all are done.

    A folder of an earlier run goes on where that stopped.
    """
    spark = elements.sparkSession
    work = Ingestion(spark, folder)
    number = (work.spark.read.schema(MARK).parquet(f"{folder}/marks/step=*").agg(F.max("step")).head()[0] or 0) + 1
    while True:
        work.step(elements, number, limit)
        if work.finished():
            return work
        number += 1


def line_elements(texts: DataFrame, is_code: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as elements, a line each, under the heading before: doc_id, pos, type, content, chapter, language. Headings are carried on within a text's own row."""
    cut = texts.select(F.col(key).alias("doc_id"), paragraphs(F.col(text)).alias("content"))
    named = cut.select("doc_id", "content", F.transform("content", heading).alias("heading"))
    carried = running(F.col("heading"), F.lit(None).cast("string"), "string", lambda last, own: (F.coalesce(own, last), F.coalesce(own, last)))
    rows = named.select("doc_id", F.posexplode(F.arrays_zip("content", carried.alias("chapter"))).alias("pos", "x")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "x.*")
    return rows.select("doc_id", "pos", F.when(is_code, "code").otherwise("text").alias("type"), "content", "chapter", F.lit(None).cast("string").alias("language"))
