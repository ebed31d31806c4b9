"""A stored inverted index of texts by English stems, and searches that read it instead of the texts.

The index has two tables. ``postings``: a row for each term and text with the places of the term, in files sorted by term,
so that a search's terms and prefixes are pushed down to the files' statistics; rows are dealt by ranges of (term,
key), so a term with a third of all rows is many tasks and files. ``lengths``: the words of each text.

A search is stems of its words, each a prefix: a text is found that has a term for each of them. Prefixes meet the
vocabulary first (a row a term), then the terms found meet the postings, so texts' rows are never multiplied by
the prefixes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.stems import is_stop_word, placed_words, stem, stem_of
from lectern.functions.values import STOP_WORDS
from lectern.sources import discard, stored

#: Words that a task groups at a time, and words whose stems it remembers.
_WORDS, _REMEMBERED = 500_000, 1_000_000


def postings(texts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, term, places): the places of each stem among a text's words, stop words counted but left out.

    ``columns`` are joined by a blank. A text's postings are made where it lies, so its words are never shuffled; a task
    makes the stem of a word once.
    """
    rows = texts.select(F.col(key).alias("key"), placed_words(F.concat_ws(" ", *columns)).alias("words"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str | None] = {}
        for batch in batches:
            at = np.asarray(batch.column(1).offsets)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(at, at[first] + _WORDS, "right")) - 1)
                yield _grouped(batch.slice(first, last - first), stems)
                first = last

    return rows.mapInArrow(run, f"key {kind}, term string, places array<int>")


def _grouped(part: pa.RecordBatch, stems: dict[str, str | None]) -> pa.RecordBatch:
    """The postings of rows (key, words), each text's in order of its terms' first meeting here."""
    at = np.asarray(part.column(1).offsets).astype(np.int64)
    found = part.column(1).flatten().dictionary_encode()
    own = found.dictionary.to_pylist()
    if len(stems) > _REMEMBERED:
        stems.clear()
    stop, numbers = set(STOP_WORDS), {}
    for word in own:
        if word not in stems:
            stems[word] = None if word in stop else stem_of(word)
    code = np.fromiter((-1 if (term := stems[w]) is None else numbers.setdefault(term, len(numbers)) for w in own), np.int64, len(own))
    term = code[np.asarray(found.indices)] if own else np.zeros(0, np.int64)
    row = np.repeat(np.arange(part.num_rows), np.diff(at))
    place = np.arange(len(term)) - (at[:-1] - at[0])[row]
    kept = np.flatnonzero(term >= 0)
    group = row[kept] * max(1, len(numbers)) + term[kept]
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    head = kept[order[starts]]
    terms = pa.array(list(numbers), pa.string()).take(pa.array(term[head]))
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(place[kept[order]].astype(np.int32)))
    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[head])), terms, places], ["key", "term", "places"])


def write_index(texts: DataFrame, folder: str, key: str, columns: list[str]) -> None:
    """Writes the index of ``texts`` under ``folder``. Postings are written before they are dealt by ranges: choosing the ranges reads them once more."""
    rows = stored(postings(texts, key, columns), "postings")
    rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{folder}/postings")
    discard(rows)
    texts.select(F.col(key).alias("key"), F.size(placed_words(F.concat_ws(" ", *columns))).cast("bigint").alias("words")).write.mode("overwrite").parquet(f"{folder}/lengths")


class TextIndex:
    """A written index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.postings, self.lengths = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")

    def vocabulary(self) -> DataFrame:
        """(term, n_texts, n_places)."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("places")).alias("n_places"))

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, rank) of the texts that have a term for each word of a query (query_id, query).

        ``rank`` is the share of a text's words that the query's words start. Queries of stop words alone, empty
        or null find nothing.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(placed_words(F.col("query")))).alias("word")).where(~is_stop_word(F.col("word")))
        asked = asked.select("query_id", stem(F.col("word")).alias("prefix")).distinct()
        need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
        sizes = asked.agg(F.collect_set(F.length("prefix")).alias("sizes"))  # one row, as many numbers as words have lengths
        terms = self.postings.select("term").distinct().join(F.broadcast(sizes))
        starts = terms.select("term", F.explode(F.filter("sizes", lambda n: n <= F.length("term"))).alias("n")).select("term", F.substr("term", F.lit(1), F.col("n")).alias("prefix"))
        # Written, as far fewer than the postings: so Spark knows their size and need not deal the postings anew for few.
        found = stored(starts.join(asked, "prefix").select("query_id", "prefix", "term"), "found-terms")
        # A place counts once for each word of the query that starts its term; each word is met at most once a term.
        sizes = self.postings.select("key", "term", F.size("places").alias("n"))
        hits = found.join(sizes, "term").groupBy("query_id", "key", "prefix").agg(F.sum("n").alias("n"))
        met = hits.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("n"))
        whole = met.join(need, "query_id").where("met = need")
        return whole.join(self.lengths, "key").select("query_id", "key", (F.col("n") / F.col("words")).alias("rank"))

    def starting(self, prefix: str) -> DataFrame:
        """Postings of the terms that start with a prefix: the filter reaches the files."""
        return self.postings.where(F.col("term").startswith(prefix))
