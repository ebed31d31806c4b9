"""Best-fit-decreasing packing of token sequences.

Texts are tokenised once into a stored table of pieces of at most ``capacity`` tokens. Best-fit
decreasing needs only how many pieces of each length there are: that histogram (at most ``capacity``
rows, whatever the corpus) goes to the driver, where a segment tree over remaining capacities finds the
tightest open bin for each piece; equal pieces that meet equal bins are placed in one step, with the
result of placing them one after the other. The plan says for each length which ranks go to which bins;
pieces get their rank among those of their length from per-task counts, so no length, however
common, is gathered anywhere.

Defined cases: a null or empty text is its end token alone; a text longer than ``capacity`` is cut into
full pieces and a last shorter one; equal lengths are told apart by task and order within it (any
assignment of equal lengths is as good); repeated rows and null keys are packed like others; an empty
table gives no pieces; further columns cannot clash, as only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import encoded_slices, id_columns, library_memory
from lectern.sources import stored, table

CAPACITY = 4096


class OpenBins:
    """A segment tree over remaining capacities; each leaf holds runs (first bin, bins) with that much left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.runs[left].append((first, n))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        self._mark(left)
        return run

    def _mark(self, left: int) -> None:
        node = self.leaves + left
        self.any[node] = bool(self.runs[left])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        node = self.leaves + least
        if self.any[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Returns rows (length, first rank, first bin, pieces a bin, offset of the first), in order, and the
    number of bins. Piece ``r`` of a length is in bin ``first bin + (r - first rank) // pieces a bin``.
    """
    bins, opened, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            left = bins.tightest(length)
            if left is None:
                left, size = capacity, -(-(n - rank) // (capacity // length))
                first, opened = opened, opened + size
            else:
                first, size = bins.take(left)
            each = left // length
            rows.append((length, rank, first, each, capacity - left))
            placed = min(n - rank, size * each)
            full, part = divmod(placed, each)
            bins.put(left - each * length, first, full)
            if part:
                bins.put(left - part * length, first + full, 1)
            bins.put(left, first + full + bool(part), size - full - bool(part))
            rank += placed
    return np.array(rows, np.int64).reshape(-1, 5), opened


def token_pieces(docs: DataFrame, vocabulary: str, drops_space: bool, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored pieces: key, piece, start, length, ids (little-endian unsigned 32-bit), task, place.

    ``place`` numbers the pieces of one length within the task that wrote them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part, ids, at in encoded_slices(batches, library_memory(vocabulary, drops_space), end):
            n = np.maximum(1, -(-np.diff(at) // capacity))
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(at)[row] - start)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [part.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, id_columns(ids, np.append(at[row] + start, at[-1])), np.full(len(row), task, np.int32), place]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [key, "piece", "start", "length", "ids", "task", "place"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary, task int, place bigint")
    return stored(out.withColumn("ids_crc32", F.crc32("ids")), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with sequence_id and offset, by best-fit decreasing."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select(F.col("task").alias("_task"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    sent = spark.sparkContext.broadcast(plan_bins(counts, capacity)[0])  # its size depends on the capacity alone

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def assigned(length: pa.Array, rank: pa.Array) -> pa.Array:
        plan = sent.value
        length, rank = np.asarray(length), np.asarray(rank)
        # Rows of the plan are in order of falling length and rising rank.
        keys = (capacity - plan[:, 0]).astype(np.float64) * 2.0**40 + plan[:, 1]
        row = plan[np.searchsorted(keys, (capacity - length).astype(np.float64) * 2.0**40 + rank, "right") - 1]
        nth = rank - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], ["sequence_id", "offset"])

    ranked = pieces.join(base, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length")))
    found = ranked.withColumn("_at", assigned("length", F.col("place") + F.col("_before")))
    return found.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")).drop("task", "place")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), True, 1)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
