"""Affinity that ends by itself: which documents a machine has worked on lately.

A touch makes its document affine to its machine for ``TTL_MINUTES``; another touch makes that longer. At each touch the
documents still affine are those touched on the same machine within that time before. As a stream this is a join
of the touches with themselves over an interval of event time: Spark keeps a touch as state until the watermark has passed
its end, so state is bounded by the touches of that time and gets rid of itself. Touches are dealt by machine
and time slice, so a machine with a third of all touches is many tasks; touches that come late and out of order, up to
``late``, are still counted.

That join has a row for each touch and each document still affine. Where only the lists are wanted, ``affine_lists`` makes
them of a log of touches without those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.values import AFFINITY_MINUTES
from lectern.sources.tables import n_tasks

LATE = "1 hour"
#: A task makes the lists of so many touches; their texts go to Spark so many bytes at a time.
TOUCHES_A_TASK, _BATCH_BYTES = 65_536, 1_000_000


def affine_touches(touches: DataFrame, minutes: int = AFFINITY_MINUTES, late: str = LATE) -> DataFrame:
    """(event_id, machine_id, doc_id, since): for each touch the touches on its machine up to ``minutes`` before it, itself included.

    ``touches``: event_id, machine_id, doc_id, at (a timestamp); batch or stream. A touch without a machine,
    document or time is left out. A time exactly ``minutes`` ago still counts.
    """
    whole = touches.where("machine_id IS NOT NULL AND doc_id IS NOT NULL AND at IS NOT NULL")
    slice_ = F.floor(F.unix_seconds("at") / (minutes * 60))
    now = whole.select("event_id", "machine_id", "at", slice_.alias("_slice")).withWatermark("at", late)
    now = now.withColumn("_slice", F.explode(F.array(F.col("_slice"), F.col("_slice") - 1)))
    before = whole.select(F.col("machine_id").alias("_machine"), "doc_id", F.col("at").alias("since"), slice_.alias("_of")).withWatermark("since", late)
    near = (F.col("since") <= F.col("at")) & (F.col("since") >= F.col("at") - F.make_dt_interval(mins=F.lit(minutes)))
    return now.join(before, (F.col("machine_id") == F.col("_machine")) & (F.col("_slice") == F.col("_of")) & near).select("event_id", "machine_id", "doc_id", "since")


def affine_documents(found: DataFrame) -> DataFrame:
    """(event_id, machine_id, n_affine, documents): each touch with its affine documents, in order of their ids."""
    each = found.groupBy("event_id", "machine_id").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    return each.select("event_id", "machine_id", F.size("ids").cast("bigint").alias("n_affine"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("documents"))


def affine_lists(touches: DataFrame, minutes: int = AFFINITY_MINUTES) -> DataFrame:
    """The rows of ``affine_documents`` from stored ``touches`` (event_id, machine_id, doc_id, at); ids are whole numbers.

    A touch is dealt to its own time slice and, as one that is only looked back at, to the next. A task holds two slices
    of a machine and a batch of lists; what is shuffled grows with the touches, not with their lists. Lists of a machine
    come in order of time, so that each is nearly the one before.
    """
    whole = touches.where("machine_id IS NOT NULL AND doc_id IS NOT NULL AND at IS NOT NULL")
    time, span = F.unix_micros("at"), minutes * 60_000_000
    slice_ = time - F.pmod(time, F.lit(span))
    places = F.array(F.struct(slice_.alias("slice"), F.lit(True).alias("own")), F.struct((slice_ + span).alias("slice"), F.lit(False).alias("own")))
    rows = whole.select("event_id", "machine_id", "doc_id", time.alias("_time"), F.inline(places))
    kinds = dict(touches.dtypes)
    dealt = rows.repartition(n_tasks(touches, TOUCHES_A_TASK), "machine_id", "slice")
    return dealt.groupBy("machine_id", "slice").applyInArrow(_lists(span), f"event_id {kinds['event_id']}, machine_id {kinds['machine_id']}, n_affine bigint, documents string")


def _lists(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists at the own touches of a slice, from these and those of the slice before (not ``own``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        time, doc, own = (rows[c].to_numpy() for c in ("_time", "doc_id", "own"))
        order = np.flatnonzero(own)
        order = order[np.argsort(time[order], kind="stable")]
        if not len(order):
            return
        keys, (now, counts) = rows.select(["event_id", "machine_id"]), np.unique(time[order], return_counts=True)
        ids, texts, size, start = [], [], 0, 0
        for (n, text), count in zip(_at_times(now, time, doc, own, span), counts.tolist()):
            for _ in range(count):
                ids.append(n)
                texts.append(text)
                size += len(text)
                if size >= _BATCH_BYTES:
                    yield _batch(keys, order[start : start + len(ids)], ids, texts)
                    start, ids, texts, size = start + len(ids), [], [], 0
        if ids:
            yield _batch(keys, order[start:], ids, texts)

    return run


def _batch(keys: pa.Table, at: np.ndarray, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    columns = [c.combine_chunks() for c in keys.take(pa.array(at)).columns]
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int32)
    documents = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(b"".join(texts)))
    return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.int64()), documents], ["event_id", "machine_id", "n_affine", "documents"])


def _at_times(now: np.ndarray, time: np.ndarray, doc: np.ndarray, own: np.ndarray, span: int) -> Iterator[tuple[int, bytes]]:
    """(number, list) of the documents affine at each of the ascending times ``now`` of a slice's own touches.

    A document leaves ``span`` after its last touch in the slice before, and is there from its first own touch on.
    The list is kept as texts of about a square root of the documents each: a change makes one of them anew.
    """
    docs, of = np.unique(doc, return_inverse=True)
    last, first = np.full(len(docs), -1), np.full(len(docs), len(now))
    np.maximum.at(last, of[~own], np.searchsorted(now, time[~own] + span, side="right") - 1)
    np.minimum.at(first, of[own], np.searchsorted(now, time[own]))
    gap = last + 1 < first  # else it is there at all times
    leaves, comes = np.flatnonzero(gap & (last >= 0)), np.flatnonzero(gap & (first < len(now)))
    when, changed = np.concatenate([last[leaves] + 1, first[comes]]), np.concatenate([leaves, comes])
    order = np.argsort(when, kind="stable")
    bounds, changed = np.searchsorted(when[order], np.arange(len(now) + 1)).tolist(), changed[order].tolist()
    names, there, width = docs.astype(bytes).tolist(), bytearray((~gap | (last >= 0)).tolist()), isqrt(len(docs))
    n = sum(there)
    text = lambda k: b",".join(compress(names[k * width : (k + 1) * width], there[k * width : (k + 1) * width]))
    parts = [text(k) for k in range(-(-len(docs) // width))]
    for start, end in zip(bounds, bounds[1:]):
        for d in changed[start:end]:
            there[d] ^= 1
            n += 2 * there[d] - 1
        for k in {d // width for d in changed[start:end]}:
            parts[k] = text(k)
        yield n, b",".join(filter(None, parts))
