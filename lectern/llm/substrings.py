"""Removal of every passage of ``length`` bytes that also starts anywhere else, by suffix arrays over shards.

Equal passages must meet in one shard, whichever documents hold them. Every passage (a window of
``length`` bytes) picks as its anchor the ``GRAM``-byte gram of least hash in it, the leftmost of equal ones;
equal windows pick equal anchors at the same place. A document thus falls into segments, runs of windows
with one anchor, about one for each 85 bytes. Segments are counted by anchor; only anchors that occur twice
go on. Where all of an anchor's segments are equal bytes their windows repeat as a whole; where they differ,
one copy of each goes to the shard of its anchor, which builds a suffix array by induced sorting and takes
the windows that a permuted common prefix of ``length`` joins.

An anchor with more than ``HOT`` different segments (the edges of a passage that very many documents share)
is split: the windows of its segments are dealt by their hash, packed in arrays, and counted there. No group
is gathered whole, no row is dropped, and results are the same for any value of ``HOT``.

Documents are told apart by a 64-bit hash of key and text, segments by 128 bits of hash.

Defined cases: a null text is empty; a text shorter than ``length`` keeps all; passages overlapping themselves
count as repeated; rows of equal key and text each hold the other's passages; null keys are allowed; an empty
table gives an empty result; input columns of any name are kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.suffixes import PrefixHashes, permuted_joins, suffix_array
from lectern.llm.text import range_hashes, slices, utf8
from lectern.sources import discard, stored, table

LENGTH, GRAM = 200, 32
HOT = 2_000
SHARD_BYTES = 1 << 20
#: Document keys that may be sent to all executors (8 bytes each); beyond, they are joined.
BROADCAST_KEYS = 500_000
_SLICE = 1 << 19


def row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("string"), F.lit("\0"), F.coalesce(text, F.lit("")))


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, first window, number of windows) of all segments of a slice."""
    n = len(data)
    edge = np.zeros(n + 1, np.int8)
    ends = np.maximum(offsets[:-1], offsets[1:] - (length - 1))
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, ends, -1)
    windows = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    starts = np.arange(n - gram + 1)
    hashes = range_hashes(data, starts, starts + gram)
    least = hashes & np.uint64(0xFFFFFFFF00000000) | starts.astype(np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    count = np.diff(np.append(begin, len(windows)))
    first = windows[begin]
    place = anchor[begin]
    # The anchor's place in the segment is part of what must be equal.
    whole = range_hashes(data, first, first + count + length - 1) ^ ((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes[place], whole, first, count


def _all_segments(docs: DataFrame, length: int) -> DataFrame:
    """(h, f, doc, at, n): anchor, segment hash, document, first byte, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            data, offsets = utf8(part.column(1))
            h, f, first, count = segments(data, offsets, length)
            row = np.searchsorted(offsets, first, "right") - 1
            doc = np.asarray(part.column(0))[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), f.view(np.int64), doc, (first - offsets[row]).astype(np.int32), count.astype(np.int32))], ["h", "f", "doc", "at", "n"])

    return docs.select("doc", "text").mapInArrow(run, "h bigint, f bigint, doc bigint, at int, n int")


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of one copy of each segment of ``wanted`` (h, f, c, hot, doc, at, n)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "f", "c", "hot", "at", "n")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            data, offsets = utf8(part.column(0))
            cuts = part.column(1)
            flat = cuts.flatten()
            row = np.repeat(np.arange(len(cuts)), np.asarray(cuts.value_lengths()))
            at, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (4, 5))
            start = offsets[row] + at
            size = n + length - 1
            ends = np.append(0, np.cumsum(size))
            own = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
            passage = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(own)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in range(4)), passage], ["h", "f", "c", "hot", "passage"])

    return docs.join(lists, "doc").select("text", "cuts").mapInArrow(run, "h bigint, f bigint, c bigint, hot boolean, passage binary")


def narrowed(docs: DataFrame, keys: DataFrame, how: str, most: int = BROADCAST_KEYS, on: str = "doc") -> DataFrame:
    """The documents with (``left_semi``) or without (``left_anti``) a key in ``keys``. Up to ``most`` keys
    are sent to the executors, so that texts stay where they are; more are joined by shuffling."""
    n = keys.limit(most + 1).count()
    return docs.join(F.broadcast(keys) if n <= most else keys, on, how)


def _runs(marks: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each row its maximal runs of marked windows, as a flat list first, last, first, last, ..."""
    n = len(marks)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, marks[:-1]), np.append(marks[1:], False)
    first = np.flatnonzero(marks & (edge[:n] | ~before))
    last = np.flatnonzero(marks & (edge[1:] | ~after))
    row = np.searchsorted(offsets, first, "right") - 1
    flat = np.stack([first - offsets[row], last - offsets[row]], axis=1).reshape(-1).astype(np.int32)
    counts = np.bincount(row, minlength=len(offsets) - 1) * 2
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat))


def shard_repeats(passages: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(marks of the windows that occur twice or more among the passages, offsets of each passage's windows)."""
    sizes = np.array([len(p) for p in passages])
    text = np.frombuffer(b"\0".join(passages) + b"\0", np.uint8).astype(np.int64)
    stops = np.cumsum(sizes + 1) - 1
    text += 2
    text[stops] = 1
    order = suffix_array(np.append(text, 0))
    # A prefix may run over the end of a passage; a window that lies in its passage has no such prefix.
    joined = permuted_joins(np.append(text, 0), order, length)[order]
    twice = joined.copy()
    twice[:-1] |= joined[1:]
    marks = np.zeros(len(text) + 1, bool)
    marks[order] = twice
    windows = sizes - length + 1
    at = np.append(0, np.cumsum(windows))
    first = stops - sizes
    return marks[np.repeat(first - at[:-1], windows) + np.arange(at[-1])], at


def _by_shard(cold: DataFrame, n_bytes: int, length: int) -> DataFrame:
    """(h, f, runs) of the segments whose anchors go to one shard each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        order = np.lexsort((whole["f"].to_numpy(), whole["h"].to_numpy()))
        h, f = whole["h"].to_numpy()[order], whole["f"].to_numpy()[order]
        new = np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1]))  # a row that stands twice gives its passages twice
        order, h, f = order[new], h[new], f[new]
        # Anchors in turn, as many at a time as make a shard.
        passages = whole["passage"].take(pa.array(order)).to_pylist()
        sizes = np.cumsum([len(p) for p in passages])
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        shard = sizes[heads] // SHARD_BYTES
        starts = heads[np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))]
        for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
            marks, at = shard_repeats(passages[a:b], length)
            yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(f[a:b]), _runs(marks, at)], ["h", "f", "runs"])

    shards = max(1, -(-n_bytes // SHARD_BYTES))
    return cold.select("h", "f", "passage").repartition(shards, "h").mapInArrow(run, "h bigint, f bigint, runs array<int>")


def _by_window(hot: DataFrame, n_bytes: int, length: int) -> DataFrame:
    """(h, f, windows), in parts, of the segments of anchors that are too common for one shard: their windows, packed and dealt by hash."""
    buckets = max(1, -(-n_bytes * 8 // SHARD_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "passage", _SLICE):
            data, offsets = utf8(part.column(2))
            windows = np.diff(offsets) - length + 1
            at = np.append(0, np.cumsum(windows))
            first = np.repeat(offsets[:-1] - at[:-1], windows) + np.arange(at[-1])
            one = range_hashes(data, first, first + length)
            two = PrefixHashes(data).of(first, length)
            row = np.repeat(np.arange(len(windows)), windows)
            packed = np.rec.fromarrays([one, two, np.asarray(part.column(0))[row], np.asarray(part.column(1))[row], (np.arange(at[-1]) - at[row]).astype(np.int64)], names="one,two,h,f,w")
            bucket = (one % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            packed, bucket = packed[order], bucket[order]
            heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array([x.tobytes() for x in np.split(packed, heads[1:])], pa.binary())], ["bucket", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.as_buffer().to_pybytes() for batch in batches for x in batch.column(1)]
        if not parts:
            return
        kind = np.dtype([("one", "<u8"), ("two", "<u8"), ("h", "<i8"), ("f", "<i8"), ("w", "<i8")])
        all_ = np.frombuffer(b"".join(parts), kind)
        all_ = np.unique(all_)  # in order of the hashes; a segment that came twice counts once
        same = (all_["one"][1:] == all_["one"][:-1]) & (all_["two"][1:] == all_["two"][:-1])
        found = all_[np.append(same, False) | np.append(False, same)]
        found = found[np.lexsort((found["w"], found["f"], found["h"]))]
        if not len(found):
            return
        heads = np.flatnonzero(np.append(True, (found["h"][1:] != found["h"][:-1]) | (found["f"][1:] != found["f"][:-1])))
        own = np.split(found["w"].astype(np.int32), heads[1:])
        yield pa.RecordBatch.from_arrays([pa.array(found["h"][heads]), pa.array(found["f"][heads]), pa.array(own, pa.list_(pa.int32()))], ["h", "f", "windows"])

    dealt = hot.select("h", "f", "passage").mapInArrow(deal, "bucket bigint, packed binary")
    return dealt.repartition(buckets, "bucket").mapInArrow(count, "h bigint, f bigint, windows array<int>")


def _joined_windows(found: DataFrame) -> DataFrame:
    """(h, f, runs) from lists of a segment's windows (h, f, windows): windows in a row are one run."""
    shifted = lambda by: F.array_except("windows", F.transform("windows", lambda w: w + F.lit(by)))
    whole = found.groupBy("h", "f").agg(F.array_sort(F.flatten(F.collect_list("windows"))).alias("windows"))
    return whole.select("h", "f", F.flatten(F.zip_with(shifted(1), shifted(-1), lambda first, last: F.array(first, last))).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, spans): for each document (``doc``, ``text``) with repeats its spans of bytes, packed as start * 2^31 + end."""
    found = stored(_all_segments(docs, length), "segments")
    repeated = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), (F.min("f") != F.max("f")).alias("differ")).where("c > 1").select("h", "differ")
    # Written first, so that the joins below meet two plain shuffles: Spark then splits the part of a very common key.
    repeated = stored(repeated, "repeated-anchors")
    met = stored(found.join(repeated, "h"), "repeated-segments")
    discard(found)
    discard(repeated)
    kinds = met.where("differ").groupBy("h", "f").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "at", "n")).alias("one"))
    kinds = stored(kinds.select("h", "f", "c", "one.doc", "one.at", "one.n"), "segment-kinds")
    common = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("h", F.lit(True).alias("hot"))
    wanted = kinds.join(common, "h", "left").fillna({"hot": False})
    passages = stored(_cut_out(narrowed(docs, kinds.select("doc").distinct(), "left_semi"), wanted, length), "passages")
    n_cold, n_hot = passages.agg(*(F.coalesce(F.sum(F.when(c, F.length("passage"))), F.lit(0)) for c in (~F.col("hot"), F.col("hot")))).head()
    runs = _by_shard(passages.where(~F.col("hot")), n_cold, length).where(F.size("runs") > 0)
    if n_hot:
        runs = runs.unionByName(_joined_windows(_by_window(passages.where("hot"), n_hot, length)))
    runs = stored(runs, "runs")
    discard(passages)
    judged = stored(kinds.join(runs, ["h", "f"], "left").select("h", "f", "c", "runs").where("c > 1 OR runs IS NOT NULL"), "judged-kinds")
    pack = lambda a, b: F.shiftleft(F.col("at").cast("bigint") + a, 31) + F.col("at") + b + length
    last = F.col("n") - 1
    whole = met.where(~F.col("differ")).select("doc", F.array(pack(F.lit(0), last)).alias("spans"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda k: pack(F.get("runs", k), F.get("runs", k + 1)))
    part = met.where("differ").join(judged, ["h", "f"]).select("doc", F.when(F.col("c") > 1, F.array(pack(F.lit(0), last))).otherwise(pairs).alias("spans"))
    # A segment's spans go to its document as one list; lists of one document differ unless its row stands twice.
    spans = stored(whole.unionByName(part).groupBy("doc").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    for used in (met, kinds, runs, judged):
        discard(used)
    return spans


def cut_repeats(docs: DataFrame, spans: DataFrame, columns: str) -> DataFrame:
    """``docs`` (``doc``, ``text``, others) that have spans, with their merged spans and kept bytes."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            data, offsets = utf8(part.column(part.schema.get_field_index("text")))
            lists = part.column(part.schema.get_field_index("spans"))
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            flat = np.asarray(lists.flatten())
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, offsets[row] + (flat >> 31), 1)
            np.add.at(edge, offsets[row] + (flat & ((1 << 31) - 1)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept_at = np.append(0, np.cumsum(~gone))[offsets]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(kept_at), pa.py_buffer(data[~gone])]).cast(pa.binary())
            runs = _runs(gone, offsets)
            own = [part.column(part.schema.get_field_index(f.name)) for f in schema]
            yield pa.RecordBatch.from_arrays([*own, kept, runs], [*(f.name for f in schema), "kept", "removed"])

    return docs.join(spans, "doc").mapInArrow(run, f"{columns}, kept binary, removed array<int>")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(row_key(F.col(key), F.col(text)).alias("doc"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """key, text (as read), kept (the bytes left), removed (flat list: first and last byte of each removed run)."""
    rows = _keyed(docs, key, text)
    spans = repeated_spans(rows, length, hot)
    keys = spans.select("doc")
    kind = docs.schema[key].dataType.simpleString()
    cut = cut_repeats(narrowed(rows, keys, "left_semi"), spans, f"doc bigint, key {kind}, text string")
    whole = narrowed(rows, keys, "left_anti").select("doc", "key", "text", F.encode("text", "UTF-8").alias("kept"), F.array().cast("array<int>").alias("removed"))
    return cut.unionByName(whole).drop("doc").withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The documents with all their columns, repeated passages cut from the text.

    A cut inside a multi-byte character leaves no part of it. Documents with nothing left go.
    """
    spans = repeated_spans(_keyed(docs, key, text), length, hot)
    rows = docs.select(row_key(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    cut = narrowed(rows, spans.select("doc"), "left_semi").join(spans, "doc")

    @F.arrow_udf("string")
    def kept(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for part in slices([pa.RecordBatch.from_arrays([texts, lists], ["text", "spans"])], "text", _SLICE):
            data, offsets = utf8(part.column(0))
            own = part.column(1)
            row = np.repeat(np.arange(len(own)), np.asarray(own.value_lengths()))
            flat = np.asarray(own.flatten())
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, offsets[row] + (flat >> 31), 1)
            np.add.at(edge, offsets[row] + (flat & ((1 << 31) - 1)), -1)
            stay = np.cumsum(edge)[:-1] == 0
            left, at = data[stay], np.append(0, np.cumsum(stay))[offsets]
            out += [left[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.array(out, pa.string())

    kept = kept.asNondeterministic()  # else the filter below would run it a second time
    named = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    new = cut.select("row", kept("text", "spans").alias("text")).where(F.length("text") > 0)
    new = new.select(*(F.col("text").alias(c) if c == text else x for c, x in zip(docs.columns, named, strict=True)))
    same = narrowed(rows, spans.select("doc"), "left_anti").select(*named)
    return new.unionByName(same)


def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_substrings(table(spark, folder, "documents"))
    n = F.size("removed")
    lost = F.aggregate(F.sequence(F.lit(0), n - 2, F.lit(2)), F.lit(0).cast("bigint"), lambda total, k: total + F.get("removed", k + 1) - F.get("removed", k) + 1)
    return found.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.when(n > 0, lost).otherwise(F.lit(0).cast("bigint")).alias("n_removed"), (n / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
