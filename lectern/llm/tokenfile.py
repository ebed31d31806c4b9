"""Token ids in binary shard files of Simple-8b words.

A shard holds the ids of a range of keys. Ids stand in blocks of ``BLOCK``; each block is a run of
64-bit words, and a table of word offsets lets any block be decoded by itself. A word's top four bits
select how many ids of how many bits fill the other sixty; an id too large for sixty bits is escaped: a
one-id word of all ones says that the next word is the id itself.

Layout, all little-endian: magic ``SIMPLE8B``, rows, ids, blocks, words (int64 each); row keys (int64), row
key is-null (uint8), ids a row (int64), word offset of each block (int64, one more than blocks), words
(uint64), a line feed.

A task writes the range of keys that it has as shards of about ``SHARD_IDS`` ids, one after the other, and holds
one shard at a time. The files are written by Spark (a text file of one record each), so that they can lie in
any store that Spark writes to, and a task that fails or runs twice leaves no file of its own. Their names
hold the task's range and the shard's number in it, which is the order of the ids.

Defined cases: a null or empty text has the end id alone; a null key comes first; rows of equal key stand
in order of their text's hash; no rows give no files and an empty result; further columns cannot clash,
as only key and text are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import encoded_slices, id_columns, library_memory
from lectern.sources import stored, table
from lectern.sources.shared import fresh_path

#: Ids after which a shard ends, with the row that reaches them.
SHARD_IDS = 1 << 20

BLOCK = 256
MAGIC = b"SIMPLE8B"
#: Ids a word and bits an id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LARGE = (1 << 60) - 1
_ESCAPE = np.uint64(15 << 60 | _LARGE)
_CHUNK = 1 << 20


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end)."""
    words, sizes = [], [np.zeros(1, np.int64)]
    for first in range(0, len(ids), _CHUNK):
        part, n = _pack_blocks(np.asarray(ids[first : first + _CHUNK], np.uint64))
        words.append(part)
        sizes.append(n)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.cumsum(np.concatenate(sizes))


def _pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_blocks = -(-len(ids) // BLOCK)
    values = np.zeros((n_blocks, BLOCK), np.uint64)
    values.reshape(-1)[: len(ids)] = ids
    total = np.full(n_blocks, BLOCK, np.int64)
    total[-1] = len(ids) - BLOCK * (n_blocks - 1)
    # What stands after a block's end counts as zeros, which fit everywhere.
    widest = np.zeros((n_blocks, BLOCK + int(COUNTS[0])), np.uint8)
    widest[:, :BLOCK] = np.frexp(values.astype(np.float64))[1]
    # The best selector for a word that would start at each place: the one of most ids that all fit.
    best = np.full((n_blocks, BLOCK), 15, np.uint8)
    size = 1
    for s in range(14, -1, -1):
        while size < COUNTS[s]:  # widest[:, k]: the bits that the ``size`` ids from k on need
            step = min(size, int(COUNTS[s]) - size)
            np.maximum(widest[:, :-step], widest[:, step:], out=widest[:, :-step])
            size += step
        best[widest[:, :BLOCK] <= WIDTHS[s]] = s
    steps = []
    live = np.arange(n_blocks)
    at = np.zeros(n_blocks, np.int64)
    while len(live):
        selector = best[live, at].astype(np.int64)
        steps.append((live, at, selector))
        at = at + COUNTS[selector]
        more = at < total[live]
        live, at = live[more], at[more]
    block = np.concatenate([x[0] for x in steps])
    place = np.concatenate([x[1] for x in steps])
    selector = np.concatenate([x[2] for x in steps])
    order = np.lexsort((place, block))
    block, place, selector = block[order], place[order], selector[order]
    packed = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        if WIDTHS[s] == 0:
            continue
        mine = np.flatnonzero(selector == s)
        column = place[mine, None] + np.arange(COUNTS[s])
        inside = column < BLOCK
        x = np.where(inside, values[block[mine, None], np.minimum(column, BLOCK - 1)], np.uint64(0))
        if s == 15:
            x = np.minimum(x, np.uint64(_LARGE))
        packed[mine] |= np.bitwise_or.reduce(x << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])), axis=1)
    escaped = packed == _ESCAPE
    sizes = np.bincount(block, 1 + escaped, n_blocks).astype(np.int64)
    if escaped.any():
        k = np.flatnonzero(escaped)
        packed = np.insert(packed, k + 1, values[block[k], place[k]])
    return packed, sizes


def unpack_ids(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks: ``words`` and their offsets by block."""
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), bool)
    mark = np.flatnonzero(words == _ESCAPE)
    if len(mark):  # a raw word may look like a mark: in a run of such words every other one is a mark
        start = np.append(True, np.diff(mark) != 1)
        nth = np.arange(len(mark)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        raw[mark[nth % 2 == 0] + 1] = True
    selector = (words >> np.uint64(60)).astype(np.int64)
    selector[raw] = 15
    counts = COUNTS[selector]
    counts[raw] = 0
    ends = np.cumsum(counts)
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begun = np.append(0, ends)[offsets[:-1]]
    place = ends - counts - begun[block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        if WIDTHS[s] == 0:
            continue
        mine = np.flatnonzero((selector == s) & ~raw)
        column = place[mine, None] + np.arange(COUNTS[s])
        x = words[mine, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])) & np.uint64((1 << int(WIDTHS[s])) - 1)
        inside = column < limit[mine, None]
        out[column[inside]] = x[inside]
    escapes = np.flatnonzero(raw) - 1
    out[place[escapes]] = words[escapes + 1]
    return out


def shard_bytes(keys: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard file."""
    words, offsets = pack_ids(ids)
    head = MAGIC + struct.pack("<4q", len(keys), len(ids), len(offsets) - 1, len(words))
    return b"".join([head, keys.astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(), counts.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def read_shard(content: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, is null, ids a row, ids) of a shard file."""
    if bytes(content[:8]) != MAGIC:
        raise ValueError("not a token shard")
    rows, n, blocks, n_words = struct.unpack_from("<4q", content, 8)
    out, at = [], 40
    for kind, size in (("<i8", rows), ("u1", rows), ("<i8", rows), ("<i8", blocks + 1), ("<u8", n_words)):
        out.append(np.frombuffer(content, kind, size, at))
        at += out[-1].nbytes
    keys, missing, counts, offsets, words = out
    return keys, missing.astype(bool), counts, unpack_ids(words, offsets, n)


def write_shards(docs: DataFrame, vocabulary: str, end: int, drops_space: bool = False, key: str = "doc_id", text: str = "text", most: int = SHARD_IDS) -> str:
    """Writes the ids of all texts in order of the key; returns the folder of the shards."""
    folder = fresh_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            content = shard_bytes(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for part, ids, at in encoded_slices(batches, library_memory(vocabulary, drops_space), end):
            keys, missing = np.asarray(part.column(0).fill_null(0)), np.asarray(part.column(0).is_null())
            first = 0
            while first < len(keys):
                last = max(first + 1, int(np.searchsorted(at, at[first] + most - size, "right")) - 1)
                held.append((keys[first:last], missing[first:last], np.diff(at[first : last + 1]), ids[at[first] : at[last]]))
                size += int(at[last] - at[first])
                first = last
                if size >= most or first < len(keys):
                    yield shard()
                    size = 0
        if held:
            yield shard()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    # Ranges end within a key too, however many rows it has.
    ordered = rows.repartitionByRange("key", "hash", "row").sortWithinPartitions("key", "hash").select("key", "text")
    shards = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    shards.write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids of every row of the shards in a folder."""
    name = F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)[^/]*$", 1), F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)[^/]*$", 2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files = files.where("length > 0").select(*(x.cast("bigint").alias(c) for c, x in zip(("range", "nth"), name, strict=True)), "content")
    # The head's count, last byte first; ``reverse`` would keep bytes together that look like a character of UTF-8.
    head = F.hex(F.substring("content", 17, 8))
    n_ids = F.conv(F.concat(*(F.substring(head, k, 2) for k in range(15, 0, -2))), 16, 10).cast("bigint")
    sizes = stored(files.select("range", "nth", n_ids.alias("n_ids")), "shard-sizes")
    # A row a shard: ids before a range by the ranges' sums, and before a shard within its range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.join(ranges, "range").select(F.col("range").alias("_range"), F.col("nth").alias("_nth"), (F.col("earlier") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for range_, nth, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                keys, missing, counts, ids = read_shard(content.as_buffer())
                at = np.append(0, np.cumsum(counts))
                low = ids.astype("<u4")
                for k in range(0, len(keys), 2000):
                    rows = slice(k, min(k + 2000, len(keys)))
                    own = id_columns(low[at[rows.start] : at[rows.stop]], at[rows.start : rows.stop + 1] - at[rows.start])
                    n = rows.stop - rows.start
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows], mask=missing[rows]), *(pa.array(np.full(n, x.as_py())) for x in (range_, nth)), pa.array(at[rows]), pa.array(counts[rows]), own], [key, "range", "nth", "start", "n_tokens", "ids"])

    read = files.mapInArrow(run, f"`{key}` bigint, range bigint, nth bigint, start bigint, n_tokens bigint, ids binary")
    placed = read.join(base, (F.col("range") == F.col("_range")) & (F.col("nth") == F.col("_nth")))
    return placed.select(key, (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    shards = write_shards(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_shards(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
