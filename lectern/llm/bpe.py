"""Byte-level BPE encoding and decoding by merge replay.

New words of a block of the corpus are merged together: an inverted index leads from each mergeable
token pair to the places in the words where it stands, every merge that occurs is applied in order of
rank at all its places, and only the touched neighbours get new index entries. Each word's ids are kept
for the rest of the task (``tokens.PieceMemory``), so a word is merged once however often it occurs.

Defined cases: a null or empty text has no ids and decodes to no bytes; equal texts get equal ids;
texts are never cut short; an empty table gives an empty result; only key and text are read, so further
columns cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.text import releases, utf8
from lectern.llm.tokens import PieceMemory, encoded_slices, id_columns, leading_space_pieces
from lectern.sources import table


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """All merges of a vocabulary, to be replayed over sets of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.first = [ranks[bytes([b])] for b in range(256)]
        # Any two tokens whose bytes together are a token may merge into it.
        self.merged = {(ranks[t[:k]], ranks[t[k:]]): rank for t, rank in ranks.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; the words are distinct and not empty."""
        merged, first = self.merged, self.first
        token: list[int] = []  # -1: merged away, -2: the end of a word
        begin = []
        for word in words:
            begin.append(len(token))
            token.extend([first[b] for b in word])
            token.append(-2)
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        index: dict[int, list[int]] = {}
        for place in range(len(token) - 1):
            rank = merged.get((token[place], token[place + 1]))
            if rank is not None:
                index.setdefault(rank, []).append(place)
        heap = list(index)
        heapq.heapify(heap)
        early = []  # places where a merge made a pair of lower rank: those words are done one merge at a time
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            for place in places:
                left = token[place]
                if left < 0:
                    continue
                other = after[place]
                right = token[other]
                if right < 0 or merged.get((left, right)) != rank:
                    continue
                token[place], token[other] = rank, -1
                after[place] = following = after[other]
                before[following] = place
                for a, x, y in ((place, rank, token[following]), (p := before[place], token[p] if p >= 0 else -2, rank)):
                    new = merged.get((x, y))
                    if new is not None:
                        if new <= rank:
                            early.append(a)
                        if new not in index:
                            index[new] = []
                            heapq.heappush(heap, new)
                        index[new].append(a)
        out = [[t for t in token[b : b + len(w)] if t >= 0] for b, w in zip(begin, words, strict=True)]
        for k in {int(x) for x in np.searchsorted(begin, early, "right") - 1} if early else ():
            out[k] = self.one_by_one(words[k])
        return out

    def one_by_one(self, word: bytes) -> list[int]:
        """Ids of a word, always merging its leftmost pair of lowest rank."""
        token = [self.first[b] for b in word]
        while len(token) > 1:
            ranks = [self.merged.get(pair, 1 << 60) for pair in zip(token, token[1:], strict=False)]
            rank = min(ranks)
            if rank == 1 << 60:
                break
            k = ranks.index(rank)
            token[k : k + 2] = [rank]
        return token


@lru_cache(maxsize=2)
def replay_memory(path: str, pattern: str) -> PieceMemory:
    """A memory whose new pieces are split by ``pattern`` and merged together; one a Python worker."""
    replay = MergeReplay(read_ranks(path))
    words = regex.compile(pattern)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [words.findall(p) for p in pieces]
        new = list({w for x in found for w in x})
        ids = dict(zip(new, replay.encode([w.encode("utf-8") for w in new]), strict=True))
        flat = [i for x in found for w in x for i in ids[w]]
        counts = np.fromiter((sum(len(ids[w]) for w in x) for x in found), np.int64, len(found))
        return np.arange(len(pieces)), np.array(flat, np.uint32), counts

    return PieceMemory(leading_space_pieces, encode)


releases.append(replay_memory.cache_clear)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: the ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, at in encoded_slices(batches, replay_memory(ranks_path, pattern), None):
            yield pa.RecordBatch.from_arrays([part.column(0), id_columns(ids, at)], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids binary")


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    ranks = read_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    by_rank = b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1]))
    return np.frombuffer(by_rank, np.uint8), np.append(0, np.cumsum(size))


def decode_ids(ids: np.ndarray, at: np.ndarray, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of each run's bytes)."""
    data, begin = _vocabulary(ranks_path)
    n = begin[ids + 1] - begin[ids]
    ends = np.append(0, np.cumsum(n))
    return data[np.repeat(begin[ids] - ends[:-1], n) + np.arange(ends[-1])], ends[at]


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """key, ids, decoded: the bytes that each row's ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                data, at = utf8(part.column(1))
                out, ends = decode_ids(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), at // 4, ranks_path)
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoded.cast(pa.binary())], [key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
