"""Periodic runs in texts: stretches of words that repeat with a period, and the texts without the repeats.

A run is a stretch of consecutive words that its smallest period q makes equal q words apart, at least ``least``
words and ``exponent`` periods long, and that no neighbouring word extends. Each run has a Lyndon root: the longest
Lyndon word that starts at the root's place, under the order of words or under its reverse. So a stack is
scanned from right to left under both orders; suffixes are compared, and roots extended to both sides, by the
longest common extension, found by doubling and binary search over rolling hashes modulo 2^61 - 1. What was found
for a distance is remembered for the places before, and the words of every run are compared one by one in the end.

Only stretches in which each window of ``window`` words occurs again, no farther away than a run could reach, are
scanned: a run of ``exponent`` >= 3 periods lies within one of them as a whole.

Defined cases: words are runs of bytes but white space (``[^\\x20\\x09-\\x0D]+``); a null or empty text has no words,
no runs and an empty collapsed text; a text is one task's work, however long (about 60 bytes a word); repeated rows
and null keys are treated row by row; an empty table gives an empty result; only key and text are read, so further
columns cannot clash. Runs are ordered by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.text import gram_hashes, mixed, slices
from lectern.sources import table

LEAST, EXPONENT = 24, 3
_PRIME, _BASE = (1 << 61) - 1, 0x1A2B3C4D5E6F7081
#: Times that stretches are narrowed; more would change no result.
_NARROW = 4


class _Words:
    """Common extensions of suffixes of one stretch of word numbers."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.prefix, self.power = [0], [1]
        for w in words:
            self.prefix.append((self.prefix[-1] * _BASE + w + 1) % _PRIME)
            self.power.append(self.power[-1] * _BASE % _PRIME)
        #: distance: (first, end) such that words first..end - 1 equal those at the distance, and the word at end doesn't.
        self.known: dict[int, tuple[int, int]] = {}

    def equal(self, i: int, j: int, size: int) -> bool:
        """Whether ``size`` words from i and from j on are equal, by their hashes."""
        h = self.prefix
        return (h[i + size] - h[j + size] - (h[i] - h[j]) * self.power[size]) % _PRIME == 0

    def _matching(self, i: int, j: int, limit: int, side: int) -> int:
        """Words, ``limit`` at most, that are equal from i and j on (side 1) or before i and j (side -1)."""
        words, t = self.words, 0
        near = min(limit, 8)
        while t < near and (words[i + t] == words[j + t] if side > 0 else words[i - t - 1] == words[j - t - 1]):
            t += 1
        if t < near or t == limit:
            return t
        same = self.equal if side > 0 else lambda i, j, size: self.equal(i - size, j - size, size)
        step = 8
        while t + step < limit and same(i, j, t + step):
            t, step = t + step, 2 * step
        low, high = t, min(limit, t + step)
        while low < high:
            middle = (low + high + 1) // 2
            if same(i, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def ahead(self, i: int, j: int) -> int:
        """Length of the longest common prefix of the suffixes at i < j."""
        if self.words[i] != self.words[j]:
            return 0
        first, end = self.known.get(j - i, (self.n, -1))
        if first <= i <= end:
            return end - i
        if i < first <= end:
            t = self._matching(i, j, first - i, 1)
            if t < first - i:
                end = i + t
        else:
            end = i + self._matching(i, j, self.n - j, 1)
        self.known[j - i] = i, end
        return end - i

    def before(self, i: int, j: int) -> int:
        """Equal words before i and before j."""
        return self._matching(i, j, i, -1)


def stretch_runs(words: list[int], least: int = LEAST, exponent: int = EXPONENT) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs in a stretch of word numbers."""
    n, found, text = len(words), set(), _Words(words)
    for forward in (True, False):
        text.known.clear()
        left_end: dict[int, int] = {}  # period: start of the run that was met last
        after = [n] * n  # end of the longest Lyndon word at each place
        for i in range(n - 1, -1, -1):
            e, common = i + 1, 0
            while e < n:
                common = text.ahead(i, e)
                if e + common == n or (words[i + common] < words[e + common]) != forward:
                    break
                e = after[e]
            after[i] = e
            period = e - i
            # The first whole root of a run starts within its first period, so at least this much follows it.
            if e == n or common < max(least, exponent * period) - 2 * period or left_end.get(period, n) <= i:
                continue
            start, end = i - text.before(i, e), e + common
            if words[start : end - period] != words[start + period : end]:  # two hashes met: look at the words
                start, end = i, e
                while start and words[start - 1] == words[start - 1 + period]:
                    start -= 1
                while end < n and words[end] == words[end - period]:
                    end += 1
            left_end[period] = start
            if end - start >= max(least, exponent * period):
                found.add((start, end - start, period))
    return found


def repeating_stretches(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(start, end) of stretches of words outside of which no run lies.

    Every window of g = 1 + least * (exponent - 2) // exponent words in a run occurs again one period away in it,
    and the period is at most the run's length / exponent.
    """
    window = 1 + least * (exponent - 2) // exponent
    if len(ids) < least:
        return []
    hashes = gram_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), window)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return []
    far = len(ids) + 1
    gap = np.diff(order)[same]
    near = np.full(len(hashes), far)
    near[order[1:][same]] = gap
    near[order[:-1][same]] = np.minimum(near[order[:-1][same]], gap)
    keep = near < far
    for _ in range(_NARROW):
        edge = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
        first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = stop - first + window - 1
        most = np.repeat(np.where(size >= least, size // exponent, -1), stop - first)
        places = np.flatnonzero(keep)
        worse = near[places] > most
        if not worse.any():
            break
        keep[places[worse]] = False
    edge = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + window - 1
    return [(int(a), int(b)) for a, b in zip(first, stop, strict=True) if b - a >= least]


def word_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    found = set()
    for a, b in repeating_stretches(ids, least, exponent):
        found |= {(a + start, length, period) for start, length, period in stretch_runs(ids[a:b].tolist(), least, exponent)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """key, n_words, runs (start, length, period), and collapsed, the text's kept words joined by one space."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, at, flat, texts = [], [0], [], []
            for value in part.column(1).cast(pa.binary()):
                words = (value.as_py() or b"").split()  # at bytes 9 to 13 and 32
                runs = word_runs(words, least, exponent)
                counts.append(len(words))
                flat += runs
                at.append(len(flat))
                texts.append(b" ".join(collapsed_words(words, runs)).decode())
            columns = np.array(flat, np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(columns[:, k])) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.string())], [key, "n_words", "runs", "collapsed"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def looped_text(key: Column, text: Column) -> Column:
    """The text; for one key in ten (by its checksum) with its end replaced by repetitions of some of its words, joined by spaces."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(key.cast("string")), F.size(words)
    g, some = ((h - h % 10) / 10).cast("bigint"), F.greatest(n, F.lit(1))
    a = (g % some).cast("int")
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    looped = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), looped), " ")).otherwise(text)


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periodic_runs(docs.select("doc_id", looped_text(F.col("doc_id"), F.col("text")).alias("text")))
    # The longest by exact length / period; of equals the first in the order of the list.
    longest = F.aggregate(F.slice("runs", 2, 1 << 30), F.get("runs", F.lit(0)), lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period))
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
