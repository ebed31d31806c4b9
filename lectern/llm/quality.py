"""Quality rules from repetition coverage.

Rolling hashes of word n-grams of several lengths find the n-grams that a text holds twice or more;
the rules look at the share of a text's characters that such n-grams, or repeated lines, cover.

Defined cases: a null or empty text has no words, all its counts are 0 and it fails the base rule; a
text shorter than an n-gram has none of that length; repeated rows are judged one by one; an empty
table gives an empty result; further columns of the input never clash, as only the key and the text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.text import gram_hashes, mixed, owners, slices, span_hashes, spans, sums, utf8
from lectern.sources import table

#: n-gram length: the largest share of a text's word characters that repeated n-grams of it may cover. Held against the
#: labelled documents: 3-grams find stuttered words, which longer n-grams miss; prose of 20,000 words is at 0.05.
COVERAGE_LIMITS = {3: 0.8, 5: 0.4, 6: 0.38, 7: 0.36, 8: 0.34, 10: 0.32}
LINE_COVERAGE_LIMIT = 0.35
#: Symbols a word.
SYMBOL_LIMIT = 0.3
BASE_GRAM, BASE_PERCENT, LEAST_WORDS = 8, 30, 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def repetition_figures(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts and covered characters of each text of a slice; ``chars_n`` for each n of ``lengths``."""
    n_docs = len(offsets) - 1
    is_char = (data & 0xC0) != 0x80
    starts, ends = spans(~_SPACE[data], offsets)
    word_doc = owners(offsets, starts)
    char_total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_char, out=char_total[1:])
    word_chars = char_total[ends] - char_total[starts]
    word_at = np.searchsorted(starts, offsets)  # words before each text's end
    out = {"n_words": np.diff(word_at), "word_chars": sums(word_chars, word_at), "n_symbols": sums(_SYMBOL[data], offsets)}

    line_starts, line_ends = spans(data != 0x0A, offsets)
    lines_with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[lines_with_word], line_ends[lines_with_word]
    line_doc = owners(offsets, line_starts)
    line_key = _in_text(span_hashes(data, line_starts, line_ends), line_doc)
    order = np.argsort(line_key, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = line_key[order][1:] == line_key[order][:-1]
    again = np.zeros(len(order), bool)
    again[order] = same
    line_at = np.searchsorted(line_starts, offsets)
    repeated = again | _repeated(line_key)
    out["n_dup_lines"] = sums(again, line_at)
    out["chars_lines"] = sums((char_total[line_ends] - char_total[line_starts]) * repeated, line_at)
    out["n_chars"] = char_total[offsets[1:]] - char_total[offsets[:-1]]

    words = span_hashes(data, starts, ends)
    found = None
    for n in sorted({*lengths, BASE_GRAM}):
        size = max(0, len(words) - n + 1)
        # An n-gram that occurs twice holds shorter ones that do: only their places need a look.
        places = np.flatnonzero(word_doc[:size] == word_doc[n - 1 :]) if found is None else found[found < size]
        places = places[word_doc[places] == word_doc[places + n - 1]]
        found = places[_repeated(_in_text(gram_hashes(words, n)[places], word_doc[places]))]
        edge = np.zeros(len(words) + 1, np.int64)
        edge[found] += 1
        edge[found + n] -= 1
        covered = np.cumsum(edge)[:-1] > 0
        out[f"chars_{n}"] = sums(word_chars * covered, word_at)
        if n == BASE_GRAM:
            out["n_repeat_words"] = sums(covered, word_at)
    assert all(len(x) == n_docs for x in out.values())
    return out


def _in_text(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return hashes ^ mixed(doc.astype(np.uint64) + np.uint64(1))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: dict[int, float] = COVERAGE_LIMITS, line_limit: float = LINE_COVERAGE_LIMIT, symbol_limit: float = SYMBOL_LIMIT) -> DataFrame:
    """Figures and verdict of each text: key, counts, coverage of each length, base_failed, kept."""
    lengths = tuple(sorted(limits))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = repetition_figures(*utf8(part.column(1)), lengths)
            chars = np.maximum(x["word_chars"], 1)
            base, kept = judged(x, limits, line_limit, symbol_limit)
            counts = [x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(base), pa.array(kept), pa.array(x["chars_lines"] / np.maximum(x["n_chars"], 1)), *(pa.array(x[f"chars_{n}"] / chars) for n in lengths)], names)

    kind = docs.schema[key].dataType.simpleString()
    columns = [(key, kind), *((c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean"), ("line_coverage", "double"), *((f"coverage_{n}", "double") for n in lengths)]
    names = [c for c, _ in columns]
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(measure, ", ".join(f"`{c}` {k}" for c, k in columns))


def judged(x: dict[str, np.ndarray], limits: dict[int, float], line_limit: float, symbol_limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(base rule failed, text kept) from a slice's figures."""
    base = (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > BASE_PERCENT * x["n_words"])
    kept = ~base & (x["chars_lines"] <= line_limit * x["n_chars"]) & (x["n_symbols"] <= symbol_limit * x["n_words"])
    for n, most in limits.items():
        kept &= x[f"chars_{n}"] <= most * x["word_chars"]
    return base, kept


def keep_good(docs: DataFrame, text: str = "text", limits: dict[int, float] = COVERAGE_LIMITS, line_limit: float = LINE_COVERAGE_LIMIT, symbol_limit: float = SYMBOL_LIMIT) -> DataFrame:
    """The documents that pass, with all their columns. The texts are judged where they lie: no join."""
    lengths = tuple(sorted(limits))

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = slices([pa.RecordBatch.from_arrays([column], ["text"])], "text")
            found = [judged(repetition_figures(*utf8(x.column(0)), lengths), limits, line_limit, symbol_limit)[1] for x in parts]
            yield pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(good(F.col(text)))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))
