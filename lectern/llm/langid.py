"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams in order of frequency; a text is given
the language whose profile its own most frequent n-grams are least out of place in.

Only letters count, in lower case; whatever stands between letters is one gap. N-grams of one to
three characters (gaps included at their ends) are counted over all training texts by Spark; only the
leading ranks of each language come to the driver (languages x ``PROFILE_SIZE`` rows).

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties between n-grams go
to the smaller code points, ties between languages to the smaller name; with no training text every
prediction is ``und``; a null key is never held out and never learned from; repeated rows count as
often as they occur; further columns never clash, as only key, text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.text import owners, slices, utf8
from lectern.sources import table

PROFILE_SIZE = 300
TEXT_GRAMS = 300
#: A prediction with a lower score is rejected by ``keep_known``.
LEAST_SCORE = 0.2
_GAP = 0
_SALTS = 64
_SLICE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or the gap."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else _GAP for i in range(0x110000)], np.uint32)


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every n-gram of a slice; a gram is up to three code points of 21 bits each."""
    data, at = utf8(column)
    starts = (data & 0xC0) != 0x80
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts, out=ends[1:])
    at = ends[at]
    letter = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    # A gap stands before and after each text, and runs of gaps shrink to one.
    n_rows = len(at) - 1
    chars = np.insert(letter, at, _GAP)
    row = np.insert(owners(at, np.arange(len(letter))), at, np.append(np.arange(n_rows), max(0, n_rows - 1)))
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != _GAP) | (chars[:-1] != _GAP) | (row[1:] != row[:-1])
    chars, row = chars[keep].astype(np.uint64), row[keep]
    b21, b42 = np.uint64(21), np.uint64(42)
    one = chars != _GAP
    two = (row[1:] == row[:-1]) & (one[1:] | one[:-1])
    three = (row[2:] == row[:-2]) & one[1:-1]
    grams = [chars[one], (chars[:-1] << b21 | chars[1:])[two] | np.uint64(1) << np.uint64(63), (chars[:-2] << b42 | chars[1:-1] << b21 | chars[2:])[three]]
    return np.concatenate([row[one], row[:-1][two], row[:-2][three]]), np.concatenate(grams)


def _counted(group: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count) in order of group and gram."""
    if not len(grams):
        return group[:0], grams, np.zeros(0, np.int64)
    # Each third of a gram has few values in a slice; their places in order make small keys.
    shifts = [np.uint64(42), np.uint64(21), np.uint64(0)]
    masks = [np.uint64((1 << 22) - 1), np.uint64((1 << 21) - 1), np.uint64((1 << 21) - 1)]
    key, width, names = group.astype(np.uint64), 1, []
    for shift, mask in zip(shifts, masks, strict=True):
        values = (grams >> shift) & mask
        seen = np.zeros(int(values.max()) + 1, bool)
        seen[values] = True
        names.append(np.flatnonzero(seen).astype(np.uint64))
        key = key * np.uint64(len(names[-1])) + (np.cumsum(seen) - 1)[values].astype(np.uint64)
        width *= len(names[-1])
    order = np.sort(key)
    first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
    counts = np.diff(np.append(first, len(order)))
    found = rest = order[first]
    gram = np.zeros(len(found), np.uint64)
    for shift, values in zip(shifts[::-1], names[::-1], strict=True):
        gram |= values[rest % np.uint64(len(values))] << shift
        rest = rest // np.uint64(len(values))
    return (found // np.uint64(width)).astype(np.int64), gram, counts


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language, in order; counts cover all given texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}
        held = 0
        for part in slices(batches, "text", _SLICE):
            langs = part.column(1).dictionary_encode()
            row, gram = _grams(part.column(0))
            group, gram, n = _counted(np.asarray(langs.indices)[row], gram)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                mine = group == k
                kept.setdefault(name, []).append((gram[mine], n[mine]))
                held += int(mine.sum())
            if held > 600_000:
                kept = {name: [_summed(x)] for name, x in kept.items()}
                held = sum(len(x[0][0]) for x in kept.values())
                if held > 400_000:  # more kinds of n-grams than expected: hand them on
                    yield from _counts_out(kept)
                    kept, held = {}, 0
        yield from _counts_out({name: [_summed(x)] for name, x in kept.items()})

    counts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(count, "lang string, gram bigint, n bigint")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = [F.desc("n"), F.asc("gram")]
    salted = total.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(_SALTS)))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("r") <= size)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("r") <= size)
    rows = top.select("lang", "gram", "r").toPandas().sort_values(["lang", "r"])
    return {name: x["gram"].to_numpy().astype(np.int64).view(np.uint64) for name, x in rows.groupby("lang")}


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([x[1] for x in parts]), len(gram)).astype(np.int64)


def _counts_out(kept: dict) -> Iterator[pa.RecordBatch]:
    for name, [(gram, n)] in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def rank_texts(column: pa.Array, profiles: dict[str, np.ndarray], text_grams: int = TEXT_GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text of a slice; the score is 1 less the share of the greatest distance."""
    names = np.array(sorted(profiles), object)
    n_rows = len(column)
    row, gram, count = _counted(*_grams(column))
    # Most frequent first in each text; the sort is stable, so equal counts stay in order of the gram.
    order = np.argsort(row * (int(count.max(initial=0)) + 1) + (int(count.max(initial=0)) - count), kind="stable")
    row, gram = row[order], gram[order]
    at = np.searchsorted(row, np.arange(n_rows + 1))
    rank = np.arange(len(row)) - at[row]
    head = rank < text_grams
    row, gram, rank = row[head], gram[head], rank[head]
    used = np.bincount(row, minlength=n_rows)
    distance = np.zeros((len(names), n_rows))
    most = np.zeros((len(names), n_rows))
    for k, name in enumerate(names):
        profile = profiles[name]
        place = np.argsort(profile)
        ordered = profile[place]
        found = np.minimum(np.searchsorted(ordered, gram), len(ordered) - 1)
        out = np.where(ordered[found] == gram, np.abs(place[found] - rank), max(len(profile), text_grams))
        distance[k] = np.bincount(row, out, n_rows)
        most[k] = np.maximum(used, 1) * max(len(profile), text_grams)
    if not len(names):
        return np.full(n_rows, "und", object), np.zeros(n_rows)
    share = distance / most
    best = np.argmin(share, axis=0)
    named = used > 0
    return np.where(named, names[best], "und"), np.where(named, 1 - share[best, np.arange(n_rows)], 0.0)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", text_grams: int = TEXT_GRAMS) -> DataFrame:
    """key, lang_pred, score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x PROFILE_SIZE numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            lang, score = rank_texts(part.column(1), sent.value, text_grams)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(judge, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: Column) -> Column:
    """The fold that is not learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is recognised, with all their columns: not ``und``, nor a score under ``least``.

    Profiles are learned as in ``op7_language``. The texts are judged where they lie: no join.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn_profiles(_training(docs)))

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            found = []
            for part in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text", _SLICE):
                lang, score = rank_texts(part.column(0), sent.value)
                found.append((lang != "und") & (score >= least))
            yield pa.array(np.concatenate(found).astype(bool) if found else np.zeros(0, bool))

    return docs.where(known(F.col("text")))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = predict(docs, learn_profiles(_training(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
