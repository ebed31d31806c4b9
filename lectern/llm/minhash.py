"""Near duplicates by b-bit MinHash: banding for candidates, packed low bits for estimates, full sets for links.

A text's set is its distinct word n-grams. Texts of one set are one class, signed once: of each minimum ``BITS`` low
bits are kept and packed, 32 minima a 64-bit word; whole minima go into band hashes. Two classes that share a band are
candidates. Their similarity is estimated from the number of equal packed minima, by bit counts, corrected for minima
that agree by chance (1 in 2^BITS); pairs more than ``MARGIN`` standard deviations below the threshold are dropped.

Links are confirmed on full sets in two steps, so that no bucket gives all its pairs:

1. each class of a bucket is compared with the bucket's pivot (its class of least id). A pivot's text goes once to
   each task that holds some of its classes, and classes stream by. Large groups are mostly held together by this.
2. only buckets whose classes are not all in one component yet are looked at again: their members are dealt into
   parts that meet in pairs, and classes with a candidate in another component are compared block by block.

So every pair of different components that shares a band and passes the estimate is compared on full sets; pairs
within a component need no link of their own. A pair exactly at the threshold is missed by all bands with
probability 1 - ``RECALL``, and its estimate falls below the margin 1 time in 300,000.

Defined cases: A-Z is lower-cased, words are what lies between white space; a text with fewer words than n is one
n-gram; texts without words (null, empty) have an empty set and are linked with nothing, not even one another; a
component is named by its least key, null keys first; rows of equal text are linked like any others of equal sets;
repeated rows stay rows; an empty table gives an empty result; only key and text are read, so further columns
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.llm.jaccard import _binary, _groups, _least_labels, _met, choose_bands, ngrams, verified
from lectern.llm.substrings import narrowed
from lectern.llm.text import mixed, slices, utf8
from lectern.sources import discard, stored, table

WORDS, THRESHOLD, RECALL = 3, 0.85, 0.9999
#: Minima of a signature, a multiple of 32, and bits kept of each: 1 or 2.
HASHES, BITS = 128, 2
MARGIN = 4.5
#: Classes that one task compares with a pivot; members of a part at least; classes of a block.
FAN, PART, BLOCK = 512, 256, 512
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def signed_sets(docs: DataFrame, words: int, bands: int, rows: int, hashes: int, bits: int) -> DataFrame:
    """(key, digest, class, n_shingles, bands, sign) of ``docs`` (key, digest, text)."""
    seeds = mixed(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
    packed = hashes * bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n = part.num_rows
            row, grams = distinct_ngrams(part.column(2), words)
            count = np.bincount(row, minlength=n)
            at = np.append(0, np.cumsum(count))
            class_ = np.zeros((n, 2), np.uint64)
            for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                total = np.append(np.uint64(0), np.cumsum(mixed(grams ^ np.uint64(salt))))
                class_[:, k] = mixed(total[at[1:]] - total[at[:-1]] + count.astype(np.uint64))
            band_hash, sign = np.zeros((n, bands), np.uint64), np.zeros((n, packed), np.uint64)
            own = np.flatnonzero(count)
            if len(own):
                for k in range(hashes):
                    least = mixed(np.minimum.reduceat((grams ^ seeds[0, k]) * (seeds[1, k] | np.uint64(1)), at[own]))
                    sign[own, k * bits // 64] |= (least & np.uint64((1 << bits) - 1)) << np.uint64(k * bits % 64)
                    if (b := k // rows) < bands:
                        band_hash[own, b] = mixed(band_hash[own, b] * np.uint64(31) + least + np.uint64(b + 1))
            lists = [pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * x.shape[1]).astype(np.int32)), pa.array(x.reshape(-1).view(np.int64))) for x in (band_hash, sign)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(class_.view(np.uint8)), pa.array(count), *lists], ["key", "digest", "class", "n_shingles", "bands", "sign"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "digest", "text").mapInArrow(run, f"key {kind}, digest binary, class binary, n_shingles bigint, bands array<bigint>, sign array<bigint>")


def distinct_ngrams(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, by row and hash."""
    row, grams = ngrams(*utf8(texts), words, _WORD)
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return row[new], grams[new]


def least_agreeing(threshold: float, hashes: int, bits: int) -> int:
    """Equal packed minima that a candidate has at least: the threshold's expected number, less the margin.

    Minima of a pair of similarity J agree with probability J + (1 - J) / 2^bits, which is to say that J is
    estimated by (agreeing - chance) / (1 - chance), chance = 2^-bits.
    """
    chance = 2.0**-bits
    p = threshold + (1 - threshold) * chance
    return max(0, math.ceil(hashes * p - MARGIN * math.sqrt(hashes * p * (1 - p))))


def agreeing(a: Column, b: Column, hashes: int, bits: int) -> Column:
    """The number of equal minima of two packed signatures."""
    differ = 0
    for k in range(hashes * bits // 64):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        if bits == 2:  # one bit for each minimum that differs in either of its two
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(x)
    return hashes - differ


def near_pairs(signs: np.ndarray, bits: int, least: int) -> np.ndarray:
    """Which pairs of the packed signatures of a part (row by word) have ``least`` equal minima or more."""
    most = signs.shape[1] * 64 // bits - least
    near = np.zeros((len(signs), len(signs)), bool)
    step = max(1, (1 << 20) // max(1, len(signs)))
    for k in range(0, len(signs), step):
        differ = np.zeros((len(signs[k : k + step]), len(signs)), np.int16)
        for word in signs.T:
            x = word[k : k + step, None] ^ word[None, :]
            if bits == 2:
                x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
            differ += np.bitwise_count(x)
        near[k : k + step] = differ <= most
    return near


def pivot_pairs(classes: DataFrame, least: int, hashes: int, bits: int) -> DataFrame:
    """(class, pivot), stored: each class with the pivots of its buckets that it may be linked to."""
    banded = classes.select(F.explode("bands").alias("band"), F.xxhash64("class").alias("id"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "pivot")
    pairs = banded.join(buckets, "band").where("id <> pivot").select("id", "pivot").distinct()
    by_id = lambda id_, name: classes.select(F.xxhash64("class").alias(id_), F.col("class").alias(name), F.col("sign").alias(f"{name}_sign"))
    both = pairs.join(by_id("id", "class"), "id").join(by_id("pivot", "pivot_class"), "pivot")
    near = both.where(agreeing(F.col("class_sign"), F.col("pivot_class_sign"), hashes, bits) >= least)
    return stored(near.select("class", F.col("pivot_class").alias("pivot")), "pivot-pairs")


def linked_to_pivots(pairs: DataFrame, texts: DataFrame, words: int, threshold: float, fan: int = FAN) -> DataFrame:
    """(a, b), stored: the pairs (class, pivot) that reach the threshold on full sets; ``texts``: class, text."""
    fans = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / fan).alias("fans"))
    dealt = pairs.join(fans, "pivot").select("pivot", F.pmod(F.xxhash64("class"), F.col("fans")).alias("fan"), "class")
    heads = fans.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fans") - 1)).alias("fan"), F.col("pivot").alias("class"))
    rows = heads.withColumn("head", F.lit(0)).unionByName(dealt.withColumn("head", F.lit(1))).join(texts, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, fan_, grams = None, None, None
        for part in slices(batches, "text"):
            row, hashes = distinct_ngrams(part.column(4), words)
            each = np.split(hashes, np.searchsorted(row, np.arange(1, part.num_rows)))
            pivots, fans_, heads_, classes = (part.column(k).to_pylist() for k in range(4))
            a, b = [], []
            for k, own in enumerate(each):
                if not heads_[k]:
                    pivot, fan_, grams = pivots[k], fans_[k], own
                    continue
                assert (pivot, fan_) == (pivots[k], fans_[k])
                common = len(np.intersect1d(grams, own, assume_unique=True))
                if reaches(common, len(grams) + len(own) - common, threshold):
                    a.append(classes[k])
                    b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    rows = rows.select("pivot", "fan", "head", "class", "text").repartition("pivot", "fan").sortWithinPartitions("pivot", "fan", "head")
    return stored(rows.mapInArrow(run, "a binary, b binary"), "pivot-links")


def spanning(links: DataFrame) -> DataFrame:
    """(a, b): fewer links that hold the same together. Of a class's links to pivots (as many as bands at most) the one to its
    least pivot stays; the others are links of that pivot to the other pivots, of which there are few."""
    pivots = links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs")).withColumn("least", F.get("bs", F.lit(0)))
    others = pivots.select(F.col("least").alias("a"), F.explode(F.slice("bs", 2, 1 << 20)).alias("b")).distinct()
    return pivots.select("a", F.col("least").alias("b")).unionByName(others)


def reaches(common: int, union: int, threshold: float) -> bool:
    return common > 0 and common >= threshold * union - 1e-6


def open_candidates(classes: DataFrame, labels: DataFrame, least: int, bits: int, part: int = PART) -> DataFrame:
    """(a, b), stored: links that put into one group any two classes of different components that are candidates."""
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", F.xxhash64(F.coalesce("label", "class")).alias("label"), "bands", "sign")
    banded = named.select(F.explode("bands").alias("band"), "class", "label")
    member = F.xxhash64("class")
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(member).alias("members"), F.min(member).alias("least"), F.min("label").alias("low"), F.max("label").alias("high"))
    once = buckets.where("low <> high").groupBy("n", "members", "least").agg(F.min("band").alias("band"))
    parts = F.ceil(F.col("n") / F.greatest(F.lit(part), F.ceil(2 * F.sqrt("n")))).cast("int")
    members = banded.join(once.select("band", parts.alias("parts")), "band").join(named.select("class", "sign"), "class")
    rows = _met(members, F.col("parts")).select("band", "i", "j", "own", "class", "label", "sign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, ["band", "i", "j"]):
            signs = np.stack(whole["sign"].to_numpy()).view(np.uint64)
            label, side = whole["label"].to_numpy(), whole["own"].to_numpy()
            near = near_pairs(signs, bits, least) & (label[:, None] != label[None, :])
            if whole["i"][0].as_py() != whole["j"][0].as_py():
                near &= side[:, None] != side[None, :]
            group = _least_labels(near, None)
            moved = np.flatnonzero(group != np.arange(len(group)))
            if len(moved):
                names = whole["class"].combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(group[moved]))], ["a", "b"])

    found = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a binary, b binary")
    return stored(found.distinct(), "open-candidates")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, bits: int = BITS, fan: int = FAN, part: int = PART, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (least key that links lead to), kept (whether it is the row's own key)."""
    bands, rows = choose_bands(threshold, recall, hashes)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("key"), F.unhex(F.md5(body.cast("binary"))).alias("digest"), body.alias("text"))
    all_ = stored(signed_sets(keyed, words, bands, rows, hashes, bits), "signed-sets")
    # All rows of a class have its bands and signature; the text of its least row stands for it.
    classes = all_.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct("key", "digest")).alias("one"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"), F.min("sign").alias("sign"))
    classes = stored(classes, "set-classes")
    least = least_agreeing(threshold, hashes, bits)

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(class, text) of the classes in ``wanted``."""
        chosen = classes.join(wanted.distinct(), "class", "left_semi").select("class", F.col("one.key").alias("key"), F.col("one.digest").alias("digest"))
        chosen = stored(chosen.select("class", F.xxhash64("key", "digest").alias("row"), "digest"), "chosen")
        rows_ = narrowed(keyed.withColumn("row", F.xxhash64("key", "digest")), chosen.select("row"), "left_semi", on="row")
        return rows_.join(chosen, ["row", "digest"]).groupBy("class").agg(F.first("text").alias("text"))

    pairs = pivot_pairs(classes, least, hashes, bits)
    texts = stored(texts_of(pairs.select("class").unionByName(pairs.select(F.col("pivot").alias("class")))), "pivot-texts")
    links = linked_to_pivots(pairs, texts, words, threshold, fan)
    discard(texts)
    labels = components(spanning(links))
    open_ = open_candidates(classes, labels, least, bits, part)
    groups = components(open_)
    sized = groups.join(classes.select(F.col("class").alias("node"), "n_shingles"), "node")
    sizes = sized.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("grams"))
    wanted = stored(sized.join(sizes, "label").select(F.col("node").alias("class"), "label", "size", "grams"), "open-groups")
    more = more_links = stored(verified(texts_of(wanted.select("class")).join(wanted, "class"), words, threshold, block, _WORD).where("b IS NOT NULL").select("a", "b"), "more-links")
    named = classes.select("class", F.col("one.key").alias("key")).join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "key", F.coalesce("label", "class").alias("label"))
    # What the second step has linked are components of the first.
    for c in ("a", "b"):
        more = more.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(c, F.coalesce(f"{c}_label", c)).select("a", "b")
    final = components(more.where("a <> b").distinct())
    named = named.join(final.select(F.col("node").alias("label"), F.col("label").alias("of")), "label", "left").select("class", "key", F.coalesce("of", "label").alias("label"))
    named = stored(named, "named-sets")
    for used in (classes, pairs, links, labels, open_, groups, wanted, more_links, final):
        discard(used)
    heads = named.groupBy("label").agg(F.min(F.struct("key")).alias("head"))
    headed = named.join(heads, "label").select("class", "head")
    # A text without words is its own component.
    out = all_.join(headed, "class", "left").select(F.col("key"), "n_shingles", F.when(F.col("head").isNull(), F.col("key")).otherwise(F.col("head.key")).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(table(spark, folder, "documents"))
