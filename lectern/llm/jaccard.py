"""Joins of near-duplicate texts: Jaccard similarity of word n-gram sets, by MinHash banding.

Bands and rows come from a target recall at the threshold and a bound on the hashes of a text. Texts with one
multiset of n-grams are one class; a class is signed once. Band hashes are counted by shuffle; those that two
classes or more share become buckets, and buckets with the same members are done once.

A bucket's members are compared by their signatures (a byte a hash). Those of a large bucket are dealt into
parts and the parts meet in pairs, so that no task holds a bucket. Members whose signatures agree less than a
pair at the threshold would (``MARGIN`` standard deviations below) are no candidates. A pair of parts gives one
link for each group joined to another, never all pairs, and after the first bands only buckets that could
still join groups are looked at.

Groups of candidates are verified by their full n-gram sets: members are dealt into blocks of at most
``BLOCK`` classes and about ``BLOCK_GRAMS`` n-grams, which meet block by block, by counting in matrices. Final
groups come from verified links alone. Numbers of links, and the links that hold a group together, leave a
task, never all pairs. No step leaves a pair of a bucket out.

Defined cases: words are runs of letters and digits, A-Z lower-cased; a text of fewer words than the n-gram
has one n-gram, all its words; texts without words (null, empty) are copies of one another and linked to
nothing else; equal similarity needs no tie rule; a class is named by its least key, null keys first; rows of
equal key and text are copies; an empty table gives an empty result; input columns of any name are kept by
``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.llm.substrings import narrowed, row_key
from lectern.llm.text import gram_hashes, mixed, owners, slices, span_hashes, spans, unused, utf8
from lectern.sources import discard, stored, table

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Hashes of a signature at most: they bound the rows of a band.
MOST_HASHES = 192
#: Standard deviations that a signature may fall short of the threshold by (of a pair at the threshold, 1 in 300,000 does).
MARGIN = 4.5
#: Members of a part at least, and classes and n-grams of a block at most (a text is never divided).
PART, BLOCK, BLOCK_GRAMS = 256, 512, 1 << 19
#: Bands that are looked at before the others; results are the same for any number.
FIRST_BANDS = 4
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective bands that find a pair at the threshold with probability ``recall`` by ``most`` hashes."""
    found = 1, 1
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        found = bands, rows
    return found


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word n-gram of a slice, in order of place; short texts have one. Words are runs of ``member`` bytes."""
    starts, ends = spans(member[data], offsets)
    words = span_hashes(_LOWER[data], starts, ends)
    row = owners(offsets, starts)
    size = max(0, len(words) - n + 1)
    whole = np.flatnonzero(row[:size] == row[n - 1 :]) if size else np.zeros(0, np.int64)
    out_row, out = row[whole], gram_hashes(words, n)[whole]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    at = np.append(0, np.cumsum(counts))
    short = np.flatnonzero((counts > 0) & (counts < n))
    extra = np.array([gram_hashes(words[at[k] : at[k + 1]], int(counts[k]))[0] for k in short], np.uint64)
    order = np.argsort(np.concatenate([out_row, short]), kind="stable")
    return np.concatenate([out_row, short])[order], np.concatenate([out, mixed(extra)])[order]


def signatures(row: np.ndarray, grams: np.ndarray, n_rows: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, a byte a hash) of each row; zeros where a row has no n-grams."""
    band_hash = np.zeros((n_rows, bands), np.uint64)
    low = np.zeros((n_rows, bands * rows), np.uint8)
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    own = row[begin]
    seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
    if len(own):
        for k in range(bands * rows):
            least = mixed(np.minimum.reduceat((grams ^ seeds[0, k]) * (seeds[1, k] | np.uint64(1)), begin))
            low[own, k] = (least & np.uint64(255)).astype(np.uint8)
            b = k // rows
            band_hash[own, b] = mixed(band_hash[own, b] * np.uint64(31) + least + np.uint64(b + 1))
    return band_hash, low


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(key, doc, class, n_grams, bands, low) of ``docs`` (key, doc, text); the class hash covers the multiset of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column(2))
            row, grams = ngrams(data, offsets, n)
            count = np.bincount(row, minlength=part.num_rows)
            at = np.append(0, np.cumsum(count))
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.append(np.uint64(0), np.cumsum(mixed(grams ^ np.uint64(salt))))
                sums.append(mixed(total[at[1:]] - total[at[:-1]] + count.astype(np.uint64)))
            band_hash, low = signatures(row, grams, part.num_rows, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(part.num_rows + 1) * bands).astype(np.int32)), pa.array(band_hash.reshape(-1).view(np.int64)))
            class_ = np.stack(sums, axis=1).view(np.uint8).reshape(part.num_rows, 16)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(class_), pa.array(count), lists, _binary(low)], ["key", "doc", "class", "n_grams", "bands", "low"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "doc", "text").mapInArrow(run, f"key {kind}, doc bigint, class binary, n_grams bigint, bands array<bigint>, low binary")


def least_estimate(threshold: float, hashes: int) -> float:
    """The least share of agreeing bytes with which a pair may be at the threshold."""
    agree = threshold + (1 - threshold) / 256
    return max(0.0, agree - MARGIN * math.sqrt(agree * (1 - agree) / hashes))


def joining_pairs(low: np.ndarray, label: np.ndarray, side: np.ndarray | None, least: float) -> np.ndarray:
    """Pairs of labels that hold together what near signatures join; rows are in order of their labels.

    Without ``side`` each label is joined to the least of its group. With it, what either side joins by itself is
    known elsewhere: the pairs are those that join groups of the one side to groups of the other.
    """
    near = np.zeros((len(low), len(low)), bool)
    step = max(1, (8 << 20) // max(1, low.size))
    for k in range(0, len(low), step):
        near[k : k + step] = (low[k : k + step, None, :] == low[None, :, :]).mean(axis=2, dtype=np.float32) >= least
    within = near if side is None else near & (side[:, None] == side[None, :])
    group = _least_labels(within | (label[:, None] == label[None, :]), None)
    if side is None:
        return np.unique(np.stack([label[group], label], axis=1)[label[group] != label], axis=0)
    i, j = np.nonzero(near & side[:, None] & ~side[None, :])
    out, root = [], {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    for x, y in np.unique(np.stack([group[i], group[j]], axis=1), axis=0).tolist():
        x, y = sorted((find(x), find(y)))
        if x != y:
            root[y] = x
            out.append((label[x], label[y]))
    return np.array(out, np.int64).reshape(-1, 2)


def _met(members: DataFrame, parts: Column) -> DataFrame:
    """``members`` (class, others) dealt into ``parts`` parts, once for each part that theirs meets: with own, i and j."""
    own = F.when(parts > 1, F.pmod(F.xxhash64("class"), parts)).otherwise(F.lit(0)).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def candidate_links(classes: DataFrame, threshold: float, hashes: int, part: int = PART, first_bands: int = FIRST_BANDS) -> DataFrame:
    """(a, b): links that put any two classes of at least the threshold into one group.

    The first bands join most of a group. In the other bands only buckets whose members are not all in one
    group yet are looked at, and only what joins groups is a link. So a group has few more links than members in
    the first bands, and few after, however many pairs it has.
    """
    signs = classes.select("class", "low")
    first = _bucket_links(classes.select("class", F.col("class").alias("label"), F.slice("bands", 1, first_bands).alias("bands")), signs, threshold, hashes, part, "first-links")
    groups = components(first)
    labelled = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("label", "class").alias("label"), F.slice("bands", first_bands + 1, 1 << 20).alias("bands"))
    labelled = stored(labelled, "labelled-classes")
    discard(groups)
    rest = _bucket_links(labelled, signs, threshold, hashes, part, "more-links")
    discard(labelled)
    return first.unionByName(rest)


def _bucket_links(classes: DataFrame, signs: DataFrame, threshold: float, hashes: int, part: int, name: str) -> DataFrame:
    """(a, b), stored: links between labels of ``classes`` (class, label, bands) that share a band hash; ``signs``: class, low."""
    banded = classes.select("class", "label", F.explode("bands").alias("band"))
    # Buckets are told apart, and labels within one, by 64-bit hashes: that halves what is shuffled.
    member, label = F.xxhash64("class"), F.xxhash64("label")
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(member).alias("members"), F.min(member).alias("least"), F.min(label).alias("low_label"), F.max(label).alias("high_label"))
    once = buckets.where("low_label <> high_label").groupBy("n", "members", "least").agg(F.min("band").alias("band"))
    # Parts grow with the root of the bucket, so that a member is copied about as often as a part has members.
    parts = F.ceil(F.col("n") / F.greatest(F.lit(part), F.ceil(2 * F.sqrt("n")))).cast("int")
    members = banded.join(once.select("band", parts.alias("parts")), "band")
    rows = _met(members.join(signs, "class"), F.col("parts")).select("band", "i", "j", "own", "label", "low")
    least = least_estimate(threshold, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, ["band", "i", "j"]):
            whole = whole.sort_by("label")
            labels = whole["label"].combine_chunks().dictionary_encode()
            data, at = utf8(whole["low"].combine_chunks())
            i, j = whole["i"][0].as_py(), whole["j"][0].as_py()
            pairs = joining_pairs(data.reshape(len(at) - 1, -1), np.asarray(labels.indices), None if i == j else whole["own"].to_numpy() == i, least)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    found = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a binary, b binary")
    return stored(found.distinct(), name)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
        cuts = np.flatnonzero(new)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(batch.column(batch.schema.get_field_index(k))[int(a)].as_py() for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def compare(grams: list[np.ndarray], split: int | None, threshold: float) -> np.ndarray:
    """Which pairs of n-gram sets reach the threshold; with ``split``, only pairs of one before it with one from it on."""
    sizes = np.array([len(g) for g in grams])
    row = np.repeat(np.arange(len(grams)), sizes)
    _, name, uses = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = uses > 1
    column = np.cumsum(shared) - 1
    row, name = row[shared[name]], column[name[shared[name]]]
    n, width = len(grams), 4096
    left, right = (slice(0, n), slice(0, n)) if split is None else (slice(0, split), slice(split, n))
    common = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(name, [first, first + width])
        here = np.zeros((n, width), np.float32)
        here[row[a:b], name[a:b] - first] = 1
        common += here[left] @ here[right].T
    union = sizes[left, None] + sizes[None, right] - common
    return (common > 0) & (common >= threshold * union - 1e-6)


def verified(members: DataFrame, n: int, threshold: float, block: int, member: np.ndarray = _WORD) -> DataFrame:
    """(a, b, links): for each class with links its number of links (b null), and links that hold groups together.

    ``members``: label, class, size and grams (of the group), text.
    """
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    pairs = _met(members, blocks).select("label", "i", "j", "own", "class", "text")

    def judged(whole: pa.Table) -> pa.RecordBatch | None:
        i, j = whole["i"][0].as_py(), whole["j"][0].as_py()
        whole = whole.sort_by("own")
        split = None if i == j else int((whole["own"].to_numpy() == i).sum())
        if split in (0, whole.num_rows):
            return None
        grams = []
        for part in slices(whole.select(["text"]).to_batches(), "text"):
            row, hashes = ngrams(*utf8(part.column(0)), n, member)
            grams += [np.unique(g) for g in np.split(hashes, np.searchsorted(row, np.arange(1, part.num_rows)))]
        names = whole["class"].combine_chunks()
        hits = compare(grams, split, threshold)
        if split is None:
            np.fill_diagonal(hits, False)
            links = hits.sum(axis=1)
        else:
            links = np.concatenate([hits.sum(axis=1), hits.sum(axis=0)])
        label = _least_labels(hits, split)
        has, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
        a = names.take(pa.array(np.concatenate([has, moved])))
        b = pa.concat_arrays([pa.nulls(len(has), pa.binary()), names.take(pa.array(label[moved]))])
        return pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([links[has], np.zeros(len(moved), np.int64)]))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, ["label", "i", "j"]):
            if (out := judged(whole)) is not None:
                yield out

    return pairs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, "a binary, b binary, links bigint")


def _least_labels(hits: np.ndarray, split: int | None) -> np.ndarray:
    """For each member the least that it is joined to by ``hits`` (members by members, or those before ``split`` by the rest)."""
    n = len(hits) if split is None else sum(hits.shape)
    label = np.arange(n)
    while True:
        if split is None:
            near = np.where(hits, label[None, :], n).min(axis=1)
        else:
            near = np.concatenate([np.where(hits, label[None, split:], n).min(axis=1), np.where(hits, label[:split, None], n).min(axis=0)])
        least = np.minimum(label, near)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = MOST_HASHES, part: int = PART, block: int = BLOCK) -> DataFrame:
    """key, class_id (least key of its near-duplicate group), n_links (other texts linked to its text), n_copies (other rows of its text), doc.

    ``doc`` is a hash of key and text.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    keyed = docs.select(F.col(key).alias("key"), row_key(F.col(key), F.col(text)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_ = stored(signed(keyed, words, bands, rows), "signed")
    least = F.min(F.struct("key", "doc"))
    # Any row of a class has its signature; the one of the least document is taken.
    classes = stored(all_.groupBy("class").agg(least.alias("one"), F.count(F.lit(1)).alias("rows"), F.max("n_grams").alias("n_grams"), F.min("bands").alias("bands"), F.min("low").alias("low")), "classes")
    links = candidate_links(classes.where("n_grams > 0"), threshold, bands * rows, part)
    groups = components(links)
    sized = groups.join(classes.select(F.col("class").alias("node"), F.col("one.doc").alias("doc"), "n_grams"), "node")
    sizes = sized.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n_grams").alias("grams"))
    wanted = stored(sized.join(sizes, "label").select(F.col("node").alias("class"), "label", "size", "grams", "doc"), "candidates")
    discard(groups)
    texts = narrowed(keyed.select("doc", "text"), wanted.select("doc"), "left_semi").join(wanted, "doc").drop("doc")
    found = stored(verified(texts, words, threshold, block), "verified")
    discard(wanted)
    final = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    named = classes.select("class", "one", "rows").join(final.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    named = stored(named.select("class", "one", "rows", F.coalesce("label", "class").alias("label"), F.coalesce("links", F.lit(0)).alias("n_links")), "named-classes")
    for used in (classes, found, final):
        discard(used)
    heads = named.groupBy("label").agg(F.min("one").alias("head"))
    classed = named.join(heads, "label").select("class", "head", "n_links", (F.col("rows") - 1).alias("n_copies"))
    out = all_.select("key", "doc", "class").join(classed, "class")
    return out.select(F.col("key").alias(key), F.col("head.key").alias("class_id"), "n_links", "n_copies", "doc", F.col("head.doc").alias("head"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, one of each near-duplicate group (that of the least key), with all their columns."""
    name = unused(docs, "_nj_doc")
    found = near_duplicates(docs, key, text, **options).select(F.col("doc").alias(name), (F.col("doc") == F.col("head")).alias("stays"))
    counts = stored(found.groupBy(name).agg(F.bool_and("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "kept-documents")
    keyed = docs.withColumn(name, row_key(F.col(key), F.col(text)))
    kept = narrowed(keyed, counts.where("NOT stays").select(name), "left_anti", on=name)
    # Rows of equal key and text share a hash: of those one stays.
    twice = counts.where("stays AND n > 1").select(name)
    if twice.limit(1).count():
        kept = narrowed(kept, twice, "left_anti", on=name).unionByName(narrowed(kept, twice, "left_semi", on=name).dropDuplicates([name]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
