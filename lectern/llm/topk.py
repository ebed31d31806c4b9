"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Vectors are dealt into blocks of bounded size, each once. A block keeps, for every dimension, posting segments:
the vectors whose component falls in one of ``LEVELS`` quantised steps. A query turns a segment into an
impact, the most that its members can gain there, and processes segments from the highest impact down,
adding to accumulators. What is still to come bounds every member's score; once that bound leaves few
members that could reach the k-th best exact score so far, those alone are rescored exactly, which proves
the block's answer. A block's index is built once; then the queries stream by, a few thousand at a time.
Best lists of all blocks are merged by query.

Defined cases: rows without an id, and vectors that are null, empty, or hold a null or a non-finite component, take no part; vectors of
other lengths are padded with zeros; components are whole numbers of any size and scores
exact: rows or products that 64 bits might not hold are scored in Python's integers, and a score among the k
best that is no bigint is an error (as in SQL); ties go to the smaller id, and among rows of one id to either; a query's own row is
no candidate, other rows of its id are; fewer candidates than k are all returned; an empty table gives an
empty result; only id and vector are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources import stored, table

LEVELS = 16
#: Vectors in a block: at most, and at least where there are enough for every core to have a block.
BLOCK_ROWS, LEAST_ROWS = 65_536, 4_096
SCALE = 1024
#: Components that an int holds; and the bound on sums of products below which 64 bits hold all that the index adds.
_INT, _SAFE = (1 << 31) - 1, 1 << 60
#: Segments between two looks at the bound, as a share of all; and the members, times k, that are few enough.
_LOOKS, _FEW = 12, 8
_MOST_TASKS = 10_000


class ImpactIndex:
    """The posting segments of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        self.segments: list[np.ndarray] = []
        low, high, dim = [], [], []
        for d in range(dims):
            column = vectors[:, d]
            order = np.argsort(column, kind="stable").astype(np.int32)
            for part in np.array_split(order, min(levels, n)):
                self.segments.append(part)
                low.append(column[part[0]])
                high.append(column[part[-1]])
                dim.append(d)
        self.low, self.high, self.dim = np.array(low, np.int64), np.array(high, np.int64), np.array(dim)

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Members that include the k best (and all that tie with the last)."""
        n = len(self.vectors)
        if n <= _FEW * k or not len(self.dim):
            return np.arange(n)
        q = query[self.dim]
        impact = np.maximum(q * self.low, q * self.high)
        dims = self.vectors.shape[1]
        least = np.full(dims, np.iinfo(np.int64).max)
        np.minimum.at(least, self.dim, impact)
        gain = impact - least[self.dim]  # over the lowest bound of its dimension, so never negative
        order = np.argsort(-gain, kind="stable")
        base = int(least.sum())
        score = np.zeros(n, np.int64)
        pending = np.full(dims, 0, np.int64)  # the highest gain to come, by dimension
        np.maximum.at(pending, self.dim, gain)
        by_dim = [list(np.sort(gain[self.dim == d])[::-1][1:]) + [0] for d in range(dims)]
        step = max(1, len(order) // _LOOKS)
        best = None
        for first in range(0, len(order), step):
            for s in order[first : first + step]:
                score[self.segments[s]] += gain[s]
                pending[self.dim[s]] = by_dim[self.dim[s]].pop(0)
            bound = base + int(pending.sum())
            near = np.argpartition(-score, k - 1)[:k]
            exact = np.sort(self.vectors[near] @ query)[0]
            best = exact if best is None else max(best, exact)
            possible = np.flatnonzero(score + bound >= best)
            if len(possible) <= _FEW * k or not pending.any():
                return possible
        return possible

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best; ties to the smaller id; ``own`` is no candidate."""
        found = self.candidates(query, k + 1)
        found = found[found != own]
        scores = self.vectors[found] @ query
        top = np.lexsort((ids[found], -scores))[:k]
        return found[top], scores[top]


class _Block:
    """The members of one block, to be searched for one query after the other."""

    def __init__(self, members: pa.Table, dims: int, scale: int):
        self.dims, self.scale = dims, scale
        self.ids, self.at = members["id"].to_numpy(), members["row"].to_numpy()
        self.is_wide = ~np.asarray(members["wide"].combine_chunks().is_null())
        self.vectors = _matrix(members["v"].combine_chunks(), dims)
        self.small, self.others = np.flatnonzero(~self.is_wide), np.flatnonzero(self.is_wide)
        self.index, self.largest = ImpactIndex(self.vectors[self.small]), int(np.abs(self.vectors).max(initial=0))
        self.wide = _exact(members["wide"].combine_chunks().drop_null().to_pylist(), dims, scale)
        self.all_exact: np.ndarray | None = None

    def search(self, row: int, vec: np.ndarray, far: list | None, k: int) -> tuple[np.ndarray, list[int]]:
        """(places, scores) of the k best for a query; its own row is no candidate."""
        place = int(np.searchsorted(self.at, row))
        own = place if place < len(self.at) and self.at[place] == row else -1
        big = vec.astype(object) if far is None else _exact([far], self.dims, self.scale)[0]
        if len(self.small) and int(sum(map(abs, big))) * max(self.largest, 1) < _SAFE:
            near = int(np.searchsorted(self.small, own)) if own >= 0 and not self.is_wide[own] else -1
            found, scores = self.index.search(big.astype(np.int64), self.ids[self.small], near, k)
            found = self.small[found]
            if len(self.others):
                found, scores = np.concatenate([found, self.others]), np.concatenate([scores.astype(object), self.wide @ big])
        else:
            if self.all_exact is None:
                self.all_exact = self.vectors.astype(object)
                self.all_exact[self.is_wide] = self.wide
            found, scores = np.arange(len(self.ids)), self.all_exact @ big
        best = sorted((i for i in range(len(found)) if found[i] != own), key=lambda i: (-scores[i], self.ids[found[i]]))[:k]
        return found[best], [int(scores[i]) for i in best]


def _held(score: int) -> int:
    """The score, or the bigint next to it."""
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, key, score: for each row for which ``is_query`` holds, its k best other rows."""
    spark = vectors.sparkSession
    # Exact size bounds a block; the row number tells rows of one id apart.
    raw = vectors.select(F.col(key).alias("id"), is_query.alias("is_query"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    fine = raw.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # Few rows have larger components: those keep their doubles, and are whole numbers in Python alone.
    is_wide = F.exists("v", lambda x: F.abs(x * scale) > _INT)
    whole = F.transform("v", lambda x: F.when(is_wide, 0).otherwise(F.floor(x * scale)).cast("int"))
    rows = stored(fine.select("id", "is_query", whole.alias("v"), F.when(is_wide, F.col("v")).alias("wide"), F.monotonically_increasing_id().alias("row")), "vectors")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
    blocks = max(-(-n // block_rows), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism), 1)
    dims = dims or 1
    # The stated queries meet every block: a copy of a query a block, and no copy of a vector.
    dealt = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    members = rows.select("id", "v", "wide", "row", F.lit(False).alias("asks"), dealt.alias("block"))
    queries = rows.where("is_query").select("id", "v", "wide", "row", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = now = None
        for batch in batches:
            own, asks = np.asarray(batch.column(5)), np.asarray(batch.column(4).cast(pa.int8()))
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if own[a] != now:
                    held, block, now = [], None, own[a]
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if block is None:
                    block = _Block(pa.Table.from_batches(held, batch.schema), dims, scale)
                    held = []
                ids, at = np.asarray(part.column(0)), np.asarray(part.column(3))
                found = [block.search(int(row), vec, far, k) for row, vec, far in zip(at, _matrix(part.column(1), dims), part.column(2).to_pylist(), strict=True)]
                sizes = [len(scores) for _, scores in found]
                places = np.concatenate([x for x, _ in found]).astype(np.int64)
                scores = [x for _, own_scores in found for x in own_scores]
                columns = [np.repeat(ids, sizes), np.repeat(at, sizes), block.ids[places], block.at[places], np.array([_held(x) for x in scores], np.int64), pa.array([_sortable(x) for x in scores], pa.string())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["query_id", "query_row", "id", "row", "score", "beyond"])

    met = members.unionByName(queries).repartitionById(min(blocks, _MOST_TASKS), F.col("block") % _MOST_TASKS)
    near = met.sortWithinPartitions("block", "asks", "row").mapInArrow(run, "query_id bigint, query_row bigint, id bigint, row bigint, score bigint, beyond string")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), F.asc("id"), F.asc("row"))
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), F.when(F.col("beyond") == "", F.col("score")).otherwise(F.raise_error(F.lit("a score among the best is no bigint")).cast("bigint")).alias("score"))


def _exact(column, dims: int, scale: int) -> np.ndarray:
    """Rows of Python's integers: floor(scale * x) of doubles."""
    out = np.zeros((len(column), dims), object)
    for k, v in enumerate(column):
        # A double of 2^53 or more is whole.
        out[k, : len(v)] = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in map(float, v)]
    return out


def _sortable(score: int) -> str:
    """Empty for a bigint; else a text that sorts as the score does among those held at the same end."""
    if -(1 << 63) < score < 1 << 63:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):06d}{digits}"
    return f"{999_999 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, padded with zeros."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLE = """
WITH r AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM r q JOIN r c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""
