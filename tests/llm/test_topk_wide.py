"""Exact top-k with components that 32 or 64 bits do not hold, against Python's integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import topk


def _plain(rows, k):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    out = []
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def _got(spark, rows, k):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 100 == 0, k, block_rows=150).collect())


def test_wide_components(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    for i, x in ((7, 150_000.5), (8, 150_000.25), (9, -2e6), (100, 140_000.0), (11, 3e6), (200, 2_500_000.125)):
        rows[i] = (i, [x, *rows[i][1][1:]])
    assert _got(spark, rows, 5) == _plain(rows, 5)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e12, 0.5]), (1, [-3e12, 0.0]), (2, [0.001, 0.001]), (3, [0.002, 1.0]), (4, [-2e12, 0.0])]
    assert _got(spark, rows, 2) == _plain(rows, 2)
    with pytest.raises(Exception, match="no bigint"):
        _got(spark, rows, 4)
    assert sorted([-(10**30), -(10**20), -(10**20) - 1], key=topk._sortable) == [-(10**30), -(10**20) - 1, -(10**20)]
    assert sorted([10**30, 10**20, 10**20 + 1], key=topk._sortable) == [10**20, 10**20 + 1, 10**30]
