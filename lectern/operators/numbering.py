"""Running sums along an order that no key's size makes one task's work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65_536


def running_sums(rows: DataFrame, keys: list[str], order: str, **measures: Column) -> DataFrame:
    """``rows`` with ``name`` (the sum of a measure up to and with this row) and ``name_total`` (of its key) for each measure.

    ``order`` is a whole number. A key's rows are dealt by ranges of ``SPAN`` numbers: each range is summed
    before the shuffle, the ranges' sums are added up along the key (one row a range), and rows are summed
    within their range only. So a key with a third of all rows is many tasks. Null keys are a key of
    their own, a null ``order`` comes first; equal ``order`` are summed one by one in any order.
    """
    rows = rows.withColumns({"_range": F.expr(f"`{order}` div {SPAN}"), **{f"_{m}": c for m, c in measures.items()}})
    ranges = rows.groupBy(*keys, "_range").agg(*(F.sum(f"_{m}").alias(f"_{m}_sum") for m in measures))
    along = Window.partitionBy(*keys)
    before = along.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = [*keys, "_range"]
    offsets = ranges.select(
        *(F.col(k).alias(f"_at{i}") for i, k in enumerate(parts)),
        *(F.coalesce(F.sum(f"_{m}_sum").over(before), F.lit(0)).alias(f"_{m}_before") for m in measures),
        *(F.sum(f"_{m}_sum").over(along).alias(f"{m}_total") for m in measures),
    )
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(parts)))
    within = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"_{m}": F.sum(f"_{m}").over(within) for m in measures}).join(offsets, same)
    return summed.withColumns({m: F.col(f"_{m}") + F.col(f"_{m}_before") for m in measures}).drop(*(f"_at{i}" for i in range(len(parts))), "_range", *(f"_{m}{s}" for m in measures for s in ("", "_before")))
