"""A fold that gives a value for each item, for lists of any length.

``aggregate`` copies an array whenever something is added to it. Values therefore gather in a block of ``BLOCK``, and blocks
in the whole: n items cost n * BLOCK / 2 + n * n / (2 * BLOCK) copied values instead of n * n / 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def running(items: Column, first: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The values (of type ``kind``) that ``step(state, item)`` gives beside each next state, in order, from the state ``first`` on; null for null."""
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(first.alias("state"), none.alias("done"), none.alias("block"))

    def one(s: Column, item: Column) -> Column:
        state, value = step(s["state"], item)
        full, own = F.size(s["block"]) >= BLOCK, F.array(value.cast(kind))
        return F.struct(state.alias("state"), F.when(full, F.concat(s["done"], s["block"])).otherwise(s["done"]).alias("done"), F.when(full, own).otherwise(F.concat(s["block"], own)).alias("block"))

    return F.aggregate(items, start, one, lambda s: F.concat(s["done"], s["block"]))
