"""Full-text search over a catalog: tokens, word prefixes, rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import query_prefixes, tokens


def _starting(prefix: str):
    return lambda token: token.startswith(prefix)


def matches(found: Column, prefixes: list[str]) -> Column:
    """Whether each prefix starts some token."""
    return reduce(lambda a, b: a & b, [F.exists(found, _starting(p)) for p in prefixes], F.lit(bool(prefixes)))


def rank(found: Column, prefixes: list[str]) -> Column:
    """Share of the tokens that a prefix starts."""
    hits = F.size(F.filter(found, lambda t: reduce(lambda a, b: a | b, [t.startswith(p) for p in prefixes], F.lit(False))))
    return hits / F.greatest(F.size(found), F.lit(1))


def search(catalog: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """The rows that hold a word for each prefix of the query, with their ``rank``. One scan, no shuffle."""
    prefixes = query_prefixes(query)
    rows = catalog.withColumn("_tokens", tokens(*(F.col(c) for c in columns)))
    return rows.where(matches(F.col("_tokens"), prefixes)).withColumn("rank", rank(F.col("_tokens"), prefixes)).drop("_tokens")


def search_many(catalog: DataFrame, queries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(query_id, key, matched): for many queries (query_id, query) the rows that hold a word for each prefix.

    Tokens are met by equal leading characters, as many as the prefix has (lengths that occur among the
    queries): an equi-join on prefixes, so no query is compared with every row.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("prefix"))
    need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    lengths = asked.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as words have lengths
    words = catalog.select(key, F.explode(tokens(*(F.col(c) for c in columns))).alias("token")).join(F.broadcast(lengths))
    starts = words.select(key, "token", F.explode(F.filter("lengths", lambda n: n <= F.length("token"))).alias("n")).select(key, F.substr("token", F.lit(1), F.col("n")).alias("prefix")).distinct()
    met = starts.join(asked, "prefix").groupBy("query_id", key).agg(F.count(F.lit(1)).alias("matched"))
    return met.join(need, "query_id").where("matched = need").drop("need")


def featured(books: DataFrame, category: str, order: list, n: int = 10) -> DataFrame:
    """The first ``n`` of each category, ranked from 0."""
    window = Window.partitionBy(category).orderBy(*order)
    return books.withColumn("rank", F.row_number().over(window) - 1).where(F.col("rank") < n)


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page of an ordered result."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def names_with(rows: DataFrame, name: str, part: str, members: DataFrame, key: str) -> DataFrame:
    """The rows whose name holds ``part``, in any case, and that are no members yet. Null names hold nothing, an empty part is in all others."""
    return rows.where(F.lower(name).contains(part.lower())).join(members.select(key), key, "left_anti")
