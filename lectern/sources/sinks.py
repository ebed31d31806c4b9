"""Writing and changing tables: appends, inserts that keep what is there, updates, deletes, all as rewrites.

Parquet has no rows to update in place. A change is a DataFrame made of the old table, to be written to
a new path (or swapped in by a table format); each is one join or one aggregate on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.paths import media_extension
from lectern.functions.text import content_name
from lectern.functions.values import IMAGE_BYTES


def insert_new(there: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``there`` and those ``rows`` whose key is not in it; of rows of one key the first in ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return there.unionByName(once.join(there.select(*keys), keys, "left_anti"))


def updated_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where a condition holds (not where it is null)."""
    holds = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(holds, v).otherwise(F.col(c)) for c, v in values.items()})


def cascade_deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose parent stays."""
    return rows.join(gone.select(key), key, "left_anti")


def parents_unset(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """All rows, those whose parent goes with a null key."""
    marked = rows.join(gone.select(key, F.lit(True).alias("_gone")), key, "left")
    return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*rows.columns)


def filled_from(rows: DataFrame, parents: DataFrame, key: str, column: str) -> DataFrame:
    """A column filled in from the parents' row of the same key."""
    return rows.drop(column).join(parents.select(key, column), key, "left").select(*rows.columns)


def with_ids(rows: DataFrame, parts: list[str], name: str = "id") -> DataFrame:
    """An id for each row that is the same whenever its parts are, so a task that runs again gives the same ids."""
    return rows.withColumn(name, F.sha2(F.to_json(F.struct(*parts)), 256).substr(1, 32))


def named_images(images: DataFrame, content: str = "content", kind: str = "mime") -> DataFrame:
    """Images that are not too large, each content once, with a name made of it."""
    rows = images.where(F.octet_length(content) <= IMAGE_BYTES)
    return rows.withColumn("file", F.concat(content_name(F.col(content)), F.lit("."), media_extension(F.col(kind)))).dropDuplicates(["file"])


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
