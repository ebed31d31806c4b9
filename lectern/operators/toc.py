"""Tables of contents: front, main and back matter.

A table of contents is one array a document, in order: (title, page, level, fragment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.cards import reply_labels
from lectern.functions.folds import running
from lectern.functions.values import BACK_MATTER, FRONT_MATTER

_STATE = "struct<seen_main:boolean,above:array<struct<level:int,section:string>>>"


def toc_labels(toc: Column) -> Column:
    """A label for each entry. What lies below a back-matter entry is back matter too; so is what lies below a
    front-matter entry front matter, until the main matter has begun (or its own title says back)."""
    start = F.struct(F.lit(False).alias("seen_main"), F.array().cast("array<struct<level:int,section:string>>").alias("above")).cast(_STATE)

    def step(state: Column, entry: Column) -> tuple[Column, Column]:
        above = F.filter(state["above"], lambda x: x["level"] < entry["level"])
        parent = F.when(F.size(above) > 0, F.element_at(above, -1)["section"])
        front, back = entry["title"].rlike(f"(?i){FRONT_MATTER}"), entry["title"].rlike(f"(?i){BACK_MATTER}")
        section = (
            F.when(parent == "back", "back")
            .when((parent == "front") & ~state["seen_main"], F.when(back, "back").otherwise("front"))
            .when(~state["seen_main"] & front, "front")
            .when(back, "back")
            .otherwise("main")
        )
        here = F.struct(entry["level"].cast("int").alias("level"), section.alias("section"))
        return F.struct((state["seen_main"] | (section == "main")).alias("seen_main"), F.concat(above, F.array(here)).alias("above")).cast(_STATE), section

    return running(toc, start, "string", step)


def labels_by_model(toc: Column, reply: Column) -> Column:
    """A model's labels where its reply has one valid label for each entry, else those of ``toc_labels``."""
    return reply_labels(reply, F.size(toc), toc_labels(toc))


def toc_question(toc: Column) -> Column:
    """What a model is asked: the entries with their numbers, indented by level."""
    entries = F.array_join(F.transform(toc, lambda e, i: F.concat(i.cast("string"), F.lit(". "), F.repeat(F.lit("  "), e["level"].cast("int")), e["title"])), "\n")
    return F.concat(F.lit('Name each entry of this table of contents "front", "main" or "back" matter.\n\n'), entries, F.lit("\n\nReply with a JSON array of "), F.size(toc).cast("string"), F.lit(" strings, in order."))


def label_differences(first: DataFrame, second: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, before, after): what two labellings of the same entries say differently; a null label differs from any other."""
    both = first.select(*keys, F.col(label).alias("before")).join(second.select(*keys, F.col(label).alias("after")), keys)
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
