"""Connected components by joins: least labels along links, then along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label), stored, for every node of the links (a, b); the label is the least node of its component.

    Each round takes the least label of the neighbours and then that label's own label, so a chain's
    length halves from round to round. Only labels that changed in the round before are sent to neighbours. Labels
    are written to the shared folder after every round, and the round before goes. No links give no rows.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumn("changed", F.lit(True)), "labels")
    while True:
        near = both.join(labels.where("changed").select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        less = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        label = F.least("label", "above")
        new = stored(less.join(above, "label", "left").select("node", label.alias("label"), (label != F.col("old")).alias("changed")), "labels")
        discard(labels)
        labels = new
        if not new.where("changed").limit(1).count():
            discard(both)
            out = new.select("node", "label")
            out.stored_path = new.stored_path
            return out
