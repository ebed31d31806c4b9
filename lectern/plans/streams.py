"""Queries that run as streams over the folder's tables, to the end of what lies there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.events import counters, reviews
from lectern.plans.registry import query
from lectern.plans.views import Views, with_views
from lectern.sources import fresh_path, table
from lectern.streaming.sync import current_counters, running_reviews, write_batch


def streamed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream: it may be one file or a folder of files."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parquet*")


class StreamedViews(Views):
    """The same derived tables, with the event log read as a stream."""

    def _events(self) -> DataFrame:
        return streamed_table(self.spark, self.folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


@query(with_views("SELECT * FROM counters"))
def streamed_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters kept by a stream of impressions, batch by batch."""
    log, counts, state = (fresh_path(spark, name) for name in ("log", "counts", "stream"))
    run = StreamedViews(spark, folder).impressions().writeStream.foreachBatch(write_batch(log, counts)).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return current_counters(spark.read.schema(counters(Views(spark, folder).feed_events()).schema).parquet(f"{counts}/*"))


@query(with_views("SELECT user_id, card_id, sr_repetition, round(sr_interval_days, 4) AS sr_interval_days, round(sr_ease_factor, 4) AS sr_ease_factor FROM review_states"))
def streamed_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Review states kept by a stream of reviews; the last state of each card."""
    out, state = fresh_path(spark, "reviews"), fresh_path(spark, "stream")
    graded = reviews(StreamedViews(spark, folder).impressions(), Views(spark, folder).cards())

    def step(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch-{batch}")

    run = running_reviews(graded).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("user_id bigint, card_id bigint, sr_repetition int, sr_interval_days double, sr_ease_factor double, reviewed_at timestamp_ntz, batch bigint").parquet(f"{out}/*")
    last = rows.groupBy("user_id", "card_id").agg(F.max_by(F.struct("sr_repetition", "sr_interval_days", "sr_ease_factor"), "batch").alias("s"))
    return last.select("user_id", "card_id", "s.sr_repetition", F.round("s.sr_interval_days", 4).alias("sr_interval_days"), F.round("s.sr_ease_factor", 4).alias("sr_ease_factor"))
