"""Whole requests of impressions: how a reader's client sends them, and how the service takes them in.

``flushed`` is the client: impressions wait in a buffer that is sent when it holds ``FLUSH_ITEMS`` or ``FLUSH_SECONDS`` are
over. ``FeedSync`` is the service, one ``foreachBatch`` step with several sinks: of each request the first
``BATCH_LIMIT`` impressions are classified and appended to the event log, and the counters and review states of the cards
that they touch are moved on together.

State is kept as rows that are absolute, not deltas: a batch reads the latest rows of the cards it touches from the batches
before its own and writes new ones under its own number. A batch that runs again reads what it read before and writes
over its own files, so it changes nothing. Every ``keep`` batches the rows of all cards are written as a snapshot; once the
next batch has begun, what lies before the snapshot is removed, so a reader never adds up all batches ever written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.scores import capped, first_state, repeated
from lectern.functions.values import BATCH_LIMIT, FLUSH_ITEMS, FLUSH_SECONDS
from lectern.operators.events import COUNTERS, KEY, classified, counters, due_at, reviews
from lectern.sources import remove

IMPRESSION = ("event_id", "card_id", "created_at", "dwell_ms", "was_sr_due", "self_grade", "quiz_selected_index")
STATE = "user_id bigint, card_id bigint, times_shown bigint, times_engaged bigint, times_skipped bigint, last_shown_at timestamp_ntz, sr_repetition int, sr_interval_days double, sr_ease_factor double, sr_due_at timestamp_ntz"
_SR = ("sr_repetition", "sr_interval_days", "sr_ease_factor", "sr_due_at")


def flushed(impressions: DataFrame, items: int = FLUSH_ITEMS, seconds: int = FLUSH_SECONDS) -> DataFrame:
    """(user_id, tick, part, impressions): the requests that readers' clients send.

    A client's clock ticks every ``seconds``; what it has buffered since the tick before goes out, and before that as soon
    as it holds ``items``. So within a tick (numbered from the epoch) every ``items`` impressions are a request,
    in order of time, then event id.
    """
    tick = F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / seconds)
    order = Window.partitionBy("user_id", "tick").orderBy("created_at", "event_id")
    placed = impressions.withColumn("tick", tick).withColumn("part", F.floor((F.row_number().over(order) - 1) / items))
    one = F.struct("created_at", *(c for c in IMPRESSION if c != "created_at"))
    return placed.groupBy("user_id", "tick", "part").agg(F.array_sort(F.collect_list(one)).alias("impressions"))


def accepted(requests: DataFrame, most: int = BATCH_LIMIT) -> DataFrame:
    """The impressions that a request may bring: its first ``most``, one row each."""
    return requests.select("user_id", F.explode(capped(F.col("impressions"), most)).alias("i")).select("user_id", *(F.col(f"i.{c}").alias(c) for c in IMPRESSION))


class FeedSync:
    """Log and state of a service under one folder; ``cards``: KEY, card_type, right_choice."""

    def __init__(self, spark: SparkSession, folder: str, cards: DataFrame, most: int = BATCH_LIMIT, keep: int = 16):
        self.spark, self.folder, self.cards, self.most, self.keep = spark, folder, cards, most, keep
        # So that there is something to read from the start; written again it stays the same.
        self._write(spark.createDataFrame([], STATE), -1)

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")

    def current(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The latest row of each card, or of the cards in ``of``, from the batches before ``before``."""
        rows = self.spark.read.schema(STATE).parquet(f"{self.folder}/state/batch=*")
        rows = rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(-?[0-9]+)/", 1).cast("bigint"))
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if of is not None:
            rows = rows.join(of, [*KEY], "left_semi")
        values = F.struct(*COUNTERS, "last_shown_at", *_SR)
        return rows.groupBy(*KEY).agg(F.max_by(values, "batch").alias("s")).select(*KEY, "s.*")

    def log(self) -> DataFrame:
        """All events so far."""
        return self.spark.read.parquet(f"{self.folder}/log")

    def moved_on(self, impressions: DataFrame, batch: int) -> DataFrame:
        """New rows for the cards of a batch's impressions."""
        counted = counters(classified(impressions))
        ordered = F.array_sort(F.collect_list(F.struct("created_at", "event_id", "grade")))
        graded = reviews(impressions, self.cards).groupBy(*KEY).agg(ordered.alias("reviews"))
        old = self.current(batch, counted.select(*KEY))
        old = old.select(*KEY, *(F.col(c).alias(f"_{c}") for c in (*COUNTERS, "last_shown_at", *_SR)))
        both = counted.join(graded, [*KEY], "left").join(old, [*KEY], "left")
        begun = F.struct(F.col("_sr_repetition").alias("repetition"), F.col("_sr_interval_days").alias("interval"), F.col("_sr_ease_factor").alias("ease"))
        # Rows of cards that were shown but never reviewed have no interval yet.
        state = F.aggregate("reviews", F.when(F.col("_sr_interval_days").isNotNull(), begun).otherwise(first_state()), lambda s, r: repeated(s, r["grade"]))
        is_new = F.col("reviews").isNotNull()
        rows = both.withColumns({"_s": F.when(is_new, state), "_at": F.element_at("reviews", -1)["created_at"]})
        kept = lambda new, c: F.when(is_new, new).otherwise(F.col(f"_{c}")).alias(c)
        return rows.select(
            *KEY, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTERS), F.greatest("last_shown_at", "_last_shown_at").alias("last_shown_at"),
            F.coalesce(F.when(is_new, F.col("_s.repetition")), F.col("_sr_repetition"), F.lit(0)).alias("sr_repetition"), kept(F.col("_s.interval"), "sr_interval_days"),
            kept(F.col("_s.ease"), "sr_ease_factor"), kept(due_at(F.col("_at"), F.col("_s.interval")), "sr_due_at"),
        )

    def step(self, requests: DataFrame, batch: int) -> None:
        """Takes in one batch of requests (``foreachBatch``)."""
        self._tidy(batch)
        impressions = accepted(requests, self.most)
        classified(impressions).write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
        rows = self.moved_on(impressions, batch)
        if (batch + 1) % self.keep == 0:
            rows = rows.unionByName(self.current(batch).join(impressions.select(*KEY).distinct(), [*KEY], "left_anti"))
        self._write(rows, batch)

    def _tidy(self, batch: int) -> None:
        """Removes what lies before the last snapshot that no batch from now on can replace."""
        last = batch // self.keep * self.keep - 1
        for k in range(max(-1, last - self.keep), last):
            remove(self.spark, f"{self.folder}/state/batch={k}")


def run_to_end(requests: DataFrame, step, checkpoint: str, seconds: int | None = None) -> None:
    """Runs a stream of requests through a ``foreachBatch`` step until all that has arrived is taken in.

    With ``seconds`` batches begin that far apart (a processing-time trigger), as they would in a service that goes on.
    """
    writer = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if seconds is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    run = writer.trigger(processingTime=f"{seconds} seconds").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def arriving(spark: SparkSession, path: str, schema, files: int = FLUSH_ITEMS) -> DataFrame:
    """Requests as files that arrive under ``path``: a stream of at most ``files`` of them a batch, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

