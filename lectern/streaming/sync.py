"""Impressions as a stream: the event log, counters and review states, kept up to date.

The counters are a streaming aggregate; review states need the reviews of a card one after another, so
each key has a small state that a batch of its reviews moves on. Replaying a log through the stream gives what
the batch operators give for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.values import FIRST_EASE, FIRST_INTERVAL, LEAST_EASE, PASS_GRADE, SECOND_INTERVAL
from lectern.operators.events import COUNTERS, KEY, classified, counters, merged_counters

STATE = "repetition int, interval double, ease double"
REVIEWED = "user_id bigint, card_id bigint, sr_repetition int, sr_interval_days double, sr_ease_factor double, reviewed_at timestamp_ntz"


def running_counters(impressions: DataFrame) -> DataFrame:
    """The counters of ``events.counters`` over a stream of impressions (update or complete mode)."""
    return counters(classified(impressions))


def reviewed(repetition: int, interval: float, ease: float, grade: int) -> tuple[int, float, float]:
    """The next review state; the same arithmetic as ``functions.scores.repeated``."""
    if grade >= PASS_GRADE:
        interval = FIRST_INTERVAL if repetition == 0 else SECOND_INTERVAL if repetition == 1 else float(int(interval * ease + 0.5))
        repetition += 1
    else:
        repetition, interval = 0, FIRST_INTERVAL
    miss = 5 - grade
    return repetition, interval, max(LEAST_EASE, ease + (0.1 - miss * (0.08 + miss * 0.02)))


def _moved_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, FIRST_INTERVAL, FIRST_EASE)
    # Most keys have a few rows: columns as arrays, as a sorted frame for each key takes far longer than its reviews.
    frames = list(batches)
    times, events, grades = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("created_at", "event_id", "grade"))
    order = np.lexsort((events, times))
    for grade in grades[order].tolist():
        now = reviewed(*now, int(grade))
    state.update(now)
    yield pd.DataFrame({"user_id": [key[0]], "card_id": [key[1]], "sr_repetition": [now[0]], "sr_interval_days": [now[1]], "sr_ease_factor": [now[2]], "reviewed_at": times[order[-1:]]})


def running_reviews(graded: DataFrame) -> DataFrame:
    """Review states after each batch of a stream of graded reviews (user_id, card_id, event_id, created_at, grade).

    A key's reviews are few in a batch (a reader's own); its state is three numbers.
    """
    return graded.groupBy(*KEY).applyInPandasWithState(_moved_on, REVIEWED, STATE, "update", GroupStateTimeout.NoTimeout)


def write_batch(log: str, counts: str):
    """A ``foreachBatch`` step: appends events to the log and counter deltas to ``counts``.

    Both are appends named by the batch, so a batch that runs again after a failure replaces its own
    files; ``current_counters`` adds the deltas up.
    """

    def step(impressions: DataFrame, batch: int) -> None:
        events = classified(impressions)
        events.write.mode("overwrite").parquet(f"{log}/batch={batch}")
        counters(events).write.mode("overwrite").parquet(f"{counts}/batch={batch}")

    return step


def current_counters(deltas: DataFrame) -> DataFrame:
    """Counters from all batches' deltas."""
    return merged_counters(deltas.select(*KEY, *COUNTERS, "last_shown_at"), deltas.select(*KEY, *COUNTERS, "last_shown_at").limit(0))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Reading sessions: events of a user less than ``gap`` apart."""
    timed = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.sum("dwell_ms").alias("dwell_ms"))

