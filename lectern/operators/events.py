"""Engagement: impressions to events, counters, review states, toggles and dwell times.

Column names: user_id, card_id, event_id, created_at, dwell_ms; an impression also has was_sr_due,
self_grade and quiz_selected_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scores import engagement, first_state, repeated, review_grade, valid_grade
from lectern.functions.values import CARD_ACTIONS, LIKE_GRADE, REVIEWED_DAYS_LIMIT, REVIEW_TYPES

KEY = ("user_id", "card_id")
COUNTERS = ("times_shown", "times_engaged", "times_skipped")


def classified(impressions: DataFrame) -> DataFrame:
    """The event log's rows: kind of engagement, a valid grade or null, hour and day of week (Sunday 0)."""
    return impressions.select(
        "event_id", *KEY, "created_at", "dwell_ms",
        engagement(F.col("dwell_ms")).alias("event_type"), valid_grade(F.col("self_grade")).cast("int").alias("self_grade"),
        F.hour("created_at").alias("time_of_day"), (F.dayofweek("created_at") - 1).alias("day_of_week"),
    )


def counters(events: DataFrame) -> DataFrame:
    """How often each card was shown, engaged with and skipped, and when it was last shown."""
    return events.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("times_shown"),
        F.count_if(F.col("event_type") == "engaged").alias("times_engaged"),
        F.count_if(F.col("event_type") == "scrolled_past").alias("times_skipped"),
        F.max("created_at").alias("last_shown_at"),
    )


def merged_counters(state: DataFrame, update: DataFrame) -> DataFrame:
    """Counters with an update added: sums of counts, the later of the times. Only partial sums are shuffled."""
    both = state.select(*KEY, *COUNTERS, "last_shown_at").unionByName(update.select(*KEY, *COUNTERS, "last_shown_at"))
    return both.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in COUNTERS), F.max("last_shown_at").alias("last_shown_at"))


def marked(impressions: DataFrame, marks: DataFrame) -> DataFrame:
    """Each impression (KEY, event_id, created_at) with what its reader did while the card was in view: self_grade, revealed.

    ``marks``: KEY, event_id, created_at, self_grade, revealed. A mark belongs to the next impression of its
    card (an impression is written when the card leaves view; at equal times marks come first) and to no
    later one; of several grades the last holds. Marks that no impression follows are left out.
    """
    shown = impressions.select(*KEY, "event_id", "created_at", F.lit(None).cast("int").alias("self_grade"), F.lit(False).alias("revealed"), F.lit(1).alias("_shown"))
    both = shown.unionByName(marks.select(*KEY, "event_id", "created_at", F.col("self_grade").cast("int").alias("self_grade"), F.coalesce("revealed", F.lit(False)).alias("revealed"), F.lit(0).alias("_shown")))
    order = Window.partitionBy(*KEY).orderBy("created_at", "_shown", "event_id")
    dealt = both.withColumn("_view", F.coalesce(F.sum("_shown").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.max_by("self_grade", F.when(F.col("self_grade").isNotNull(), F.struct("created_at", F.col("event_id"))))
    one = lambda c: F.max(F.when(F.col("_shown") == 1, F.col(c))).alias(c)
    return dealt.groupBy(*KEY, "_view").agg(one("event_id"), one("created_at"), last.alias("self_grade"), F.bool_or("revealed").alias("revealed")).where("event_id IS NOT NULL").drop("_view")


def reviews(impressions: DataFrame, cards: DataFrame) -> DataFrame:
    """The impressions that count as reviews, with their grades: of cards to be reviewed, when due, graded or answered.

    ``cards``: user_id, card_id, card_type, right_choice.
    """
    asked = impressions.where(F.col("was_sr_due") | F.col("self_grade").isNotNull() | F.col("quiz_selected_index").isNotNull())
    known = cards.where(F.col("card_type").isin(*REVIEW_TYPES)).select(*KEY, "card_type", "right_choice")
    grade = review_grade(F.col("self_grade"), F.col("quiz_selected_index"), F.col("right_choice"), F.col("card_type") == "quiz", F.col("dwell_ms"))
    return asked.join(known, [*KEY]).select(*KEY, "event_id", "created_at", grade.alias("grade"))


def liked_reviews(actions: DataFrame, cards: DataFrame) -> DataFrame:
    """A like counts as a review of the best grade (``actions``: user_id, card_id, event_id, created_at, action)."""
    known = cards.where(F.col("card_type").isin(*REVIEW_TYPES)).select(*KEY)
    return actions.where(F.col("action") == "like").join(known, [*KEY]).select(*KEY, "event_id", "created_at", F.lit(LIKE_GRADE).alias("grade"))


def review_states(graded: DataFrame) -> DataFrame:
    """sr_repetition, sr_interval_days, sr_ease_factor, sr_due_at of each card, its reviews taken in order.

    A review is a time, an id and a grade, about 20 bytes, and a reader reviews a card some tens of
    times: the fold runs over an array a card, in the JVM.
    """
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "event_id", "grade")))
    folded = F.aggregate("reviews", first_state(), lambda state, r: repeated(state, r["grade"]))
    states = graded.groupBy(*KEY).agg(ordered.alias("reviews")).select(*KEY, folded.alias("s"), F.element_at("reviews", -1)["created_at"].alias("at"))
    return states.select(*KEY, F.col("s.repetition").alias("sr_repetition"), F.col("s.interval").alias("sr_interval_days"), F.col("s.ease").alias("sr_ease_factor"), due_at(F.col("at"), F.col("s.interval")).alias("sr_due_at"))


def due_at(reviewed: Column, interval: Column) -> Column:
    """The time after an interval of days."""
    return reviewed + F.make_dt_interval(F.least(interval, F.lit(REVIEWED_DAYS_LIMIT)).cast("int"))


def scores(events: DataFrame, states: DataFrame) -> DataFrame:
    """Counters and review states side by side; cards never reviewed have repetition 0 and no due time."""
    return counters(events).join(states, [*KEY], "left").fillna({"sr_repetition": 0})


def active_actions(actions: DataFrame) -> DataFrame:
    """The actions that are switched on: each one toggles, so an odd number is on."""
    toggles = actions.groupBy(*KEY, "action").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("created_at"))
    return toggles.where(F.col("n") % 2 == 1).drop("n")


def card_states(cards: DataFrame, impressions: DataFrame, actions: DataFrame, tasks: int) -> DataFrame:
    """``cards`` (KEY, card_type, right_choice, ...) with counters, times_looked_at, last_shown_at, sr_repetition, sr_due_at and the sorted ``actions`` that are switched on.

    The same as ``counters``, ``review_states`` and ``active_actions`` joined to the cards, but everything about
    a card meets in one shuffle. Cards that were shown and are not in ``cards`` have a row too, its columns null.
    """
    own = [c for c in cards.columns if c not in KEY]
    asked = F.col("was_sr_due") | F.col("self_grade").isNotNull() | F.col("quiz_selected_index").isNotNull()
    shown = impressions.select(*KEY, F.lit(True).alias("_shown"), F.col("created_at").alias("_at"), "dwell_ms", asked.alias("_asked"), F.when(asked, F.col("event_id")).alias("event_id"), "self_grade", "quiz_selected_index")
    rows = cards.unionByName(shown, allowMissingColumns=True).unionByName(actions.select(*KEY, "action"), allowMissingColumns=True).repartition(tasks, *KEY)
    kind, review = engagement(F.col("dwell_ms")), F.struct(F.col("_at").alias("at"), "event_id", "self_grade", "quiz_selected_index", "dwell_ms")
    found = rows.groupBy(*KEY).agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in own),
        F.count("_shown").alias("times_shown"), F.count_if(kind == "engaged").alias("times_engaged"), F.count_if(kind == "scrolled_past").alias("times_skipped"), F.count_if(kind.isin("glanced", "engaged")).alias("times_looked_at"),
        F.max("_at").alias("last_shown_at"), F.collect_list(F.when(F.col("_asked"), review)).alias("_reviews"), *(F.count_if(F.col("action") == a).alias(f"_{a}") for a in CARD_ACTIONS),
    )
    reviews = F.when(F.col("card_type").isin(*REVIEW_TYPES) & (F.size("_reviews") > 0), F.array_sort("_reviews"))
    grade = lambda r: review_grade(r["self_grade"], r["quiz_selected_index"], F.col("right_choice"), F.col("card_type") == "quiz", r["dwell_ms"])
    folded = F.aggregate("_reviews", first_state(), lambda state, r: repeated(state, grade(r)))
    found = found.withColumn("_reviews", reviews).withColumn("_s", folded)
    active = F.array_compact(F.array(*(F.when(F.col(f"_{a}") % 2 == 1, a) for a in sorted(CARD_ACTIONS))))
    return found.select(
        *KEY, *own, *COUNTERS, "times_looked_at", "last_shown_at",
        F.coalesce("_s.repetition", F.lit(0)).alias("sr_repetition"), due_at(F.element_at("_reviews", -1)["at"], F.col("_s.interval")).alias("sr_due_at"), active.alias("actions"),
    )


def dwell_times(owners: DataFrame) -> DataFrame:
    """How long each card held the view: until the next card of its user took over (the last is still open).

    ``owners``: user_id, card_id, event_id, created_at. Rows are ordered within an hour of their user; only
    the last row and the first change of each hour are carried on to the next ones, so that a user with a
    third of all rows is as many tasks as hours.
    """
    rows = owners.withColumn("_hour", F.date_trunc("HOUR", "created_at"))
    place = F.struct("created_at", "event_id", "card_id")
    hours = Window.partitionBy("user_id").orderBy("_hour")
    within = Window.partitionBy("user_id", "_hour").orderBy("created_at", "event_id")

    def beside(df: DataFrame, by_hour: Column, carried: Column) -> DataFrame:
        found = df.groupBy("user_id", "_hour").agg(by_hour.alias("_kept")).select(F.col("user_id").alias("_u"), F.col("_hour").alias("_h"), carried.alias("_carried"))
        return df.join(found, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_hour").eqNullSafe(F.col("_h"))).drop("_u", "_h")

    last = beside(rows.withColumn("_lag", F.lag(place).over(within)), F.max(place), F.lag("_kept").over(hours))
    before = F.coalesce("_lag", "_carried")
    begun = last.where(before.isNull() | ~F.col("card_id").eqNullSafe(before["card_id"])).drop("_lag", "_carried")
    following = beside(begun.withColumn("_lead", F.lead("created_at").over(within)), F.min("created_at"), F.lead("_kept").over(hours))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    until = F.coalesce("_lead", "_carried")
    return following.withColumn("_micros", micros(until) - micros(F.col("created_at"))).withColumn("dwell_ms", F.expr("_micros div 1000")).drop("_micros", "_lead", "_carried", "_hour")
