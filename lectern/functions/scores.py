"""Engagement, spaced repetition and scheduling arithmetic on columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.values import (
    ALL_TYPES, BATCH_LIMIT, COOLDOWN_DAYS, DWELL_GRADES, EARLY_LIMIT, EARLY_TYPES, ENGAGE_MS, FIRST_EASE, FIRST_INTERVAL, GLANCE_MS, LEAST_EASE, MID_LIMIT, MID_TYPES, MODEL_PRICES, NOVELTY, PASS_GRADE, PLUS_WEIGHT, PRIORITY_WEIGHT,
    QUANTUM, REVEALED_GRADE, RIGHT_GRADE, SECOND_INTERVAL, UNKNOWN_AFFINITY, WRONG_GRADE,
)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, together; true if there are none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def engagement(dwell_ms: Column) -> Column:
    """What a dwell time means: ``scrolled_past``, ``glanced`` or ``engaged``."""
    return F.when(dwell_ms < GLANCE_MS, "scrolled_past").when(dwell_ms < ENGAGE_MS, "glanced").when(dwell_ms.isNotNull(), "engaged")


def valid_grade(grade: Column) -> Column:
    """A reader's own grade, or null where it is none of 0 to 5."""
    return F.when(grade.between(0, 5), grade)


def own_grade(self_grade: Column, quiz_choice: Column, revealed: Column) -> Column:
    """The reader's grade; the answer seen but neither graded nor chosen counts as ``REVEALED_GRADE``."""
    return F.coalesce(valid_grade(self_grade), F.when(F.coalesce(revealed, F.lit(False)) & quiz_choice.isNull(), REVEALED_GRADE)).cast("int")


def review_grade(self_grade: Column, quiz_choice: Column, right_choice: Column, is_quiz: Column, dwell_ms: Column) -> Column:
    """The grade of an impression: the reader's own, else that of a quiz answer, else that of the dwell time."""
    by_quiz = F.when(is_quiz & quiz_choice.isNotNull(), F.when(quiz_choice.eqNullSafe(right_choice), RIGHT_GRADE).otherwise(WRONG_GRADE))
    kind = engagement(dwell_ms)
    by_dwell = F.coalesce(*(F.when(kind == k, v) for k, v in DWELL_GRADES.items()))
    return F.coalesce(valid_grade(self_grade), by_quiz, by_dwell).cast("int")


def repeated(state: Column, grade: Column) -> Column:
    """The next state (repetition, interval, ease) after a review of this grade."""
    miss = 5 - grade
    ease = F.greatest(F.lit(LEAST_EASE), state["ease"] + (0.1 - miss * (0.08 + miss * 0.02)))
    passed = grade >= PASS_GRADE
    longer = F.when(state["repetition"] == 0, FIRST_INTERVAL).when(state["repetition"] == 1, SECOND_INTERVAL).otherwise(rounded(state["interval"] * state["ease"]))
    return F.struct(
        F.when(passed, state["repetition"] + 1).otherwise(0).cast("int").alias("repetition"),
        F.when(passed, longer).otherwise(FIRST_INTERVAL).cast("double").alias("interval"),
        ease.cast("double").alias("ease"),
    )


def first_state() -> Column:
    return F.struct(F.lit(0).alias("repetition"), F.lit(FIRST_INTERVAL).alias("interval"), F.lit(FIRST_EASE).alias("ease"))


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def eligible_types(seen_cards: Column) -> Column:
    """The card types for a reader who has seen so many cards."""
    listed = lambda types: F.array(*map(F.lit, types))
    return F.when(seen_cards <= EARLY_LIMIT, listed(EARLY_TYPES)).when(seen_cards <= MID_LIMIT, listed(MID_TYPES)).otherwise(listed(ALL_TYPES))


def tier(seen_cards: Column) -> Column:
    return F.when(seen_cards <= EARLY_LIMIT, "EARLY").when(seen_cards <= MID_LIMIT, "MID").otherwise("ALL")


def cooled_down(last_shown: Column, engaged: Column, skipped: Column, due: Column, as_of: Column) -> Column:
    """Whether a card that was shown may be shown again; a card never scored may."""
    days = F.when(skipped > engaged, COOLDOWN_DAYS["skipped"]).when(engaged > 0, COOLDOWN_DAYS["engaged"]).otherwise(COOLDOWN_DAYS["other"])
    rested = last_shown < as_of - F.make_dt_interval(days)
    return last_shown.isNull() | F.coalesce(rested, F.lit(False)) | F.coalesce(due <= as_of, F.lit(False))


def feed_score(affinity: Column, shown: Column, jitter: Column) -> Column:
    """Affinity of the card's type, raised for cards never shown, times a jitter from 0.5 to 1.5."""
    novelty = F.when(F.coalesce(shown, F.lit(0)) == 0, NOVELTY).otherwise(1.0)
    return F.coalesce(affinity, F.lit(UNKNOWN_AFFINITY)) * novelty * (0.5 + jitter)


def jitter(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: the same in every run and engine."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def ai_cost(model: Column, tokens_in: Column, tokens_out: Column, thinking: Column) -> Column:
    """Dollars of a call; null for an unknown model or missing counts."""
    price = lambda k: F.coalesce(*(F.when(model == name, F.lit(p[k])) for name, p in MODEL_PRICES.items()))
    return (tokens_in * price(0) + tokens_out * price(1) + F.coalesce(thinking, F.lit(0)) * price(1)) / 1_000_000


def schedule_weight(is_priority: Column, is_plus: Column) -> tuple[Column, Column]:
    """(weight of a document, weight of a user): the larger, the more turns."""
    return F.when(is_priority, PRIORITY_WEIGHT).otherwise(1), F.when(is_plus, PLUS_WEIGHT).otherwise(1)


def turn_size(budget: Column) -> Column:
    return F.least(budget, F.lit(QUANTUM))


def percent(part: Column, whole: Column, most: int = 100) -> Column:
    """A whole percentage, at most ``most``; 0 where the whole is missing or 0."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0).otherwise(F.least(F.lit(most), rounded(part / whole * 100))).cast("bigint")


def capped(batch: Column, most: int = BATCH_LIMIT) -> Column:
    """The first impressions of a batch."""
    return F.slice(batch, 1, most)


def clamped_number(text: Column, default: int, most: int) -> Column:
    """A number from a text: ``default`` where it is none, ``most`` at most."""
    return F.least(F.coalesce(text.try_cast("int"), F.lit(default)), F.lit(most))
