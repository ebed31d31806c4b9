"""Which documents get cards made, and in what order: budgets, missing types, fair turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scores import any_of, rounded
from lectern.functions.values import LOCK_MINUTES, MAIN_FIRST, MAX_RETRIES, PLUS_WEIGHT, PRIORITIES, PRIORITY_WEIGHT, QUANTUM, TIER_LIMITS, TRANSIENT_ERRORS, VIRTUAL_TIME_LIMIT
from lectern.operators.numbering import running_sums


def daily_usage(usage: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, used): cards made since midnight (UTC)."""
    today = usage.where((F.col("event_type") == "cards_generated") & (F.col("occurred_at") >= F.date_trunc("DAY", as_of)))
    return today.groupBy("user_id").agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("used"))


def budgets(users: DataFrame, usage: DataFrame, unseen: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, tier, used, budget): what is left of the day's cards; none where twice a day's cards wait unseen."""
    limits = F.coalesce(*(F.when(F.col("tier") == t, F.lit(cards)) for t, (_, cards) in TIER_LIMITS.items()))
    rows = users.join(daily_usage(usage, as_of), "user_id", "left").join(unseen.select("user_id", F.col("n").alias("waiting")), "user_id", "left").fillna(0, ["used", "waiting"])
    left = F.greatest(limits - F.col("used"), F.lit(0))
    return rows.select("user_id", "tier", "used", F.when(F.col("waiting") >= 2 * limits, 0).otherwise(left).cast("bigint").alias("budget"))


def is_free(locked_by: Column, locked_at: Column, me: str, as_of: Column) -> Column:
    """Whether a lock is open, one's own, or stale."""
    return locked_by.isNull() | (locked_by == me) | (locked_at < as_of - F.make_dt_interval(mins=F.lit(LOCK_MINUTES)))


def waiting_documents(documents: DataFrame, me: str, as_of: Column) -> DataFrame:
    """Documents to be worked on: chunking or generating, not paused, and free."""
    return documents.where(F.col("status").isin("chunking", "generating") & ~F.col("paused") & is_free(F.col("locked_by"), F.col("locked_at"), me, as_of))


def turns(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """The turns (user_id, turn, document_id, cards) of fair scheduling by virtual time, within each user's budget.

    ``documents``: user_id, document_id, priority, virtual_time, available (cards that can still be made).
    A turn makes up to ``QUANTUM`` cards and adds them, divided by the weight, to the document's virtual time;
    the document of least virtual time is next. As turns of one document are evenly spaced, all turns
    are listed with their times and merged by a sort: no loop over turns. A budget is at most a day's cards,
    so a document has at most that many turns.
    """
    rank = F.coalesce(*(F.when(F.col("priority") == p, r) for p, r in PRIORITIES.items()), F.lit(max(PRIORITIES.values())))
    first = Window.partitionBy("user_id").orderBy(rank, "virtual_time", "document_id")
    weighted = documents.withColumn("weight", F.when(F.row_number().over(first) == 1, PRIORITY_WEIGHT).otherwise(1)).join(budgets.where("budget > 0"), "user_id")
    most = F.least("available", "budget")
    n = F.ceil(most / QUANTUM).cast("int")
    listed = weighted.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    size = F.least(F.lit(QUANTUM), F.col("available") - F.col("k") * QUANTUM)
    listed = listed.withColumns({"at": F.col("virtual_time") + F.col("k") * QUANTUM / F.col("weight"), "size": size})
    order = Window.partitionBy("user_id").orderBy("at", "document_id")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    granted = listed.withColumns({"turn": F.row_number().over(order), "cards": F.least(F.col("size"), F.col("budget") - before)})
    return granted.where("cards > 0").select("user_id", F.col("turn").cast("bigint").alias("turn"), "document_id", F.col("cards").cast("bigint").alias("cards"))


def user_order(users: DataFrame) -> DataFrame:
    """Users by virtual time, those with an affinity first among equals (user_id, virtual_time, tier, affine)."""
    return users.orderBy(*affine_first(F.col("affine"), "user_id"))


def affine_first(affine: Column, key: str) -> list:
    """The order of what is next: by virtual time, those with an affinity first among equals, then by key."""
    return [F.col("virtual_time"), F.when(affine, 0).otherwise(1), F.col(key)]


def fair_order(users: DataFrame, turns: DataFrame, turns_a_visit: int | None = 1) -> DataFrame:
    """All users' turns in one order (place from 1), and the user's virtual time at which each is taken (starts_at).

    ``users``: user_id, tier, virtual_time; ``turns``: what ``turns`` gives. The user of least virtual time is next, the
    least id among equals; a visit of ``turns_a_visit`` turns (all that are left without it) moves the user's time on by
    its cards divided by the tier's weight. As a user's times only grow, taking the least each time is merging by
    time: visits are numbered by one running sum over the times and one along the users of a time, with no loop.
    Virtual times are whole or half numbers.
    """
    weight = F.when(F.col("tier") == "plus", PLUS_WEIGHT).otherwise(1)
    visit = F.lit(0) if turns_a_visit is None else F.floor((F.col("turn") - 1) / turns_a_visit)
    along = Window.partitionBy("user_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumns({"visit": visit, "_before": F.coalesce(F.sum("cards").over(along), F.lit(0))})
    begun = F.min("_before").over(Window.partitionBy("user_id", "visit"))
    rows = rows.withColumn("_before", begun).join(users.select("user_id", "tier", "virtual_time"), "user_id")
    rows = rows.withColumn("starts_at", F.col("virtual_time") + F.col("_before") / weight).withColumn("_slot", F.rint(F.col("starts_at") * PLUS_WEIGHT).cast("bigint"))
    visits = rows.groupBy("_slot", "user_id").agg(F.count(F.lit(1)).alias("n"))
    slots = visits.groupBy("_slot").agg(F.sum("n").alias("n"))
    earlier = running_sums(slots, [], "_slot", upto=F.col("n")).select("_slot", (F.col("upto") - F.col("n")).alias("_earlier"))
    within = running_sums(visits, ["_slot"], "user_id", upto=F.col("n")).select("_slot", "user_id", (F.col("upto") - F.col("n")).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy("user_id", "_slot").orderBy("turn"))
    placed = rows.withColumn("_nth", nth).join(within, ["_slot", "user_id"]).join(earlier, "_slot")
    return placed.select("user_id", "turn", "document_id", "cards", "starts_at", (F.col("_earlier") + F.col("_ahead") + F.col("_nth")).alias("place"))


def advanced(users: DataFrame, made: DataFrame) -> DataFrame:
    """Virtual times after cards were made (user_id, made); all are lowered by the least once that is large."""
    weight = F.when(F.col("tier") == "plus", PLUS_WEIGHT).otherwise(1)
    rows = users.join(made, "user_id", "left").withColumn("virtual_time", F.col("virtual_time") + F.coalesce("made", F.lit(0)) / weight).drop("made")
    least = rows.agg(F.min("virtual_time").alias("_least"))
    lower = F.when(F.col("_least") > VIRTUAL_TIME_LIMIT, F.col("_least")).otherwise(0.0)
    return rows.join(F.broadcast(least)).withColumn("virtual_time", F.col("virtual_time") - lower).drop("_least")


def missing_types(chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """(user_id, chunk_id, missing): required card types (``card_types`` of the chunk) that it has no card of yet."""
    have = cards.groupBy("user_id", "chunk_id").agg(F.collect_set("card_type").alias("have"))
    rows = chunks.join(have, ["user_id", "chunk_id"], "left")
    missing = F.array_sort(F.array_except("card_types", F.coalesce("have", F.array().cast("array<string>"))))
    return rows.select("user_id", "chunk_id", missing.alias("missing")).where(F.size("missing") > 0)


def main_first(chunks: DataFrame, is_front: Column, n: int = MAIN_FIRST) -> DataFrame:
    """Chunks (doc_id, pos) in the order to be worked on: the first ``n`` of the main matter, all front matter, the rest."""
    front = F.coalesce(is_front, F.lit(False)).cast("int")
    rows = running_sums(chunks, ["doc_id"], "pos", _front=front, _main=1 - front)
    after_first = F.least(F.lit(n), F.col("_main_total")) + F.col("_front")
    nth = F.when(F.coalesce(is_front, F.lit(False)), after_first).when(F.col("_main") <= n, F.col("_main")).otherwise(F.col("_main") + F.col("_front_total"))
    return rows.withColumn("nth", nth).drop("_front", "_main", "_front_total", "_main_total")


def is_transient(error: Column) -> Column:
    """Whether an error is worth another try."""
    return any_of(error.rlike(f"(?i){p}") for p in TRANSIENT_ERRORS)


def status_after_error(status: Column, error: Column, retries: Column) -> Column:
    return F.when(is_transient(error) & (retries < MAX_RETRIES), status).otherwise("error")


def next_status(status: Column, elements: Column, done: Column, missing: Column) -> Column:
    """``generating`` once all elements are chunked, ``ready`` once no chunk lacks a card type."""
    chunked = done >= elements
    return F.when(status.isin("pending", "preview", "error"), status).when(~chunked, "chunking").when(missing > 0, "generating").otherwise("ready")


def estimated_chunks(chunks: Column, elements: Column, done: Column) -> Column:
    """Chunks of the whole document, from the share of its elements that are done."""
    return F.when((done > 0) & (done < elements), rounded(chunks * elements / done)).otherwise(chunks).cast("bigint")
