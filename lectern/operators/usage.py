"""What model calls used: rows for a log, an append that never fails its batch, and what errors are worth another try."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lectern.functions.scores import ai_cost
from lectern.operators.scheduler import is_transient

USAGE = ("user_id", "document_id", "chunk_id", "operation", "provider", "model", "prompt_tokens", "completion_tokens", "thinking_tokens", "total_tokens", "duration_ms", "estimated_cost", "error")


def thinking_tokens(raw: Column) -> Column:
    """The number of thinking tokens in a provider's raw usage (JSON), or null."""
    return F.get_json_object(raw, "$.thoughtsTokenCount").try_cast("bigint")


def usage_rows(calls: DataFrame, operation: str, provider: str) -> DataFrame:
    """Log rows of calls (user_id, document_id, chunk_id, answer); ``answer`` is what ``generate.replies`` gives.

    A call that failed has null counts, no cost and its error's text.
    """
    a = F.col("answer")
    rows = calls.select(
        "user_id", "document_id", "chunk_id", F.lit(operation).alias("operation"), F.lit(provider).alias("provider"), a["model"].alias("model"), a["tokens_in"].alias("prompt_tokens"), a["tokens_out"].alias("completion_tokens"),
        a["thinking"].alias("thinking_tokens"), (a["tokens_in"] + a["tokens_out"] + F.coalesce(a["thinking"], F.lit(0))).alias("total_tokens"), a["duration_ms"].alias("duration_ms"), a["error"].alias("error"),
    )
    cost = ai_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), F.col("thinking_tokens"))
    return rows.withColumn("estimated_cost", cost).select(*USAGE)


def log_usage(rows: DataFrame, path: str) -> dict | None:
    """Appends usage rows to the log and returns their totals, gathered as they are written; None, with a warning, where
    that failed. Cards that were made are worth more than the note of what they cost: nothing is raised."""
    seen = Observation()
    totals = [F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "thinking_tokens", "estimated_cost"))]
    try:
        rows.observe(seen, *totals).write.mode("append").parquet(path)
    except Exception as error:  # whatever the store or a row's expression raises
        warnings.warn(f"usage was not logged: {type(error).__name__}", stacklevel=2)
        return None
    return seen.get


def retries(log: DataFrame) -> DataFrame:
    """(document_id, chunk_id, failed, worth_retrying): chunks whose calls failed, and whether some error is transient."""
    failed = log.where("error IS NOT NULL")
    return failed.groupBy("document_id", "chunk_id").agg(F.count(F.lit(1)).alias("failed"), F.bool_or(is_transient(F.col("error"))).alias("worth_retrying"))
