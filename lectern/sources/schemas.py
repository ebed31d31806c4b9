"""The tables of a reading service: columns, keys, and the checks that parquet does not make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.values import CARD_ACTIONS, CARD_TYPES, CHUNK_TYPES, DOCUMENT_TYPES, FEED_EVENT_TYPES, PRIORITIES, READING_GOALS, STATUSES, TIER_LIMITS

_TOC = "array<struct<title:string,page:int,level:int,fragment:string>>"
SCHEMAS = {
    "profiles": "id string, display_name string, ai_provider string, ai_model string, tier string, virtual_time double, processing_locked_by string, processing_locked_at timestamp, created_at timestamp",
    "documents": "id string, user_id string, title string, author string, document_type string, language string, is_read boolean, source string, file_path string, file_size bigint, processing_status string, total_pages int, page_start int, page_end int, toc " + _TOC + ", selected_toc_indices array<int>, toc_classification array<string>, total_elements int, elements_processed int, chunk_count int, card_count int, reading_goal string, card_types_override array<string>, chunk_interval_override int, priority string, paused boolean, locked_by string, locked_at timestamp, retry_count int, catalog_book_id string, doc_virtual_time double, created_at timestamp",
    "collections": "id string, user_id string, name string, description string, created_at timestamp, updated_at timestamp",
    "collection_documents": "collection_id string, document_id string, added_at timestamp",
    "chunks": "id string, user_id string, document_id string, chunk_type string, content string, encrypted boolean, chunk_index int, chapter string, word_count int, language string, catalog_chunk_id string, created_at timestamp",
    "chunk_images": "id string, chunk_id string, document_id string, storage_path string, mime_type string, alt_text string, position int, created_at timestamp",
    "cards": "id string, user_id string, chunk_id string, card_type string, content string, encrypted boolean, secondary_chunk_id string, ai_provider string, ai_model string, created_at timestamp",
    "jobs": "id string, user_id string, document_id string, status string, error string, created_at timestamp, started_at timestamp, finished_at timestamp",
    "card_actions": "id string, user_id string, card_id string, action string, created_at timestamp",
    "feed_events": "id string, user_id string, card_id string, event_type string, dwell_ms int, self_grade int, time_of_day int, day_of_week int, created_at timestamp",
    "card_scores": "user_id string, card_id string, times_shown int, times_engaged int, times_skipped int, last_shown_at timestamp, sr_repetition int, sr_interval_days double, sr_due_at timestamp, sr_ease_factor double",
    "ai_usage_logs": "id string, user_id string, document_id string, chunk_id string, operation string, provider string, model string, prompt_tokens int, completion_tokens int, thinking_tokens int, total_tokens int, duration_ms int, estimated_cost_usd double, metadata string, created_at timestamp",
    "usage_events": "id string, user_id string, event_type string, quantity int, document_id string, metadata string, occurred_at timestamp",
    "catalog": "catalog_id int, title string, author string, subjects string, bookshelves string, language string, issued_at string",
    "featured": "id string, category string, catalog_id int, title string, author string, rank int, download_count int",
    "catalog_books": "id string, catalog_id int, title string, author string, subjects array<string>, languages array<string>, cover_image_url string, total_pages int, total_chunks int, total_cards int, toc " + _TOC + ", toc_classification array<string>, processing_status string, error string, processing_started_at timestamp, created_at timestamp",
    "catalog_chunks": "id string, catalog_book_id string, chunk_type string, content string, chunk_index int, chapter string, word_count int, language string",
    "catalog_cards": "id string, catalog_chunk_id string, card_type string, content string, secondary_catalog_chunk_id string, ai_provider string, ai_model string",
}
KEYS = {name: ["id"] for name in SCHEMAS} | {"collection_documents": ["collection_id", "document_id"], "card_scores": ["user_id", "card_id"], "catalog": ["catalog_id"]}
UNIQUE = {"collections": ["user_id", "name"], "card_actions": ["user_id", "card_id", "action"], "catalog_books": ["catalog_id"], "catalog_cards": ["catalog_chunk_id", "card_type"]}
DOMAINS = {
    ("profiles", "tier"): tuple(TIER_LIMITS), ("documents", "document_type"): DOCUMENT_TYPES, ("documents", "reading_goal"): READING_GOALS, ("documents", "processing_status"): STATUSES, ("documents", "priority"): tuple(PRIORITIES),
    ("chunks", "chunk_type"): CHUNK_TYPES, ("cards", "card_type"): CARD_TYPES, ("card_actions", "action"): CARD_ACTIONS, ("feed_events", "event_type"): FEED_EVENT_TYPES,
}


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, column: str, parent_key: str = "id") -> DataFrame:
    """Rows that refer to no parent; null refers to none and is fine."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")


def outside_domain(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not one of a column's values."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
