"""Schemas of a store's tables, and the rules that its rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import is_slug, normalize_title

UNITS = "uuid string, category string, title_norm string, content string, summary string, revision long, status string, recall_when string, trashed_at timestamp, created_at timestamp, updated_at timestamp"
KEYWORDS = "memory_uuid string, keyword_norm string, weight int"
RELATIONS = "uuid string, from_memory_uuid string, to_memory_uuid string, relation_type string, weight int, note string, created_at timestamp"
EMBEDDINGS = "memory_uuid string, embedding array<float>, embedding_model string, embedding_dimension int"
CHANGES = "memory_uuid string, action string, before_state string, after_state string, created_at timestamp, updated_at timestamp"
USAGE = "memory_uuid string, use_count long, last_used_at timestamp"
SEARCH_INDEX = "memory_uuid string, status string, title_text string, summary_text string, keywords_text string, content_text string, recall_when_text string, all_text string"
POSTINGS = "gram string, field string, memory_uuid string, size int"
GRAPH_META = "dirty boolean, updated_at timestamp, revision long"
#: Records whose embedding is to be made: how often that was tried in vain, and why.
EMBEDDING_REQUESTS = "memory_uuid string, attempts int, error string, requested_at timestamp"
TABLES = {
    "units": UNITS, "keywords": KEYWORDS, "relations": RELATIONS, "changes": CHANGES, "embeddings": EMBEDDINGS, "usage": USAGE, "search_index": SEARCH_INDEX,
    "postings": POSTINGS, "graph_meta": GRAPH_META, "embedding_requests": EMBEDDING_REQUESTS,
}
SNAPSHOT = (
    "memory struct<uuid: string, category: string, title_norm: string, content: string, summary: string, revision: long, status: string, recall_when: string, trashed_at: timestamp>, "
    "keywords array<struct<keyword_norm: string, weight: int>>, "
    "relations array<struct<relation_uuid: string, from_memory_uuid: string, to_memory_uuid: string, relation_type: string, weight: int, note: string>>"
)

# Fixed values.
STATUSES = ("pending", "active", "trashed")
RELATION_TYPES = ("related_to", "supersedes", "depends_on", "conflicts_with", "elaborates", "applies_to")
SEARCH_FIELDS = ("title", "summary", "keywords", "content", "recall_when")
CATEGORIES = ("core", "init", "share")


def unit_violations(units: DataFrame, shared: bool = False) -> DataFrame:
    """uuid, rule: each rule that a record breaks; shared: whether the store is the shared one."""
    c = F.col
    rules: list[tuple[str, Column]] = [
        ("category", ~F.coalesce(is_slug(c("category")), F.lit(False))),
        ("category_scope", (c("category") != "share") if shared else (c("category") == "share")),
        ("title", c("title_norm").isNull() | (c("title_norm") == "") | (normalize_title(c("title_norm")) != c("title_norm"))),
        ("content", c("content").isNull()),
        ("status", ~c("status").isin(*STATUSES)),
        ("trashed_at", (c("status") == "trashed") != c("trashed_at").isNotNull()),
    ]
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    return units.select("uuid", F.explode(broken).alias("rule"))


def duplicate_titles(units: DataFrame) -> DataFrame:
    """Categories and titles that more than one record that isn't trashed bears."""
    return units.where("status <> 'trashed'").groupBy("category", "title_norm").agg(F.count("*").alias("n")).where("n > 1")
