"""The test tables as a store of knowledge records, and the same as SQL for the oracle.

Keys are longs here. Titles and contents repeat, so the uniqueness that a
live store enforces doesn't hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title


@dataclass(frozen=True)
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def units(self) -> DataFrame:
        d, e = self.table("documents"), self.table("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
        ids = F.col("doc_id")
        return d.join(e, d["doc_id"] == e["event_id"]).select(
            ids.alias("uuid"),
            F.col("lang").alias("category"),
            normalize_title(F.substring("text", 1, 60)).alias("title_norm"),
            F.col("text").alias("content"),
            F.when(ids % 3 != 0, F.substring("text", 1, 200)).alias("summary"),
            (ids % 4 + 1).cast("long").alias("revision"),
            F.when(ids % 10 == 0, "trashed").when(ids % 10 == 1, "pending").otherwise("active").alias("status"),
            F.when(ids % 2 != 0, F.concat(F.lit("when "), "source")).alias("recall_when"),
            F.when(ids % 10 == 0, F.col("ts")).alias("trashed_at"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("updated_at"),
        )

    @cached_property
    def keywords(self) -> DataFrame:
        d, p = self.table("documents"), self.table("part")
        words = F.array("source", "lang", F.lower("p_brand"), F.lower("p_type"), F.lower("p_name"))
        held = d.select("doc_id", "source", "lang").join(p, d["doc_id"] == p["p_partkey"], "left")
        return held.select(F.col("doc_id").alias("memory_uuid"), F.explode(F.array_distinct(F.array_compact(words))).alias("keyword_norm")).select(
            "memory_uuid", "keyword_norm", F.lit(None).cast("int").alias("weight")
        )

    @cached_property
    def relations(self) -> DataFrame:
        ids = self.table("documents").select("doc_id")
        e = self.table("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("created_at"))
        other = ids.select(F.col("doc_id").alias("to_uuid"))
        kinds = F.array(*map(F.lit, ("related_to", "supersedes", "depends_on", "conflicts_with", "elaborates", "applies_to")))
        made = ids.withColumn("to", F.col("doc_id") + 1 + F.col("doc_id") % 5).join(other, F.col("to") == F.col("to_uuid")).join(e, F.col("doc_id") == F.col("event_id"))
        return made.select(
            F.col("doc_id").alias("uuid"),
            F.col("doc_id").alias("from_memory_uuid"),
            F.col("to_uuid").alias("to_memory_uuid"),
            F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("relation_type"),
            F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 101).cast("int")).alias("weight"),
            F.lit(None).cast("string").alias("note"),
            "created_at",
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("memory_uuid"),
            "embedding",
            F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("embedding_model"),
            F.lit(64).alias("embedding_dimension"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        views = self.table("events").where("event_type = 'view'")
        return views.groupBy(F.col("user_id").alias("memory_uuid")).agg(F.count("*").alias("use_count"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last_used_at"))

    @cached_property
    def changes(self) -> DataFrame:
        """At most one open change for each record: the first state before it and the latest one after it."""
        e = self.table("events").where("event_type in ('signup', 'click', 'error')").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        last = F.max_by("event_type", "event_id")
        return e.groupBy(F.col("user_id").alias("memory_uuid")).agg(
            F.when(last == "signup", "create").when(last == "click", "update").otherwise("delete").alias("action"),
            F.min_by("props", "event_id").alias("before_state"),
            F.max_by("props", "event_id").alias("after_state"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
        )


UNITS = r"""memory_units AS (
  SELECT d.doc_id AS uuid, d.lang AS category, regexp_replace(lower(trim(substring(d.text, 1, 60))), '\s+', ' ', 'g') AS title_norm,
         d.text AS content, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE substring(d.text, 1, 200) END AS summary,
         CAST(1 + d.doc_id % 4 AS BIGINT) AS revision,
         CASE d.doc_id % 10 WHEN 0 THEN 'trashed' WHEN 1 THEN 'pending' ELSE 'active' END AS status,
         CASE WHEN d.doc_id % 2 = 0 THEN NULL ELSE concat('when ', d.source) END AS recall_when,
         CASE WHEN d.doc_id % 10 = 0 THEN e.ts END AS trashed_at, e.ts AS created_at, e.ts AS updated_at
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""
KEYWORDS = """memory_keywords AS (
  SELECT DISTINCT memory_uuid, keyword_norm, CAST(NULL AS INT) AS weight FROM (
    SELECT doc_id AS memory_uuid, source AS keyword_norm FROM documents UNION ALL SELECT doc_id, lang FROM documents
    UNION ALL SELECT doc_id, lower(p_brand) FROM documents JOIN part ON p_partkey = doc_id
    UNION ALL SELECT doc_id, lower(p_type) FROM documents JOIN part ON p_partkey = doc_id
    UNION ALL SELECT doc_id, lower(p_name) FROM documents JOIN part ON p_partkey = doc_id) WHERE keyword_norm IS NOT NULL)"""
RELATIONS = """memory_relations AS (
  SELECT a.doc_id AS uuid, a.doc_id AS from_memory_uuid, b.doc_id AS to_memory_uuid,
         CASE a.doc_id % 6 WHEN 0 THEN 'related_to' WHEN 1 THEN 'supersedes' WHEN 2 THEN 'depends_on' WHEN 3 THEN 'conflicts_with'
           WHEN 4 THEN 'elaborates' ELSE 'applies_to' END AS relation_type,
         CASE WHEN a.doc_id % 5 = 0 THEN NULL ELSE CAST(a.doc_id % 101 AS INT) END AS weight, CAST(NULL AS VARCHAR) AS note, e.ts AS created_at
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 + a.doc_id % 5 JOIN events e ON e.event_id = a.doc_id)"""
EMBEDDINGS = """memory_embeddings AS (
  SELECT vec_id AS memory_uuid, embedding, concat('m', CAST(label % 2 AS VARCHAR)) AS embedding_model, 64 AS embedding_dimension FROM embeddings)"""
USAGE = """memory_usage AS (
  SELECT user_id AS memory_uuid, count(*) AS use_count, max(ts) AS last_used_at FROM events WHERE event_type = 'view' GROUP BY user_id)"""
CHANGES = """memory_changes AS (
  SELECT user_id AS memory_uuid,
         CASE max_by(event_type, event_id) WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' ELSE 'delete' END AS action,
         min_by(props, event_id) AS before_state, max_by(props, event_id) AS after_state, min(ts) AS created_at, max(ts) AS updated_at
  FROM events WHERE event_type IN ('signup', 'click', 'error') GROUP BY user_id)"""


def sql(body: str, *views: str) -> str:
    """One SELECT: the fixture views that it reads, then its own."""
    head, _, rest = body.strip().partition("WITH ")
    start = "WITH RECURSIVE" if any(v.startswith("reached AS") for v in views) else "WITH"
    return f"{start} " + ", ".join([*views, rest]) if not head and rest else f"{start} {', '.join(views)} {body}"
