"""Snapshots, listings and reports of a store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_hash, json_string, text_diff
from ..schemas import SNAPSHOT

MEMORY = ("uuid", "category", "title_norm", "content", "summary", "revision", "status", "recall_when", "trashed_at")


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """memory_uuid, keywords: (keyword_norm, weight) in the order of keyword_norm."""
    return keywords.groupBy("memory_uuid").agg(F.array_sort(F.collect_list(F.struct("keyword_norm", "weight"))).alias("keywords"))


def relation_lists(relations: DataFrame) -> DataFrame:
    """memory_uuid, relations: those that touch a record at either end, by age."""
    item = F.struct("created_at", F.col("uuid").alias("relation_uuid"), "from_memory_uuid", "to_memory_uuid", "relation_type", "weight", "note")
    ends = relations.select(F.explode(F.array("from_memory_uuid", "to_memory_uuid")).alias("memory_uuid"), item.alias("item"))
    return ends.groupBy("memory_uuid").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.dropFields("created_at")).alias("relations"))


def snapshots(units: DataFrame, keywords: DataFrame, relations: DataFrame) -> DataFrame:
    """uuid, memory, keywords, relations: the canonical state of each record; empty lists for none."""
    k = keyword_lists(keywords).withColumnRenamed("memory_uuid", "uuid")
    r = relation_lists(relations).withColumnRenamed("memory_uuid", "uuid")
    joined = units.select("uuid", "updated_at", F.struct(*MEMORY).alias("memory")).join(k, "uuid", "left").join(r, "uuid", "left")
    return joined.select(
        "uuid", "updated_at", "memory", F.coalesce("keywords", F.array().cast(k.schema["keywords"].dataType)).alias("keywords"), F.coalesce("relations", F.array().cast(r.schema["relations"].dataType)).alias("relations")
    )


def state_json() -> Column:
    """A snapshot as JSON with its nulls."""
    return F.to_json(F.struct("memory", "keywords", "relations"), {"ignoreNullFields": "false"})


def init_read(units: DataFrame, category: str = "init") -> DataFrame:
    return units.where((F.col("category") == category) & (F.col("status") != "trashed")).select("uuid", "title_norm", "content").orderBy("title_norm", "uuid")


def list_memories(units: DataFrame, keywords: DataFrame, changes: DataFrame) -> DataFrame:
    """Active records with their keywords and whether a change is open, latest first."""
    k = keyword_lists(keywords).select(F.col("memory_uuid").alias("uuid"), F.array_join(F.col("keywords.keyword_norm"), ",").alias("keywords"))
    c = changes.select(F.col("memory_uuid").alias("uuid"), F.col("action").alias("change_action"))
    rows = units.where("status = 'active'").join(k, "uuid", "left").join(c, "uuid", "left")
    return rows.select(
        "uuid", "category", "title_norm", "summary", "content", "revision", "recall_when", F.coalesce("keywords", F.lit("")).alias("keywords"),
        F.col("change_action").isNotNull().alias("has_open_change"), "change_action", "created_at", "updated_at",
    ).orderBy(F.desc("updated_at"), "uuid")


def category_keywords(units: DataFrame, keywords: DataFrame, category: str) -> DataFrame:
    own = units.where((F.col("status") == "active") & (F.col("category") == category)).select(F.col("uuid").alias("memory_uuid"))
    return keywords.join(own, "memory_uuid", "left_semi").select("keyword_norm").distinct().orderBy("keyword_norm")


def open_changes(changes: DataFrame, units: DataFrame) -> DataFrame:
    """Changes with the record's or else the later state's title and summary, but for deletions of trashed records."""
    u = units.select(F.col("uuid").alias("memory_uuid"), "status", "title_norm", "summary", "category")
    path = lambda k: F.get_json_object("after_state", f"$.memory.{k}")
    rows = changes.join(u, "memory_uuid", "left").where(~((F.col("action") == "delete") & F.coalesce(F.col("status") == "trashed", F.lit(False))))
    return rows.select(
        "memory_uuid", "action", F.coalesce("title_norm", path("title_norm")).alias("title_norm"), F.coalesce("summary", path("summary")).alias("summary"),
        "status", "before_state", "after_state", "created_at", "updated_at",
    )


def trash(changes: DataFrame, units: DataFrame, retention_minutes: int) -> DataFrame:
    """Trashed records with their deletion and when they expire, latest first."""
    u = units.where("status = 'trashed' and trashed_at is not null").select(F.col("uuid").alias("memory_uuid"), "category", "title_norm", "summary", "trashed_at")
    expires = F.col("trashed_at") + F.expr(f"INTERVAL '{int(retention_minutes)}' MINUTE")
    return changes.where("action = 'delete'").join(u, "memory_uuid").withColumn("expires_at", expires).orderBy(F.desc("trashed_at"), "memory_uuid")


def memory_hashes(states: DataFrame) -> DataFrame:
    """uuid, title_norm, revision and the hashes of a record's state and fields, for records that aren't trashed."""
    m = lambda k: F.col(f"memory.{k}")
    text = lambda k: json_hash(F.coalesce(json_string(m(k)), F.lit("null")))
    own = states.where(m("status") != "trashed")
    return own.select(
        "uuid", m("title_norm").alias("title_norm"), m("revision").alias("revision"), json_hash(state_json()).alias("state_hash"),
        text("title_norm").alias("title_hash"), text("content").alias("content_hash"), text("summary").alias("summary_hash"),
        text("recall_when").alias("recall_when_hash"), text("category").alias("category_hash"),
        json_hash(F.concat(F.lit("["), F.array_join(F.transform("keywords", lambda k: json_string(k["keyword_norm"])), ","), F.lit("]"))).alias("keywords_hash"),
    )


def ui_filter(units: DataFrame, keywords: DataFrame, category: str | None = None, text: str = "", since: date | None = None, until: date | None = None, by: str = "created_at") -> DataFrame:
    """Records of a category, of days from since to until, that hold a text in any field or keyword."""
    k = keyword_lists(keywords).withColumnRenamed("memory_uuid", "uuid")
    rows = units.join(k, "uuid", "left")
    if category:
        rows = rows.where(F.col("category") == category)
    if since:
        rows = rows.where(F.to_date(by) >= F.lit(since))
    if until:
        rows = rows.where(F.to_date(by) <= F.lit(until))
    if text.strip():
        needle = text.strip().lower()
        has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
        fields = [F.col("uuid").cast("string"), *(F.col(c) for c in ("title_norm", "summary", "content", "recall_when"))]
        found = F.coalesce(F.exists("keywords", lambda x: F.contains(F.lower(x["keyword_norm"]), F.lit(needle))), F.lit(False))
        for field in fields:
            found = found | has(field)
        rows = rows.where(found)
    return rows.select("uuid", "category", "title_norm", "status", by)


#: Fields of a state that a review shows, and how their values are written.
DIFFED = ("title_norm", "category", "summary", "content", "recall_when", "status")


def state_fields(parsed: Column) -> dict[str, Column]:
    """A parsed state's fields by name as texts, with keywords and relations as lists, a line each."""
    relation = lambda r: F.concat_ws(" ", r["from_memory_uuid"], r["relation_type"], r["to_memory_uuid"], r["weight"].cast("string"), r["note"])
    lists = {"keywords": F.transform(parsed["keywords"], lambda k: k["keyword_norm"]), "relations": F.array_sort(F.transform(parsed["relations"], relation))}
    return {f: parsed["memory"][f] for f in DIFFED} | {f: F.array_join(c, "\n") for f, c in lists.items()}


def change_fields(changes: DataFrame) -> DataFrame:
    """memory_uuid, field, old, new, prefix, removed, added, suffix: each field that a change touches, a dash for what is missing,
    and where the two texts differ: what they begin and end with in common, and what is between.

    Both states lie in one row, so they are parsed once each and compared there, without a shuffle.
    """
    rows = changes.select("memory_uuid", F.from_json("before_state", SNAPSHOT).alias("before"), F.from_json("after_state", SNAPSHOT).alias("after"))
    old, new = (state_fields(F.col(c)) for c in ("before", "after"))
    cells = rows.select("memory_uuid", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), old[f].alias("old"), new[f].alias("new")) for f in old))))
    cells = cells.where(~F.col("old").eqNullSafe(F.col("new"))).select("memory_uuid", "field", F.coalesce("old", F.lit("-")).alias("old"), F.coalesce("new", F.lit("-")).alias("new"))
    return cells.withColumn("d", text_diff(F.col("old"), F.col("new"))).select("memory_uuid", "field", "old", "new", "d.prefix", F.col("d.old").alias("removed"), F.col("d.new").alias("added"), "d.suffix")
