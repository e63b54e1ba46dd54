"""Approval, rejection, restoration and expiry of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SNAPSHOT

RESTORED = ("category", "title_norm", "content", "summary", "recall_when")


def reviewable(changes: DataFrame, units: DataFrame) -> DataFrame:
    """Changes with their record's status, but for deletions of trashed records, which the trash decides."""
    u = units.select(F.col("uuid").alias("memory_uuid"), "status", "revision")
    return changes.join(u, "memory_uuid").where(~((F.col("action") == "delete") & (F.col("status") == "trashed")))


def approve(changes: DataFrame, units: DataFrame) -> DataFrame:
    """uuid, status, revision, removed, dirty after the changes are approved.

    Creations become active, other edits are live already, deletions remove the record.
    """
    rows = reviewable(changes, units)
    create = F.col("action") == "create"
    return rows.select(
        F.col("memory_uuid").alias("uuid"), "action", F.when(create, "active").otherwise(F.col("status")).alias("next_status"),
        (F.col("revision") + create.cast("int")).alias("revision"), (F.col("action") == "delete").alias("removed"), F.col("action").isin("create", "delete").alias("dirty"),
    )


def snapshot(state: Column) -> Column:
    return F.from_json(state, SNAPSHOT)


def reject(changes: DataFrame, units: DataFrame) -> DataFrame:
    """uuid, removed, the fields after rejection and the revision, which still goes up.

    Creations go; others get back the fields of the state before, where that has them.
    """
    rows = reviewable(changes, units).drop("revision", "status").join(units.withColumnRenamed("uuid", "memory_uuid"), "memory_uuid").withColumn("old", snapshot(F.col("before_state")))
    there = (F.col("action") != "create") & F.col("old.memory.title_norm").isNotNull()
    return rows.select(
        F.col("memory_uuid").alias("uuid"), "action", (F.col("action") == "create").alias("removed"),
        *(F.when(there, F.col(f"old.memory.{f}")).otherwise(F.col(f)).alias(f) for f in RESTORED), (F.col("revision") + 1).alias("revision"),
    )


def restored_keywords(changes: DataFrame) -> DataFrame:
    """memory_uuid, keyword_norm, weight of the states before."""
    return changes.select("memory_uuid", F.inline(snapshot(F.col("before_state"))["keywords"]))


def restored_relations(changes: DataFrame) -> DataFrame:
    """Relations of the states before; ids are made anew from what they hold."""
    rows = changes.select(F.inline(snapshot(F.col("before_state"))["relations"])).drop("relation_uuid")
    return rows.distinct().withColumn("uuid", F.sha2(F.concat_ws("|", "from_memory_uuid", "to_memory_uuid", "relation_type"), 256))


def restore(trashed: DataFrame, units: DataFrame) -> DataFrame:
    """trashed (memory_uuid, before_state) taken out of the trash as they were before: uuid, their fields, next_status, trashed_at,
    open_action, after_state, revision, dirty, error_code.

    The state before tells all fields, keywords and relations (see
    restored_keywords, restored_relations), so that what was edited without
    review before the deletion isn't live again. An active record has no open
    change any more; a pending one is a creation again, whose state after is
    the state before. Others can't be restored and stay as they are.
    """
    rows = trashed.select("memory_uuid", "before_state", snapshot(F.col("before_state"))["memory"].alias("old")).join(units.withColumnRenamed("uuid", "memory_uuid"), "memory_uuid").where("status = 'trashed'")
    was = F.coalesce(F.col("old.status"), F.lit(""))
    code = F.when(~was.isin("active", "pending"), "STATE_ERROR")
    done, pending = code.isNull(), was == "pending"
    return rows.select(
        F.col("memory_uuid").alias("uuid"), *(F.when(done, F.col(f"old.{f}")).otherwise(F.col(f)).alias(f) for f in RESTORED), F.when(done, was).otherwise(F.col("status")).alias("next_status"),
        F.when(~done, F.col("trashed_at")).alias("trashed_at"), F.when(pending, "create").alias("open_action"), F.when(pending, F.col("before_state")).alias("after_state"),
        (F.col("revision") + done.cast("int")).alias("revision"), (was == "active").alias("dirty"), code.alias("error_code"),
    )


def expired(changes: DataFrame, units: DataFrame, now: Column, retention_minutes: int) -> DataFrame:
    """uuid of records in the trash for as long as they are kept, or longer."""
    u = units.where("status = 'trashed' and trashed_at is not null").select(F.col("uuid").alias("memory_uuid"), "trashed_at")
    rows = changes.where("action = 'delete'").join(u, "memory_uuid")
    due = F.col("trashed_at") + F.expr(f"INTERVAL '{int(retention_minutes)}' MINUTE") <= now
    return rows.where(due).select(F.col("memory_uuid").alias("uuid"), "trashed_at")


def delete_from_trash(wanted: DataFrame, changes: DataFrame, units: DataFrame) -> DataFrame:
    """wanted (uuid): whether each can be deleted for good."""
    rows = wanted.join(units.select("uuid", "status"), "uuid", "left").join(changes.select(F.col("memory_uuid").alias("uuid"), "action"), "uuid", "left")
    code = F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status") != "trashed", "NOT_TRASHED").when(~F.col("action").eqNullSafe("delete"), "INVARIANT_ERROR")
    return rows.select("uuid", code.alias("error_code"))
