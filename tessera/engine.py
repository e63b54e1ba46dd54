"""One method for each thing that a client does with a store.

Reading methods return DataFrames (or a dict for a search) of the last
revision. An editing method reads one revision, checks its command against
it, and commits the rows that change: those of the records that it edits, and
of the index. If another commit came meanwhile, the edit fails as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import schemas
from .functions.text import normalize_keyword
from .operators import commands, graph, index, listing, review, search
from .sources import backup
from .sources.store import ConflictError, Delta, Derived, Snapshot, Store, side_by_side
from .streaming import embedding

#: Rows that go with a record: table and the column that names it. Relations go by their own keys.
OWNED = {"keywords": "memory_uuid", "embeddings": "memory_uuid", "usage": "memory_uuid", "search_index": "memory_uuid", "postings": "memory_uuid", "embedding_requests": "memory_uuid", "changes": "memory_uuid", "units": "uuid"}


class EditError(ValueError):
    """An edit that isn't done; its text is the error code."""


def local(spark: SparkSession, schema: str, rows: Sequence[dict]) -> DataFrame:
    """A few rows as a relation that needs no job to be read."""
    kinds = T.StructType.fromDDL(schema)
    zoned = [f.name for f in kinds if f.dataType == T.TimestampType()]
    fixed = [r | {c: r[c].astimezone(UTC) for c in zoned if r.get(c) is not None} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(fixed, to_arrow_schema(kinds)), kinds)


def gather(*frames: DataFrame) -> list[list[Row]]:
    """The rows of small frames."""
    return side_by_side(lambda df: df.collect(), frames)


@dataclass(frozen=True)
class View:
    """The tables of one revision; one that was never written is empty."""

    snapshot: Snapshot

    def table(self, name: str) -> DataFrame:
        rows = self.snapshot.read(name)
        return rows if rows is not None else self.snapshot.spark.createDataFrame([], schemas.TABLES[name])

    units = property(lambda self: self.table("units"))
    keywords = property(lambda self: self.table("keywords"))
    relations = property(lambda self: self.table("relations"))
    changes = property(lambda self: self.table("changes"))
    embeddings = property(lambda self: self.table("embeddings"))

    def touching(self, uuid: str) -> DataFrame:
        return self.relations.where((F.col("from_memory_uuid") == uuid) | (F.col("to_memory_uuid") == uuid))


@dataclass
class Record:
    """One record's rows, as frames that need no job."""

    units: DataFrame
    keywords: DataFrame
    relations: DataFrame
    changes: DataFrame
    unit: dict | None
    change: dict | None
    words: list[dict]

    def state(self) -> DataFrame:
        return listing.snapshots(self.units, self.keywords, self.relations).select("uuid", listing.state_json().alias("state"))


@dataclass
class Engine:
    store: Store
    retention_minutes: int = 10_080
    categories: tuple[str, ...] = schemas.CATEGORIES
    model: str = ""
    embed: Callable[[str], Sequence[float]] | None = None
    rerank: Callable[[str, list[str]], list[tuple[int, float]]] | None = None

    # Tables

    def view(self, revision: int | None = None) -> View:
        """All tables as of a revision, or the last one."""
        return View(self.store.snapshot(revision))

    units = property(lambda self: self.view().units)
    keywords = property(lambda self: self.view().keywords)
    relations = property(lambda self: self.view().relations)
    changes = property(lambda self: self.view().changes)
    embeddings = property(lambda self: self.view().embeddings)

    def _rows(self, name: str, rows: Sequence[dict]) -> DataFrame:
        return local(self.store.spark, schemas.TABLES.get(name, name), rows)

    def _row(self, schema: str, **values) -> DataFrame:
        return local(self.store.spark, schema, [values])

    def _record(self, view: View, uuid: str) -> Record:
        mine = F.col("memory_uuid") == uuid
        units, words, edges, open_ = gather(view.units.where(F.col("uuid") == uuid), view.keywords.where(mine), view.touching(uuid), view.changes.where(mine))
        rows = [[r.asDict() for r in part] for part in (units, words, edges, open_)]
        frames = [self._rows(n, r) for n, r in zip(("units", "keywords", "relations", "changes"), rows, strict=True)]
        return Record(*frames, rows[0][0] if rows[0] else None, rows[3][0] if rows[3] else None, rows[1])

    # Reading

    def list_memories(self) -> DataFrame:
        v = self.view()
        return listing.list_memories(v.units, v.keywords, v.changes)

    def init_memories(self) -> DataFrame:
        return listing.init_read(self.units)

    def category_keywords(self, category: str) -> DataFrame:
        v = self.view()
        return listing.category_keywords(v.units, v.keywords, category)

    def list_changes(self) -> DataFrame:
        v = self.view()
        return listing.open_changes(v.changes, v.units)

    def change(self, uuid: str) -> DataFrame:
        v = self.view()
        return listing.open_changes(v.changes.where(F.col("memory_uuid") == uuid), v.units)

    def change_fields(self, uuid: str) -> DataFrame:
        """field, old, new, parts of each field that a record's open change touches."""
        return listing.change_fields(self.changes.where(F.col("memory_uuid") == uuid))

    def list_trash(self) -> DataFrame:
        v = self.view()
        return listing.trash(v.changes, v.units, self.retention_minutes)

    def read_memory(self, uuid: str, revision: int | None = None) -> DataFrame:
        """A record that isn't in the trash, as it is or as it was at a revision of the store."""
        v = self.view(revision)
        return listing.snapshots(v.units.where((F.col("uuid") == uuid) & (F.col("status") != "trashed")), v.keywords.where(F.col("memory_uuid") == uuid), v.touching(uuid))

    def read_memory_hash(self, uuid: str) -> DataFrame:
        return listing.memory_hashes(self.read_memory(uuid))

    def search_memory(self, request: dict) -> dict:
        """By the kept index and its postings, once build_index or an edit has made them."""
        v = self.view()
        built = v.snapshot.read("search_index")
        built = built if built is not None else index.build_search_index(v.units, v.keywords)
        return search.Retrieval(built, v.embeddings, self.model, self.embed, self.rerank, postings=v.snapshot.read("postings"), grams=v.snapshot.read("grams")).search(request)

    def graph_status(self) -> DataFrame:
        v = self.view()
        return graph.status(v.units, v.relations, v.snapshot.read("graph_meta"))

    def graph_overview(self) -> tuple[DataFrame, DataFrame]:
        v = self.view()
        return graph.overview_nodes(v.units), graph.overview_edges(v.units, v.relations)

    def graph_neighbors(self, uuid: str) -> DataFrame:
        v = self.view()
        return graph.neighbors(v.units, v.relations, uuid)

    def graph_reach(self, uuid: str, depth: int) -> DataFrame:
        """Active records that relations lead to in at most depth steps, with the number of steps."""
        v = self.view()
        return graph.reachable(v.units, v.relations, self._row("uuid string", uuid=uuid), depth)

    def suggest_relations(self, uuid: str) -> DataFrame:
        v = self.view()
        return graph.suggest(v.units, v.keywords, v.relations, uuid)

    def distinct_categories(self) -> DataFrame:
        return self.units.where("category <> ''").select("category").distinct().orderBy("category")

    def backup_memory(self, path: str, profile: str) -> None:
        v = self.view()
        backup.write(v.units, v.keywords, v.relations, path, profile)

    # Editing

    def build_index(self) -> None:
        """The search index and its postings of all records, for a store whose tables were loaded as a whole."""
        v = self.view()
        built = index.build_search_index(v.units, v.keywords)
        self.store.commit(v.snapshot, {"search_index": built, "postings": index.gram_postings(built), "grams": Derived("postings", index.gram_counts)})

    def _editable(self) -> View:
        """The last revision, with an index that edits can follow."""
        v = self.view()
        if v.snapshot.segments("units") and not v.snapshot.segments("postings"):
            self.build_index()
            v = self.view()
        return v

    def _commit(self, view: View, now: datetime, dirty: bool, changes: dict[str, Delta], units: DataFrame | None = None, keywords: DataFrame | None = None) -> None:
        """Commits changes, those of the index that follow from units (with all their keywords), and the mark that the graph is behind."""
        changes = dict(changes)
        if units is not None:
            built = index.build_search_index(units, keywords)
            ids = units.select(F.col("uuid").alias("memory_uuid"))
            changes |= {"units": Delta(units), "search_index": Delta(built), "postings": Delta(index.gram_postings(built), ids)}
        if dirty:
            meta = view.snapshot.read("graph_meta")
            built_at = meta.agg(F.max("revision").alias("r")).first()["r"] if meta is not None else None
            changes["graph_meta"] = self._row(schemas.GRAPH_META, dirty=True, updated_at=now, revision=built_at)
        try:
            self.store.commit(view.snapshot, changes)
        except ConflictError as e:
            raise EditError("STORE_CONFLICT") from e

    def _gone(self, view: View, uuid: str) -> dict[str, Delta]:
        """All rows of a record in all tables."""
        out = {name: Delta(gone=self._row(f"{column} string", **{column: uuid})) for name, column in OWNED.items() if view.snapshot.segments(name)}
        if view.snapshot.segments("relations"):
            out["relations"] = Delta(gone=self._rows("uuid string", [{"uuid": r["uuid"]} for r in view.touching(uuid).select("uuid").collect()]))
        return out

    def _alike(self, view: View, unit: dict) -> DataFrame:
        """The few records that bear one of a record's texts that may be borne once: a scan with these texts pushed down."""
        same = F.lit(False)
        for f in commands.UNIQUE:
            if unit.get(f) is not None:
                same = same | (F.col(f) == unit[f])
        return view.units.where(same)

    def _opened(self, now: datetime, record: Record, uuid: str, action: str, before: str | None, after: str) -> Delta:
        """The record's open change: an earlier one keeps its action and state before."""
        fresh = self._row(schemas.CHANGES, memory_uuid=uuid, action=action, before_state=before, after_state=after, created_at=now, updated_at=now)
        return Delta(commands.upsert_changes(record.changes, fresh))

    def _closed(self, view: View, uuid: str) -> dict[str, Delta]:
        return {"changes": Delta(gone=self._row("memory_uuid string", memory_uuid=uuid))} if view.snapshot.segments("changes") else {}

    def create_memory(self, now: datetime, title: str, content: str, keywords: Sequence[str], category: str | None = None, summary: str | None = None, recall_when: str | None = None, init_authorised: bool = False) -> str:
        """A pending record; its uuid."""
        view = self._editable()
        schema = "command_id string, category string, title string, content string, summary string, keywords array<string>, recall_when string, init_authorised boolean"
        row = self._row(schema, command_id=now.isoformat(), category=category, title=title, content=content, summary=summary, keywords=list(keywords), recall_when=recall_when, init_authorised=init_authorised)
        made = commands.new_units(row, F.lit(now))
        errors, units, words = gather(commands.create_errors(row, self.categories), made, commands.new_keywords(row))
        if code := errors[0]["error_code"]:
            raise EditError(code)
        unit = units[0].asDict()
        if alike := self._alike(view, unit).collect():
            sent = self._row("command_id string, new_title_norm string, new_content string, new_summary string", command_id="1", **{f"new_{f}": unit[f] for f in commands.UNIQUE})
            if field := commands.duplicates(sent, self._rows("units", [r.asDict() for r in alike])).first()["duplicate_field"]:
                raise EditError(f"DUPLICATE_{field.upper()}")
        uuid = unit["uuid"]
        held = self._rows("keywords", [{"memory_uuid": uuid, "keyword_norm": w["keyword_norm"], "weight": None} for w in words])
        record = Record(self._rows("units", [{k: unit[k] for k in unit if k != "command_id"}]), held, self._rows("relations", []), self._rows("changes", []), unit, None, [])
        change = self._opened(now, record, uuid, "create", None, record.state().first()["state"])
        self._commit(view, now, False, {"keywords": Delta(held), "changes": change}, record.units, held)
        return uuid

    def _edit(self, now: datetime, view: View, record: Record, locks: DataFrame | None, result: DataFrame, whole: bool = False) -> None:
        """Commits a record's next state; locks: what the client hasn't seen of it; result: fields by name, revision, error_code, and
        keywords if they change. whole: a full edit, which replaces keywords with their weights.

        Active records are in the graph, which is behind then; after a full edit always.
        """
        if record.unit is None:
            raise EditError("NOT_FOUND")
        errors, rows, old = gather(locks if locks is not None else self._row("error_code string", error_code=None), result, record.state())
        for row in (*errors, *rows):
            if row["error_code"]:
                raise EditError(row["error_code"])
        row, uuid = rows[0], record.unit["uuid"]
        unit = record.unit | {c: row[c] for c in result.columns if c in (*commands.FIELDS, "revision")} | {"updated_at": now}
        after = Record(self._rows("units", [unit]), record.keywords, record.relations, record.changes, unit, record.change, record.words)
        changes: dict[str, Delta] = {}
        if "keywords" in result.columns:
            weights = {} if whole else {w["keyword_norm"]: w["weight"] for w in record.words}
            after.keywords = self._rows("keywords", [{"memory_uuid": uuid, "keyword_norm": w, "weight": weights.get(w)} for w in row["keywords"]])
            changes["keywords"] = Delta(after.keywords, self._row("memory_uuid string", memory_uuid=uuid))
        new, alike = gather(after.state(), self._alike(view, unit if {"title_norm", "content", "summary"}.intersection(result.columns) else {}))
        if any(r["uuid"] != uuid for r in alike):
            asked = self._row("command_id string, uuid string, new_title_norm string, new_content string, new_summary string", command_id="1", uuid=uuid, **{f"new_{f}": unit[f] for f in commands.UNIQUE})
            if field := commands.duplicates(asked, self._rows("units", [r.asDict() for r in alike]), update=True).first()["duplicate_field"]:
                raise EditError(f"DUPLICATE_{field.upper()}")
        changes["changes"] = self._opened(now, record, uuid, "update", old[0]["state"], new[0]["state"])
        self._commit(view, now, whole or unit["status"] == "active", changes, after.units, after.keywords)

    def _live(self, uuid: str, revision: int, fields: dict[str, str] | None = None) -> tuple[View, Record, DataFrame]:
        """The record, and whether it has another revision, or another hash of a field, than the client has seen."""
        view = self._editable()
        record = self._record(view, uuid)
        sent = [{"command_id": str(k), "uuid": uuid, "revision": revision, "field": field or "content", "hash": seen} for k, (field, seen) in enumerate((fields or {"": ""}).items())]
        locks = commands.lock_errors(local(self.store.spark, "command_id string, uuid string, revision long, field string, hash string", sent), record.units)
        return view, record, (locks if fields else locks.where("error_code <> 'HASH_CONFLICT'")).orderBy("command_id")

    def update_memory_replace(self, now: datetime, uuid: str, revision: int, hashes: dict[str, str], **new: str | None) -> None:
        """Fields by name; each needs the hash of what the client has seen. None clears summary and recall_when."""
        if missing := [f for f in new if f not in hashes]:
            raise EditError(f"HASH_MISSING: {', '.join(missing)}")
        view, record, locks = self._live(uuid, revision, hashes)
        names = [f"new_{f}" for f in commands.FIELDS]
        cleared = [f for f in ("summary", "recall_when") if f in new and new[f] is None]
        row = self._row("uuid string, cleared array<string>, " + ", ".join(f"{n} string" for n in names), uuid=uuid, cleared=cleared, **{n: new.get(n[4:]) for n in names})
        self._edit(now, view, record, locks, commands.replace_fields(row, record.units, self.categories))

    def edit_memory(self, now: datetime, uuid: str, revision: int, title: str, content: str, keywords: Sequence[str], summary: str | None = None, recall_when: str | None = None) -> None:
        """All fields and keywords of an active record at once; None clears."""
        schema = "uuid string, expected_revision long, new_title string, new_summary string, new_recall_when string, new_content string, new_keywords array<string>"
        row = self._row(schema, uuid=uuid, expected_revision=revision, new_title=title, new_summary=summary, new_recall_when=recall_when, new_content=content, new_keywords=list(keywords))
        view = self._editable()
        record = self._record(view, uuid)
        self._edit(now, view, record, None, commands.full_edit(row, record.units, record.keywords), whole=True)

    def update_memory_patch_content(self, now: datetime, uuid: str, revision: int, match: str, replacement: str) -> None:
        view, record, locks = self._live(uuid, revision)
        self._edit(now, view, record, locks, commands.patch_content(self._row("uuid string, match string, replacement string", uuid=uuid, match=match, replacement=replacement), record.units))

    def update_memory_append(self, now: datetime, uuid: str, revision: int, content: str | None = None, recall_when: str | None = None) -> None:
        view, record, locks = self._live(uuid, revision)
        row = self._row("uuid string, append_content string, append_recall_when string", uuid=uuid, append_content=content, append_recall_when=recall_when)
        self._edit(now, view, record, locks, commands.append_text(row, record.units))

    def _change_keywords(self, now: datetime, uuid: str, revision: int, words: Sequence[str], add: bool) -> None:
        view, record, locks = self._live(uuid, revision)
        self._edit(now, view, record, locks, commands.change_keywords(self._row("uuid string, words array<string>", uuid=uuid, words=list(words)), record.units, record.keywords, add))

    def update_memory_add_keywords(self, now: datetime, uuid: str, revision: int, words: Sequence[str]) -> None:
        self._change_keywords(now, uuid, revision, words, True)

    def update_memory_remove_keywords(self, now: datetime, uuid: str, revision: int, words: Sequence[str]) -> None:
        self._change_keywords(now, uuid, revision, words, False)

    # Relations

    def _relate(self, now: datetime, view: View, source: str, target: str, changed: Delta) -> None:
        """Commits a relation that changes with the record it starts from: that one's change stays open, both ends' revisions go up."""
        record = self._record(view, source)
        ends = view.units.where(F.col("uuid").isin(source, target)).collect()
        units = self._rows("units", [r.asDict() | {"revision": r["revision"] + 1, "updated_at": now} for r in ends])
        gone = [d for d in (changed.rows, changed.gone) if d is not None][0].select("uuid")
        edges = record.relations.join(gone, "uuid", "left_anti")
        edges = edges.unionByName(changed.rows) if changed.rows is not None else edges
        after = Record(units.where(F.col("uuid") == source), record.keywords, edges, record.changes, None, record.change, record.words)
        old, new = (part[0]["state"] for part in gather(record.state(), after.state()))
        # Revisions aren't in the index.
        self._commit(view, now, True, {"units": Delta(units), "relations": changed, "changes": self._opened(now, record, source, "update", old, new)})

    def add_relation(self, now: datetime, source: str, target: str, kind: str, weight: int | None = None, note: str | None = None) -> str:
        view = self._editable()
        row = self._row("command_id string, from_memory_uuid string, to_memory_uuid string, relation_type string, weight int", command_id="1", from_memory_uuid=source, to_memory_uuid=target, relation_type=kind, weight=weight)
        ends = view.units.where(F.col("uuid").isin(source, target))
        if code := graph.add_errors(row, ends, view.touching(source)).first()["error_code"]:
            raise EditError(code)
        uuid = hashlib.sha256(f"{source}|{target}|{kind}|{now.isoformat()}".encode()).hexdigest()
        made = self._row(schemas.RELATIONS, uuid=uuid, from_memory_uuid=source, to_memory_uuid=target, relation_type=kind, weight=weight, note=(note or "").strip() or None, created_at=now)
        self._relate(now, view, source, target, Delta(made))
        return uuid

    def _relation(self, view: View, uuid: str) -> dict:
        row = view.relations.where(F.col("uuid") == uuid).first()
        if row is None:
            raise EditError("NOT_FOUND")
        return row.asDict()

    def patch_relation(self, now: datetime, uuid: str, kind: str | None = None, weight: int | None = None, note: str | None = None) -> None:
        """None keeps; an empty note clears it. A pair has a relation of a kind once."""
        view = self._editable()
        patch = self._row("uuid string, new_type string, new_weight int, new_note string", uuid=uuid, new_type=kind, new_weight=weight, new_note=note)
        found = view.relations.where(F.col("uuid") == uuid).first()
        ends = view.touching(found["from_memory_uuid"]) if found else self._rows("relations", [])
        if code := graph.patch_errors(patch, ends).first()["error_code"]:
            raise EditError(code)
        one = self._rows("relations", [found.asDict()])
        self._relate(now, view, found["from_memory_uuid"], found["to_memory_uuid"], Delta(graph.patch_relations(one, patch)))

    def delete_relation(self, now: datetime, uuid: str) -> None:
        view = self._editable()
        found = self._relation(view, uuid)
        self._relate(now, view, found["from_memory_uuid"], found["to_memory_uuid"], Delta(gone=self._row("uuid string", uuid=uuid)))

    def rebuild_graph(self, now: datetime) -> bool:
        """Brings the graph's vertices and edges up to date if edits came after the last time, once for all of them; whether it did.

        Only what touches records and relations that changed since is made
        anew, unless the store can't tell these any more.
        """
        view = self.view()
        if not self.graph_status().first()["dirty"]:
            return False
        snap = view.snapshot
        meta = snap.read("graph_meta")
        since = meta.agg(F.max("revision").alias("r")).first()["r"] if meta is not None else None
        units = snap.changed("units", since) if since is not None else None
        edges = snap.changed("relations", since) if since is not None else None
        done = self._row(schemas.GRAPH_META, dirty=False, updated_at=now, revision=snap.revision)
        if units is None or edges is None or not snap.segments("graph_edges"):
            changes = {"graph_vertices": graph.vertices(view.units), "graph_edges": graph.edges(view.units, view.relations)}
        else:
            vertices, around = graph.refresh(view.units, view.relations, snap.read("graph_edges"), units, edges)
            changes = {"graph_vertices": Delta(vertices, units.select("uuid")), "graph_edges": Delta(*around)}
        self.store.commit(snap, changes | {"graph_meta": done})
        return True

    # Trash and review

    def delete_memory(self, now: datetime, uuid: str, revision: int) -> str:
        """Moves a record to the trash; which case it was."""
        view = self._editable()
        record = self._record(view, uuid)
        cases = commands.classify_deletes(self._row("uuid string, revision long", uuid=uuid, revision=revision), record.units, record.changes)
        case = cases.first()["case"]
        if case.isupper():
            raise EditError(case)
        if case == "already_deleted":
            return case
        row = commands.apply_deletes(cases, record.units, F.lit(now)).first()
        unit = record.unit | {"status": "trashed", "trashed_at": row["trashed_at"], "revision": row["revision"], "updated_at": now}
        after = Record(self._rows("units", [unit]), record.keywords, record.relations, record.changes, unit, record.change, record.words)
        old, new = (part[0]["state"] for part in gather(record.state(), after.state()))
        before = record.change["before_state"] if case == "delete_changed" else old
        change = Delta(self._row(schemas.CHANGES, memory_uuid=uuid, action="delete", before_state=before, after_state=new, created_at=now, updated_at=now))
        self._commit(view, now, row["dirty"], {"changes": change}, after.units, after.keywords)
        return case

    def approve(self, now: datetime, uuid: str) -> None:
        """Ends a record's open change; a creation becomes active and gets relations to its category's nearest.

        If there is a provider, an embedding is requested (see embed_pending), not waited for.
        """
        view = self._editable()
        record = self._record(view, uuid)
        row = review.approve(record.changes, record.units).first()
        if row is None:
            raise EditError("NOT_FOUND")
        if row["removed"]:
            self._commit(view, now, True, self._gone(view, uuid))
            return
        changes = self._closed(view, uuid)
        if self.embed:
            changes["embedding_requests"] = Delta(self._row(schemas.EMBEDDING_REQUESTS, memory_uuid=uuid, attempts=0, error=None, requested_at=now))
        if row["action"] != "create":
            self._commit(view, now, row["dirty"], changes)
            return
        unit = record.unit | {"status": row["next_status"], "revision": row["revision"], "updated_at": now}
        units = self._rows("units", [unit])
        words = [w["keyword_norm"] for w in record.words]
        found = graph.relate_one(view.units, view.keywords, record.relations, uuid, unit["category"], words).collect()
        ids = lambda r: hashlib.sha256("|".join((r["from_memory_uuid"], r["to_memory_uuid"], r["relation_type"])).encode()).hexdigest()
        if found:
            changes["relations"] = Delta(self._rows("relations", [r.asDict() | {"uuid": ids(r), "created_at": now} for r in found]))
        self._commit(view, now, row["dirty"], changes, units, record.keywords)

    def _back(self, now: datetime, view: View, uuid: str, unit: dict, record: Record, changes: dict[str, Delta]) -> None:
        """Commits a record with the keywords and relations of the state before its open change."""
        words, edges = gather(review.restored_keywords(record.changes), review.restored_relations(record.changes))
        keywords = self._rows("keywords", [r.asDict() for r in words])
        old = [{"uuid": r["uuid"]} for r in record.relations.collect()]
        back = self._rows("relations", [r.asDict() | {"created_at": now} for r in edges])
        changes = changes | {"keywords": Delta(keywords, self._row("memory_uuid string", memory_uuid=uuid))}
        if old or edges:
            changes["relations"] = Delta(back, self._rows("uuid string", old))
        self._commit(view, now, True, changes, self._rows("units", [unit]), keywords)

    def restore(self, now: datetime, uuid: str) -> None:
        """Takes a record out of the trash as it was before: live again without an open change, or an open creation again."""
        view = self._editable()
        record = self._record(view, uuid)
        row = review.restore(record.changes.where("action = 'delete'"), record.units).first()
        if row is None:
            raise EditError("NOT_FOUND")
        if row["error_code"]:
            raise EditError(row["error_code"])
        unit = record.unit | {f: row[f] for f in (*review.RESTORED, "revision", "trashed_at")} | {"status": row["next_status"], "updated_at": now}
        changes = self._closed(view, uuid)
        if row["open_action"]:
            changes = {"changes": Delta(self._row(schemas.CHANGES, memory_uuid=uuid, action=row["open_action"], before_state=None, after_state=row["after_state"], created_at=record.change["created_at"], updated_at=now))}
        self._back(now, view, uuid, unit, record, changes)

    def reject(self, now: datetime, uuid: str) -> None:
        """Takes a creation back; gives other records their state before the open change."""
        view = self._editable()
        record = self._record(view, uuid)
        row = review.reject(record.changes, record.units).first()
        if row is None:
            raise EditError("NOT_FOUND")
        if row["removed"]:
            self._commit(view, now, True, self._gone(view, uuid))
            return
        self._back(now, view, uuid, record.unit | {f: row[f] for f in (*review.RESTORED, "revision")} | {"updated_at": now}, record, self._closed(view, uuid))

    def delete_forever(self, now: datetime, uuid: str) -> None:
        """Deletes a record in the trash, and its rows in all tables."""
        view = self._editable()
        record = self._record(view, uuid)
        if code := review.delete_from_trash(self._row("uuid string", uuid=uuid), record.changes, record.units).first()["error_code"]:
            raise EditError(code)
        self._commit(view, now, True, self._gone(view, uuid))

    def import_memory(self, now: datetime, path: str) -> int:
        """Adds the records of a backup with their ids and revisions; how many. All must be importable, and none be there."""
        view = self._editable()
        rows = backup.read(self.store.spark, path)
        made = backup.imported_units(rows).withColumn("created_at", F.lit(now)).withColumn("updated_at", F.col("created_at"))
        if not made.join(view.units.select("uuid"), "uuid", "left_semi").isEmpty() or not made.groupBy("uuid").count().where("count > 1").isEmpty():
            raise EditError("MEMORY_EXISTS")
        keywords = backup.imported_keywords(rows)
        self._commit(view, now, True, {"keywords": Delta(keywords)}, made, keywords)
        return made.count()

    def embed_pending(self) -> int:
        """Makes the embeddings that approvals have requested; how many. See streaming.embedding.refresh."""
        one = self.embed
        return embedding.refresh(self.store, lambda texts: [one(t) for t in texts], self.model)
