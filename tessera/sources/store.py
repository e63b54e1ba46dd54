"""A store's tables as Parquet: a sorted base, and small deltas that are merged when they are read.

A commit writes the rows that it replaces, and the keys of those that go, as
one delta a table, and then one small file that lists what each table
consists of by then. So an edit costs what it changes, all tables of a commit
become visible together, and each revision that isn't vacuumed can still be
read. Two commits on one revision can't both be: the file of the next one is
there already when the second comes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import file_system, materialize, release, write_small

#: What a row belongs to: a delta replaces all earlier rows of the same key. Other tables have no deltas.
KEYS = {
    "units": ("uuid",), "keywords": ("memory_uuid",), "relations": ("uuid",), "changes": ("memory_uuid",), "embeddings": ("memory_uuid",), "usage": ("memory_uuid",),
    "search_index": ("memory_uuid",), "postings": ("memory_uuid",), "graph_vertices": ("uuid",), "graph_edges": ("relation_uuid",), "embedding_requests": ("memory_uuid",),
}
#: How a base is sorted, where not by its key, so that readers skip row groups.
SORTED = {"postings": ("gram", "field", "size"), "graph_edges": ("from_memory_uuid",)}
#: Tables whose rows cost much to make. Sorting takes a base's rows twice, first to find its ranges, so these are written before.
COSTLY = {"postings"}
#: Deltas of a table that are merged into one, share of the base's rows at which deltas go into it, rows of deltas up to
#: which their keys are broadcast to the base.
DELTAS, SHARE, BROADCAST = 8, 0.25, 500_000
REVISION, GONE = "_revision", "_gone"
#: Small jobs, which needn't wait for each other, run in these threads.
_POOL = ThreadPoolExecutor(16)


def side_by_side[A, B](work: Callable[[A], B], items: Iterable[A]) -> list[B]:
    return list(_POOL.map(work, items))


class ConflictError(ValueError):
    """Another commit came first; what this one was based on isn't the last revision."""


class Delta:
    """rows that replace those of their keys, and keys whose rows go."""

    def __init__(self, rows: DataFrame | None = None, gone: DataFrame | None = None):
        self.rows, self.gone = rows, gone


@dataclass(frozen=True)
class Derived:
    """A whole table that is made of another one of the same commit, from its rows as they are written there."""

    source: str
    make: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Snapshot:
    """All tables as of one revision."""

    spark: SparkSession
    revision: int
    tables: dict = field(default_factory=dict)
    marks: dict = field(default_factory=dict)
    held: dict = field(default_factory=dict, compare=False, repr=False)

    def _parquet(self, name: str, segments: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(self.tables[name]["schema"])
        return self.spark.read.schema(T.StructType([*schema, T.StructField(REVISION, T.LongType()), T.StructField(GONE, T.BooleanType())])).parquet(*(s["path"] for s in segments))

    def segments(self, name: str) -> list[dict]:
        return self.tables.get(name, {}).get("segments", [])

    def changed(self, name: str, since: int) -> DataFrame | None:
        """Keys of which rows came or went after a revision; None if that isn't known, since the base is younger."""
        segments = self.segments(name)
        if any(s["base"] and s["revision"] > since for s in segments):
            return None
        late = [s for s in segments if s["revision"] > since]
        if not late:
            return self.spark.createDataFrame([], T.StructType([f for f in T.StructType.fromJson(self.tables[name]["schema"]) if f.name in KEYS[name]])) if segments else None
        return self._parquet(name, late).where(F.col(REVISION) > since).select(*KEYS[name]).distinct()

    def latest(self, name: str, deltas: list[dict]) -> DataFrame:
        """The last rows of each key in these deltas, and the marks of those that are gone."""
        rows = self._parquet(name, deltas)
        if len(deltas) == 1:
            return rows
        last = F.max(REVISION).over(Window.partitionBy(*KEYS[name]))
        return rows.withColumn("_last", last).where(F.col(REVISION) == F.col("_last")).drop("_last")

    def read(self, name: str) -> DataFrame | None:
        """A table's rows: those of the base whose key no delta has, and the deltas' last ones."""
        if name not in self.held:
            self.held[name] = self._read(name)
        return self.held[name]

    def _read(self, name: str) -> DataFrame | None:
        segments = self.segments(name)
        if not segments:
            return None
        columns = [f["name"] for f in self.tables[name]["schema"]["fields"]]
        base, deltas = [s for s in segments if s["base"]], [s for s in segments if not s["base"]]
        if not deltas:
            return self._parquet(name, base).select(*columns)
        fresh = self.latest(name, deltas).where(~F.col(GONE)).select(*columns)
        if not base:
            return fresh
        keys = self._parquet(name, deltas).select(*KEYS[name]).distinct()
        if sum(s["rows"] for s in deltas) <= BROADCAST:
            keys = F.broadcast(keys)
        return self._parquet(name, base).select(*columns).join(keys, list(KEYS[name]), "left_anti").select(*columns).unionByName(fresh)


@dataclass(frozen=True)
class Store:
    """root may be any path that Spark writes to; a profile is a root of its own."""

    spark: SparkSession
    root: str

    # The list of commits

    @cached_property
    def _log(self) -> str:
        return f"{self.root.rstrip('/')}/_log"

    def _fs(self, path: str):
        return file_system(self.spark, path)

    def _files(self, path: str) -> list[str]:
        place, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def revisions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._files(self._log) if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def snapshot(self, revision: int | None = None) -> Snapshot:
        """The tables as of a revision, or the last one; an empty one before the first commit."""
        known = self.revisions()
        if revision is None:
            if not known:
                return Snapshot(self.spark, 0)
            revision = known[-1]
        elif revision not in known:
            raise ValueError(f"no revision {revision}")
        place, fs = self._fs(f"{self._log}/{revision:012d}.json")
        stream = fs.open(place)
        try:
            told = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(self.spark, revision, told["tables"], told["marks"])

    def _publish(self, revision: int, tables: dict, marks: dict) -> None:
        """Writes a commit's file beside its place and moves it there, which fails if there is one."""
        jvm = self.spark.sparkContext._jvm
        draft, fs = self._fs(f"{self._log}/draft-{uuid.uuid4().hex}")
        write_small(self.spark, draft.toString(), json.dumps({"tables": tables, "marks": marks}))
        final, _ = self._fs(f"{self._log}/{revision:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"revision {revision} is there already") from e
            raise

    # Reading and writing

    def read(self, name: str, revision: int | None = None) -> DataFrame | None:
        return self.snapshot(revision).read(name)

    def _written(self, name: str, rows: DataFrame, revision: int, base: bool) -> dict:
        path, seen = f"{self.root.rstrip('/')}/{name}/{'base' if base else 'delta'}-{revision:012d}-{uuid.uuid4().hex[:8]}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        return {"path": path, "rows": seen.get["rows"], "base": base, "revision": revision}

    def _base(self, name: str, rows: DataFrame, revision: int) -> dict:
        order = SORTED.get(name, KEYS.get(name))
        made = rows = materialize(rows) if name in COSTLY else rows
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        done = self._written(name, rows.withColumn(REVISION, F.lit(revision).cast("long")).withColumn(GONE, F.lit(False)), revision, True)
        if name in COSTLY:
            release(made)
        return done

    def _delta(self, name: str, change: Delta, schema: T.StructType, revision: int) -> dict:
        rows = None
        for part, gone in ((change.rows, False), (change.gone, True)):
            if part is not None:
                own = part.select(*((F.col(f.name) if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), F.lit(revision).cast("long").alias(REVISION), F.lit(gone).alias(GONE))
                rows = own if rows is None else rows.unionByName(own)
        return self._written(name, rows, revision, False)

    def commit(self, seen: Snapshot, changes: dict[str, Delta | DataFrame | Derived], mark: tuple[str, int] | None = None) -> int:
        """All changes at once as the revision after seen, which it returns: deltas, or whole tables by name, which may be made of others.

        ConflictError if another commit came meanwhile. mark: a stream and its epoch; a commit whose mark is there already, or
        that changes nothing, is left out.
        """
        if not changes or mark and seen.marks.get(mark[0], -1) >= mark[1]:
            return seen.revision
        revision = seen.revision + 1

        def put(item: tuple[str, Delta | DataFrame]) -> tuple[str, dict]:
            name, change = item
            if isinstance(change, DataFrame):
                return name, {"schema": json.loads(change.schema.json()), "segments": [self._base(name, change, revision)]}
            known = seen.tables.get(name)
            if known is None and change.rows is None:
                return name, {}
            schema = T.StructType.fromJson(known["schema"]) if known else change.rows.schema
            return name, {"schema": json.loads(schema.json()), "segments": [*seen.segments(name), self._delta(name, change, schema, revision)]}

        own = {name: change for name, change in changes.items() if not isinstance(change, Derived)}
        made = {name: table for name, table in side_by_side(put, own.items()) if table}
        written = Snapshot(self.spark, revision, seen.tables | made, seen.marks)
        made |= side_by_side(put, ((name, change.make(written.read(change.source))) for name, change in changes.items() if isinstance(change, Derived)))
        self._publish(revision, seen.tables | made, seen.marks | (dict([mark]) if mark else {}))
        self._tidy(Snapshot(self.spark, revision, seen.tables | made, seen.marks))
        return revision

    def retry(self, build: Callable[[Snapshot], dict[str, Delta | DataFrame]], mark: tuple[str, int] | None = None, times: int = 10) -> int:
        """Commits what build makes of the last revision, anew if another commit comes meanwhile."""
        while True:
            seen, times = self.snapshot(), times - 1
            if mark and seen.marks.get(mark[0], -1) >= mark[1]:
                return seen.revision
            try:
                return self.commit(seen, build(seen), mark)
            except ConflictError:
                if times <= 0:
                    raise

    def write(self, name: str, rows: DataFrame) -> None:
        self.write_all({name: rows})

    def write_all(self, tables: dict[str, DataFrame | Derived]) -> None:
        """Whole tables as they are to be from now on."""
        self.commit(self.snapshot(), tables)

    # Upkeep

    def _tidy(self, now: Snapshot) -> None:
        """Compacts tables of which a read would merge too much; another commit may forestall it."""
        due = [name for name in now.tables if sum(not s["base"] for s in now.segments(name)) >= DELTAS]
        if due:
            try:
                self.compact(*due)
            except ConflictError:
                return

    def compact(self, *names: str, whole: bool = False) -> None:
        """Merges the deltas of tables: into the base if whole, or if they have a share of its rows, else into one delta.

        So a base is rewritten only after edits of a fixed share of it. What tables hold doesn't change.
        """
        now = self.snapshot()

        def merged(name: str) -> tuple[str, dict]:
            base, deltas = ([s for s in now.segments(name) if s["base"] is b] for b in (True, False))
            if not deltas:
                return name, now.tables[name]
            if whole or not base or sum(s["rows"] for s in deltas) >= SHARE * sum(s["rows"] for s in base):
                made = [self._base(name, now.read(name), now.revision + 1)]
            else:
                made = [*base, self._written(name, now.latest(name, deltas), now.revision + 1, False)]
            return name, now.tables[name] | {"segments": made}

        self._publish(now.revision + 1, now.tables | dict(side_by_side(merged, names)), now.marks)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that none of the last keep revisions needs, and the lists of the others; how many folders.

        Readers of older revisions, and commits that are under way, lose what they read or wrote: run it alone.
        """
        known = self.revisions()
        last = [self.snapshot(r) for r in known[-keep:]]
        needed = {s["path"].rsplit("/", 1)[1] for snap in last for name in snap.tables for s in snap.segments(name)}
        n = 0
        for name in {t for snap in last for t in snap.tables} | {f for f in self._files(self.root) if not f.startswith("_")}:
            for found in self._files(f"{self.root.rstrip('/')}/{name}"):
                if re.match(r"(base|delta)-", found) and found not in needed:
                    place, fs = self._fs(f"{self.root.rstrip('/')}/{name}/{found}")
                    fs.delete(place, True)
                    n += 1
        for r in known[:-keep]:
            place, fs = self._fs(f"{self._log}/{r:012d}.json")
            fs.delete(place, False)
        return n
