"""Relations between records: neighbours, overview, suggestions, and the graph projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import RELATION_TYPES
from ..sources.shared import materialize, release

#: Suggestions for a record at most; weight of one without shared keywords.
TOP, LONE_WEIGHT = 3, 40


def active(units: DataFrame) -> DataFrame:
    return units.where("status = 'active'")


def both_active(relations: DataFrame, units: DataFrame) -> DataFrame:
    ids = active(units).select("uuid")
    return relations.join(ids.withColumnRenamed("uuid", "from_memory_uuid"), "from_memory_uuid", "left_semi").join(ids.withColumnRenamed("uuid", "to_memory_uuid"), "to_memory_uuid", "left_semi")


def neighbors(units: DataFrame, relations: DataFrame, uuid) -> DataFrame:
    """Edges of an active record, newest first, with the record at the other end, null unless that is active.

    Outgoing and incoming edges are two equality filters, not one OR.
    """
    one = active(units).where(F.col("uuid") == uuid).select(F.col("uuid").alias("self"))
    edge = lambda way, own, other: relations.where(F.col(own) == uuid).select(F.lit(way).alias("direction"), F.col("uuid").alias("relation_uuid"), F.col(own).alias("self"), F.col(other).alias("other"), "relation_type", "weight", "note", "created_at")
    edges = edge("out", "from_memory_uuid", "to_memory_uuid").union(edge("in", "to_memory_uuid", "from_memory_uuid")).join(one, "self", "left_semi")
    ends = active(units).select(F.col("uuid").alias("other"), F.col("uuid").alias("memory_uuid"), "title_norm", "status")
    return edges.join(ends, "other", "left").select("relation_uuid", "direction", "relation_type", "weight", "note", "created_at", "memory_uuid", "title_norm").orderBy(F.desc("created_at"), "relation_uuid")


def overview_nodes(units: DataFrame, limit: int = 100) -> DataFrame:
    return active(units).orderBy(F.desc("updated_at"), "uuid").limit(limit).select("uuid", "category", "title_norm", "status", "summary", "updated_at")


def overview_edges(units: DataFrame, relations: DataFrame, limit: int = 100) -> DataFrame:
    """Edges with both ends among the overview's nodes, newest first."""
    nodes = F.broadcast(overview_nodes(units, limit).select("uuid"))  # limit rows
    rows = relations.join(nodes.withColumnRenamed("uuid", "from_memory_uuid"), "from_memory_uuid", "left_semi").join(nodes.withColumnRenamed("uuid", "to_memory_uuid"), "to_memory_uuid", "left_semi")
    return rows.select("uuid", "from_memory_uuid", "to_memory_uuid", "relation_type", "weight", "note", "created_at").orderBy(F.desc("created_at"), "uuid")


def _weight(shared: Column) -> Column:
    return F.least(F.lit(100), 50 + 10 * shared).cast("int")


def _related(relations: DataFrame) -> DataFrame:
    """Pairs that are related_to each other, in both directions."""
    own = relations.where("relation_type = 'related_to'").select(F.col("from_memory_uuid").alias("a"), F.col("to_memory_uuid").alias("b"))
    return own.union(own.select("b", "a")).distinct()


def suggest(units: DataFrame, keywords: DataFrame, relations: DataFrame, uuid, top: int = TOP) -> DataFrame:
    """Active records that share most keywords with one and aren't related_to it yet."""
    own = keywords.where(F.col("memory_uuid") == uuid).select("keyword_norm")
    shared = keywords.where(F.col("memory_uuid") != uuid).join(own, "keyword_norm").groupBy("memory_uuid").agg(F.count("*").alias("shared"))
    known = _related(relations).where(F.col("a") == uuid).select(F.col("b").alias("memory_uuid"))
    rows = active(units).select(F.col("uuid").alias("memory_uuid"), "title_norm", "category").join(shared, "memory_uuid").join(known, "memory_uuid", "left_anti")
    rows = rows.orderBy(F.desc("shared"), "title_norm", "memory_uuid").limit(top)
    return rows.select("memory_uuid", "title_norm", "category", "shared", _weight(F.col("shared")).alias("weight"), F.concat(F.lit("shared_keywords="), F.col("shared").cast("string")).alias("note"))


def _edges(rows: DataFrame) -> DataFrame:
    """New related_to edges from source, target and the number of keywords that both bear."""
    return rows.select(
        F.col("source").alias("from_memory_uuid"), F.col("target").alias("to_memory_uuid"), F.lit("related_to").alias("relation_type"),
        F.when(F.col("shared") == 0, F.lit(LONE_WEIGHT)).otherwise(_weight(F.col("shared"))).alias("weight"),
        F.when(F.col("shared") == 0, F.lit("auto: same_category")).otherwise(F.concat(F.lit("auto: shared_keywords="), F.col("shared").cast("string"))).alias("note"),
    )


def relate_one(units: DataFrame, keywords: DataFrame, relations: DataFrame, uuid, category: str, words: list[str], top: int = TOP) -> DataFrame:
    """auto_relations for one record that bears words, whatever its status is: a pass over its category's ids, and a few rows kept.

    relations: those that touch it.
    """
    shared = keywords.where(F.col("keyword_norm").isin(words)).groupBy(F.col("memory_uuid").alias("target")).agg(F.count_distinct("keyword_norm").alias("shared"))
    known = _related(relations).where(F.col("a") == uuid).select(F.col("b").alias("target"))
    rows = active(units).where((F.col("category") == category) & (F.col("uuid") != uuid)).select(F.col("uuid").alias("target"))
    rows = rows.join(known, "target", "left_anti").join(shared, "target", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return _edges(rows.orderBy(F.desc("shared"), "target").limit(top).withColumn("source", F.lit(uuid)))


#: Records of a category that bear a keyword, from which on it is common; common keywords of a record at most (its most
#: frequent ones); relations of a record from which on it is held against its whole category; such records that are broadcast.
COMMON, HELD, RELATED, BROADCAST = 64, 8, 60, 10_000


def subsets(values: Column) -> Column:
    """All subsets of an array without repeats, each in the array's order."""
    empty = F.array(F.array().cast("array<string>"))
    return F.aggregate(values, empty, lambda made, x: F.concat(made, F.transform(made, lambda s: F.concat(s, F.array(x)))))


def auto_relations(units: DataFrame, keywords: DataFrame, relations: DataFrame, sources: DataFrame, top: int = TOP, common: int = COMMON, held: int = HELD, related: int = RELATED) -> DataFrame:
    """New related_to edges for each of sources (uuid): to the active records of its category that share most keywords.

    Ties go to the least id; records without shared keywords fill up. Exact, and no category's records are held against
    each other:

    - Records that share a rare keyword meet by it; it has at most common bearers.
    - What is shared in common keywords is some subset of a record's. Of the bearers of a subset the least ids suffice, as
      many as are wanted, so these lists are short, and a source looks up those of its own subsets.
    - Only the held most frequent common keywords of a record make subsets; by its others it meets all their bearers.
    - A source with more than related relations, which would make all lists longer, is held against its category.
    """
    records = active(units).select("uuid", "category")
    borne = records.join(keywords.select(F.col("memory_uuid").alias("uuid"), "keyword_norm").distinct(), "uuid")
    counts = borne.groupBy("category", "keyword_norm").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("n"), "keyword_norm"))  # a record's keywords
    told = borne.join(counts, ["category", "keyword_norm"]).withColumn("is_common", (F.col("n") > common) & (place <= held))
    words = lambda only: F.coalesce(F.array_sort(F.collect_list(only)), F.array().cast("array<string>"))
    sets = told.groupBy("uuid").agg(words(F.when(F.col("is_common"), F.col("keyword_norm"))).alias("held"), words(F.col("keyword_norm")).alias("all"))
    none = F.array().cast("array<string>")
    sets = materialize(records.join(sets, "uuid", "left").select("uuid", "category", F.coalesce("held", none).alias("held"), F.coalesce("all", none).alias("all")))
    told = materialize(told.select("uuid", "category", "keyword_norm", "n", "is_common"))

    known = _related(relations).select(F.col("a").alias("source"), F.col("b").alias("target"))
    asked = sources.select(F.col("uuid").alias("source")).distinct()
    degree = known.join(asked, "source", "left_semi").groupBy("source").agg(F.count("*").alias("known"))
    from_ = materialize(asked.join(sets.withColumnRenamed("uuid", "source"), "source").join(degree, "source", "left").withColumn("known", F.coalesce("known", F.lit(0))))
    some = from_.where(F.col("known") <= related)
    many = from_.where(F.col("known") > related)

    mine = told.withColumnRenamed("uuid", "source").join(some.select("source"), "source", "left_semi")
    theirs = told.select("category", "keyword_norm", F.col("uuid").alias("target"), F.col("is_common").alias("common_there"), "n")
    met = mine.where("not is_common").drop("n").join(theirs.drop("n"), ["category", "keyword_norm"]).select("source", "target")
    # A keyword that is common for the source, but not among the target's most frequent ones.
    beyond = theirs.where((F.col("n") > common) & ~F.col("common_there")).drop("n", "common_there")
    met = met.union(mine.where("is_common").drop("n").join(beyond, ["category", "keyword_norm"]).select("source", "target"))
    pairs = met.where("source <> target").distinct().join(some.select("source", F.col("all").alias("own")), "source")
    near = pairs.join(sets.select(F.col("uuid").alias("target"), "all"), "target").select("source", "target", F.size(F.array_intersect("own", "all")).cast("long").alias("shared"))

    # Whatever is left out below, itself and what it is related to already, leaves top records.
    reach = top + 1 + (some.agg(F.max("known").alias("n")).first()["n"] or 0)
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("target")) <= reach
    bearers = sets.select("category", "held", F.col("uuid").alias("target"))
    bearers = bearers.withColumn("first", first("category", "held")).where("first").select("category", F.explode(subsets(F.col("held"))).alias("part"), "target")
    lists = bearers.withColumn("first", first("category", "part")).where("first").drop("first")
    looked = some.select("category", "held").distinct().select("category", "held", F.explode(subsets(F.col("held"))).alias("part"))
    offered = looked.join(lists, ["category", "part"]).groupBy("category", "held", "target").agg(F.max(F.size("part")).cast("long").alias("shared"))
    best = Window.partitionBy("category", "held").orderBy(F.desc("shared"), "target")
    offered = offered.withColumn("place", F.row_number().over(best)).where(F.col("place") <= reach)
    far = some.join(offered, ["category", "held"]).where("source <> target").select("source", "target", "shared")

    hubs = many.select("source", "category", F.col("all").alias("own"))
    if (n := many.count()) <= BROADCAST:
        hubs = F.broadcast(hubs)
    whole = sets.select(F.col("uuid").alias("target"), "category", "all").join(hubs, "category").where("source <> target").select("source", "target", F.size(F.array_intersect("own", "all")).cast("long").alias("shared"))

    found = near.union(far).groupBy("source", "target").agg(F.max("shared").alias("shared"))
    found = (found.union(whole) if n else found).join(known, ["source", "target"], "left_anti")
    order = Window.partitionBy("source").orderBy(F.desc("shared"), "target")
    return _edges(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top))


def add_errors(commands: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """commands (command_id, from_memory_uuid, to_memory_uuid, relation_type, weight) with the first rule each breaks, or null."""
    ids = active(units).select("uuid")
    rows = commands.join(ids.select(F.col("uuid").alias("from_memory_uuid"), F.lit(True).alias("from_ok")), "from_memory_uuid", "left")
    rows = rows.join(ids.select(F.col("uuid").alias("to_memory_uuid"), F.lit(True).alias("to_ok")), "to_memory_uuid", "left")
    there = relations.select("from_memory_uuid", "to_memory_uuid", "relation_type", F.lit(True).alias("there")).distinct()
    rows = rows.join(there, ["from_memory_uuid", "to_memory_uuid", "relation_type"], "left")
    code = (
        F.when(~F.col("relation_type").isin(*RELATION_TYPES), "INVALID_TYPE")
        .when((F.col("weight") < 0) | (F.col("weight") > 100), "INVALID_WEIGHT")
        .when(F.col("from_memory_uuid") == F.col("to_memory_uuid"), "SAME_MEMORY")
        .when(F.col("from_ok").isNull() | F.col("to_ok").isNull(), "NOT_ACTIVE")
        .when(F.col("there").isNotNull(), "RELATION_EXISTS")
    )
    return rows.select("command_id", "from_memory_uuid", "to_memory_uuid", "relation_type", "weight", code.alias("error_code"))


def patch_errors(patches: DataFrame, relations: DataFrame) -> DataFrame:
    """patches (uuid, new_type, new_weight, new_note) with the first rule each breaks, or null; a pair has a relation of a kind once."""
    rows = patches.join(relations.select("uuid", "from_memory_uuid", "to_memory_uuid", "relation_type"), "uuid", "left")
    others = relations.select(F.col("uuid").alias("other"), "from_memory_uuid", "to_memory_uuid", F.col("relation_type").alias("new_type"))
    rows = rows.join(others.groupBy("from_memory_uuid", "to_memory_uuid", "new_type").agg(F.min("other").alias("first"), F.max("other").alias("last")), ["from_memory_uuid", "to_memory_uuid", "new_type"], "left")
    code = (
        F.when(F.col("new_type").isNull() & F.col("new_weight").isNull() & F.col("new_note").isNull(), "NO_CHANGE")
        .when(~F.col("new_type").isin(*RELATION_TYPES), "INVALID_TYPE")
        .when((F.col("new_weight") < 0) | (F.col("new_weight") > 100), "INVALID_WEIGHT")
        .when(F.col("from_memory_uuid").isNull(), "NOT_FOUND")
        .when((F.col("first") != F.col("uuid")) | (F.col("last") != F.col("uuid")), "RELATION_EXISTS")
    )
    return rows.select("uuid", "new_type", "new_weight", "new_note", code.alias("error_code"))


def patch_relations(relations: DataFrame, patches: DataFrame) -> DataFrame:
    """relations after patches (uuid, new_type, new_weight, new_note): null keeps, an empty note clears. See patch_errors, which a batch has none of."""
    rows = relations.join(patches, "uuid", "left")
    note = F.when(F.col("new_note").isNull(), F.col("note")).when(F.trim("new_note") != "", F.trim("new_note"))
    changed = {"relation_type": F.coalesce("new_type", "relation_type"), "weight": F.coalesce("new_weight", "weight"), "note": note}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in relations.columns))


def delete_relations(relations: DataFrame, gone: DataFrame) -> DataFrame:
    return relations.join(gone.select("uuid"), "uuid", "left_anti")


def status(units: DataFrame, relations: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row: dirty (true if nothing is known of the graph), its time, active records, edges between them."""
    nodes = active(units).agg(F.count("*").alias("nodes"))
    edges = both_active(relations, units).agg(F.count("*").alias("edges"))
    counts = nodes.crossJoin(F.broadcast(edges))  # one row each
    if meta is None:
        return counts.select(F.lit(True).alias("dirty"), F.lit(None).cast("timestamp").alias("updated_at"), "nodes", "edges")
    told = meta.agg(F.coalesce(F.max("dirty"), F.lit(True)).alias("dirty"), F.max("updated_at").alias("updated_at"))
    return told.crossJoin(F.broadcast(counts)).select("dirty", "updated_at", "nodes", "edges")


def vertices(units: DataFrame) -> DataFrame:
    return active(units).select("uuid", "category", "title_norm", "status", F.coalesce("summary", F.lit("")).alias("summary"))


def edges(units: DataFrame, relations: DataFrame) -> DataFrame:
    return both_active(relations, units).select("from_memory_uuid", "to_memory_uuid", F.upper("relation_type").alias("label"), F.col("uuid").alias("relation_uuid"), "weight", "note", "created_at")


def refresh(units: DataFrame, relations: DataFrame, stored: DataFrame, touched: DataFrame, changed: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """What the graph's edges (stored) and vertices lack after edits of records (touched: uuid) and relations (changed: uuid).

    The vertices of touched records, and the edges that take the place of
    those of changed relations and at touched records, with the keys
    (relation_uuid) of all that must go first.
    """
    fresh = vertices(units.join(touched, "uuid", "left_semi"))
    at = lambda rows, end: rows.join(touched.select(F.col("uuid").alias(end)), end, "left_semi")
    ends = ("from_memory_uuid", "to_memory_uuid")
    ids = changed.select("uuid")
    for end in ends:
        ids = ids.union(at(relations, end).select("uuid"))
    gone = ids.withColumnRenamed("uuid", "relation_uuid")
    for end in ends:
        gone = gone.union(at(stored, end).select("relation_uuid"))
    return fresh, (edges(units, relations.join(ids.distinct(), "uuid", "left_semi")), gone.distinct())


#: Edges that a record has from which on they are dealt to SPREAD tasks in a search by steps.
HUB, SPREAD = 10_000, 64


def reachable(units: DataFrame, relations: DataFrame, sources: DataFrame, depth: int, kinds: tuple[str, ...] = RELATION_TYPES) -> DataFrame:
    """source, uuid, steps: the active records that relations of some kinds lead to from each of sources (uuid), in either direction,
    in at most depth steps, with the least number of these; a source reaches itself in none.

    Each round joins only what the last one has newly reached with the edges,
    and takes away what was reached before; it ends when nothing is new.
    Edges of records that have very many are dealt out, so that no record's meet in one task.
    """
    live = both_active(relations.where(F.col("relation_type").isin(*kinds)), units).select(F.col("from_memory_uuid").alias("a"), F.col("to_memory_uuid").alias("b"))
    both = live.union(live.select("b", "a")).where("a <> b").distinct()
    hubs = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= HUB).select("a", F.lit(SPREAD).alias("ways"))
    salt = F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    hubs = materialize(hubs)
    edges_ = materialize(both.join(hubs, "a", "left").select("a", "b", salt.alias("salt")))
    seen = [materialize(active(units).select("uuid").join(sources.select("uuid").distinct(), "uuid").select(F.col("uuid").alias("source"), "uuid", F.lit(0).alias("steps")))]
    for k in range(1, depth + 1):
        last = seen[-1].join(hubs.withColumnRenamed("a", "uuid"), "uuid", "left")
        dealt = last.select("source", F.col("uuid").alias("a"), F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("salt"))
        new = dealt.join(edges_, ["a", "salt"]).select("source", F.col("b").alias("uuid")).distinct()
        for old in seen:
            new = new.join(old.select("source", "uuid"), ["source", "uuid"], "left_anti")
        seen.append(materialize(new.withColumn("steps", F.lit(k))))
        if seen[-1].isEmpty():
            break
    found = seen[0]
    for more in seen[1:]:
        found = found.union(more)
    release(hubs, edges_)
    return found


def layout(nodes: DataFrame, radius: float = 240.0) -> DataFrame:
    """uuid, x, y: the nodes of an overview evenly on a circle, the first one at its top."""
    order, whole = Window.orderBy(F.desc("updated_at"), "uuid"), Window.partitionBy()  # an overview's rows
    angle = F.lit(2.0) * F.pi() * (F.row_number().over(order) - 1) / F.count("*").over(whole) - F.pi() / 2
    return nodes.select("uuid", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
