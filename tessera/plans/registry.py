"""Named queries over the test tables, and SQL for their rows.

Each query wires operators to the fixture views; each oracle says the same
in SQL on its own, with the fixture views inlined.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands, graph, index, listing, load, review, search
from ..sources import backup
from ..sources.shared import materialize, scratch
from ..sources.store import Delta, Derived, Store
from .fixtures import CHANGES, EMBEDDINGS, KEYWORDS, RELATIONS, UNITS, USAGE, Fixtures, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Standard parameters.
QUERY, VECTOR_ID, MODEL, MAX_DISTANCE = "worthless license", 3, "m1", 0.85
AS_OF, RETENTION = "2024-01-09 12:00:00", 10_080
SOURCE, SUGGEST, CATEGORY = 7, 2, "fr"


def query(oracle: str, *views: str):
    def register(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        ORACLES[f.__name__] = sql(oracle, *views) if views else oracle
        return f

    return register


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


# Listings


@query("SELECT uuid, title_norm, content FROM memory_units WHERE category = 'en' AND status <> 'trashed'", UNITS)
def init_memories(fx):
    return listing.init_read(fx.units, "en")


@query(
    """SELECT u.uuid, u.category, u.title_norm, u.summary, u.content, u.revision, u.recall_when, coalesce(k.keywords, '') AS keywords,
              c.action IS NOT NULL AS has_open_change, c.action AS change_action, u.created_at, u.updated_at
       FROM memory_units u LEFT JOIN (SELECT memory_uuid, string_agg(keyword_norm, ',' ORDER BY keyword_norm) AS keywords FROM memory_keywords GROUP BY 1) k ON k.memory_uuid = u.uuid
       LEFT JOIN memory_changes c ON c.memory_uuid = u.uuid WHERE u.status = 'active'""",
    UNITS, KEYWORDS, CHANGES,
)
def list_memories(fx):
    return listing.list_memories(fx.units, fx.keywords, fx.changes)


@query("SELECT DISTINCT keyword_norm FROM memory_keywords JOIN memory_units ON uuid = memory_uuid WHERE status = 'active' AND category = 'fr'", UNITS, KEYWORDS)
def category_keywords(fx):
    return listing.category_keywords(fx.units, fx.keywords, CATEGORY)


LISTED = """SELECT c.memory_uuid, c.action, u.title_norm, u.summary, u.status, c.before_state, c.after_state, c.created_at, c.updated_at
  FROM memory_changes c LEFT JOIN memory_units u ON u.uuid = c.memory_uuid WHERE NOT (c.action = 'delete' AND coalesce(u.status, '') = 'trashed')"""


@query(LISTED, CHANGES, UNITS)
def list_changes(fx):
    return listing.open_changes(fx.changes, fx.units).orderBy(F.desc("updated_at"), "memory_uuid")


@query(f"SELECT count(*) AS n FROM ({LISTED})", CHANGES, UNITS)
def count_changes(fx):
    return listing.open_changes(fx.changes, fx.units).agg(F.count("*").alias("n"))


@query(f"SELECT * FROM ({LISTED}) WHERE memory_uuid = 7", CHANGES, UNITS)
def change_detail(fx):
    return listing.open_changes(fx.changes.where(F.col("memory_uuid") == SOURCE), fx.units)


TRASH = """SELECT c.memory_uuid, c.action, c.before_state, c.after_state, c.created_at, c.updated_at, u.category, u.title_norm, u.summary, u.trashed_at,
  u.trashed_at + INTERVAL 10080 MINUTE AS expires_at FROM memory_changes c JOIN memory_units u ON u.uuid = c.memory_uuid
  WHERE c.action = 'delete' AND u.status = 'trashed' AND u.trashed_at IS NOT NULL"""


@query(TRASH, CHANGES, UNITS)
def list_trash(fx):
    return listing.trash(fx.changes, fx.units, RETENTION)


@query(f"SELECT * FROM ({TRASH}) WHERE memory_uuid = (SELECT min(memory_uuid) FROM ({TRASH}))", CHANGES, UNITS)
def trash_detail(fx):
    one = listing.trash(fx.changes, fx.units, RETENTION).agg(F.min("memory_uuid").alias("id")).first()["id"]
    return listing.trash(fx.changes.where(F.col("memory_uuid") == one), fx.units, RETENTION)


def _states(fx):
    return listing.snapshots(fx.units, fx.keywords, fx.relations)


STATES = """states AS (SELECT u.*, coalesce(k.keywords, '') AS keywords, coalesce(r.relations, '') AS relations FROM memory_units u
  LEFT JOIN (SELECT memory_uuid, string_agg(keyword_norm, ',' ORDER BY keyword_norm) AS keywords FROM memory_keywords GROUP BY 1) k ON k.memory_uuid = u.uuid
  LEFT JOIN (SELECT m, string_agg(concat(uuid, ':', relation_type, ':', coalesce(CAST(weight AS VARCHAR), '-')), ',' ORDER BY created_at, uuid) AS relations
             FROM (SELECT from_memory_uuid AS m, * FROM memory_relations UNION ALL SELECT to_memory_uuid AS m, * FROM memory_relations) GROUP BY 1) r ON r.m = u.uuid)"""


def _flat(states):
    """Snapshots with their lists as texts."""
    word = lambda r: F.concat(r["relation_uuid"].cast("string"), F.lit(":"), r["relation_type"], F.lit(":"), F.coalesce(r["weight"].cast("string"), F.lit("-")))
    return states.select("updated_at", "memory.*", F.array_join("keywords.keyword_norm", ",").alias("keywords"), F.array_join(F.transform("relations", word), ",").alias("relations"))


@query(
    "SELECT uuid, category, title_norm, content, summary, revision, status, recall_when, trashed_at, keywords, relations FROM states WHERE status <> 'trashed'",
    UNITS, KEYWORDS, RELATIONS, STATES,
)
def read_memory(fx):
    return _flat(_states(fx)).where("status <> 'trashed'").drop("updated_at")


def _hash(c: str) -> str:
    return f"concat('0x', sha256(coalesce(CAST(to_json({c}) AS VARCHAR), 'null')))"


def _json(c: str) -> str:
    return f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"


#: A record's state as compact JSON, its fields in order and nulls written.
JSON_STATES = f"""json_states AS (SELECT u.*, k.words, concat('{{"memory":{{"uuid":', u.uuid, ',"category":', {_json('category')}, ',"title_norm":', {_json('title_norm')}, ',"content":', {_json('content')},
    ',"summary":', {_json('summary')}, ',"revision":', revision, ',"status":', {_json('status')}, ',"recall_when":', {_json('recall_when')},
    ',"trashed_at":', CASE WHEN trashed_at IS NULL THEN 'null' ELSE concat('"', strftime(trashed_at, '%Y-%m-%dT%H:%M:%S.%g'), '"') END, '}},"keywords":[', coalesce(k.items, ''), '],"relations":[', coalesce(r.items, ''), ']}}') AS state
  FROM memory_units u LEFT JOIN (
    SELECT memory_uuid, string_agg(concat('{{"keyword_norm":', {_json('keyword_norm')}, ',"weight":', coalesce(CAST(weight AS VARCHAR), 'null'), '}}'), ',' ORDER BY keyword_norm) AS items,
           concat('[', string_agg({_json('keyword_norm')}, ',' ORDER BY keyword_norm), ']') AS words FROM memory_keywords GROUP BY 1) k ON k.memory_uuid = u.uuid
  LEFT JOIN (
    SELECT m, string_agg(concat('{{"relation_uuid":', uuid, ',"from_memory_uuid":', from_memory_uuid, ',"to_memory_uuid":', to_memory_uuid, ',"relation_type":', {_json('relation_type')},
           ',"weight":', coalesce(CAST(weight AS VARCHAR), 'null'), ',"note":', {_json('note')}, '}}'), ',' ORDER BY created_at, uuid) AS items
    FROM (SELECT from_memory_uuid AS m, * FROM memory_relations UNION ALL SELECT to_memory_uuid AS m, * FROM memory_relations) GROUP BY 1) r ON r.m = u.uuid)"""


@query(
    f"""SELECT uuid, title_norm, revision, {_hash('title_norm')} AS title_hash, {_hash('content')} AS content_hash,
       {_hash('summary')} AS summary_hash, {_hash('recall_when')} AS recall_when_hash, {_hash('category')} AS category_hash,
       concat('0x', sha256(coalesce(words, '[]'))) AS keywords_hash, concat('0x', sha256(state)) AS state_hash FROM json_states WHERE status <> 'trashed'""",
    UNITS, KEYWORDS, RELATIONS, JSON_STATES,
)
def memory_hashes(fx):
    return listing.memory_hashes(_states(fx))


@query(
    """SELECT uuid, category, title_norm, status, created_at FROM memory_units u WHERE category = 'fr' AND CAST(created_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-02'
       AND (contains(lower(CAST(uuid AS VARCHAR)), 'ring') OR contains(lower(title_norm), 'ring') OR contains(lower(summary), 'ring') OR contains(lower(content), 'ring')
            OR contains(lower(recall_when), 'ring') OR uuid IN (SELECT memory_uuid FROM memory_keywords WHERE contains(lower(keyword_norm), 'ring')))""",
    UNITS, KEYWORDS,
)
def ui_filter_memories(fx):
    from datetime import date

    return listing.ui_filter(fx.units, fx.keywords, CATEGORY, "Ring", date(2024, 1, 1), date(2024, 1, 2))


@query("SELECT DISTINCT category FROM memory_units WHERE category <> ''", UNITS)
def distinct_categories(fx):
    return fx.units.where("category <> ''").select("category").distinct().orderBy("category")


#: Edits of all fields of a record: the state before is its own, the one after has other texts, one keyword less and a relation more.
EDITED = """edited AS (SELECT u.uuid, u.title_norm || ' bis' AS title_norm, 'xx' AS category, CASE WHEN uuid % 4 = 0 THEN NULL ELSE coalesce(summary, 'é new') END AS summary,
    substring(content, 1, 10) || '<' || substring(content, 15) AS content, recall_when FROM memory_units u)"""


#: How many leading entries two lists share.
ALIKE = "coalesce(list_position(list_transform(list_zip({a}, {b}), lambda x: x[1] IS DISTINCT FROM x[2]), true) - 1, least(len({a}), len({b})))"


@query(
    f"""SELECT memory_uuid, field, old, new, left(old, p) AS prefix, substring(old, p + 1, length(old) - p - n) AS removed, substring(new, p + 1, length(new) - p - n) AS added, right(old, n) AS suffix
        FROM (SELECT *, CAST({ALIKE.format(a='list_reverse(x[p + 1:])', b='list_reverse(y[p + 1:])')} AS INT) AS n
              FROM (SELECT *, CAST({ALIKE.format(a='x', b='y')} AS INT) AS p
                    FROM (SELECT *, string_split(old, '') AS x, string_split(new, '') AS y
                          FROM (SELECT uuid AS memory_uuid, field, coalesce(o, '-') AS old, coalesce(n, '-') AS new FROM (
                            SELECT u.uuid, unnest(['title_norm', 'category', 'summary', 'content', 'recall_when', 'keywords']) AS field,
                                   unnest([u.title_norm, u.category, u.summary, u.content, u.recall_when, k.words]) AS o, unnest([e.title_norm, e.category, e.summary, e.content, e.recall_when, k.fewer]) AS n
                            FROM memory_units u JOIN edited e USING (uuid)
                            JOIN (SELECT memory_uuid, string_agg(keyword_norm, chr(10) ORDER BY keyword_norm) AS words, string_agg(keyword_norm, chr(10) ORDER BY keyword_norm) FILTER (WHERE keyword_norm NOT LIKE 'src%') AS fewer FROM memory_keywords GROUP BY 1) k ON k.memory_uuid = u.uuid
                            ) WHERE o IS DISTINCT FROM n))))""",
    UNITS, KEYWORDS, EDITED,
)
def change_field_diff(fx):
    """What a review shows of edits of all records: each field that they touch, with the parts that differ."""
    before = _states(fx).drop("updated_at")
    m = lambda f: F.col(f"memory.{f}")
    new = {
        "title_norm": F.concat(m("title_norm"), F.lit(" bis")), "category": F.lit("xx"), "summary": F.when(F.col("uuid") % 4 != 0, F.coalesce(m("summary"), F.lit("é new"))),
        "content": F.concat(F.substring(m("content"), 1, 10), F.lit("<"), F.substr(m("content"), F.lit(15))),
    }
    before = before.withColumn("before_state", listing.state_json())
    after = before.withColumn("memory", F.struct(*(new[f].alias(f) if f in new else m(f).alias(f) for f in listing.MEMORY))).withColumn("keywords", F.filter("keywords", lambda k: ~k["keyword_norm"].startswith("src")))
    return listing.change_fields(after.select(F.col("uuid").alias("memory_uuid"), "before_state", listing.state_json().alias("after_state")))


# Sources and sinks


@query("SELECT uuid, category, title_norm, content, summary, revision, status, recall_when, trashed_at, keywords, relations FROM states WHERE status = 'active'", UNITS, KEYWORDS, RELATIONS, STATES)
def backup_snapshot(fx):
    return _flat(backup.snapshot_rows(fx.units, fx.keywords, fx.relations)).drop("updated_at")


def _imported(fx):
    rows = backup.snapshot_rows(fx.units, fx.keywords, fx.relations)
    return backup.parse(rows.select(listing.state_json().alias("value")))


@query("SELECT CAST(uuid AS VARCHAR) AS uuid, category, title_norm, content, summary, revision, status, recall_when FROM memory_units WHERE status = 'active'", UNITS)
def import_units(fx):
    return backup.imported_units(_imported(fx)).drop("trashed_at")


@query("SELECT CAST(memory_uuid AS VARCHAR) AS memory_uuid, keyword_norm, weight FROM memory_keywords JOIN memory_units ON uuid = memory_uuid WHERE status = 'active'", UNITS, KEYWORDS)
def import_keywords(fx):
    return backup.imported_keywords(_imported(fx))


def _edited_store(fx):
    """A store of units after two commits: approvals and deletions for good, then edits of records with an open update."""
    store = Store(fx.spark, f"{scratch(fx.spark)}/store-{uuid4().hex}")
    store.write_all({"units": fx.units})
    approved = fx.units.where("status = 'pending'").withColumns({"status": F.lit("active"), "revision": F.col("revision") + 1})
    store.retry(lambda seen: {"units": Delta(approved, fx.units.where("status = 'trashed' and category = 'en'").select("uuid"))})
    open_ = fx.changes.where("action = 'update'").select(F.col("memory_uuid").alias("uuid"))
    store.retry(lambda seen: {"units": Delta(seen.read("units").join(open_, "uuid", "left_semi").withColumns({"content": F.lit("edited"), "revision": F.col("revision") + 1}))})
    return store


APPROVED = """approved AS (SELECT uuid, category, title_norm, content, CASE status WHEN 'pending' THEN 'active' ELSE status END AS status, revision + CASE status WHEN 'pending' THEN 1 ELSE 0 END AS revision
  FROM memory_units WHERE NOT (status = 'trashed' AND category = 'en'))"""


@query(
    """SELECT uuid, category, title_norm, CASE WHEN e THEN 'edited' ELSE content END AS content, status, revision + CASE WHEN e THEN 1 ELSE 0 END AS revision
       FROM (SELECT *, uuid IN (SELECT memory_uuid FROM memory_changes WHERE action = 'update') AS e FROM approved)""",
    UNITS, CHANGES, APPROVED,
)
def store_merge_on_read(fx):
    return _edited_store(fx).read("units").select("uuid", "category", "title_norm", "content", "status", "revision")


@query("SELECT * FROM approved", UNITS, APPROVED)
def store_as_of(fx):
    """The same store as of its second revision, after more were written."""
    return _edited_store(fx).read("units", 2).select("uuid", "category", "title_norm", "content", "status", "revision")


# Derived projections

INDEX = """search_index AS (SELECT u.uuid AS memory_uuid, u.status, title_norm AS title_text, coalesce(summary, '') AS summary_text, coalesce(k.words, '') AS keywords_text,
  content AS content_text, coalesce(recall_when, '') AS recall_when_text FROM memory_units u
  LEFT JOIN (SELECT memory_uuid, string_agg(keyword_norm, ' ' ORDER BY keyword_norm) AS words FROM memory_keywords GROUP BY 1) k ON k.memory_uuid = u.uuid)"""


@query("SELECT *, concat_ws(' ', title_text, summary_text, keywords_text, content_text, recall_when_text) AS all_text FROM search_index", UNITS, KEYWORDS, INDEX)
def search_index_build(fx):
    return index.build_search_index(fx.units, fx.keywords)


def _vectors(rows):
    return rows.select("memory_uuid", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), "embedding_model", F.size("embedding").cast("long").alias("size"))


@query(
    """SELECT memory_uuid, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total,
       CASE WHEN memory_uuid % 3 = 0 THEN 'm2' ELSE embedding_model END AS embedding_model, CAST(len(embedding) AS BIGINT) AS size FROM memory_embeddings""",
    EMBEDDINGS,
)
def embedding_upsert(fx):
    fresh = fx.embeddings.where("memory_uuid % 3 = 0").withColumn("embedding_model", F.lit("m2"))
    return _vectors(index.upsert_embeddings(fx.embeddings, fresh))


@query(
    """SELECT e.memory_uuid, CASE WHEN e.memory_uuid % 7 = 0 THEN true ELSE false END AS conflict FROM memory_embeddings e JOIN memory_units u ON u.uuid = e.memory_uuid""",
    EMBEDDINGS, UNITS,
)
def embedding_stale_guard(fx):
    states = _states(fx).select("uuid", F.sha2(listing.state_json(), 256).alias("state_hash"))
    stale = F.when(F.col("uuid") % 7 == 0, F.lit("old")).otherwise(F.col("state_hash"))
    fresh = fx.embeddings.select("memory_uuid").join(states.select(F.col("uuid").alias("memory_uuid"), stale.alias("state_hash")), "memory_uuid", "left")
    return index.current_embeddings(fresh, states).select("memory_uuid", "conflict")


@query("SELECT memory_uuid, CAST(len(embedding) AS BIGINT) AS size, embedding_dimension FROM memory_embeddings WHERE memory_uuid % 50 = 0", EMBEDDINGS)
def embedding_dim_violations(fx):
    cut = F.when(F.col("memory_uuid") % 50 == 0, F.lit(32)).otherwise(F.col("embedding_dimension"))
    return index.dimension_violations(fx.embeddings.withColumn("embedding_dimension", cut), 64).select("memory_uuid", "size", F.lit(64).alias("embedding_dimension"))


# Retrieval


def _index(fx):
    return index.build_search_index(fx.units, fx.keywords)


def _results(rows):
    more = [c for c in rows.columns if c == "strategy"]
    return rows.select("memory_uuid", "title_text", "status", "content_preview", F.array_join("matched_fields", ",").alias("matched_fields"), F.round(F.col("score").cast("double"), 6).alias("score"), *more)


def _grams(text: str) -> str:
    return f"list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _literal_sql(fields: tuple[str, ...]) -> str:
    sims = ", ".join(f"{_grams(f + '_text')} AS {f}_g" for f in fields)
    both = lambda f: f"len(list_intersect({f}_g, q))"
    sim = ", ".join(f"CASE WHEN len({f}_g) = 0 THEN 0 ELSE {both(f)} / (len({f}_g) + len(q) - {both(f)}) END AS {f}_s" for f in fields)
    hit = {f: f"({f}_s >= 0.3 OR contains(lower({f}_text), 'worthless') OR contains(lower({f}_text), 'license'))" for f in fields}
    names = ", ".join(f"CASE WHEN {hit[f]} THEN '{f}' END" for f in ("title", "summary", "keywords", "content", "recall_when") if f in fields)
    preview = f"CASE WHEN {hit['content']} THEN left(content_text, 120) END" if "content" in fields else "CAST(NULL AS VARCHAR)"
    text = "concat_ws(' ', " + ", ".join(f"{f}_text" for f in fields) + ")"
    return f"""grams AS (SELECT *, {text} AS t, {_grams("'worthless license'")} AS q, {sims} FROM search_index WHERE status <> 'trashed'),
      sims AS (SELECT *, {sim} FROM grams),
      literal AS (SELECT memory_uuid, title_text, status, {preview} AS content_preview, concat_ws(',', {names}) AS matched_fields,
        round(CAST(contains(lower(t), 'worthless') AS INT) + CAST(contains(lower(t), 'license') AS INT) + greatest(0, {', '.join(f'{f}_s' for f in fields)}), 6) AS score
        FROM sims WHERE {' OR '.join(hit.values())} ORDER BY score DESC, title_text, memory_uuid LIMIT 8)"""


@query("SELECT * FROM literal", UNITS, KEYWORDS, INDEX, _literal_sql(("title", "summary", "keywords", "content", "recall_when")))
def search_basic(fx):
    return _results(search.literal(_index(fx), search.request({"query": QUERY})))


@query("SELECT * FROM literal", UNITS, KEYWORDS, INDEX, _literal_sql(("title", "summary", "keywords", "content", "recall_when")))
def search_indexed(fx):
    built = _index(fx)
    return _results(search.indexed(built, index.gram_postings(built), search.request({"query": QUERY})))


def _kept(fx):
    """The index, its postings and their numbers as a store keeps them."""
    store = Store(fx.spark, f"{scratch(fx.spark)}/store-{uuid4().hex}")
    built = _index(fx)
    store.write_all({"search_index": built, "postings": index.gram_postings(built), "grams": Derived("postings", index.gram_counts)})
    now = store.snapshot()
    return now.read("search_index"), now.read("postings"), now.read("grams")


@query("SELECT * FROM literal", UNITS, KEYWORDS, INDEX, _literal_sql(("title", "summary", "keywords", "content", "recall_when")))
def search_kept(fx):
    built, postings, grams = _kept(fx)
    return _results(search.indexed(built, postings, search.request({"query": QUERY}), grams=grams))


@query(
    """SELECT memory_uuid, title_text, status, CAST(NULL AS VARCHAR) AS content_preview, '' AS matched_fields, CAST(0 AS DOUBLE) AS score FROM search_index
       WHERE status <> 'trashed' AND (contains(lower(concat_ws(' ', keywords_text, recall_when_text)), 'src7') OR contains(lower(concat_ws(' ', keywords_text, recall_when_text)), 'polished steel'))
         AND NOT contains(lower(concat_ws(' ', keywords_text, recall_when_text)), 'brass') ORDER BY title_text, memory_uuid LIMIT 8""",
    UNITS, KEYWORDS, INDEX,
)
def search_kept_terms(fx):
    built, postings, grams = _kept(fx)
    wanted = search.request({"terms": {"include": ["src7", "Polished Steel"], "exclude": ["brass"]}, "filters": ["keywords", "recall_when"]})
    return _results(search.indexed(built, postings, wanted, grams=grams))


@query("SELECT * FROM literal", UNITS, KEYWORDS, INDEX, _literal_sql(("title", "summary", "recall_when")))
def search_fields(fx):
    return _results(search.literal(_index(fx), search.Search(query=QUERY, fields=("title", "summary", "recall_when"))))


@query(
    """SELECT memory_uuid, title_text, status, CAST(NULL AS VARCHAR) AS content_preview, '' AS matched_fields, CAST(0 AS DOUBLE) AS score FROM search_index
       WHERE status <> 'trashed' AND (contains(lower(content_text), 'worthless') OR contains(lower(content_text), 'license')) AND NOT contains(lower(content_text), 'the ')
       ORDER BY title_text, memory_uuid LIMIT 8""",
    UNITS, KEYWORDS, INDEX,
)
def search_advanced(fx):
    return _results(search.literal(_index(fx), search.request({"terms": {"include": ["worthless", "license"], "exclude": ["the "]}, "filters": ["content"]})))


def _near_sql(where: str) -> str:
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"""near AS (SELECT i.memory_uuid, i.title_text, i.status, CAST(NULL AS VARCHAR) AS content_preview, '' AS matched_fields, round({dot('e.embedding', 'q.embedding')}
        / (sqrt({dot('e.embedding', 'e.embedding')}) * sqrt({dot('q.embedding', 'q.embedding')})), 6) AS score
      FROM memory_embeddings e JOIN search_index i ON i.memory_uuid = e.memory_uuid, (SELECT embedding FROM memory_embeddings WHERE memory_uuid = 3) q
      WHERE i.status = 'active' AND e.embedding_model = 'm1' {where}),
      fallback AS (SELECT * FROM near WHERE 1 - score <= 0.85 ORDER BY score DESC, title_text, memory_uuid LIMIT 8)"""


def _query_vector(fx):
    """The stated query vector: one row."""
    return fx.embeddings.where(F.col("memory_uuid") == VECTOR_ID).first()["embedding"]


@query("SELECT * FROM fallback", UNITS, KEYWORDS, INDEX, EMBEDDINGS, _near_sql(""))
def vector_fallback(fx):
    return _results(search.vector_fallback(_index(fx), fx.embeddings, search.Search(query=QUERY), _query_vector(fx), MODEL, MAX_DISTANCE))


@query(
    "SELECT *, 'vector' AS strategy FROM fallback",
    UNITS, KEYWORDS, INDEX, EMBEDDINGS, _near_sql("AND NOT contains(lower(concat_ws(' ', title_text, summary_text, keywords_text, content_text, recall_when_text)), 'zzzz unheard')"),
)
def hybrid_search(fx):
    rows = search.hybrid(_index(fx), fx.embeddings, search.Search(query="qxqx unheardofword"), _query_vector(fx), MODEL, MAX_DISTANCE)
    return _results(rows)


@query("SELECT *, 'literal' AS strategy FROM literal", UNITS, KEYWORDS, INDEX, _literal_sql(("title", "summary", "keywords", "content", "recall_when")))
def hybrid_search_literal(fx):
    return _results(search.hybrid(_index(fx), fx.embeddings, search.request({"query": QUERY}), _query_vector(fx), MODEL, MAX_DISTANCE))


@query(
    """SELECT memory_uuid, score, CASE WHEN quality IS NULL THEN NULL ELSE place END AS place FROM (
         SELECT u.uuid AS memory_uuid, l.quality, u.uuid % 13 AS place, CASE WHEN l.quality IS NULL THEN round(u.revision / 10.0, 6) ELSE round(l.quality * 0.9, 6) END AS score
         FROM memory_units u LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = u.uuid) WHERE quality IS NULL OR score >= 0.1""",
    UNITS,
)
def rerank_merge(fx):
    candidates = fx.units.select(F.col("uuid").alias("ordinal"), F.col("uuid").alias("memory_uuid"), (F.col("revision") / 10.0).alias("score"))
    labels = fx.table("labels").groupBy(F.col("doc_id").alias("ordinal")).agg((F.max("quality") * 0.9).alias("rerank_score"))
    ranked = labels.withColumn("place", F.col("ordinal") % 13).unionByName(labels.select(F.col("ordinal"), F.lit(0.5).alias("rerank_score"), F.lit(99).cast("long").alias("place")))
    return search.rerank_merge(candidates, ranked).select("memory_uuid", F.round(F.col("score").cast("double"), 6).alias("score"), "place")


# Graph


@query(
    """SELECT r.relation_uuid, r.direction, r.relation_type, r.weight, r.note, r.created_at, u.uuid AS memory_uuid, u.title_norm FROM (
         SELECT uuid AS relation_uuid, 'out' AS direction, to_memory_uuid AS other, relation_type, weight, note, created_at FROM memory_relations WHERE from_memory_uuid = 7
         UNION ALL SELECT uuid, 'in', from_memory_uuid, relation_type, weight, note, created_at FROM memory_relations WHERE to_memory_uuid = 7) r
       LEFT JOIN memory_units u ON u.uuid = r.other AND u.status = 'active'""",
    UNITS, RELATIONS,
)
def graph_neighbors(fx):
    return graph.neighbors(fx.units, fx.relations, SOURCE)


NODES = "nodes AS (SELECT uuid, category, title_norm, status, summary, updated_at FROM memory_units WHERE status = 'active' ORDER BY updated_at DESC, uuid LIMIT 100)"


@query("SELECT * FROM nodes", UNITS, NODES)
def graph_overview_nodes(fx):
    return graph.overview_nodes(fx.units)


@query("SELECT uuid, from_memory_uuid, to_memory_uuid, relation_type, weight, note, created_at FROM memory_relations WHERE from_memory_uuid IN (SELECT uuid FROM nodes) AND to_memory_uuid IN (SELECT uuid FROM nodes)", UNITS, RELATIONS, NODES)
def graph_overview_edges(fx):
    return graph.overview_edges(fx.units, fx.relations)


@query(
    """SELECT uuid, round(240 * cos(a), 6) AS x, round(240 * sin(a), 6) AS y FROM (
         SELECT uuid, 2 * pi() * (row_number() OVER (ORDER BY updated_at DESC, uuid) - 1) / count(*) OVER () - pi() / 2 AS a FROM nodes)""",
    UNITS, NODES,
)
def graph_layout(fx):
    return graph.layout(graph.overview_nodes(fx.units)).select("uuid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """SELECT u.uuid AS memory_uuid, u.title_norm, u.category, count(*) AS shared, CAST(least(100, 50 + 10 * count(*)) AS INT) AS weight, concat('shared_keywords=', count(*)) AS note
       FROM memory_units u JOIN memory_keywords k ON k.memory_uuid = u.uuid JOIN memory_keywords s ON s.keyword_norm = k.keyword_norm AND s.memory_uuid = 2
       WHERE u.status = 'active' AND u.uuid <> 2 AND NOT EXISTS (SELECT 1 FROM memory_relations r WHERE r.relation_type = 'related_to'
         AND ((r.from_memory_uuid = 2 AND r.to_memory_uuid = u.uuid) OR (r.to_memory_uuid = 2 AND r.from_memory_uuid = u.uuid)))
       GROUP BY 1, 2, 3 ORDER BY shared DESC, title_norm, memory_uuid LIMIT 3""",
    UNITS, KEYWORDS, RELATIONS,
)
def suggest_relations(fx):
    return graph.suggest(fx.units, fx.keywords, fx.relations, SUGGEST)


def _auto_sql(sources: str) -> str:
    return f"""SELECT from_memory_uuid, to_memory_uuid, 'related_to' AS relation_type, CAST(CASE WHEN shared = 0 THEN 40 ELSE least(100, 50 + 10 * shared) END AS INT) AS weight,
      CASE WHEN shared = 0 THEN 'auto: same_category' ELSE concat('auto: shared_keywords=', shared) END AS note FROM (
        SELECT *, row_number() OVER (PARTITION BY from_memory_uuid ORDER BY shared DESC, to_memory_uuid) AS n FROM (
          SELECT s.uuid AS from_memory_uuid, t.uuid AS to_memory_uuid, count(k2.keyword_norm) AS shared
          FROM memory_units s JOIN memory_units t ON t.category = s.category AND t.uuid <> s.uuid AND t.status = 'active'
          LEFT JOIN memory_keywords k1 ON k1.memory_uuid = s.uuid LEFT JOIN memory_keywords k2 ON k2.memory_uuid = t.uuid AND k2.keyword_norm = k1.keyword_norm
          WHERE s.status = 'active' AND {sources} AND NOT EXISTS (SELECT 1 FROM memory_relations r WHERE r.relation_type = 'related_to'
            AND ((r.from_memory_uuid = s.uuid AND r.to_memory_uuid = t.uuid) OR (r.to_memory_uuid = s.uuid AND r.from_memory_uuid = t.uuid)))
          GROUP BY 1, 2)) WHERE n <= 3"""


@query(_auto_sql("s.uuid = 2"), UNITS, KEYWORDS, RELATIONS)
def auto_relations(fx):
    return graph.auto_relations(fx.units, fx.keywords, fx.relations, fx.units.where(F.col("uuid") == SUGGEST).select("uuid"))


@query(_auto_sql("s.uuid IN (SELECT memory_uuid FROM memory_changes WHERE action = 'create')"), UNITS, KEYWORDS, RELATIONS, CHANGES)
def auto_relations_batch(fx):
    return graph.auto_relations(fx.units, fx.keywords, fx.relations, fx.changes.where("action = 'create'").select(F.col("memory_uuid").alias("uuid")))


@query(
    """SELECT c.command_id, c.from_memory_uuid, c.to_memory_uuid, c.relation_type, c.weight,
         CASE WHEN c.relation_type NOT IN ('related_to', 'supersedes', 'depends_on', 'conflicts_with', 'elaborates', 'applies_to') THEN 'INVALID_TYPE'
              WHEN c.weight < 0 OR c.weight > 100 THEN 'INVALID_WEIGHT' WHEN c.from_memory_uuid = c.to_memory_uuid THEN 'SAME_MEMORY'
              WHEN f.uuid IS NULL OR t.uuid IS NULL THEN 'NOT_ACTIVE'
              WHEN EXISTS (SELECT 1 FROM memory_relations r WHERE r.from_memory_uuid = c.from_memory_uuid AND r.to_memory_uuid = c.to_memory_uuid AND r.relation_type = c.relation_type) THEN 'RELATION_EXISTS' END AS error_code
       FROM (SELECT uuid AS command_id, uuid AS from_memory_uuid, uuid + CASE WHEN uuid % 9 = 0 THEN 0 ELSE 1 + uuid % 5 END AS to_memory_uuid,
                    CASE WHEN uuid % 11 = 0 THEN 'likes' WHEN uuid % 2 = 0 THEN 'related_to' ELSE 'supersedes' END AS relation_type, CAST(uuid % 120 AS INT) AS weight FROM memory_units) c
       LEFT JOIN memory_units f ON f.uuid = c.from_memory_uuid AND f.status = 'active' LEFT JOIN memory_units t ON t.uuid = c.to_memory_uuid AND t.status = 'active'""",
    UNITS, RELATIONS,
)
def relation_add_errors(fx):
    u = F.col("uuid")
    kind = F.when(u % 11 == 0, "likes").when(u % 2 == 0, "related_to").otherwise("supersedes")
    wanted = fx.units.select(u.alias("command_id"), u.alias("from_memory_uuid"), (u + F.when(u % 9 == 0, 0).otherwise(u % 5 + 1)).alias("to_memory_uuid"), kind.alias("relation_type"), (u % 120).cast("int").alias("weight"))
    return graph.add_errors(wanted, fx.units, fx.relations)


@query(
    """SELECT uuid, from_memory_uuid, to_memory_uuid, CASE WHEN uuid % 4 = 0 THEN 'elaborates' ELSE relation_type END AS relation_type,
       CASE WHEN uuid % 4 = 0 THEN 55 ELSE weight END AS weight, CASE WHEN uuid % 8 = 0 THEN 'seen' END AS note, created_at FROM memory_relations""",
    RELATIONS,
)
def relation_patch(fx):
    u = F.col("uuid")
    patches = fx.relations.where(u % 4 == 0).select("uuid", F.lit("elaborates").alias("new_type"), F.lit(55).alias("new_weight"), F.when(u % 8 == 0, " seen ").otherwise("").alias("new_note"))
    return graph.patch_relations(fx.relations, patches)


@query(
    """SELECT from_memory_uuid, to_memory_uuid, upper(relation_type) AS label, uuid AS relation_uuid, weight, note, created_at FROM memory_relations
       WHERE coalesce(weight, 0) <= 80 AND from_memory_uuid IN (FROM live) AND to_memory_uuid IN (FROM live)""",
    UNITS, RELATIONS, "live AS (SELECT uuid FROM memory_units WHERE CASE status WHEN 'pending' THEN 'active' ELSE CASE WHEN category = 'es' THEN 'trashed' ELSE status END END = 'active')",
)
def graph_refresh(fx):
    """The stored graph's edges after approvals, deletions of a category's records and of heavy relations, from what these touch."""
    status = F.when(F.col("status") == "pending", "active").when((F.col("category") == "es"), "trashed").otherwise(F.col("status"))
    # Tables as a store has them: else a task sorts for all the joins that make them, and for those that read them, at once.
    held = materialize(fx.relations)
    units, relations = fx.units.withColumn("status", status), held.where(F.coalesce("weight", F.lit(0)) <= 80)
    stored = materialize(graph.edges(fx.units, held))
    touched = materialize(fx.units.where("status = 'pending' or category = 'es'").select("uuid"))
    _, (fresh, gone) = graph.refresh(units, relations, stored, touched, held.where("weight > 80").select("uuid"))
    fresh, gone = materialize(fresh), materialize(gone)
    return stored.join(gone, "relation_uuid", "left_anti").select(*fresh.columns).union(fresh)


TWICE = """twice AS (SELECT uuid, from_memory_uuid, to_memory_uuid, relation_type FROM memory_relations
  UNION ALL SELECT uuid + 1000000000, from_memory_uuid, to_memory_uuid, 'applies_to' FROM memory_relations WHERE weight < 30 AND relation_type <> 'applies_to')"""


@query(
    """SELECT p.uuid, new_type, new_weight, new_note, CASE WHEN new_type IS NULL AND new_weight IS NULL AND new_note IS NULL THEN 'NO_CHANGE' WHEN new_type = 'likes' THEN 'INVALID_TYPE' WHEN new_weight > 100 THEN 'INVALID_WEIGHT'
              WHEN t.uuid IS NULL THEN 'NOT_FOUND' WHEN EXISTS (SELECT 1 FROM twice o WHERE o.uuid <> p.uuid AND o.from_memory_uuid = t.from_memory_uuid AND o.to_memory_uuid = t.to_memory_uuid AND o.relation_type = new_type) THEN 'RELATION_EXISTS' END AS error_code
       FROM (SELECT CASE WHEN weight = 50 THEN -uuid ELSE uuid END AS uuid, CASE WHEN weight = 7 THEN 'likes' WHEN weight > 15 THEN 'applies_to' END AS new_type, CASE WHEN weight > 15 THEN CAST(weight + 10 AS INT) END AS new_weight,
                    CASE WHEN weight = 3 THEN '' END AS new_note FROM memory_relations) p LEFT JOIN twice t ON t.uuid = p.uuid""",
    RELATIONS, TWICE,
)
def relation_patch_errors(fx):
    """Patches to a kind that some pairs have already by another relation."""
    w = F.col("weight")
    own = fx.relations.select("uuid", "from_memory_uuid", "to_memory_uuid", "relation_type")
    more = fx.relations.where((w < 30) & (F.col("relation_type") != "applies_to")).select((F.col("uuid") + 1_000_000_000).alias("uuid"), "from_memory_uuid", "to_memory_uuid", F.lit("applies_to").alias("relation_type"))
    patches = fx.relations.select(
        F.when(w == 50, -F.col("uuid")).otherwise(F.col("uuid")).alias("uuid"), F.when(w == 7, "likes").when(w > 15, "applies_to").alias("new_type"),
        F.when(w > 15, (w + 10).cast("int")).alias("new_weight"), F.when(w == 3, "").alias("new_note"),
    )
    return graph.patch_errors(patches, own.union(more))


@query(
    """SELECT source, uuid, min(steps) AS steps FROM reached GROUP BY ALL""",
    UNITS, RELATIONS, "live AS (SELECT uuid FROM memory_units WHERE status = 'active')",
    """ways AS (SELECT from_memory_uuid AS a, to_memory_uuid AS b FROM memory_relations WHERE from_memory_uuid IN (FROM live) AND to_memory_uuid IN (FROM live)
       UNION SELECT to_memory_uuid, from_memory_uuid FROM memory_relations WHERE from_memory_uuid IN (FROM live) AND to_memory_uuid IN (FROM live))""",
    CHANGES, """reached AS (SELECT memory_uuid AS source, memory_uuid AS uuid, 0 AS steps FROM memory_changes WHERE memory_uuid IN (FROM live)
       UNION SELECT source, b, steps + 1 FROM reached JOIN ways ON a = reached.uuid WHERE steps < 3)""",
)
def graph_reach(fx):
    """Records that relations lead to in at most three steps from those with an open change."""
    return graph.reachable(fx.units, fx.relations, fx.changes.select(F.col("memory_uuid").alias("uuid")), 3)


@query("SELECT * FROM memory_relations WHERE uuid % 3 <> 0", RELATIONS)
def relation_delete(fx):
    return graph.delete_relations(fx.relations, fx.relations.where("uuid % 3 = 0"))


BOTH = "from_memory_uuid IN (SELECT uuid FROM memory_units WHERE status = 'active') AND to_memory_uuid IN (SELECT uuid FROM memory_units WHERE status = 'active')"


@query(f"SELECT true AS dirty, (SELECT count(*) FROM memory_units WHERE status = 'active') AS nodes, (SELECT count(*) FROM memory_relations WHERE {BOTH}) AS edges", UNITS, RELATIONS)
def graph_status(fx):
    return graph.status(fx.units, fx.relations).drop("updated_at")


@query("SELECT uuid, category, title_norm, status, coalesce(summary, '') AS summary FROM memory_units WHERE status = 'active'", UNITS)
def graph_vertices(fx):
    return graph.vertices(fx.units)


@query(f"SELECT from_memory_uuid, to_memory_uuid, upper(relation_type) AS label, uuid AS relation_uuid, weight, note, created_at FROM memory_relations WHERE {BOTH}", UNITS, RELATIONS)
def graph_edges(fx):
    return graph.edges(fx.units, fx.relations)


# Edits


@query(
    """SELECT uuid AS command_id, CASE WHEN uuid % 13 = 0 THEN 'EMPTY_TITLE' WHEN uuid % 17 = 0 THEN 'INVALID_CATEGORY' WHEN uuid % 19 = 0 THEN 'NO_KEYWORDS'
       WHEN uuid % 5 = 0 THEN 'DUPLICATE_KEYWORD' WHEN uuid % 7 = 0 THEN 'EMPTY_RECALL_WHEN' END AS error_code FROM memory_units""",
    UNITS,
)
def create_validation_errors(fx):
    u = F.col("uuid")
    words = F.when(u % 19 == 0, F.array().cast("array<string>")).when(u % 5 == 0, F.array(F.lit("A  b"), F.lit("a b"))).otherwise(F.array(F.lit("one"), F.lit("two")))
    made = fx.units.select(
        u.alias("command_id"), F.when(u % 17 == 0, "other").alias("category"), F.when(u % 13 == 0, "  ").otherwise(F.lit("title")).alias("title"), "content", "summary",
        words.alias("keywords"), F.when(u % 7 == 0, " ").alias("recall_when"), F.lit(False).alias("init_authorised"),
    )
    return commands.create_errors(made)


DUPLICATES = """SELECT c.uuid AS command_id, CASE WHEN EXISTS (SELECT 1 FROM memory_units u WHERE u.title_norm = c.title_norm {other}) THEN 'title'
  WHEN EXISTS (SELECT 1 FROM memory_units u WHERE u.content = c.content {other}) THEN 'content' WHEN EXISTS (SELECT 1 FROM memory_units u WHERE u.summary = c.summary {other}) THEN 'summary' END AS duplicate_field
  FROM (SELECT uuid, CASE WHEN uuid % 2 = 0 THEN concat('new ', uuid) ELSE title_norm END AS title_norm, CASE WHEN uuid % 4 = 0 THEN concat('new ', uuid) ELSE content END AS content, summary FROM memory_units) c"""


def _new_fields(fx):
    u = F.col("uuid")
    new = F.concat(F.lit("new "), u.cast("string"))
    return fx.units.select("uuid", u.alias("command_id"), F.when(u % 2 == 0, new).otherwise(F.col("title_norm")).alias("new_title_norm"), F.when(u % 4 == 0, new).otherwise(F.col("content")).alias("new_content"), F.col("summary").alias("new_summary"))


@query(DUPLICATES.format(other=""), UNITS)
def create_duplicates(fx):
    return commands.duplicates(_new_fields(fx).drop("uuid"), fx.units)


@query(DUPLICATES.format(other="AND u.uuid <> c.uuid AND u.status <> 'trashed'"), UNITS)
def update_duplicates(fx):
    return commands.duplicates(_new_fields(fx), fx.units, update=True)


@query(
    f"""SELECT c.uuid AS command_id, c.uuid, CASE WHEN u.status = 'trashed' THEN 'NOT_FOUND' WHEN c.revision <> u.revision THEN 'REVISION_CONFLICT' WHEN c.hash <> {_hash('u.content')} THEN 'HASH_CONFLICT' END AS error_code
        FROM memory_units u JOIN (SELECT uuid, CASE WHEN category = 'fr' THEN 2 ELSE revision END AS revision, {_hash("replace(content, 'worthless', 'worthy')")} AS hash FROM memory_units) c USING (uuid)""",
    UNITS,
)
def optimistic_lock_check(fx):
    """Clients that have seen revision 2 of all records of a category, and that of all others; and their contents before a word was replaced."""
    from ..functions.text import json_hash, json_string

    seen = json_hash(F.coalesce(json_string(F.replace("content", F.lit("worthless"), F.lit("worthy"))), F.lit("null")))
    sent = fx.units.select(F.col("uuid").alias("command_id"), "uuid", F.when(F.col("category") == "fr", 2).otherwise(F.col("revision")).alias("revision"), F.lit("content").alias("field"), seen.alias("hash"))
    return commands.lock_errors(sent, fx.units)


@query(
    """SELECT uuid, t AS title_norm, category, content, s AS summary, recall_when, concat_ws(',', CASE WHEN t IS DISTINCT FROM title_norm THEN 'title_norm' END, CASE WHEN s IS DISTINCT FROM summary THEN 'summary' END) AS updated_fields,
       revision + CASE WHEN t IS DISTINCT FROM title_norm OR s IS DISTINCT FROM summary THEN 1 ELSE 0 END AS revision,
       CASE WHEN t IS NOT DISTINCT FROM title_norm AND s IS NOT DISTINCT FROM summary THEN 'NO_CHANGE' END AS error_code
       FROM (SELECT *, CASE WHEN uuid % 2 = 0 THEN concat('new title ', uuid) ELSE title_norm END AS t, CASE WHEN uuid % 3 = 1 THEN 'new summary' ELSE summary END AS s FROM memory_units)""",
    UNITS,
)
def apply_replace(fx):
    u, none = F.col("uuid"), F.lit(None).cast("string")
    sent = fx.units.select("uuid", F.when(u % 2 == 0, F.concat(F.lit(" New  Title "), u.cast("string"))).alias("new_title_norm"), none.alias("new_category"), none.alias("new_content"), F.when(u % 3 == 1, " new summary ").alias("new_summary"), none.alias("new_recall_when"))
    return commands.replace_fields(sent, fx.units).withColumn("updated_fields", F.array_join("updated_fields", ","))


@query(
    """SELECT uuid, CASE WHEN n = 1 THEN replace(content, m, '<<>>') ELSE content END AS content, revision + CASE WHEN n = 1 THEN 1 ELSE 0 END AS revision,
       CASE WHEN n = 0 THEN 'MATCH_NOT_FOUND' WHEN n > 1 THEN 'MATCH_AMBIGUOUS' END AS error_code
       FROM (SELECT *, CASE WHEN m = '' THEN 0 ELSE (length(content) - length(replace(content, m, ''))) // greatest(1, length(m)) END AS n FROM (SELECT *, CASE WHEN uuid % 2 = 0 THEN substring(content, 5, 12) ELSE 'e' END AS m FROM memory_units))""",
    UNITS,
)
def apply_patch_content(fx):
    part = F.when(F.col("uuid") % 2 == 0, F.substring("content", 5, 12)).otherwise("e")
    return commands.patch_content(fx.units.select("uuid", part.alias("match"), F.lit("<<>>").alias("replacement")), fx.units)


@query(
    """SELECT uuid, CASE uuid % 3 WHEN 0 THEN content || ' more' ELSE content END AS content, CASE uuid % 3 WHEN 1 THEN coalesce(recall_when, '') || ' more' ELSE recall_when END AS recall_when,
       revision + CASE WHEN uuid % 3 < 2 THEN 1 ELSE 0 END AS revision, CASE WHEN uuid % 3 = 2 THEN 'EXACTLY_ONE_FIELD' END AS error_code FROM memory_units""",
    UNITS,
)
def apply_append(fx):
    way = F.col("uuid") % 3
    return commands.append_text(fx.units.select("uuid", F.when(way != 1, " more").alias("append_content"), F.when(way != 0, " more").alias("append_recall_when")), fx.units)


HELD = "held AS (SELECT memory_uuid AS uuid, list(keyword_norm) AS held FROM memory_keywords GROUP BY 1)"


@query(
    """SELECT uuid, list_aggregate(list_sort(CASE WHEN e IS NULL THEN list_distinct(list_concat(held, w)) ELSE held END), 'string_agg', ',') AS keywords, revision + CASE WHEN e IS NULL THEN 1 ELSE 0 END AS revision, e AS error_code
       FROM (SELECT u.uuid, u.revision, h.held, w, CASE WHEN uuid % 4 = 0 THEN 'DUPLICATE_KEYWORD' WHEN len(list_intersect(w, held)) > 0 THEN 'KEYWORD_EXISTS' END AS e
             FROM (SELECT *, CASE WHEN uuid % 4 = 0 THEN ['x y', 'x y'] WHEN uuid % 4 = 1 THEN ['src1', 'fresh'] ELSE ['fresh', 'word'] END AS w FROM memory_units) u JOIN held h USING (uuid))""",
    UNITS, KEYWORDS, HELD,
)
def apply_add_keywords(fx):
    way = F.col("uuid") % 4
    words = F.when(way == 0, F.array(F.lit("X  y"), F.lit("x y"))).when(way == 1, F.array(F.lit("SRC1"), F.lit("fresh"))).otherwise(F.array(F.lit("fresh"), F.lit(" Word")))
    return commands.change_keywords(fx.units.select("uuid", words.alias("words")), fx.units, fx.keywords, add=True).withColumn("keywords", F.array_join("keywords", ","))


@query(
    """SELECT uuid, list_aggregate(list_sort(CASE WHEN e IS NULL THEN list_filter(held, lambda x: x <> lang) ELSE held END), 'string_agg', ',') AS keywords, revision + CASE WHEN e IS NULL THEN 1 ELSE 0 END AS revision, e AS error_code
       FROM (SELECT u.uuid, u.revision, h.held, u.category AS lang, CASE WHEN uuid % 2 = 1 THEN 'KEYWORD_NOT_FOUND' END AS e FROM memory_units u JOIN held h USING (uuid))""",
    UNITS, KEYWORDS, HELD,
)
def apply_remove_keywords(fx):
    words = F.when(F.col("uuid") % 2 == 0, F.array("category")).otherwise(F.array(F.lit("never heard")))
    return commands.change_keywords(fx.units.select("uuid", words.alias("words")), fx.units, fx.keywords, add=False).withColumn("keywords", F.array_join("keywords", ","))


@query(
    """SELECT user_id AS memory_uuid, min_by(event_type, event_id) AS action, min_by(props, event_id) AS before_state, max_by(props, event_id) AS after_state, count(*) AS edits
       FROM events WHERE event_type IN ('signup', 'click', 'error') GROUP BY 1"""
)
def change_baseline(fx):
    e = fx.table("events").where("event_type in ('signup', 'click', 'error')")
    return commands.change_baseline(e.select(F.col("user_id").alias("memory_uuid"), F.col("event_id").alias("order_id"), F.col("event_type").alias("action"), F.col("props").alias("before_state"), F.col("props").alias("after_state")))


CASES = """cases AS (SELECT u.uuid, u.status, c.action, CASE WHEN u.uuid % 9 = 0 THEN 'REVISION_CONFLICT' WHEN u.status = 'trashed' AND c.action IS NOT DISTINCT FROM 'delete' THEN 'already_deleted'
  WHEN u.status = 'pending' AND c.action IS NOT DISTINCT FROM 'create' THEN 'discard_pending' WHEN u.status = 'active' AND c.action IS NULL THEN 'delete_active'
  WHEN c.action IS NOT NULL THEN 'delete_changed' ELSE 'STATE_ERROR' END AS "case", u.revision, u.trashed_at FROM memory_units u LEFT JOIN memory_changes c ON c.memory_uuid = u.uuid)"""


def _deletes(fx):
    sent = fx.units.select("uuid", (F.col("revision") + F.when(F.col("uuid") % 9 == 0, 1).otherwise(0)).alias("revision"))
    return commands.classify_deletes(sent, fx.units, fx.changes)


@query('SELECT uuid, status, action, "case" FROM cases', UNITS, CHANGES, CASES)
def delete_classify(fx):
    return _deletes(fx)


@query(
    """SELECT uuid, CASE WHEN m THEN 'trashed' ELSE status END AS next_status, CASE WHEN m THEN coalesce(trashed_at, TIMESTAMP '2024-01-09 12:00:00') ELSE trashed_at END AS trashed_at,
       revision + CAST(m AS INT) AS revision, m AND status = 'active' AS dirty FROM (SELECT *, "case" IN ('discard_pending', 'delete_active', 'delete_changed') AS m FROM cases)""",
    UNITS, CHANGES, CASES,
)
def apply_delete(fx):
    return commands.apply_deletes(_deletes(fx), fx.units, as_of())


@query(
    """SELECT uuid, CASE WHEN e IS NULL THEN concat('edited ', uuid) ELSE title_norm END AS title_norm, CASE WHEN e IS NULL THEN NULL ELSE summary END AS summary,
       CASE WHEN e IS NULL THEN 'later ' ELSE recall_when END AS recall_when, CASE WHEN e IS NULL THEN ' kept as is ' ELSE content END AS content,
       CASE WHEN e IS NULL THEN 'a word,src1' ELSE coalesce(held, '') END AS keywords, revision + CASE WHEN e IS NULL THEN 1 ELSE 0 END AS revision, e AS error_code
       FROM (SELECT u.*, h.held, CASE WHEN category = 'fr' AND summary IS NOT NULL THEN 'EMPTY_SUMMARY' WHEN recall_when = 'when src2' THEN 'NO_KEYWORDS' WHEN recall_when = 'when src3' THEN 'EMPTY_KEYWORD'
                    WHEN recall_when = 'when src4' THEN 'DUPLICATE_KEYWORD' WHEN status <> 'active' THEN 'NOT_ACTIVE' WHEN revision <> greatest(2, revision) THEN 'REVISION_CONFLICT' END AS e
             FROM memory_units u LEFT JOIN (SELECT memory_uuid, string_agg(keyword_norm, ',' ORDER BY keyword_norm) AS held FROM memory_keywords GROUP BY 1) h ON h.memory_uuid = u.uuid)""",
    UNITS, KEYWORDS,
)
def apply_full_edit(fx):
    """Edits whose summaries are blank in a category, whose keywords are missing, blank or doubled in some, and whose revision is 2 at least."""
    words = lambda *ws: F.array(*map(F.lit, ws)).cast("array<string>")
    when = F.col("recall_when")
    keywords = F.when(when == "when src2", words()).when(when == "when src3", words(" ", "x")).when(when == "when src4", words("x", " X ")).otherwise(words("SRC1", "a  Word"))
    sent = fx.units.select(
        "uuid", F.greatest(F.lit(2), "revision").alias("expected_revision"), F.concat(F.lit(" Edited  "), F.col("uuid").cast("string")).alias("new_title"),
        F.when((F.col("category") == "fr") & F.col("summary").isNotNull(), " ").alias("new_summary"), F.lit("later ").alias("new_recall_when"), F.lit(" kept as is ").alias("new_content"), keywords.alias("new_keywords"),
    )
    return commands.full_edit(sent, fx.units, fx.keywords).withColumn("keywords", F.array_join("keywords", ","))


@query(
    """SELECT 'keywords' AS child, count(*) AS n FROM memory_keywords WHERE memory_uuid % 10 <> 0
       UNION ALL SELECT 'relations', count(*) FROM memory_relations WHERE from_memory_uuid % 10 <> 0 AND to_memory_uuid % 10 <> 0
       UNION ALL SELECT 'embeddings', count(*) FROM memory_embeddings WHERE memory_uuid % 10 <> 0
       UNION ALL SELECT 'usage', count(*) FROM memory_usage WHERE memory_uuid % 10 <> 0""",
    KEYWORDS, RELATIONS, EMBEDDINGS, USAGE,
)
def cascade_delete_counts(fx):
    gone = fx.table("embeddings").select(F.col("vec_id").alias("uuid")).union(fx.table("documents").select("doc_id")).where("uuid % 10 = 0").distinct()
    left = commands.cascade(
        gone, keywords=(fx.keywords, ("memory_uuid",)), relations=(fx.relations, ("from_memory_uuid", "to_memory_uuid")), embeddings=(fx.embeddings, ("memory_uuid",)), usage=(fx.usage, ("memory_uuid",))
    )
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, rows in left.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


# Review

REVIEW = "review AS (SELECT c.*, u.status, u.revision, u.category, u.title_norm, u.content, u.summary, u.recall_when FROM memory_changes c JOIN memory_units u ON u.uuid = c.memory_uuid WHERE NOT (c.action = 'delete' AND u.status = 'trashed'))"


@query(
    """SELECT memory_uuid AS uuid, action, CASE WHEN action = 'create' THEN 'active' ELSE status END AS next_status, revision + CAST(action = 'create' AS INT) AS revision, action = 'delete' AS removed, action IN ('create', 'delete') AS dirty FROM review""",
    UNITS, CHANGES, REVIEW,
)
def apply_approve(fx):
    return review.approve(fx.changes, fx.units)


def _with_states(fx):
    """Changes whose state before is a snapshot: the record's own one, with another summary."""
    before = listing.snapshots(fx.units, fx.keywords, fx.relations)
    before = before.withColumn("memory", F.col("memory").withField("summary", F.concat(F.lit("before "), F.col("uuid").cast("string"))))
    return fx.changes.drop("before_state").join(before.select(F.col("uuid").alias("memory_uuid"), listing.state_json().alias("before_state")), "memory_uuid", "left")


@query(
    """SELECT memory_uuid AS uuid, action, action = 'create' AS removed, category, title_norm, content, CASE WHEN action = 'create' THEN summary ELSE concat('before ', memory_uuid) END AS summary, recall_when, revision + 1 AS revision FROM review""",
    UNITS, CHANGES, REVIEW,
)
def apply_reject(fx):
    return review.reject(_with_states(fx), fx.units)


#: The state that trashed records had before: active without a recall text, else pending; one category was in the trash already.
WERE = "CASE WHEN u.category = 'de' THEN 'trashed' WHEN u.recall_when IS NULL AND u.summary IS NULL THEN 'pending' ELSE 'active' END"


def _trashed_states(fx):
    """Deletions of the trashed records: the state before has their keywords and relations, other texts, and the status before."""
    own = _states(fx).where("memory.status = 'trashed'")
    m = lambda f: F.col(f"memory.{f}")
    was = F.when(m("category") == "de", "trashed").when(m("recall_when").isNull() & m("summary").isNull(), "pending").otherwise("active")
    old = F.col("memory").withField("title_norm", F.concat(F.lit("before "), m("title_norm"))).withField("content", F.lit("before")).withField("status", was).withField("trashed_at", F.lit(None).cast("timestamp_ntz"))
    return own.withColumn("memory", old).select(F.col("uuid").alias("memory_uuid"), F.lit("delete").alias("action"), listing.state_json().alias("before_state"))


@query(
    f"""SELECT uuid, category, CASE WHEN w = 'trashed' THEN title_norm ELSE 'before ' || title_norm END AS title_norm, CASE WHEN w = 'trashed' THEN content ELSE 'before' END AS content, summary, recall_when,
        w AS next_status, CASE WHEN w = 'trashed' THEN trashed_at END AS trashed_at, CASE WHEN w = 'pending' THEN 'create' END AS open_action, CASE WHEN w = 'pending' THEN 'before' END AS after_content,
        revision + CASE WHEN w = 'trashed' THEN 0 ELSE 1 END AS revision, w = 'active' AS dirty, CASE WHEN w = 'trashed' THEN 'STATE_ERROR' END AS error_code
        FROM (SELECT u.*, {WERE} AS w FROM memory_units u WHERE u.status = 'trashed')""",
    UNITS,
)
def apply_trash_restore(fx):
    rows = review.restore(_trashed_states(fx), fx.units)
    return rows.withColumn("after_content", F.get_json_object("after_state", "$.memory.content")).drop("after_state")


@query(
    """SELECT memory_uuid, keyword_norm, weight FROM memory_keywords JOIN memory_units u ON u.uuid = memory_uuid WHERE status = 'trashed'""",
    UNITS, KEYWORDS,
)
def restored_keywords(fx):
    return review.restored_keywords(_trashed_states(fx)).select(F.col("memory_uuid").cast("long").alias("memory_uuid"), "keyword_norm", "weight")


@query(
    """SELECT CAST(from_memory_uuid AS VARCHAR) AS from_memory_uuid, CAST(to_memory_uuid AS VARCHAR) AS to_memory_uuid, relation_type, weight, note,
       sha256(concat(from_memory_uuid, '|', to_memory_uuid, '|', relation_type)) AS uuid FROM memory_relations
       WHERE from_memory_uuid IN (SELECT uuid FROM memory_units WHERE status = 'trashed') OR to_memory_uuid IN (SELECT uuid FROM memory_units WHERE status = 'trashed')""",
    UNITS, RELATIONS,
)
def restored_relations(fx):
    return review.restored_relations(_trashed_states(fx))


@query(
    """SELECT w.uuid, CASE WHEN u.uuid IS NULL THEN 'NOT_FOUND' WHEN u.status <> 'trashed' THEN 'NOT_TRASHED' WHEN c.action IS DISTINCT FROM 'delete' THEN 'INVARIANT_ERROR' END AS error_code
       FROM (SELECT uuid * 2 AS uuid FROM memory_units) w LEFT JOIN memory_units u ON u.uuid = w.uuid LEFT JOIN memory_changes c ON c.memory_uuid = w.uuid""",
    UNITS, CHANGES,
)
def trash_delete(fx):
    return review.delete_from_trash(fx.units.select((F.col("uuid") * 2).alias("uuid")), fx.changes, fx.units)


DUE = "SELECT c.memory_uuid FROM memory_changes c JOIN memory_units u ON u.uuid = c.memory_uuid WHERE c.action = 'delete' AND u.status = 'trashed' AND u.trashed_at + INTERVAL 10080 MINUTE <= TIMESTAMP '2024-01-09 12:00:00'"


@query(f"SELECT uuid, trashed_at FROM memory_units WHERE uuid IN ({DUE})", UNITS, CHANGES)
def expired_trash(fx):
    return review.expired(fx.changes, fx.units, as_of(), RETENTION)


@query(f"SELECT uuid, status FROM memory_units WHERE uuid NOT IN ({DUE})", UNITS, CHANGES)
def retained_units(fx):
    gone = review.expired(fx.changes, fx.units, as_of(), RETENTION)
    return commands.cascade(gone, units=(fx.units, ("uuid",)))["units"].select("uuid", "status")


# Reports

PROBES = "probes AS (SELECT event_type AS stage, CAST(user_id % 3 AS INT) AS status, event_type <> 'error' OR event_id % 10 <> 0 AS ok, value AS latency_ms, ts FROM events)"


def _probes(fx):
    ok = (F.col("event_type") != "error") | (F.col("event_id") % 10 != 0)
    return fx.table("events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).cast("int").alias("status"), ok.alias("ok"), F.col("value").alias("latency_ms"), "ts")


SUMMARY = """summary AS (SELECT stage, count(*) AS requests, count(*) FILTER (WHERE ok) AS successes, round(1 - count(*) FILTER (WHERE ok) / count(*), 6) AS error_rate,
  round(s, 3) AS duration_s, round(count(*) / s, 3) AS rps, round(avg(latency_ms), 3) AS avg_ms, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
  quantile_disc(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms FROM probes JOIN (SELECT stage, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM probes GROUP BY 1) USING (stage) GROUP BY stage, s)"""


@query("SELECT * FROM summary", PROBES, SUMMARY)
def latency_summary(fx):
    return load.summarise(_probes(fx))


@query("SELECT stage, status, count(*) AS n FROM probes GROUP BY 1, 2", PROBES)
def status_histogram(fx):
    return load.status_histogram(_probes(fx))


@query("SELECT stage, error_rate < 0.01 AND p95_ms < 500 AND p99_ms < 1000 AS accepted, error_rate >= 0.05 OR p99_ms >= 3000 AS stop FROM summary", PROBES, SUMMARY)
def load_gate(fx):
    return load.gate(load.summarise(_probes(fx)))


@query(
    """SELECT memory_uuid, CAST(sum(n) AS BIGINT) AS use_count, max(t) AS last_used_at FROM (
         SELECT memory_uuid, use_count AS n, last_used_at AS t FROM memory_usage
         UNION ALL SELECT user_id, 1, ts FROM events JOIN memory_units ON uuid = user_id WHERE event_type = 'click' AND status <> 'trashed') GROUP BY 1""",
    USAGE, UNITS,
)
def usage_rollup(fx):
    uses = fx.table("events").where("event_type = 'click'").select(F.col("user_id").alias("memory_uuid"), F.col("ts").cast("timestamp_ntz").alias("used_at"))
    return load.usage(fx.usage, uses, fx.units)
