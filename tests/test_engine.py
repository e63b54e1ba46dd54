"""A record's life through the engine: created, found, approved, edited, rejected, deleted."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.engine import EditError, Engine
from tessera.operators import commands, graph, index, search
from tessera.plans.fixtures import Fixtures
from tessera.sources.store import Delta, Store

NOW = datetime(2024, 1, 9, 12)


def test_life_of_records(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "store")))
    a = e.create_memory(NOW, " First  Title ", "Some content about rivers", ["Water", "maps"])
    b = e.create_memory(NOW.replace(minute=1), "second", "Other content about roads", ["maps"])
    with pytest.raises(EditError, match="DUPLICATE_TITLE"):
        e.create_memory(NOW, "first title", "x", ["k"])
    with pytest.raises(EditError, match="NO_KEYWORDS"):
        e.create_memory(NOW, "t", "x", [])
    assert e.search_memory({"query": "rivers"})["results"][0]["memory_uuid"] == a
    e.approve(NOW, a)
    e.approve(NOW, b)
    assert {r.uuid for r in e.list_memories().collect()} == {a, b} and e.list_changes().count() == 0
    assert [(r.from_memory_uuid, r.to_memory_uuid, r.note) for r in e.relations.collect()] == [(b, a, "auto: shared_keywords=1")]
    h = e.read_memory_hash(a).first()
    assert h["title_norm"] == "first title"
    with pytest.raises(EditError, match="REVISION_CONFLICT"):
        e.update_memory_patch_content(NOW, a, h["revision"] + 1, "rivers", "lakes")
    e.update_memory_patch_content(NOW, a, h["revision"], "rivers", "lakes")
    e.update_memory_add_keywords(NOW, a, h["revision"] + 1, ["New Word"])
    assert e.search_memory({"query": "lakes"})["count"] == 1
    assert e.change(a).first()["action"] == "update"
    e.reject(NOW, a)
    row = e.read_memory(a).first()
    assert row.memory.content == "Some content about rivers" and [k.keyword_norm for k in row.keywords] == ["maps", "water"] and e.relations.count() == 1
    assert e.delete_memory(NOW, b, e.read_memory_hash(b).first()["revision"]) == "delete_active"
    assert [r.memory_uuid for r in e.list_trash().collect()] == [b] and e.search_memory({"query": "roads"})["count"] == 0
    assert e.graph_status().first()["dirty"]


def test_edits_and_relations(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "store")), model="m", embed=lambda text: [float(len(text)), 1.0])
    a = e.create_memory(NOW, "first", "content one", ["maps"], summary="short")
    b = e.create_memory(NOW.replace(minute=1), "second", "content two", ["maps"])
    e.approve(NOW, a)
    e.approve(NOW, b)
    assert e.embeddings.count() == 0 and e.embed_pending() == 2 and e.embed_pending() == 0
    assert {r.memory_uuid for r in e.embeddings.collect()} == {a, b} and all(r.embedding_model == "m" for r in e.embeddings.collect())
    seen = e.read_memory_hash(a).first()
    hashes = {"title_norm": seen["title_hash"], "summary": seen["summary_hash"], "category": seen["category_hash"]}
    for new, code in (({"title_norm": "second"}, "DUPLICATE_TITLE"), ({"title_norm": " "}, "EMPTY_TITLE"), ({"category": "nonsense Cat"}, "INVALID_CATEGORY"), ({"content": "x"}, "HASH_MISSING")):
        with pytest.raises(EditError, match=code):
            e.update_memory_replace(NOW, a, seen["revision"], hashes, **new)
    e.update_memory_replace(NOW, a, seen["revision"], hashes, summary=None)
    assert e.read_memory(a).first().memory.summary is None
    assert e.rebuild_graph(NOW) and not e.rebuild_graph(NOW) and not e.graph_status().first()["dirty"]
    revision = e.read_memory(a).first().memory.revision
    r = e.add_relation(NOW, a, b, "depends_on", 10, " why ")
    with pytest.raises(EditError, match="RELATION_EXISTS"):
        e.add_relation(NOW, a, b, "depends_on")
    e.patch_relation(NOW, r, weight=20, note="")
    row = e.relations.where(f"uuid = '{r}'").first()
    assert (row.weight, row.note) == (20, None) and e.read_memory(a).first().memory.revision == revision + 2 and e.graph_status().first()["dirty"]
    e.delete_relation(NOW, r)
    assert e.relations.where(f"uuid = '{r}'").count() == 0 and e.change(a).first()["action"] == "update"
    e.delete_memory(NOW, b, e.read_memory(b).first().memory.revision)
    e.restore(NOW, b)
    assert e.read_memory(b).first().memory.status == "active" and e.list_trash().count() == 0
    e.delete_memory(NOW, b, e.read_memory(b).first().memory.revision)
    e.delete_forever(NOW, b)
    assert e.units.count() == 1 and e.embeddings.count() == 1 and e.relations.count() == 0
    with pytest.raises(EditError, match="NOT_FOUND"):
        e.restore(NOW, b)


@pytest.fixture
def pair(spark, tmp_path):
    """Two active records without relations but the automatic one."""
    e = Engine(Store(spark, str(tmp_path / "store")))
    a = e.create_memory(NOW, "first", "content one", ["maps"], summary="short")
    b = e.create_memory(NOW.replace(minute=1), "second", "content two", ["maps"])
    e.approve(NOW, a)
    e.approve(NOW, b)
    return e, a, b


def revision(e, uuid):
    return e.units.where(f"uuid = '{uuid}'").first()["revision"]


def test_restore_leaves_no_unreviewed_edit(pair):
    """What was edited without review before the deletion isn't live after the restoration."""
    e, a, b = pair
    seen = e.read_memory(a).first()
    e.update_memory_append(NOW, a, revision(e, a), content=" UNREVIEWED")
    e.update_memory_add_keywords(NOW, a, revision(e, a), ["unreviewed"])
    e.add_relation(NOW, a, b, "depends_on")
    assert e.delete_memory(NOW, a, revision(e, a)) == "delete_changed"
    e.rebuild_graph(NOW)
    e.restore(NOW, a)
    back = e.read_memory(a).first()
    assert back.memory.content == "content one" and back.memory.status == "active" and back.memory.trashed_at is None
    assert [k.keyword_norm for k in back.keywords] == ["maps"]
    assert [(r.from_memory_uuid, r.to_memory_uuid, r.relation_type) for r in back.relations] == [(r.from_memory_uuid, r.to_memory_uuid, r.relation_type) for r in seen.relations]
    assert e.list_changes().count() == 0 and e.list_trash().count() == 0 and e.graph_status().first()["dirty"]
    assert e.search_memory({"query": "unreviewed"})["count"] == 0


def test_restored_creations_are_reviewed_again(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "store")))
    a = e.create_memory(NOW, "first", "content one", ["maps"])
    e.update_memory_append(NOW, a, 1, content=" more")
    state = e.changes.first()["after_state"]
    assert e.delete_memory(NOW, a, 2) == "discard_pending"
    e.restore(NOW, a)
    change = e.changes.first()
    assert (change["action"], change["before_state"], change["after_state"]) == ("create", None, state)
    assert e.units.first()["status"] == "pending" and e.units.first()["content"] == "content one more"
    e.approve(NOW, a)
    assert e.units.first()["status"] == "active" and e.changes.count() == 0


def test_every_edit_of_an_active_record_marks_the_graph(pair):
    e, a, b = pair
    h = e.read_memory_hash(a).first()
    edits = [
        lambda: e.update_memory_replace(NOW, a, revision(e, a), {"title_norm": h["title_hash"]}, title_norm="third"),
        lambda: e.update_memory_patch_content(NOW, a, revision(e, a), "one", "1"),
        lambda: e.update_memory_append(NOW, a, revision(e, a), recall_when="later"),
        lambda: e.update_memory_add_keywords(NOW, a, revision(e, a), ["new"]),
        lambda: e.update_memory_remove_keywords(NOW, a, revision(e, a), ["new"]),
        lambda: e.edit_memory(NOW, a, revision(e, a), "Fourth  Title", "content four", ["k"]),
        lambda: e.add_relation(NOW, a, b, "elaborates"),
        lambda: e.reject(NOW, a),
        lambda: e.delete_memory(NOW, b, revision(e, b)),
    ]
    assert e.rebuild_graph(NOW)
    for edit in edits:
        assert not e.rebuild_graph(NOW)
        edit()
        assert e.rebuild_graph(NOW)
        v = e.view()
        read = lambda name: sorted(map(str, v.snapshot.read(name).collect()))
        assert read("graph_vertices") == sorted(map(str, graph.vertices(v.units).collect()))
        assert read("graph_edges") == sorted(map(str, graph.edges(v.units, v.relations).collect()))
    pending = e.create_memory(NOW, "fifth", "content five", ["k"])
    e.update_memory_append(NOW, pending, 1, content="!")
    assert not e.rebuild_graph(NOW)


def test_relations_touch_both_ends_and_are_there_once(pair):
    e, a, b = pair
    at = revision(e, a), revision(e, b)
    r = e.add_relation(NOW, a, b, "depends_on")
    assert (revision(e, a), revision(e, b)) == (at[0] + 1, at[1] + 1)
    assert [c["memory_uuid"] for c in e.changes.collect()] == [a]
    with pytest.raises(EditError, match="REVISION_CONFLICT"):
        e.update_memory_append(NOW, b, at[1], content="!")
    other = e.add_relation(NOW, a, b, "elaborates")
    for change, code in (({"kind": "depends_on"}, "RELATION_EXISTS"), ({"kind": "nonsense"}, "INVALID_TYPE"), ({"weight": 101}, "INVALID_WEIGHT"), ({}, "NO_CHANGE")):
        with pytest.raises(EditError, match=code):
            e.patch_relation(NOW, other, **change)
    e.patch_relation(NOW, other, kind="applies_to", note=" why ")
    assert {(x.relation_type, x.note) for x in e.relations.where(f"from_memory_uuid = '{a}'").collect()} == {("depends_on", None), ("applies_to", "why")}
    e.delete_relation(NOW, r)
    assert (revision(e, a), revision(e, b)) == (at[0] + 4, at[1] + 4)
    with pytest.raises(EditError, match="NOT_FOUND"):
        e.delete_relation(NOW, r)


def test_full_edit_checks_what_it_is_given(pair):
    e, a, b = pair
    n = revision(e, a)
    for keywords, code in (([], "NO_KEYWORDS"), ([" ", "k1"], "EMPTY_KEYWORD"), (["k1", "K1"], "DUPLICATE_KEYWORD")):
        with pytest.raises(EditError, match=code):
            e.edit_memory(NOW, a, n, "title", "content", keywords)
    with pytest.raises(EditError, match="EMPTY_SUMMARY"):
        e.edit_memory(NOW, a, n, "title", "content", ["k"], summary=" ")
    with pytest.raises(EditError, match="DUPLICATE_TITLE"):
        e.edit_memory(NOW, a, n, "Second", "content", ["k"])
    with pytest.raises(EditError, match="REVISION_CONFLICT"):
        e.edit_memory(NOW, a, n + 1, "title", "content", ["k"])
    e.edit_memory(NOW, a, n, " The  Title", " content ", ["Some  Word", "b"], recall_when="then")
    row = e.read_memory(a).first()
    assert (row.memory.title_norm, row.memory.content, row.memory.summary, row.memory.recall_when) == ("the title", " content ", None, "then")
    assert [(k.keyword_norm, k.weight) for k in row.keywords] == [("b", None), ("some word", None)]
    fields = {r.field: (r.removed, r.added) for r in e.change_fields(a).collect()}
    assert fields["content"] == ("content one", " content ") or fields["content"][1] != "" and set(fields) >= {"title_norm", "content", "summary", "keywords", "recall_when"}
    assert fields["summary"] == ("short", "-")


def test_nothing_of_a_record_stays_when_it_is_deleted(pair):
    e, a, b = pair
    now = e.store.snapshot()
    usage = e._row(schemas.USAGE, memory_uuid=a, use_count=3, last_used_at=NOW)
    e.store.commit(now, {"usage": Delta(usage), "embeddings": Delta(e._row(schemas.EMBEDDINGS, memory_uuid=a, embedding=[1.0], embedding_model="m", embedding_dimension=1))})
    e.delete_memory(NOW, a, revision(e, a))
    e.delete_forever(NOW, a)
    snap = e.store.snapshot()
    for name in ("units", "keywords", "relations", "changes", "embeddings", "usage", "search_index", "postings"):
        rows = snap.read(name)
        assert rows is None or not any(a in str(r) for r in rows.collect()), name


def test_a_failing_provider_does_not_fail_approvals(spark, tmp_path):
    def embed(text):
        if "broken" in text:
            raise ValueError("no vector")
        return [1.0, float(len(text))]

    e = Engine(Store(spark, str(tmp_path / "store")), model="m", embed=embed)
    a = e.create_memory(NOW, "broken one", "content one", ["maps"])
    b = e.create_memory(NOW.replace(minute=1), "second", "content two", ["maps"])
    e.approve(NOW, a)
    e.approve(NOW, b)
    assert e.embed_pending() == 1
    left = e.store.read("embedding_requests").collect()
    assert [(r.memory_uuid, r.attempts) for r in left] == [(a, 1)] and "no vector" in left[0].error
    h = e.read_memory_hash(a).first()
    e.update_memory_replace(NOW, a, h["revision"], {"title_norm": h["title_hash"]}, title_norm="mended one")
    assert e.embed_pending() == 1 and e.store.read("embedding_requests").count() == 0 and e.embeddings.count() == 2


def test_two_writers_at_one_revision(pair):
    e, a, b = pair
    view = e.view()
    record = e._record(view, a)
    e.update_memory_append(NOW, b, revision(e, b), content="!")
    row = e._row("uuid string, append_content string, append_recall_when string", uuid=a, append_content="?", append_recall_when=None)
    with pytest.raises(EditError, match="STORE_CONFLICT"):
        e._edit(NOW, view, record, None, commands.append_text(row, record.units))
    assert e.units.where("content like '%?'").count() == 0 and e.changes.count() == 1


def test_records_as_they_were(pair):
    e, a, b = pair
    written = {}
    for k in range(4):
        e.update_memory_append(NOW, a, revision(e, a), content=f" {k}")
        written[e.store.snapshot().revision] = e.read_memory(a).first()
    for at, row in written.items():
        assert e.read_memory(a, at).first() == row


def test_an_edit_writes_what_it_changes(spark, tmp_path):
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    store = Store(spark, str(tmp_path / "store"))
    text = lambda df, *columns: df.withColumns({c: F.col(c).cast("string") for c in columns})
    store.write_all({"units": text(fx.units, "uuid"), "keywords": text(fx.keywords, "memory_uuid"), "relations": text(fx.relations, "uuid", "from_memory_uuid", "to_memory_uuid")})
    e = Engine(store)
    e.build_index()
    base = {n: s for n in ("units", "search_index", "postings") for s in [store.snapshot().segments(n)]}
    e.update_memory_append(NOW, "7", 4, content=" and a zyzzyva")
    snap = store.snapshot()
    for name, segments in base.items():
        more = snap.segments(name)
        assert more[: len(segments)] == segments and more[-1]["rows"] < 5_000 and not more[-1]["base"]
    assert [r["memory_uuid"] for r in e.search_memory({"query": "zyzzyva"})["results"]] == ["7"]
    # The kept postings give what a full pass gives.
    v = e.view()
    built = index.build_search_index(v.units, v.keywords)
    for request in ({"query": "worthless license"}, {"query": "zyzzyva"}, {"query": "en"}, {"terms": {"include": ["zyzz", "steel"], "exclude": ["brass"]}, "filters": ["content", "keywords"]}):
        want = search.literal(built, search.request(request)).collect()
        got = e.search_memory(request)["results"]
        assert [(r["memory_uuid"], r["matched_fields"]) for r in got] == [(r.memory_uuid, r.matched_fields) for r in want]
