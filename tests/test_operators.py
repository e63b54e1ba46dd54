"""Small cases of functions and operators that the fixture tables don't show."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, vectors
from tessera.operators import commands, index, listing, search
from tessera.plans.fixtures import Fixtures
from tessera.sources import backup

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text(spark):
    c = F.col("a")
    assert one(spark, text.normalize_title(c), a="  A \t b\n ") == "a b "
    assert one(spark, text.normalize_keyword(c), a="　A  \t b\n ") == "a b"
    assert one(spark, text.trigram_similarity(text.trigrams(c), text.trigrams(F.col("b"))), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, text.trigram_similarity(text.trigrams(c), text.trigrams(F.col("b"))), a="", b="x") == 0
    assert one(spark, text.contains(c, F.lit("")), a="x") is True
    assert one(spark, text.replace_unique(c, F.lit("b"), F.lit("XX")), a="abc") == "aXXc"
    assert one(spark, text.replace_unique(c, F.lit("b"), F.lit("XX")), a="abcb") is None
    assert one(spark, F.size(text.chunks(c)), a="x" * 1001) == 3
    assert one(spark, F.size(text.chunks(c)), a="") == 1
    assert one(spark, F.size(text.chunks(c)), a="x" * 30_000) == 40
    assert one(spark, text.json_hash(text.json_string(c)), a='a"b') == "0x" + __import__("hashlib").sha256(b'"a\\"b"').hexdigest()


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    parts = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0, 0.0]), (2, [0.0, 4.0]), (3, [1.0]), (3, [-1.0])], "memory_uuid long, embedding array<float>")
    assert {r[0]: r[1] for r in vectors.mean_pool(parts).collect()} == {1: [3.0, 4.0], 2: [0.6, 0.8], 3: None}


def test_index_is_idempotent_and_refreshes(spark):
    fx = Fixtures(spark, SF)
    built = index.build_search_index(fx.units, fx.keywords)
    again = index.refresh_index(built, fx.units, fx.keywords, fx.units.where("uuid % 5 = 0").select("uuid"))
    assert built.exceptAll(again).isEmpty() and again.exceptAll(built).isEmpty()


def test_exclude_never_adds(spark):
    fx = Fixtures(spark, SF)
    built = index.build_search_index(fx.units, fx.keywords)
    found = lambda none: {r[0] for r in search.literal(built, search.Search(any=("the",), none=none), limit=False).select("memory_uuid").collect()}
    assert found(("in",)) <= found(())


def test_term_may_cross_fields(spark):
    row = [(1, "active", "one", "two", "", "", "")]
    table = spark.createDataFrame(row, "memory_uuid long, status string, title_text string, summary_text string, keywords_text string, content_text string, recall_when_text string")
    assert search.literal(table, search.Search(any=("one two",))).count() == 1


def test_backup_round_trip(spark, tmp_path):
    fx = Fixtures(spark, SF)
    path = tmp_path / "b"
    n = backup.write(fx.units, fx.keywords, fx.relations, str(path), "p")
    rows = backup.read(spark, str(path))
    live = fx.units.where("status = 'active'")
    assert rows.count() == n == live.count()
    want = backup.snapshot_rows(fx.units, fx.keywords, fx.relations).orderBy("updated_at", "uuid").collect()
    files = sorted(f for f in path.iterdir() if f.name.endswith((".txt", ".json")) and not f.name.startswith("."))
    whole = json.loads("".join(f.read_text() for f in files))
    assert (whole["format"], whole["profile"], whole["count"]) == (backup.FORMAT, "p", n)
    assert [(m["memory"]["uuid"], m["memory"]["content"], len(m["keywords"]), len(m["relations"])) for m in whole["memories"]] == [(r.uuid, r.memory.content, len(r.keywords), len(r.relations)) for r in want]
    assert {f.stat().st_mode & 0o777 for f in files} == {0o600} and path.stat().st_mode & 0o777 == 0o700
    with pytest.raises(backup.BackupError, match="there already"):
        backup.write(fx.units, fx.keywords, fx.relations, str(path), "p")
    assert [f.name for f in tmp_path.iterdir()] == ["b"]


def test_only_whole_backups_are_read(spark, tmp_path):
    fx = Fixtures(spark, SF)
    for name in ("no end", "fewer", "other", "trashed", "empty"):
        units = fx.units.where("uuid < 0") if name == "empty" else fx.units.where("uuid < 50")
        backup.write(units, fx.keywords, fx.relations, str(tmp_path / name), "p")
    (tmp_path / "no end" / backup.TAIL).unlink()
    next((tmp_path / "fewer").glob("part*")).unlink()
    head = tmp_path / "other" / backup.HEAD
    head.write_text(head.read_text().replace(backup.FORMAT, "records-0"))
    (tmp_path / "other" / f".{backup.HEAD}.crc").unlink()
    head = tmp_path / "trashed" / backup.HEAD
    head.write_text(head.read_text().replace('"status":"active"', '"status":"trashed"'))
    (tmp_path / "trashed" / f".{backup.HEAD}.crc").unlink()
    for name, why in (("no end", "whole"), ("fewer", "missing"), ("other", "format"), ("trashed", "active")):
        with pytest.raises(backup.BackupError, match=why):
            backup.read(spark, str(tmp_path / name))
    assert backup.read(spark, str(tmp_path / "empty")).count() == 0
    spark.createDataFrame([("x",)], "format string").write.json(str(tmp_path / "c"))
    with pytest.raises(backup.BackupError):
        backup.read(spark, str(tmp_path / "c"))


def test_open_create_keeps_no_state_before(spark):
    schema = "memory_uuid long, action string, before_state string, after_state string, created_at long, updated_at long"
    old = spark.createDataFrame([(1, "create", None, "a", 1, 1)], schema)
    new = spark.createDataFrame([(1, "update", "a", "b", 2, 2), (2, "update", "c", "d", 2, 2)], schema)
    rows = {r.memory_uuid: tuple(r)[1:] for r in commands.upsert_changes(old, new).collect()}
    assert rows == {1: ("create", None, "b", 1, 2), 2: ("update", "c", "d", 2, 2)}


def test_postings_are_the_trigrams_of_each_field(spark):
    """Made for many records at once, they are what the expression on whole texts gives, and come sorted."""
    odd = ["a", "", " - ", "Two  words, two WORDS", "\U00010428\U00010429x \U00010428", "\u00e9\u00e9\u00df \u0130x \u4e2d\u6587\u5b57", "x\U00020000", "n\u00bd 12"]
    cells = [(str(k), "trashed" if k == 3 else "active", a, b, "src1 fr", None if k == 2 else f"{a} {b}", "") for k, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    own = spark.createDataFrame(cells, "memory_uuid string, status string, " + ", ".join(f"{c} string" for c in index.TEXTS)).coalesce(1)
    made = index.gram_postings(own)
    want = own.where("status <> 'trashed'").select("memory_uuid", F.inline(F.array(*(F.struct(F.lit(c.removesuffix("_text")).alias("field"), text.trigrams(F.col(c)).alias("grams")) for c in index.TEXTS))))
    want = want.select(F.explode("grams").alias("gram"), "field", "memory_uuid", F.size("grams").alias("size"))
    got = [tuple(r) for r in made.collect()]
    assert len(got) > 100 and sorted(got) == sorted(tuple(r) for r in want.collect())
    keys = [(g.encode(), f, n) for g, f, _, n in got]
    assert keys == sorted(keys)


def test_fields_of_changes_are_compared_in_their_row(spark):
    """No shuffle, and each state is parsed once, however many fields it has."""
    state = lambda **fields: json.dumps({"memory": fields, "keywords": [{"keyword_norm": "k", "weight": None}], "relations": []})
    cells = [("1", state(title_norm="a", content="x\U0001f600z"), state(title_norm="a", content="x\U0001f601z")), ("2", None, state(title_norm="b")), ("3", state(summary="s"), state())]
    made = listing.change_fields(spark.createDataFrame(cells, "memory_uuid string, before_state string, after_state string"))
    got = sorted((r.memory_uuid, r.field, r.old, r.new, r.prefix, r.removed, r.added, r.suffix) for r in made.collect())
    assert got == [("1", "content", "x\U0001f600z", "x\U0001f601z", "x", "\U0001f600", "\U0001f601", "z"), ("2", "keywords", "-", "k", "", "-", "k", ""), ("2", "relations", "-", "", "", "-", "", ""),
                   ("2", "title_norm", "-", "b", "", "-", "b", ""), ("3", "summary", "s", "-", "", "s", "-", "")]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("from_json(") == 2


def test_duplicates_shuffle_no_texts(spark):
    """Texts meet by their digests, in one join for all fields; every command has its row, whatever it lacks."""
    units = spark.createDataFrame([("a", "active", "t", "c", None), ("b", "trashed", "u", "d", "s"), ("e", "active", "t", "x", "")], "uuid string, status string, title_norm string, content string, summary string")
    sent = [("1", "a", "new", "c", "s"), ("2", "a", "t", "c", None), ("3", "z", None, None, None), ("4", "e", "u", "c", ""), ("5", "b", "5", "5", "s")]
    asked = spark.createDataFrame(sent, "command_id string, uuid string, new_title_norm string, new_content string, new_summary string")
    new, old = commands.duplicates(asked.drop("uuid"), units), commands.duplicates(asked, units, update=True)
    assert {r.command_id: r.duplicate_field for r in new.collect()} == {"1": "content", "2": "title", "3": None, "4": "title", "5": "summary"}
    assert {r.command_id: r.duplicate_field for r in old.collect()} == {"1": None, "2": "title", "3": None, "4": "content", "5": None}
    assert {type(r.command_id) for r in old.collect()} == {str}
    for made in (new, old):
        exchanges = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
        assert exchanges and not any(f in x.split("],")[0] for x in exchanges for f in ("title_norm", "content", "summary"))
