"""Automatic relations and steps through relations against brute force."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans import registry

UNITS = "uuid long, category string, title_norm string, status string, summary string"
RELATIONS = "uuid long, from_memory_uuid long, to_memory_uuid long, relation_type string, weight int, note string"


def frames(spark, units, words, relations):
    u = spark.createDataFrame([(i, c, f"t{i}", s, None) for i, c, s in units], UNITS)
    k = spark.createDataFrame([(i, w, None) for i, ws in words.items() for w in ws], "memory_uuid long, keyword_norm string, weight int")
    r = spark.createDataFrame([(k, a, b, kind, None, None) for k, (a, b, kind) in enumerate(relations)], RELATIONS)
    return u, k, r


def brute(units, words, relations, sources, top=3):
    live = {i: c for i, c, s in units if s == "active"}
    known = {(a, b) for x, y, kind in relations if kind == "related_to" for a, b in ((x, y), (y, x))}
    out = set()
    for s in sources:
        if s in live:
            found = sorted((-len(words[s] & words[t]), t) for t in live if t != s and live[t] == live[s] and (s, t) not in known)[:top]
            out |= {(s, t, min(100, 50 - 10 * n) if n else 40) for n, t in found}
    return out


def table(seed, n=150, categories="xy", many=6):
    rng = random.Random(seed)
    units = [(i, rng.choice(categories), "active" if rng.random() < 0.9 else "pending") for i in range(n)]
    words = {i: {f"w{int(rng.paretovariate(0.5)) % 40}" for _ in range(rng.randint(0, many))} | ({"all"} if rng.random() < 0.8 else set()) for i, _, _ in units}
    relations = list({(rng.randrange(n), rng.randrange(n), rng.choice(("related_to", "depends_on"))) for _ in range(n)}) + [(0, t, "related_to") for t in range(1, 90)]
    return units, words, sorted((a, b, k) for a, b, k in set(relations) if a != b)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limits", [{}, {"common": 4}, {"common": 2, "held": 1}, {"common": 3, "held": 2, "related": 2}, {"common": 0, "related": 0}])
def test_auto_relations(spark, seed, limits):
    units, words, relations = table(seed)
    u, k, r = frames(spark, units, words, relations)
    sources = [i for i, _, _ in units if i % 3 == 0 or i < 5]
    asked = spark.createDataFrame([(i,) for i in [*sources, 10_000, sources[0]]], "uuid long")
    got = [(x.from_memory_uuid, x.to_memory_uuid, x.weight) for x in graph.auto_relations(u, k, r, asked, **limits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(units, words, relations, sources)
    one = next(i for i, _, s in units if s == "active")
    mine = r.where((F.col("from_memory_uuid") == one) | (F.col("to_memory_uuid") == one))
    lone = graph.relate_one(u, k, mine, one, dict((i, c) for i, c, _ in units)[one], sorted(words[one]))
    assert {(x.from_memory_uuid, x.to_memory_uuid, x.weight) for x in lone.collect()} == brute(units, words, relations, [one])


def test_pairs_grow_with_records(spark):
    """Pairs that are looked at (by rare keywords and by lists of subsets) grow hardly faster than records."""
    looked = []
    for n in (500, 1000, 2000):
        rng = random.Random(n)
        units = [(i, "x", "active") for i in range(n)]
        words = {i: {"all", f"a{rng.randrange(3)}", f"b{rng.randrange(25)}", f"c{rng.randrange(150)}", f"d{rng.randrange(n)}"} for i in range(n)}
        u, k, r = frames(spark, units, words, [(0, 1, "depends_on")])
        asked = u.select("uuid")
        df = graph.auto_relations(u, k, r, asked)
        assert len(df.collect()) == 3 * n
        plan, found = df._jdf.queryExecution().executedPlan(), []

        def walk(node, found=found):
            if node.nodeName() == "AdaptiveSparkPlan":
                return walk(node.executedPlan())
            if "QueryStage" in node.nodeName():
                return walk(node.plan())
            if "Join" in node.nodeName():
                found.append(node.metrics().apply("numOutputRows").value())
            for j in range(node.children().size()):
                walk(node.children().apply(j))

        walk(plan)
        looked.append(max(found))
    assert looked[2] < looked[0] * 4**1.2, looked


@pytest.mark.parametrize("hub", [10_000, 3])
def test_reachable(spark, hub, monkeypatch):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(2)
    units = [(i, "x", "active" if i % 7 else "trashed") for i in range(60)]
    relations = list({(rng.randrange(60), rng.randrange(60), rng.choice(("related_to", "depends_on"))) for _ in range(55)}) + [(3, t, "related_to") for t in range(30, 45)]
    u, _, r = frames(spark, units, {0: {"w"}}, relations)
    live = {i for i, _, s in units if s == "active"}
    for depth, kinds in ((0, ("related_to",)), (2, ("related_to", "depends_on")), (50, ("depends_on",))):
        near = {}
        for a, b, kind in relations:
            if kind in kinds and a in live and b in live:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want = set()
        for s in (1, 2, 3, 7):
            steps, todo = ({s: 0} if s in live else {}), deque([s])
            while todo:
                a = todo.popleft()
                for b in near.get(a, ()) if a in steps and steps[a] < depth else ():
                    if b not in steps:
                        steps[b] = steps[a] + 1
                        todo.append(b)
            want |= {(s, i, d) for i, d in steps.items()}
        got = graph.reachable(u, r, spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 1)], "uuid long"), depth, kinds)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_refresh_reads_stored_tables(spark):
    """The joins that make what is stored and what is touched are done before, so a task of the last step sorts for one join only."""
    made = registry.QUERIES["graph_refresh"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and made.count() > 0
