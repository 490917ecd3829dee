"""Maintenance of the graph sends no table whole to a task, and gives what plain Python gives."""

import re

from pyspark.sql import functions as F

from kelpie.operators import memory
from kelpie.plans import assembly
from kelpie.plans.tables import AS_OF

N, HUBS, TIERS = 3000, 7, ["working", "semantic", "crystallised"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffled(df):
    """The ends by which rows meet the entities in a shuffled outer join, as planned before anything ran."""
    return set(re.findall(r"SortMergeJoin \[(\w+)#\d+\], \[\w+#\d+\], LeftOuter", df._jdf.queryExecution().sparkPlan().toString()))


def graph(spark):
    """entities: N named ones, and one twice; edges: each to a hub of few; triples: each claims the next hub, one an unknown."""
    name, k = lambda c: F.concat(F.lit("e"), c.cast("string")), F.col("id")
    tier = lambda key: F.element_at(F.array(*(F.lit(t) for t in TIERS)), (key % 3 + 1).cast("int"))
    rows = spark.range(N).union(spark.range(1)).repartition(3)
    entities = rows.select(name(k).alias("eid"), name(k).alias("name"), tier(k).alias("tier"))
    edges = spark.range(HUBS, N + 1).select(name(k).alias("src"), name(k % HUBS).alias("dst"), F.lit("located_at").alias("type"), (k % 10 / 10).alias("weight"), tier(k + 1).alias("tier"))
    triples = spark.range(HUBS, N + 1).select(name(k).alias("src"), name((k + 1) % HUBS).alias("dst"), F.lit("located_at").alias("type"), F.lit(0.9).alias("confidence"), F.lit("x").alias("source"))
    return entities, edges, triples


def wanted():
    out = []
    for k in range(HUBS, N + 1):
        high = TIERS[(k + 1) % 3] == "crystallised" or (k < N and k % 3 == 2) or k % HUBS % 3 == 2
        row = (f"e{k}", f"e{k % HUBS}", f"e{(k + 1) % HUBS}", "high" if high else "medium" if k % 10 / 10 > 0.6 else "low")
        out += [row] * (2 if k % HUBS == 0 else 1)  # e0 stands twice among the entities
    return sorted(out)


def test_contradictions_look_up_ends_without_sending_all_entities(spark):
    entities, edges, triples = graph(spark)
    found = memory.find_contradictions(triples, edges, entities)
    assert sorted(map(tuple, found.select("src", "old_dst", "new_dst", "severity").collect())) == wanted()
    assert shuffled(found) == {"src", "old_dst"}
    none = spark.createDataFrame([], "subject string, relation string, object string")
    rejected = spark.createDataFrame([("e8", "located_at", "e2")], "subject string, relation string, object string")
    fewer = memory.find_contradictions(triples, edges, entities, rejected=rejected, truths=none)
    # a claim about e0, which stands twice among the entities, is looked up twice
    assert sorted(map(tuple, fewer.where("new_dst <> 'e0'").select("src", "old_dst", "new_dst", "severity").collect())) == [r for r in wanted() if r[0] != "e8" and r[2] != "e0"]
    assert shuffled(fewer) >= {"src", "dst", "old_dst"}
    left = memory.purge_rejected(edges, entities.distinct(), spark.createDataFrame([("e8", "located_at", "e1")], rejected.schema), none)
    assert left.columns == edges.columns and sorted(r["src"] for r in left.collect()) == sorted(f"e{k}" for k in range(HUBS, N + 1) if k != 8)
    assert shuffled(left) >= {"src", "dst"}


def test_orphans_meet_the_ends_in_one_join(spark):
    rows = [("a", 0.05, "working"), ("b", 0.05, "working"), ("b", 0.06, "working"), ("c", 0.05, "crystallised"), (None, 0.05, "working"), ("d", 0.05, "working"), ("e", 0.1, "working")]
    some = lambda r: spark.createDataFrame(r, "eid string, weight double, tier string").repartition(2)
    edges = spark.createDataFrame([("a", "x"), ("a", "d"), ("y", "d"), (None, "z")], "src string, dst string")
    lone = memory.orphan_entities(some(rows[:3]).unionByName(some(rows[3:])), edges)
    want = {("b", 0.05, "working"), ("b", 0.06, "working")}
    assert {tuple(r) for r in lone.where("eid is not null").collect()} == want and lone.columns == ["eid", "weight", "tier"]
    assert len(re.findall(r"Join ", plan(lone))) == 1


def test_compression_ranks_no_more_of_a_tier_than_its_budget(spark):
    k = F.col("id")
    at = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((30 + k % 500).cast("int"))
    files = spark.range(2000).select(F.concat(F.lit("MEMORY/weekly/f"), k.cast("string"), F.lit(".md")).alias("path"), F.lit("b").alias("body"), (k * 7919 % 1000).alias("size_bytes"), at.alias("mtime"))
    chosen = memory.select_for_compression(files, AS_OF)
    tiers, ratio, budget = {}, {"aging": 0.60, "mature": 0.25, "ancient": 0.10}, {"aging": 30, "mature": 20, "ancient": 10}
    for i in range(2000):
        age = 30 + i % 500
        t = "aging" if age < 90 else "mature" if age < 365 else "ancient"
        tiers.setdefault(t, []).append((-round(i * 7919 % 1000 * (1 - ratio[t]), 6), f"MEMORY/weekly/f{i}.md"))
    assert {(r["tier"], r["path"]) for r in chosen.collect()} == {(t, p) for t, rows in tiers.items() for _, p in sorted(rows)[: budget[t]]}
    assert "WindowGroupLimit" in plan(chosen)


def test_briefing_finds_contradictions_once(spark):
    entities, edges, triples = graph(spark)
    day, k = F.lit(AS_OF).cast("timestamp_ntz"), F.lit(1)
    entities = entities.withColumns({"type": F.lit("person"), "base": F.lit(0.2), "computed": F.lit(0.3), "activation_count": k, "last_activated": day, "priority_floor": F.lit(False), "ris": F.lit(0.0)})
    edges = edges.withColumns({"confidence": F.lit(0.9), "computed": F.lit(0.3), "priority_floor": F.lit(False), "ris": F.lit(0.0), "cred": F.lit(0.9), "activation_count": k, "last_activated": day, "n_sources": k})
    files = spark.createDataFrame([("MEMORY/weekly/x.md", "b", 9)], "path string, body string, size_bytes long").withColumn("mtime", day - F.make_dt_interval(F.lit(40)))
    night = assembly.nightly(files, entities, edges, triples, AS_OF)
    found, weighed = night["contradictions"].collect(), night["edges"].count() + night["archived"].count()
    brief = night["briefing"].collect()[0].asDict()
    want = {"edges_updated": weighed, "edges_archived": night["archived"].count(), "orphans": night["orphans"].count(), "to_compress": 1, "contradictions": len(found), "resolved": sum(r["status"] != "unresolved" for r in found)}
    assert brief == want and 0 < want["resolved"] < len(found) and 0 < want["edges_archived"] < weighed
    assert len(re.findall(r"NOT \(old_dst", plan(night["briefing"]))) == 1
