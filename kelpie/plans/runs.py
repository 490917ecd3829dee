"""Runs that go on where they were: every step's table is written once and named with the step, in one version.

A run that is killed anywhere leaves whole steps only. Started again at the same root, it reads what is there and works
on from the first step that isn't, so that stopping after any step gives the same tables as not stopping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators import memory, ordered
from kelpie.plans import assembly
from kelpie.sources.versions import Versions


class Run:
    """The steps of one run below a root; did: names of the steps that this object has worked."""

    def __init__(self, spark, root):
        self.spark, self.versions, self.did = spark, Versions(spark, root), []

    def step(self, name, make):
        """The table of a step: as it was written before, or make() written now."""
        tables, base = self.versions.tables(), (self.versions.numbers() or [0])[-1]
        if name not in tables:
            path = self.versions.write("step", make())
            self.versions.publish(tables | {name: path}, base)
            self.did.append(name)
        return self.versions.read(name)

    def batches(self, name, rows, column, size, work):
        """work(batch) of every `size` rows in order of a column, a step each, as one table; None without rows.

        The rows are numbered and kept in a step of their own first, so that batches don't move when the input grows.
        """
        kept = self.step(f"{name}:rows", lambda: ordered.numbered(rows, column))
        n = kept.count()
        done = [self.step(f"{name}:{i}", lambda i=i: work(kept.where(F.col("no").between(i * size, (i + 1) * size - 1)))) for i in range(-(-n // size))]
        return reduce(DataFrame.unionByName, done) if done else None

    def done(self):
        """Names of the finished steps."""
        return sorted(self.versions.tables())


def sleep_cycle(run, files, entities, edges, triples, as_of):
    """The nightly phases, each a step that reads what the ones before have written: a dict of tables and the briefing."""
    weighed = run.step("weights", lambda: memory.recompute_weights(edges, as_of))
    kept = weighed.where("not archived").withColumn("weight", F.col("new_weight")).drop("new_weight", "archived")
    nodes = run.step("entities", lambda: memory.entity_weights(entities, as_of))
    lone = run.step("orphans", lambda: memory.orphan_entities(nodes, kept))
    found = run.step("contradictions", lambda: memory.auto_resolve(memory.find_contradictions(triples, kept, entities)))
    plan = run.step("compression", lambda: memory.select_for_compression(files, as_of))
    count = lambda df, name: df.agg(F.count("*").alias(name))

    def briefing():
        parts = [count(weighed, "edges_updated"), count(weighed.where("archived"), "edges_archived"), count(lone, "orphans"), count(plan, "to_compress"), count(found, "contradictions"), count(found.where("status <> 'unresolved'"), "resolved")]
        return reduce(DataFrame.crossJoin, parts)  # one row each

    brief = run.step("briefing", briefing)
    return {"edges": kept, "archived": weighed.where("archived"), "entities": nodes, "orphans": lone, "compression": plan, "contradictions": found, "briefing": brief}


def wiki_ingest(run, files, ingested, completions, size=50):
    """(path, page, body): pages that a completer makes of files (path, body) that weren't ingested yet (path), batch by batch.

    Replies are JSON of a page and its body; files whose reply can't be read have null pages, and aren't asked about again
    in this run. Returns None where nothing is left to do.
    """
    def work(batch):
        prompt = F.concat(F.lit("Make a wiki page of this. JSON: {\"page\": \"\", \"body\": \"\"}\n"), F.substring("body", 1, 20_000))
        r = completions.answer(batch.select("path", prompt.alias("prompt")))
        made = assembly.salvage_json(F.col("reply"), "page string, body string")
        return r.select("path", made["page"].alias("page"), made["body"].alias("body"))

    new = files.join(ingested.select("path").distinct(), "path", "left_anti").select("path", "body")
    return run.batches("pages", new, "path", size, work)
