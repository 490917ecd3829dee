"""Whole flows composed of operators: search pipeline, context assembly, nightly maintenance and views."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from kelpie.functions import text as X
from kelpie.operators import graph, ingest, memory, ordered, rollups, search
from kelpie.operators.cut import cut


@dataclass(frozen=True)
class Settings:
    """What a run can be told; every field has the value that the operators assume."""

    max_files: int = 8
    max_pages: int = 4
    extra_files: int = 3
    depth: int = 2
    hop_decay: float = 0.6
    threshold: float = 0.12
    body_chars: int = 8000
    budget_chars: int = 80_000
    file_chars: int = 5_000
    synonyms: dict = field(default_factory=dict)
    bundles: tuple = ()

    @classmethod
    def load(cls, values, environment=()):
        """From nested values (as of a YAML file) and overrides named KELPIE_<FIELD>; unknown names are ignored."""
        flat = dict(values.get("retrieval", values))
        for name, kind in (("max_files", int), ("max_pages", int), ("extra_files", int), ("depth", int), ("hop_decay", float), ("threshold", float), ("body_chars", int), ("budget_chars", int), ("file_chars", int)):
            if (key := f"KELPIE_{name.upper()}") in environment:
                flat[name] = environment[key]
            if name in flat:
                flat[name] = kind(flat[name])
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})


def memory_scan(files, entities, edges, queries, as_of, index=None, settings=Settings()):
    """(query_id, path, kind, ord): keyword files, bundles, files of activated entities and wiki pages, each path once.

    Activation of all queries runs together: strengths are kept per query, so one pass over the edges serves them all.
    """
    scored = search.keyword_score(files, queries, as_of, settings.body_chars, settings.synonyms)
    # a few rows a query, used three times below: the corpus is scanned once for them
    direct = cut(search.top_files(scored, settings.max_files).select("query_id", "path", F.lit("direct").alias("kind"), F.col("rank").cast("long").alias("ord")))
    if settings.bundles:
        more = search.domain_bundles(files, queries, settings.bundles)
        direct = direct.unionByName(more.select("query_id", "path", F.lit("direct").alias("kind"), (F.col("ord") + 1000).alias("ord")))
    tokens = queries.select("query_id", X.query_tokens(F.col("query")).alias("q"))
    by_name = graph.name_seeds(entities, tokens)
    by_file = entities.select("eid", F.explode("sources").alias("path")).join(direct.select("query_id", "path"), "path").select("query_id", "eid")
    active = activate(entities, edges, by_name.union(by_file).distinct(), settings)
    hits = active.join(entities.select("eid", "sources"), "eid").select("query_id", F.explode("sources").alias("path"), "strength")
    hits = hits.join(files.select("path"), "path", "left_semi").join(direct, ["query_id", "path"], "left_anti").groupBy("query_id", "path").agg(F.max("strength").alias("s"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 6)), "path"))
    extra = hits.withColumn("ord", rank).where(F.col("ord") <= settings.extra_files).select("query_id", "path", F.lit("graph").alias("kind"), F.col("ord").cast("long").alias("ord"))
    out = direct.unionByName(extra)
    if index is not None:
        pages = search.wiki_scan(index, queries, settings.max_pages)
        out = out.unionByName(pages.select("query_id", F.col("page").alias("path"), F.lit("wiki").alias("kind"), F.col("rank").cast("long").alias("ord")))
    first = F.min_by(F.struct("kind", "ord"), F.struct(F.when(F.col("kind") == "direct", 0).when(F.col("kind") == "graph", 1).otherwise(2), "ord")).alias("f")
    return out.groupBy("query_id", "path").agg(first).select("query_id", "path", "f.kind", "f.ord")


def activate(entities, edges, seeds, settings=Settings()):
    """(query_id, eid, strength) as in graph.spreading_activation, for the seeds (query_id, eid) of many queries at once."""
    adjacency = graph.symmetric(edges).join(entities.select(F.col("eid").alias("other")), "other", "left_semi")
    active = seeds.join(entities.select("eid"), "eid", "left_semi").select("query_id", "eid", F.lit(1.0).alias("strength"))
    for _ in range(settings.depth):
        moved = active.withColumnRenamed("eid", "node").join(adjacency, "node").select("query_id", F.col("other").alias("eid"), (F.col("strength") * F.col("weight") * settings.hop_decay).alias("strength"))
        active = active.unionByName(moved.where(F.col("strength") > settings.threshold)).groupBy("query_id", "eid").agg(F.max("strength").alias("strength"))
    return active.join(seeds, ["query_id", "eid"], "left_anti")


def context(candidates, files, settings=Settings()):
    """(query_id, path, kind, rank, taken): candidates in order of kind, filled up to the budget of characters."""
    from pyspark.sql import Window

    order = F.when(F.col("kind") == "direct", 0).when(F.col("kind") == "graph", 1).otherwise(2)
    r = candidates.join(files.select("path", F.char_length("body").alias("length")), "path")  # no body is shuffled
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "ord", "path")))
    taken = ordered.context_budget(r, settings.budget_chars, settings.file_chars)
    return taken.join(candidates.select("query_id", "path", "kind"), ["query_id", "path"])


def crystallised_block(entities, most=20):
    """The most salient crystallised entities."""
    return entities.where(F.col("tier") == "crystallised").orderBy(F.desc("computed"), "eid").limit(most).select("eid", "name", "type", "computed")


def question_block(questions, most=10):
    """Open questions by priority."""
    return questions.orderBy(F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2), "question").limit(most)


def contradiction_block(contradictions, most=5):
    """Unresolved contradictions by severity."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return contradictions.orderBy(rank, "src", "type", "old_dst", "new_dst").limit(most)


def nightly(files, entities, edges, triples, as_of, completer=None):
    """The maintenance phases as tables: decayed edges, archived ones, weights, orphans, compression plan, contradictions, briefing.

    completer: a function from prompt to text for what a language model would write; without one those texts stay null.
    """
    weighed = memory.recompute_weights(edges, as_of)
    kept = weighed.where("not archived").withColumn("weight", F.col("new_weight")).drop("new_weight", "archived")
    nodes = memory.entity_weights(entities, as_of)
    lone = memory.orphan_entities(nodes, kept)
    plan = memory.select_for_compression(files, as_of)
    found = memory.auto_resolve(memory.find_contradictions(triples, kept, entities))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both = lambda df, name, part, where: df.agg(F.count("*").alias(name), F.count(F.when(where, 1)).alias(part))
    brief = both(weighed, "edges_updated", "edges_archived", F.col("archived")).crossJoin(n(lone, "orphans")).crossJoin(n(plan, "to_compress"))
    brief = brief.crossJoin(both(found, "contradictions", "resolved", F.col("status") != "unresolved"))
    if completer is not None:
        brief = brief.withColumn("text", complete(completer)(F.to_json(F.struct(*brief.columns))))
    return {"edges": kept, "archived": weighed.where("archived"), "entities": nodes, "orphans": lone, "compression": plan, "contradictions": found, "briefing": brief}


def complete(completer):
    """A column function that has a completer answer prompts in Arrow batches; failures give null."""
    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return completer(p)
            except Exception:
                return None

        return prompts.map(one)

    return answer


def stub_completer(prompt):
    """A deterministic stand-in: the prompt's first words, as the JSON that row functions expect."""
    import json

    return json.dumps({"summary": " ".join((prompt or "").split()[:8])})


def salvage_json(column, schema):
    """Rows of a completer's JSON: fences stripped, from the first to the last brace; what can't be read is null.

    Raw control characters inside strings are taken as they are.
    """
    inner = F.regexp_extract(F.regexp_replace(column, r"```(?:json)?", ""), r"(?s)(\{.*\}|\[.*\])", 1)
    found = F.from_json(inner, schema, {"allowUnquotedControlChars": "true"})
    return F.when(F.to_json(found) != "{}", found)


def row_function(rows, prompt, completer, schema, fallback):
    """rows with `answer` (a struct of schema): the completer's parsed reply to a prompt column, else the fallback struct."""
    return rows.withColumn("answer", F.coalesce(salvage_json(complete(completer)(prompt), schema), fallback))


def statistics(files, entities, edges, proposals, as_of):
    """One row per metric: the counts a status page shows."""
    row = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    old = rollups.age_days(as_of)
    return (
        row(files, "files").unionByName(row(files.where(old < 7), "files_7d")).unionByName(row(entities, "entities")).unionByName(row(edges, "edges"))
        .unionByName(row(entities.where("tier = 'crystallised'"), "crystallised")).unionByName(row(proposals.where("status = 'pending'"), "pending"))
    )


def recent_activity(files, as_of, days=14, most=50):
    """Files changed in the last two weeks, newest first."""
    age = rollups.age_days(as_of)
    return files.where((age >= 0) & (age <= days)).orderBy(F.desc("mtime"), F.desc("path")).limit(most).select("path", "mtime", "size_bytes")


def top_of_mind(questions, contradictions, proposals, most=12):
    """(kind, label): what presses most: high questions, severe contradictions, pending proposals by path."""
    a = questions.where("priority = 'high'").select(F.lit("question").alias("kind"), F.col("question").alias("label")).orderBy("label").limit(most)
    b = contradictions.where("severity = 'high'").select(F.lit("contradiction").alias("kind"), F.concat_ws(" ", "src", "type", "new_dst").alias("label")).orderBy("label").limit(most)
    c = proposals.where("status = 'pending'").select(F.lit("proposal").alias("kind"), F.col("path").alias("label")).distinct().orderBy("label").limit(most)
    return a.unionByName(b).unionByName(c)


def ingest_batch(rows, seen, id_col="id"):
    """New mail of a batch of (id, raw): cleaned, without promotions and without fingerprints seen before (fp)."""
    clean = ingest.clean_emails(rows).where("not dropped")
    return ingest.new_blocks(clean, seen, column="raw", order=(id_col,))


# --- what a language model is asked, row by row: prompt, parsed reply, checks and caps, and the fallback ------------------


def priors(primed, entities, questions, focus=6, open_=4):
    """(session, focus, open): the strongest primed entities by name, and the most salient open questions, as prompt lines."""
    from pyspark.sql import Window

    named = primed.join(entities.select("eid", "name"), "eid", "left")
    r = named.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("strength"), "eid"))).where(F.col("n") <= focus)
    r = r.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("name", "eid").alias("name")))).alias("s"))
    r = r.select("session", F.concat(F.lit("Recent session focus: "), F.array_join(F.transform("s", lambda x: x["name"]), ", ")).alias("focus"))
    q = questions.where(~F.coalesce("status", F.lit("open")).isin("resolved", "dismissed", "closed") & (F.coalesce("text", F.lit("")) != ""))
    q = q.orderBy(F.desc(F.coalesce("salience", F.lit(0.5))), "text").limit(open_).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("salience", F.lit(0.5))).alias("s"), F.substring("text", 1, 120).alias("t")))).alias("q"))
    lines = F.when(F.size("q") > 0, F.concat(F.lit("Unresolved open questions:\n"), F.array_join(F.transform("q", lambda x: F.concat(F.lit("  \u2022 "), x["t"])), "\n"))).otherwise("")
    return r.crossJoin(F.broadcast(q.select(lines.alias("open"))))


def curate(candidates, completer, keep=10, shown=25):
    """(query_id, path, place): candidates (query_id, query, path, ord, snippet) that the completer selects, `keep` at most.

    A query with no more than `keep` candidates keeps all. Else the first `shown` are listed, and the reply's indexes that
    are in the list count, in the reply's order; without any, the first `keep` by order stay.
    """
    item = F.struct("ord", "path", F.substring(F.regexp_replace(F.coalesce("snippet", F.lit("")), "\n", " "), 1, 100).alias("snippet"))
    r = candidates.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(item)).alias("c")).withColumn("all", F.size("c")).withColumn("c", F.slice("c", 1, shown))
    name = lambda c: F.replace(F.regexp_replace(F.element_at(F.split(c["path"], "/"), -1), r"\.[^.]+$", ""), F.lit("_"), F.lit(" "))
    lines = F.array_join(F.transform("c", lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), name(c), F.lit(": "), c["snippet"])), "\n")
    prompt = F.concat(F.lit("Query: "), "query", F.lit(f"\n\nCandidates (select at most {keep}):\n"), lines, F.lit('\n\nReply with JSON only: {"selected": [0, 2], "reasoning": "one sentence"}'))
    r = r.withColumn("prompt", F.when(F.col("all") > keep, prompt))
    r = row_function(r, F.col("prompt"), completer, "selected array<int>, reasoning string", F.lit(None).cast("struct<selected:array<int>,reasoning:string>"))
    valid = F.array_distinct(F.filter(F.coalesce("answer.selected", F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.size("c"))))
    first = F.sequence(F.lit(0), F.least(F.size("c"), F.lit(keep)) - 1)
    r = r.withColumn("picked", F.when((F.col("all") > keep) & (F.size(valid) > 0), F.slice(valid, 1, keep)).otherwise(first))
    return r.select("query_id", F.posexplode("picked").alias("place", "_i"), "c").select("query_id", F.get("c", F.col("_i"))["path"].alias("path"), "place")


def deadline_signals(mails, completer, today):
    """mails (path, subject, body, date) with deadline, action, urgency, confidence and already_responded, where the completer sees one to act on."""
    prompt = F.concat(F.lit(f"Today is {today}. Mail of "), "date", F.lit("\nSubject: "), F.substring(F.coalesce("subject", F.lit("")), 1, 140), F.lit("\n<<<"), F.substring(F.coalesce("body", F.lit("")), 1, 5000), F.lit(">>>\nJSON:"))
    schema = "has_actionable_deadline boolean, deadline string, action string, urgency string, confidence double, already_responded boolean"
    r = row_function(mails, prompt, completer, schema, F.lit(None).cast("struct<has_actionable_deadline:boolean,deadline:string,action:string,urgency:string,confidence:double,already_responded:boolean>"))
    r = r.where(F.coalesce("answer.has_actionable_deadline", F.lit(False)))
    return r.select(*mails.columns, F.lit(True).alias("actionable"), *(F.col(f"answer.{c}").alias(c) for c in ("deadline", "action", "urgency", "confidence", "already_responded")))


#: Kinds of what is harvested from a turn.
HARVEST_KINDS = ["decision", "commitment", "fact", "question"]


def harvest_turns(turns, completer, user="the user"):
    """(…, kind, text, subjects, salience): what turns (session, turn, user, assistant) hold; short or one-sided ones aren't asked about."""
    said, heard = F.coalesce("user", F.lit("")), F.coalesce("assistant", F.lit(""))
    asked = turns.where((F.trim(said) != "") & (F.trim(heard) != "") & (F.char_length(said) + F.char_length(heard) >= 80))
    prompt = F.concat(F.lit(f"What does {user} decide, promise, state or ask?\n<<<"), F.substring(said, 1, 3000), F.lit(">>>\nJSON:"))
    r = row_function(asked, prompt, completer, "items array<struct<kind:string,text:string,subjects:array<string>,salience:double>>", F.lit(None).cast("struct<items:array<struct<kind:string,text:string,subjects:array<string>,salience:double>>>"))
    r = r.select("session", "turn", F.explode("answer.items").alias("i")).where(F.col("i.kind").isin(*HARVEST_KINDS) & (F.trim("i.text") != ""))
    return r.select("session", "turn", "i.kind", F.substring(F.trim("i.text"), 1, 240).alias("text"), F.slice(F.coalesce("i.subjects", F.array().cast("array<string>")), 1, 6).alias("subjects"), F.coalesce("i.salience", F.lit(0.5)).alias("salience"))


def due_sessions(turns, index, now, least_seconds=3600, force=False):
    """(session, from_turn, turns, due): sessions with turns that weren't harvested, and whether the last harvest is long enough ago.

    index: (session, turn_count, last_at). A session never harvested is due; force leaves only the count to decide.
    """
    n = turns.groupBy("session").agg(F.count("*").alias("turns")).join(index, "session", "left")
    start = F.coalesce("turn_count", F.lit(0))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_at").cast("timestamp"))
    due = F.lit(True) if force else F.coalesce(age >= least_seconds, F.lit(True))
    return n.where(F.col("turns") > start).select("session", start.cast("long").alias("from_turn"), "turns", due.alias("due"))


def pinned(log):
    """(path, pinned_at): what is pinned after a log of (path, op, at): add, remove and restore, the last of a path counts."""
    last = log.groupBy("path").agg(F.max_by("op", F.struct("at", "op")).alias("op"), F.max("at").alias("pinned_at"))
    return last.where(F.col("op").isin("add", "restore")).select("path", "pinned_at")


def next_due(now, schedule, last_day=None):
    """When a daily run (HH:MM, 02:00 if unreadable) is due: now, if today's is past and hasn't run; else today's or tomorrow's time."""
    import datetime
    import re

    found = re.fullmatch(r"\s*(\d{1,2}):(\d{1,2})\s*", schedule or "")
    hour, minute = (int(found[1]), int(found[2])) if found and int(found[1]) < 24 and int(found[2]) < 60 else (2, 0)
    today = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    if now < today:
        return today
    return now if last_day != now.strftime("%Y-%m-%d") else today + datetime.timedelta(days=1)
