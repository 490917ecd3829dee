"""Work that a language model does, as joins: distinct prompts, a memo of replies, a budget, and rounds of a council.

A completer is any function from prompt to text. Replies are kept in a memo table before they are used, so that a prompt
is asked once, whatever runs again; what was asked, failed and was held back by the budget is logged with it.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.operators.cut import cut
from kelpie.operators.ordered import numbered
from kelpie.plans.assembly import salvage_json
from kelpie.sources.versions import Versions

_MEMO = "key string, reply string, attempts int, error string"


def _asking(completer, pause):
    """A function over batches (key, prompt, most) that asks each prompt in turn; an error is tried again after a pause."""

    def run(batches):
        for rows in batches:
            out = []
            for key, prompt, most in zip(rows["key"], rows["prompt"], rows["most"]):
                reply, error, n = None, None, 0
                while n < most and reply is None:
                    if n:
                        time.sleep(pause * 2 ** (n - 1))
                    n += 1
                    try:
                        reply = completer(prompt)
                    except Exception as e:  # whatever a completer raises is a failed call
                        error = f"{type(e).__name__}: {e}"[:200]
                out.append((key, reply, n, None if reply is not None else error or "no reply"))
            yield pd.DataFrame(out, columns=["key", "reply", "attempts", "error"])

    return run


class Completions:
    """A completer with its memo below a root. tasks: prompts asked at a time; budget: calls that may ever be made."""

    def __init__(self, spark, root, completer, budget=None, tasks=4, retries=2, pause=0.5):
        self.spark, self.versions, self.completer = spark, Versions(spark, root), completer
        self.budget, self.tasks, self.retries, self.pause = budget, tasks, retries, pause

    def memo(self):
        """(key, reply, attempts, error) of every prompt that was ever asked; key: sha256 of the prompt."""
        if "memo" not in self.versions.tables():
            return self.spark.createDataFrame([], _MEMO)
        return self.versions.read("memo")

    def log(self):
        """(run, wanted, known, asked, failed, calls, held_back) of each run that asked."""
        return self.versions.read("log")

    def calls(self):
        """Calls made so far, repeated ones included."""
        return (self.memo().agg(F.sum("attempts")).first()[0] or 0) if self.versions.tables() else 0

    def answer(self, rows, prompt="prompt"):
        """rows with reply and status: known, asked, failed (no reply), held (the budget is spent) or null for null prompts.

        Prompts are made distinct and met with the memo; what is new is asked in the order of its key until the budget is
        spent, where a prompt counts with all the calls that it may need. What failed before is asked again.
        """
        rows = rows.withColumn("_key", F.sha2(F.col(prompt), 256))
        wanted = rows.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.first(prompt).alias("prompt"))
        known = self.memo().where("reply IS NOT NULL").groupBy("key").agg(F.first("reply").alias("reply"))
        new = cut(wanted.join(known, "key", "left_anti"))
        n_new = new.count()
        run, asked = None, None
        if n_new:
            tables, base = self.versions.tables(), (self.versions.numbers() or [0])[-1]
            each = 1 + self.retries
            room = n_new * each if self.budget is None else max(0, self.budget - self.calls())
            share = F.least(F.lit(each), F.greatest(F.lit(0), F.lit(room) - F.col("no") * each)).cast("int")
            due = numbered(new, "key").withColumn("most", share).where("most > 0").select("key", "prompt", "most")
            asked = due.repartition(self.tasks).mapInPandas(_asking(self.completer, self.pause), _MEMO)
            path = self.versions.write("memo", asked)
            asked = self.spark.read.schema(_MEMO).parquet(path)
            run = len(tables.get("log", []))
            one = asked.agg(F.count("*").alias("asked"), F.count_if(F.col("reply").isNull()).alias("failed"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("calls"))
            total = wanted.count()
            line = one.select(F.lit(run).alias("run"), F.lit(total).alias("wanted"), F.lit(total - n_new).alias("known"), "asked", "failed", "calls", (F.lit(n_new) - F.col("asked")).alias("held_back"))
            self.versions.publish({"memo": [*tables.get("memo", []), path], "log": [*tables.get("log", []), self.versions.write("log", line)]}, base)
        now = known.withColumn("_status", F.lit("known"))
        if asked is not None:
            now = now.unionByName(asked.select("key", "reply", F.when(F.col("reply").isNull(), "failed").otherwise("asked").alias("_status")))
        now = now.select(F.col("key").alias("_key"), "reply", "_status")
        out = rows.join(now, "_key", "left")
        return out.withColumn("status", F.when(F.col("_key").isNotNull(), F.coalesce("_status", F.lit("held")))).drop("_key", "_status")


#: Words of a question that call for a specialist, in the order in which they are looked for.
SPECIALIST_WORDS = {
    "cfo": ["cost", "budget", "roi", "revenue", "margin", "p&l", "capex", "investment"],
    "commercial": ["customer", "deal", "account", "partner", "win", "loss", "sourcing", "contract", "pipeline"],
    "marketing": ["brand", "narrative", "positioning", "launch", "marketing", "gtm", "campaign"],
    "hr": ["people", "team", "headcount", "hire", "attrition", "comp", "perf"],
    "strategy": ["portfolio", "100m", "filter", "long term", "second order", "option", "thesis"],
}
#: Who is asked where no word calls for anybody, and who always is unless a question only wants to know.
DEFAULT_SPECIALISTS, CRITIC, PANEL = ["strategy", "commercial"], "contrarian", ["contrarian", "strategy", "commercial"]
KNOWING_WORDS = ["what is", "tell me about", "summary", "summarise", "explain"]


def _says(text, words):
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def specialists(query, most=3):
    """Keys of the specialists that the words of a question call for, the critic first."""
    low = F.lower(F.coalesce(query, F.lit("")))
    picks = F.filter(F.array(*(F.when(_says(low, words), F.lit(key)) for key, words in SPECIALIST_WORDS.items())), lambda x: x.isNotNull())
    picks = F.when(F.size(picks) == 0, F.array(*(F.lit(x) for x in DEFAULT_SPECIALISTS))).otherwise(picks)
    picks = F.when(_says(low, KNOWING_WORDS), picks).otherwise(F.concat(F.array(F.lit(CRITIC)), picks))
    return F.slice(picks, 1, most)


def council(questions, personas, completions, cross_read=True, most=4):
    """One row a question (query_id, query, context): who was asked, their takes, and a conclusion.

    personas: (key, label, system). Four rounds, each a join and one answer(): who to ask (where the reply names nobody
    of the roster, the panel's default), each one's take, each one's second take with those of the others, and one
    conclusion. A round that fails leaves what the round before said.
    """
    order = F.array(*(F.lit(p) for p in PANEL))
    roster = F.broadcast(personas.agg(F.array_sort(F.collect_list("key")).alias("roster")))  # one row
    q = questions.crossJoin(roster)
    ask = F.concat(F.lit("Who of "), F.array_join("roster", ", "), F.lit(" should answer? JSON: {\"personas\": [], \"rationale\": \"\"}\n"), F.substring("query", 1, 1500))
    q = completions.answer(q.withColumn("prompt", ask))
    named = salvage_json(F.col("reply"), "personas array<string>, rationale string")
    valid = F.slice(F.array_intersect(F.coalesce(named["personas"], F.array().cast("array<string>")), F.col("roster")), 1, most)
    q = q.withColumn("_valid", valid).withColumn("asked", F.when(F.size("_valid") > 0, F.col("_valid")).otherwise(F.array_intersect(order, F.col("roster"))))
    q = cut(q.select("query_id", "query", "context", "asked", F.when(F.size("_valid") > 0, F.coalesce(F.substring(named["rationale"], 1, 240), F.lit(""))).otherwise("fallback").alias("rationale")))
    each = q.select("query_id", "query", "context", F.posexplode("asked").alias("place", "key")).join(personas, "key")
    head = F.concat(F.col("system"), F.lit("\n\n"))
    each = completions.answer(each.withColumn("prompt", F.concat(head, F.lit("What is known:\n"), F.substring(F.coalesce("context", F.lit("(nothing)")), 1, 8000), F.lit("\n\nQuestion: "), F.substring("query", 1, 2000))))
    takes = cut(each.select("query_id", "query", "place", "key", "label", "system", F.trim(F.coalesce("reply", F.lit(""))).alias("take")))
    if cross_read:
        beside = takes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "key", "label", "take"))).alias("all"))
        others = F.filter("all", lambda x: (x["key"] != F.col("key")) & (x["take"] != ""))
        text = F.array_join(F.transform(others, lambda x: F.concat(F.lit("### "), x["label"], F.lit("\n\n"), x["take"])), "\n\n---\n\n")
        again = takes.join(beside, "query_id").withColumn("prompt", F.when(F.size("all") > 1, F.concat(head, F.lit("Your take:\n"), "take", F.lit("\n\nThe others:\n"), text, F.lit("\n\nRevise yours or stand by it."))))
        again = completions.answer(again)
        takes = cut(again.select("query_id", "query", "place", "key", "label", "take", F.coalesce(F.trim("reply"), F.col("take")).alias("revised")))
    else:
        takes = takes.withColumn("revised", F.col("take"))
    stances = takes.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("place", "key", "label", "take", "revised"))).alias("takes"))
    block = F.substring(F.array_join(F.transform("takes", lambda x: F.concat(F.lit("### "), x["label"], F.lit("\n\n"), x["revised"])), "\n\n---\n\n"), 1, 18000)
    final = completions.answer(stances.withColumn("prompt", F.concat(F.lit("Conclude in JSON: {\"conclusion\": \"\", \"options\": [], \"decision_required\": false}\nQuestion: "), F.substring("query", 1, 2000), F.lit("\n\n"), block)))
    said = salvage_json(F.col("reply"), "conclusion string, options array<string>, decision_required boolean")
    text = F.coalesce(F.nullif(F.trim(said["conclusion"]), F.lit("")), F.nullif(F.trim("reply"), F.lit("")), F.lit("(no conclusion)"))
    final = final.select("query_id", "takes", text.alias("conclusion"), F.slice(F.coalesce(said["options"], F.array().cast("array<string>")), 1, 3).alias("options"), F.coalesce(said["decision_required"], F.lit(False)).alias("decision_required"))
    return q.select("query_id", "asked", "rationale").join(final, "query_id")


def reconsolidate(turns, activated, entities, completions, day, most=10):
    """(session, turn, n_findings, path, reason, content): a proposal for each turn whose reply speaks against or adds to what is remembered.

    turns: (session, turn, user, assistant); activated: (session, turn, eid, strength). Replies of under 100 characters
    and turns that activate no known entity aren't asked about; the strongest `most` entities are named. Findings are
    (kind, entity, summary, confidence); one contradiction of 0.7 or more makes the turn one that contradicts.
    """
    rank = F.row_number().over(Window.partitionBy("session", "turn").orderBy(F.desc("strength"), "eid"))
    top = activated.withColumn("n", rank).where(F.col("n") <= most)
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("?")), F.lit(" ("), F.coalesce("type", F.lit("?")), F.lit(")"))
    if "description" in entities.columns:
        line = F.concat(line, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.substring("description", 1, 200))).otherwise(""))
    named = top.join(entities, "eid").groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    asked = turns.where(F.char_length("assistant") >= 100).join(named, ["session", "turn"])
    prompt = F.concat(F.lit("Known:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n\nWhat does this contradict or add? JSON: {\"findings\": [{\"kind\": \"\", \"entity\": \"\", \"summary\": \"\", \"confidence\": 0.5}]}\n"), F.substring("user", 1, 1000))
    r = completions.answer(asked.withColumn("prompt", prompt))
    found = salvage_json(F.col("reply"), "findings array<struct<kind:string,entity:string,summary:string,confidence:double>>")["findings"]
    r = r.withColumn("findings", found).where(F.size(F.coalesce("findings", F.array().cast(r.select(found.alias("f")).schema["f"].dataType))) > 0)
    sure = lambda f: F.coalesce(f["confidence"], F.lit(0.5))
    clash = F.exists("findings", lambda f: (sure(f) >= 0.7) & (f["kind"] == "contradiction"))
    lines = F.transform("findings", lambda f: F.concat(F.lit("- "), F.when(f["kind"] == "contradiction", "⚡").otherwise("➕"), F.lit(" **"), F.coalesce(f["entity"], F.lit("?")), F.lit("** — "), F.coalesce(f["summary"], F.lit("")), F.lit(" _(conf "), F.format_string("%.2f", sure(f)), F.lit(")_")))
    content = F.concat(F.lit(f"# Reconsolidation log\n\n_Updated {day}_\n\n## Session "), F.col("session").cast("string"), F.lit(' — "'), F.substring("user", 1, 80), F.lit('"\n\n'), F.array_join(lines, "\n"))
    reason = F.concat(F.lit("Reconsolidation: chat response "), F.when(clash, "contradicts").otherwise("enriches"), F.lit(" memory ("), F.size("findings").cast("string"), F.lit(" update[s])"))
    return r.select("session", "turn", F.size("findings").alias("n_findings"), F.lit("MEMORY/episodic/reconsolidation_log.md").alias("path"), reason.alias("reason"), content.alias("content"))


def compress(files, selected, completions, stamp):
    """(path, status, body, new_chars, actual_savings, backup): what compression makes of the selected files (path, age_days, savings).

    status: ok, or error where the reply is missing or under 50 characters; body and backup (where the old text goes) are
    null then. files: (path, body). Writing both is up to the caller, with filetree.write_files.
    """
    both = files.select("path", F.col("body").alias("old")).join(selected.select("path", "age_days", "savings"), "path")
    prompt = F.concat(F.lit("Shorten this note of "), F.col("age_days").cast("string"), F.lit(" days by about "), F.col("savings").cast("string"), F.lit(" characters; keep names, numbers and decisions. End with [Compressed ...].\n\n"), F.col("old"))
    r = completions.answer(both.withColumn("prompt", prompt))
    ok = F.char_length(F.coalesce("reply", F.lit(""))) >= 50
    folder, name = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    backup = F.concat(folder, F.lit("_pre_compression_backups/"), name, F.lit(f"_{stamp}.md"))
    return r.select("path", F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, F.col("reply")).alias("body"), F.when(ok, F.char_length("reply")).alias("new_chars"), F.when(ok, F.char_length("old") - F.char_length("reply")).alias("actual_savings"), F.when(ok, backup).alias("backup"))
