"""What a status page shows: what is open and how much of it, and what presses most."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.operators import signals
from kelpie.operators.graph import context_edges

#: States that close a contradiction or a question.
SETTLED = ["resolved_A", "resolved_B", "both_true", "both_false", "dismissed", "superseded"]
CLOSED = ["answered", "dismissed", "resolved", "closed", "stale"]


def _counted(rows, order, most):
    """The first rows of an order, each with the number of all; that is one row, counted by a combining aggregate."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total))


def open_contradictions(contradictions, most=50):
    """(src, type, old_dst, new_dst, severity, status, total): the gravest that aren't settled."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    rows = contradictions.where(~F.coalesce("status", F.lit("unresolved")).isin(*SETTLED))
    return _counted(rows.select("src", "type", "old_dst", "new_dst", "severity", "status"), [rank, "src", "type", "old_dst", "new_dst"], most)


def open_questions(questions, most=50):
    """(id, text, priority, status, total): what is open, without the lines that templates add, 400 characters of each."""
    rows = questions.where(~F.coalesce("status", F.lit("open")).isin(*CLOSED))
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace("text", r"(?s)\*\*Status:\*\*.*$", "")), r"(?s)\*\*Review:\*\*.*$", ""))
    text = F.substring(F.when(clean != "", clean).otherwise(F.col("text")), 1, 400)
    return _counted(rows.select("id", text.alias("text"), F.coalesce("priority", F.lit("medium")).alias("priority"), F.coalesce("status", F.lit("open")).alias("status")), ["id"], most)


def pending_proposals(proposals, most=80):
    """(uid, path, reason, salience, ts, total): pending ones, the most salient first, the newest of equals."""
    rows = proposals.where("status = 'pending'").withColumn("_s", F.coalesce("salience", F.lit(0.0)))
    rows = rows.select("uid", "path", F.substring(F.coalesce("reason", F.lit("")), 1, 300).alias("reason"), F.round("_s", 2).alias("salience"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"), "_s", "ts")
    return _counted(rows, [F.desc("_s"), F.desc("ts"), "uid"], most).select("uid", "path", "reason", "salience", F.col("shown").alias("ts"), "total")


def top_of_mind(events, pins, deadlines, today, until, most_events=12, most_pins=30):
    """(kind, place, label, at): events of high stakes in a window, what is pinned, and deadlines, each in its order.

    events: of signals.calendar_order; pins: (path, pinned_at); deadlines: rows with rank, path and deadline.
    """
    one = lambda rows, kind, label, at, order: rows.select(F.lit(kind).alias("kind"), label.alias("label"), at.cast("string").alias("at"), order.alias("_o"))
    shown = signals.pressing_events(events, today, until, most_events)
    a = one(shown, "event", F.col("summary"), F.coalesce("iso", F.lit("")), F.struct(F.coalesce("iso", F.lit("")).alias("a"), F.lpad(F.col("rank").cast("string"), 19, "0").alias("b")))
    newest = pins.orderBy(F.desc("pinned_at"), "path").limit(most_pins)
    b = one(newest, "pinned", F.col("path"), F.date_format("pinned_at", "yyyy-MM-dd HH:mm:ss"), F.struct(F.lpad((F.lit(10**17) - F.unix_micros(F.col("pinned_at").cast("timestamp"))).cast("string"), 19, "0").alias("a"), F.col("path").alias("b")))
    c = one(deadlines, "deadline", F.col("path"), F.col("deadline"), F.struct(F.lpad(F.col("rank").cast("string"), 19, "0").alias("a"), F.col("path").alias("b")))
    rows = a.unionByName(b).unionByName(c)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("_o"))).select("kind", "place", "label", "at")


def context_block(entities, edges, activated, most=4):
    """(eid, line): each activated node as a prompt has it: name, type, what it is, and its first edges by name.

    A line is `- name (type): description [edge; edge]`; what a node lacks is left out. Ends without a name go by their id.
    """
    name = entities.select(F.col("eid").alias("_e"), F.col("name").alias("_n"))
    near = context_edges(edges, activated.select(F.col("eid").alias("node")), most)
    near = near.withColumn("_other", F.when(F.col("src") == F.col("node"), F.col("dst")).otherwise(F.col("src"))).join(name, F.col("_other") == F.col("_e"), "left")
    text = F.when(F.col("src") == F.col("node"), F.concat("type", F.lit(" → "), F.coalesce("_n", "_other"))).otherwise(F.concat(F.coalesce("_n", "_other"), F.lit(" → "), "type"))
    lines = near.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("_l"))
    about = F.coalesce(F.col("description"), F.lit("")) if "description" in entities.columns else F.lit("")
    r = entities.join(activated.select("eid"), "eid", "left_semi").join(lines, F.col("eid") == F.col("node"), "left")
    tail = F.coalesce(F.concat(F.lit(" ["), F.array_join(F.transform("_l", lambda x: x["t"]), "; "), F.lit("]")), F.lit(""))
    return r.select("eid", F.concat(F.lit("- "), F.coalesce("name", "eid"), F.lit(" ("), F.coalesce("type", F.lit("?")), F.lit(")"), F.when(about != "", F.concat(F.lit(": "), F.substring(about, 1, 200))).otherwise(""), tail).alias("line"))

