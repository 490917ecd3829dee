"""Deadlines and calendar events: filters and order, links to entities, and meetings as part of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators.ordered import numbered

#: Kinds of entities that an account slug may mean.
ACCOUNT_TYPES = ["account", "company"]


def urgency_rank(urgency):
    """0 high, 1 medium or anything else, 2 low."""
    return F.when(urgency == "high", 0).when(urgency == "low", 2).otherwise(1)


def deadlines(signals, today):
    """(rank, path, deadline, subject, action, urgency, confidence): what still asks for something.

    signals: (path, subject, actionable, action, urgency, confidence, deadline as ISO date or null, already_responded).
    Answered ones and those with a past date go; dated ones come first, by urgency and date, ties by path.
    """
    open_ = signals.where("actionable and not coalesce(already_responded, false)").where(F.col("deadline").isNull() | (F.col("deadline") >= today))
    r = open_.select("path", F.coalesce("deadline", F.lit("")).alias("deadline"), "subject", F.substring(F.coalesce("action", F.lit("")), 1, 160).alias("action"), F.coalesce("urgency", F.lit("medium")).alias("urgency"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    order = F.struct((F.col("deadline") == "").alias("a"), urgency_rank(F.col("urgency")).alias("b"), F.col("deadline").alias("c"), F.col("path").alias("d"))
    return numbered(r.withColumn("_order", order), "_order").withColumn("rank", F.col("no") + 1).drop("_order", "no")


def calendar_order(events):
    """Events with rank: no cancelled or personal ones; high stakes first, then by urgency, date and id."""
    r = events.where("not coalesce(is_cancelled, false) and coalesce(kind, '') <> 'personal'")
    order = F.struct((~F.coalesce("is_high_stakes", F.lit(False))).alias("a"), urgency_rank(F.col("urgency")).alias("b"), F.col("iso").alias("c"), F.col("event_id").alias("d"))
    return numbered(r.withColumn("_order", order), "_order").withColumn("rank", F.col("no") + 1).drop("_order", "no")


def pressing_events(ordered_events, today, until, most=12):
    """The next events of high stakes in a window of ISO dates, by date and then by calendar order; undated ones count."""
    iso = F.coalesce("iso", F.lit(""))
    r = ordered_events.where(F.coalesce("is_high_stakes", F.lit(False))).where((iso == "") | iso.between(today, until))
    return r.orderBy(iso, "rank").limit(most)


def link_index(entities, types, order="eid"):
    """(key, eid): names and their words, in lower case, of entities of some types; the first entity that has a key keeps it."""
    e = entities.where(F.col("type").isin(*types) & (F.trim("name") != "")).select("eid", F.lower(F.trim("name")).alias("name"), F.col(order).alias("ord"))
    keys = e.select("eid", "ord", F.posexplode(F.concat(F.array("name"), F.split("name", r"\s+"))).alias("pos", "key"))
    return keys.groupBy("key").agg(F.min_by("eid", F.struct("ord", "pos")).alias("eid"))


def resolve_slugs(rows, column, index):
    """rows with eid (or null): the index's entity for a slug, or for the slug with spaces for underscores."""
    a = index.select(F.col("key").alias("_a"), F.col("eid").alias("_a_eid"))
    b = index.select(F.col("key").alias("_b"), F.col("eid").alias("_b_eid"))
    r = rows.withColumn("_a", F.lower(column)).withColumn("_b", F.replace(F.lower(column), F.lit("_"), F.lit(" ")))
    r = r.join(a, "_a", "left").join(b, "_b", "left")
    return r.withColumn("eid", F.coalesce("_a_eid", "_b_eid")).drop("_a", "_b", "_a_eid", "_b_eid")


def meeting_id(events):
    """One id a series: the slug of the summary, and the date where the event doesn't recur."""
    base = T.under_slug(F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.lit("meeting")))
    single = F.concat(F.lit(":"), F.coalesce("iso", F.lit("unknown")))
    return F.concat(F.lit("meeting:"), base, F.when(F.coalesce("is_recurring", F.lit(False)), "").otherwise(single))


def meetings(ordered_events):
    """(eid, name, type, urgency, next_iso, salience) of the series of high stakes; the last event of a series counts."""
    m = ordered_events.where(F.coalesce("is_high_stakes", F.lit(False))).withColumn("eid", meeting_id(ordered_events))
    last = m.groupBy("eid").agg(F.max_by(F.struct("summary", F.coalesce("urgency", F.lit("medium")).alias("urgency"), F.coalesce("iso", F.lit("")).alias("iso")), "rank").alias("e"))
    return last.select("eid", F.col("e.summary").alias("name"), F.lit("meeting").alias("type"), "e.urgency", F.col("e.iso").alias("next_iso"), F.when(F.col("e.urgency") == "high", 0.7).otherwise(0.55).alias("salience"))


#: Of each kind of link its entity types, its weight, and the relations there and back.
MEETING_LINKS = [("people_links", ["person"], 0.6, "attended_by", "attends"), ("account_links", ACCOUNT_TYPES, 0.7, "about_account", "discussed_in")]


def meeting_edges(ordered_events, entities):
    """(src, dst, type, weight): both ways between a meeting and who and what it links to, once an event; unknown slugs have none."""
    m = ordered_events.where(F.coalesce("is_high_stakes", F.lit(False))).withColumn("mid", meeting_id(ordered_events))
    out = None
    for column, types, weight, there, back in MEETING_LINKS:
        hit = resolve_slugs(m.select("mid", F.explode(column).alias("slug")), "slug", link_index(entities, types)).where("eid is not null")
        for src, dst, kind in (("mid", "eid", there), ("eid", "mid", back)):
            part = hit.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))
            out = part if out is None else out.unionByName(part)
    return out


def write_meetings(entities, edges, ordered_events):
    """(entities, edges) in which the meetings of these events replace all that were there, with their edges."""
    old = entities.where("type = 'meeting'").select("eid")
    kept = edges.join(old.select(F.col("eid").alias("src")), "src", "left_anti").join(old.select(F.col("eid").alias("dst")), "dst", "left_anti")
    nodes = entities.where("coalesce(type, '') <> 'meeting'").unionByName(meetings(ordered_events).select("eid", "name", "type", F.col("salience").alias("base")), allowMissingColumns=True)
    return nodes, kept.unionByName(meeting_edges(ordered_events, entities), allowMissingColumns=True)
