"""Writers: snapshots, append-only logs, keyed merges and rendered Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F


def snapshot(df, root, kind="parquet"):
    """Write a new version below root and return its path; readers take the path they are given, so none is half written."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.format(kind).save(path)
    return path


def append_log(df, path):
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def merge(current, incoming, key, order):
    """current plus the incoming rows of new keys, of each the first in order: what has a key stays as it is."""
    fresh = incoming.join(current.select(key), key, "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return current.unionByName(fresh, allowMissingColumns=True)


def email_markdown(emails):
    """(…, markdown) of cleaned mail."""
    head = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), F.col(c)))
    return emails.withColumn("markdown", F.concat_ws("\n", head("From", "sender"), head("Subject", "subject"), F.lit(""), F.col("cleaned")))


def event_files(events, as_of, back_days=7, ahead_days=30):
    """(month, name, markdown) of events near a clock, without cancelled ones; write with partitionBy('month')."""
    near = F.col("start").between(F.expr(f"timestamp'{as_of}' - INTERVAL {back_days} DAYS"), F.expr(f"timestamp'{as_of}' + INTERVAL {ahead_days} DAYS"))
    e = events.where(near & (F.upper("status") != "CANCELLED"))
    slug = F.regexp_replace(F.lower("summary"), r"[^a-z0-9]+", "-")
    body = F.concat(F.lit("# "), F.col("summary"), F.lit("\n\n- Start: "), F.date_format("start", "yyyy-MM-dd HH:mm"), F.lit("\n- End: "), F.date_format("end", "yyyy-MM-dd HH:mm"), F.lit("\n- Attendees: "), F.array_join("attendees", ", "))
    return e.select(F.date_format("start", "yyyy-MM").alias("month"), F.concat(F.date_format("start", "yyyy-MM-dd_HHmm_"), F.substring(slug, 1, 60), F.lit(".md")).alias("name"), body.alias("markdown"))


def index_page(pages):
    """(topic, markdown): an index of each topic's pages (topic, name, title, summary) in name order."""
    line = F.concat(F.lit("- [["), F.col("name"), F.lit("|"), F.col("title"), F.lit("]] - "), F.col("summary"))
    r = pages.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("l")))).alias("_l"))
    return r.select("topic", F.concat(F.lit("# "), F.col("topic"), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("markdown"))


def transcript_markdown(blocks):
    """(file, markdown) of merged blocks."""
    from kelpie.functions.text import vtt_stamp

    line = F.concat(F.lit("**"), F.col("speaker"), F.lit("** ("), vtt_stamp(F.col("start")), F.lit("): "), F.col("text"))
    r = blocks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", line.alias("l")))).alias("_l"))
    return r.select("file", F.array_join(F.transform("_l", lambda x: x["l"]), "\n\n").alias("markdown"))
