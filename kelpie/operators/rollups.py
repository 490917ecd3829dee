"""Health, volume, cost and coverage rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import scoring as S

SKIPPED = ["archive", "_raw", "_pre_compression_backups", "sessions", "proposals", "priming", "health"]


def age_days(as_of, column="mtime"):
    return (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(column).cast("timestamp"))) / 86400.0


def tier_distribution(entities):
    """Count per tier, zero where a tier has none."""
    dim = entities.sparkSession.createDataFrame([("working",), ("episodic",), ("semantic",), ("crystallised",)], "tier string")
    n = entities.groupBy(F.coalesce("tier", F.lit("semantic")).alias("tier")).agg(F.count("*").alias("n"))
    return dim.join(n, "tier", "full_outer").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def graph_quality(edges, entities):
    e = edges.agg(F.coalesce(F.round(F.avg(F.coalesce("weight", F.lit(0.5))), 3), F.lit(0.0)).alias("avg_weight"), F.coalesce(F.round(F.avg(F.coalesce("confidence", F.lit(0.7))), 3), F.lit(0.0)).alias("avg_confidence"), F.count("*").alias("edge_count"))
    return e.crossJoin(entities.agg(F.count("*").alias("entity_count")))


def age_distribution(files, as_of):
    """Whole percentages of files by age, and the total."""
    t = files.select(S.age_tier(age_days(as_of)).alias("tier"))
    n = F.count("*")
    share = lambda tier: F.coalesce(F.round(100.0 * F.count(F.when(F.col("tier") == tier, 1)) / F.when(n > 0, n)), F.lit(0.0)).cast("int").alias(tier)
    return t.agg(*(share(x) for x in ("fresh", "aging", "mature", "ancient")), n.alias("total"))


def _covered(entities, files):
    f = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(s) for s in SKIPPED)))).select("path").distinct()
    referenced = entities.select(F.explode("sources").alias("path")).distinct().withColumn("hit", F.lit(1))
    return f.join(referenced, "path", "left").select("path", F.coalesce("hit", F.lit(0)).alias("hit"))


def coverage(entities, files):
    """(score, well, thin, blind): share of files that an entity refers to, and folders by their share."""
    c = _covered(entities, files)
    by = c.groupBy(F.get(F.split("path", "/"), F.lit(1)).alias("dir")).agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    ratio = F.col("hits") / F.col("n")
    pick = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("dir")))), ",")
    return by.agg(F.round(100.0 * F.sum("hits") / F.greatest(F.sum("n"), F.lit(1))).cast("int").alias("score"), pick(ratio >= 0.7).alias("well"), pick((ratio >= 0.3) & (ratio < 0.7)).alias("thin"), pick(ratio < 0.3).alias("blind"))


def volume(files, as_of):
    """Files, characters and tokens in all and by folder (folder null: all), with what a day and a week added."""
    parts = F.split(F.regexp_replace("path", "^MEMORY/", ""), "/")
    folder = F.when(F.size(parts) == 1, "(root)").when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    f = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(s) for s in SKIPPED)))).select(folder.alias("folder"), "size_bytes", age_days(as_of).alias("age"))
    r = f.rollup("folder").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("chars"), F.count(F.when(F.col("age") < 1, 1)).alias("added_24h"), F.count(F.when(F.col("age") < 7, 1)).alias("added_7d"))
    return r.withColumn("tokens", F.floor(F.col("chars") / 4))


def cost_summary(log, as_of, days=7):
    """(model, operation, date, calls, cost) by each of the three alone and in all, over the last days: one pass of grouping sets."""
    recent = log.where(age_days(as_of, "ts") <= days)
    r = recent.groupingSets([["model"], ["operation"], ["date"], []], "model", "operation", "date")
    return r.agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.grouping_id().alias("gid"))


def budget_status(log, day, budget=2.0, warn=0.8):
    t = log.where(F.col("date") == F.lit(day).cast("date")).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("c"))
    pct = F.col("c") / budget
    return t.select(F.when(pct > 1.0, "over").when(pct > warn, "warn").otherwise("ok").alias("status"), F.round("c", 4).alias("today_usd"), F.lit(budget).alias("budget"), F.round(pct * 100, 1).alias("pct"))


def top_counts(rows, column, most):
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def status_counts(proposals):
    return proposals.groupBy("status").agg(F.count("*").alias("n"))


def community_labels(members, entities):
    """(community, label, n): the most frequent type of its members (of equals the first by name) and their number."""
    t = members.join(entities.select("eid", "type"), "eid", "left").select("community", F.coalesce("type", F.lit("?")).alias("type"))
    n = t.groupBy("community", "type").agg(F.count("*").alias("n"))
    r = n.groupBy("community").agg(F.min_by("type", F.struct((-F.col("n")).alias("a"), F.col("type").alias("b"))).alias("type"), F.sum("n").alias("n"))
    return r.select("community", F.concat(F.initcap("type"), F.lit(" cluster ("), F.col("n").cast("string"), F.lit(" nodes)")).alias("label"), "n")


def compression_summary(results):
    """One row of counts over (status, before, after): done, skipped, failed, characters saved."""
    done = F.col("status") == "ok"
    return results.agg(
        F.count(F.when(done, 1)).alias("compressed"), F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"),
        F.coalesce(F.sum(F.when(done, F.col("before") - F.col("after"))), F.lit(0)).alias("chars_saved"),
    )


def runs_on(log, day):
    """One row: how many records of a log bear a date (its first ten characters)."""
    return log.agg(F.count(F.when(F.substring(F.coalesce("date", F.lit("")), 1, 10) == day, 1)).alias("runs"))
