"""Ordered analytics: drift, sessions, budgets, superseding, near-duplicate proposals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators.cut import cut


def drift(turns, threshold=0.20):
    """(conv_id, turn, jaccard, drifted) of user turns against the user turn before; the first has drifted."""
    u = turns.where((F.col("role") == "user") & (F.col("text") != ""))
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = u.select("conv_id", "turn", T.drift_tokens(F.col("text")).alias("now"), F.lag("text").over(w).alias("_before"))
    r = r.withColumn("before", T.drift_tokens(F.col("_before")))
    j = T.jaccard(F.col("now"), F.col("before"))
    empty = F.col("_before").isNull() | (F.size(F.array_union("now", "before")) == 0)
    return r.select("conv_id", "turn", F.when(empty, F.lit(None)).otherwise(F.round(j, 6)).alias("jaccard"), F.when(empty, True).otherwise(j < threshold).alias("drifted"))


def merge_cues(cues, gap=120.0):
    """(file, block, speaker, start, end, text): neighbouring cues of one speaker with a gap of at most two minutes."""
    w = Window.partitionBy("file").orderBy("n")
    new = F.lag("speaker").over(w).isNull() | (F.lag("speaker").over(w) != F.col("speaker")) | (F.col("start") - F.lag("end").over(w) > gap)
    r = cues.withColumn("_new", new.cast("int")).withColumn("block", F.sum("_new").over(w))
    r = r.groupBy("file", "block", "speaker").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("_t"))
    return r.withColumn("text", F.array_join(F.transform("_t", lambda x: x["text"]), " ")).drop("_t")


def merge_paragraphs(cues, gap=3.0, most=500):
    """(file, paragraphs): texts joined while the last doesn't end in a full stop, or the pause is short and the whole stays under a length.

    The length depends on what is joined so far, so an ordered array is folded per file.
    """
    item = F.struct("n", "start", "end", "text")
    rows = cues.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0.0).alias("end"))

    def step(a, x):
        joined = F.concat_ws(" ", a["cur"], x["text"])
        goes_on = ~a["cur"].endswith(".") | ((x["start"] - a["end"] < gap) & (F.char_length(joined) <= most))
        first = a["cur"].isNull()
        return F.struct(
            F.when(first | goes_on, a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))).alias("done"),
            F.when(first | ~goes_on, x["text"]).otherwise(joined).alias("cur"), x["end"].cast("double").alias("end"),
        )

    done = F.aggregate("items", zero, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
    return rows.select("file", done.alias("paragraphs"))


def _similar(sets, threshold):
    """(path, newer, older, similarity): pairs of distinct word sets (path, id, words, at) of a path with Jaccard >= threshold.

    Words are put in the order of how rare they are in their path. Sets that are that similar share one of their first
    |x| - ceil(threshold |x|) + 1 words, and are of like size: only such pairs meet, on that word, and are compared.
    """
    counts = sets.select("path", F.explode("words").alias("word")).groupBy("path", "word").agg(F.count("*").alias("n"))
    ranked = sets.select("path", "id", F.explode("words").alias("word")).join(counts, ["path", "word"]).groupBy("path", "id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    whole = cut(sets.join(ranked, ["path", "id"]).select("path", "id", "at", F.transform("ranked", lambda x: x["word"]).alias("words")))
    size = F.size("words")
    head = F.explode(F.slice("words", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))).alias("word")
    probe = lambda name: whole.select("path", F.col("id").alias(name), F.col("at").alias(f"{name}_at"), size.alias(f"{name}_n"), head)
    near = probe("newer").join(probe("older"), ["path", "word"]).where((F.col("newer_at") < F.col("older_at")) & (F.least("newer_n", "older_n") >= F.lit(threshold) * F.greatest("newer_n", "older_n") - 1e-9))
    near = near.select("path", "newer", "older").distinct()
    for name in ("newer", "older"):
        near = near.join(whole.select("path", F.col("id").alias(name), F.col("words").alias(f"{name}_words")), ["path", name])
    near = near.withColumn("similarity", T.jaccard(F.col("newer_words"), F.col("older_words"))).where(F.col("similarity") >= threshold)
    return near.select("path", "newer", "older", "similarity")


def near_duplicate_proposals(proposals, threshold=0.55):
    """(path, uid, kept, similarity): newest first within a path, a proposal goes if a kept newer one is that similar.

    similarity: that of the most similar kept newer one, null where the proposal stays. Proposals without words stay.
    Equal word sets are compared once. What is dropped hangs on what was kept, so it is decided in rounds: a set stays
    when no newer similar one is undecided or kept, and goes when one is kept; all sets of all paths at once. Ties of
    time go by uid, the least first.
    """
    p = proposals.select("path", "uid", "ts", F.array_sort(T.proposal_tokens(F.coalesce("reason", F.lit("")))).alias("words"))
    some = cut(p.withColumn("at", F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "uid")).withColumn("id", F.xxhash64("words")))
    full = some.where(F.size("words") > 0)
    sets = cut(full.groupBy("path", "id", "words").agg(F.min("at").alias("at")))
    pairs = cut(_similar(sets, threshold))
    open_, kept = sets.select("path", "id"), sets.select("path", "id").limit(0)
    while open_.limit(1).count():
        waits = pairs.join(open_.select("path", F.col("id").alias("newer")), ["path", "newer"]).select("path", F.col("older").alias("id"))
        stays = cut(open_.join(waits.distinct(), ["path", "id"], "left_anti"))
        goes = pairs.join(stays.select("path", F.col("id").alias("newer")), ["path", "newer"]).select("path", F.col("older").alias("id")).distinct()
        kept = cut(kept.union(stays))
        open_ = cut(open_.join(stays, ["path", "id"], "left_anti").join(goes, ["path", "id"], "left_anti"))
    first = kept.join(sets.select("path", "id", F.col("at").alias("kept_at")), ["path", "id"])
    own = first.select("path", "id", F.col("id").alias("by"), F.lit(1.0).alias("similarity"), "kept_at")
    # a kept set may stand between repeats of one that is newer, so both ends of a pair may be the one that stays
    both = pairs.union(pairs.select("path", F.col("older").alias("newer"), F.col("newer").alias("older"), "similarity"))
    others = both.join(first.select("path", F.col("id").alias("newer"), "kept_at"), ["path", "newer"]).select("path", F.col("older").alias("id"), F.col("newer").alias("by"), "similarity", "kept_at")
    hits = full.select("path", "id", "uid", "at").join(own.union(others), ["path", "id"]).where(F.col("kept_at") < F.col("at")).groupBy("path", "uid").agg(F.max("similarity").alias("similarity"))
    r = some.select("path", "uid").join(hits, ["path", "uid"], "left")
    return r.select("path", "uid", F.col("similarity").isNull().alias("kept"), F.round("similarity", 6).alias("similarity"))


def supersede(proposals):
    """Pending proposals for a path for which a later one of another source exists, with the first such.

    In order of time and uid, the proposals of one source in a row have one answer: the first of the next row of another.
    """
    p = proposals.where(F.col("status") == "pending")
    w = Window.partitionBy("path").orderBy("ts", "uid")
    p = p.withColumn("_turn", F.coalesce((F.col("source") != F.lag("source").over(w)).cast("int"), F.lit(0)))
    p = p.withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = p.where("_turn = 1").select("path", (F.col("_run") - 1).alias("_run"), F.col("uid").alias("superseded_by"))
    return p.select("path", "uid", "_run").join(heads, ["path", "_run"]).select("path", "uid", "superseded_by")


def keep_first(rows, key, order):
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def context_budget(ranked, budget=80_000, per_file=5_000):
    """(query_id, path, rank, taken): files in rank order, each cut to its cap and to what is left of the budget.

    ranked has the length of each file, or its body.
    """
    length = F.col("length") if "length" in ranked.columns else F.char_length("body")
    cut = F.least(length, F.lit(per_file))
    before = F.coalesce(F.sum(cut).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.select("query_id", "path", "rank", cut.alias("_c"), before.alias("_b")).where(F.col("_b") < budget).select("query_id", "path", "rank", F.least("_c", F.lit(budget) - F.col("_b")).alias("taken"))


def numbered(rows, column):
    """Rows with no, 0 and on in order of a column, without one task that sorts all: range partitions, and their counts summed."""
    # kept in the shared folder: a lost partition that is computed again might be numbered otherwise
    parts = cut(rows.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_before")  # one row per partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return parts.join(F.broadcast(before), "_p").withColumn("no", own + F.col("_before")).drop("_p", "_before")


def batches(files, size=50):
    """(path, batch): consecutive batches in path order."""
    return numbered(files.select("path"), "path").select("path", (F.floor(F.col("no") / size) + 1).cast("int").alias("batch"))


def new_turns(turns, harvested):
    """Turns at or beyond the number that was harvested of their conversation."""
    return turns.join(harvested, "conv_id", "left").where(F.col("turn") >= F.coalesce("last_count", F.lit(0))).drop("last_count")


def union_candidates(*tables):
    """(path, kind): candidates of several kinds in order of precedence; a path keeps its first kind."""
    out = None
    for i, (kind, t) in enumerate(tables):
        part = t.select("path", F.lit(kind).alias("kind"), F.lit(i).alias("_i"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path").agg(F.min_by("kind", "_i").alias("kind"))


def agenda(events):
    """(date, lines): events of each day in order of time, rendered."""
    line = F.concat(F.date_format("start", "HH:mm"), F.lit(" "), F.col("summary"))
    r = events.groupBy(F.to_date("start").alias("date")).agg(F.array_sort(F.collect_list(F.struct("start", line.alias("l")))).alias("_l"))
    return r.select("date", F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("lines"))


def speakers(cues):
    """(file, speakers, duration): distinct speakers in order of appearance, and the end of the last cue."""
    first = cues.groupBy("file", "speaker").agg(F.min("n").alias("n"))
    named = first.where(F.coalesce("speaker", F.lit("")) != "").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "speaker"))).alias("_s"))
    last = cues.groupBy("file").agg(F.max_by("end", "n").alias("duration"))
    return last.join(named, "file", "left").select("file", F.coalesce(F.transform("_s", lambda x: x["speaker"]), F.array().cast("array<string>")).alias("speakers"), "duration")


def newest(rows, time, tie, most=5000):
    """The newest rows, at most `most`: a distributed top-k. Ties go to the lesser."""
    return rows.orderBy(F.desc(time), tie).limit(most)


def newest_of_each(rows, key, time, tie, most=30):
    """The newest rows of each key, at most `most`."""
    w = Window.partitionBy(key).orderBy(F.desc(time), tie)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
