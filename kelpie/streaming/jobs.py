"""Continuous forms: inbox, duplicate suppression, cost windows, refresh debouncing and session priming."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from kelpie.functions import text as X


def inbox(spark, root, pattern="*.md", archive=None, files_per_trigger=100):
    """A stream of new files: (path, body, mtime). The checkpoint remembers what was read; read files can be archived."""
    r = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("mtime"))


def unseen(stream, content="body", time="mtime", delay="1 day"):
    """Without rows whose content came before, within a delay that bounds the state."""
    return stream.withColumn("hash", F.substring(F.sha2(F.col(content), 256), 1, 16)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def unseen_emails(stream, content="body", time="mtime", delay="1 day"):
    """Without mails whose fingerprint came before; what has no fingerprint counts by its content."""
    fp = X.fingerprint(F.col(content))
    return stream.withColumn("fp", F.when(fp == "", F.sha2(F.col(content), 256)).otherwise(fp)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["fp"])


def daily_costs(stream, delay="2 days"):
    """(day, model, calls, cost) per day of a cost log stream."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "model")
    return w.agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost")).select(F.col("window.start").alias("day"), "model", "calls", "cost")


def weekly_costs(stream, delay="2 days"):
    """(start, end, calls, cost) in seven-day windows that end each day."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", "7 days", "1 day"))
    return w.agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost")).select("window.start", "window.end", "calls", "cost")


def refreshes(stream, key="path", time="mtime", gap="30 seconds"):
    """One row a burst of changes: a session window that closes after a quiet gap."""
    return stream.withWatermark(time, gap).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("changes")).select(key, F.col("session_window.end").alias("due"), "changes")


def prime(nodes, activated, keep=0.7, gain=0.5, least=0.05):
    """One update of a session's priming vector: decay, merge by the greater, prune."""
    out = {k: v * keep for k, v in nodes.items()}
    for k, v in activated.items():
        out[k] = max(out.get(k, 0.0), v * gain)
    return {k: v for k, v in out.items() if v > least}


def priming(stream, idle="1 day"):
    """Per session its priming vector after each query: (session, eid, strength) rows from (session, query, ts, eid, strength).

    The vector is the state of the session's key; queries of a batch are applied in order. Sessions that are idle for a
    day of event time go, so the state stays bounded.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        nodes = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches))
        for _, part in rows.groupby("query", sort=True):
            nodes = prime(nodes, dict(zip(part["eid"], part["strength"])))
        state.update((json.dumps(nodes),))
        latest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)
        yield pd.DataFrame({"session": [key[0]] * len(nodes), "eid": list(nodes), "strength": [float(v) for v in nodes.values()]})

    keyed = stream.withWatermark("ts", idle).groupBy("session")
    return keyed.applyInPandasWithState(update, "session string, eid string, strength double", "nodes string", "update", GroupStateTimeout.EventTimeTimeout)


def run_once(df, sink, checkpoint, path=None, mode="append", kind="parquet"):
    """Process what is there and stop: sink is a foreachBatch function, or a table format with a path."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(sink) if callable(sink) else w.format(kind).option("path", path)
    q = w.start()
    q.awaitTermination()
    return q
