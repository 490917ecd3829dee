"""Cutting plans where a small result is used several times, and spreading inputs of few, wide row groups."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark):
    """The folder that spark.checkpoint.dir names; where none is, a temporary one on a local master (tests), an error elsewhere."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_kelpie_folder", None)
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = sc._kelpie_folder = tempfile.mkdtemp(prefix="kelpie-")
    return named


def cut(df):
    """df, computed once and kept in the session's checkpoint folder (shared_folder); it survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df, split_bytes=16 << 20):
    """df dealt evenly to all cores if its files hold less than split_bytes a core; else as it is.

    Few row groups feed few tasks, however many cores there are. At that size the shuffle costs less than the text work
    that it spreads; a larger input has splits enough and isn't shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * split_bytes else df


def in_slices(queries, search, key="query_id", most=1000):
    """search(queries), for slices of about `most` queries where there are more: what is asked at once goes to every task."""
    parts = -(-queries.count() // most)
    if parts <= 1:
        return search(queries)
    slice_ = F.pmod(F.xxhash64(key), F.lit(parts))
    return reduce(DataFrame.unionByName, (search(queries.where(slice_ == i)) for i in range(parts)))
