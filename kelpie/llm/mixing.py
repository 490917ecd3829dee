"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source fall into permuted blocks. Each source's target is met by whole passes over its blocks and a
part of one more, so a quota of block copies per source is exact. A tree then splits these quotas among the output
shards: a node with the quotas m hands its left child a multivariate-hypergeometric draw of m, down to the shards,
so every shard is a fair sample of the mix. Shards take disjoint runs of each source's permuted block copies, and are
shuffled locally by a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import chunks, discard, every_column, quoted, ship, written
from .rolling import words

#: Blocks that a source's documents fall into, at most.
BLOCKS = 1024


def targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Words wanted of each source: total size shared by weight; what is above ceiling * size is shared again.

    sizes: whole numbers, in order of the sources; weights repeat along it.
    """
    total, n = sum(sizes), len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    full = {i for i in range(n) if sizes[i] == 0}
    while True:
        rest = total - sum(ceiling * sizes[i] for i in full)
        share = sum(w[i] for i in range(n) if i not in full)
        above = {i for i in range(n) if i not in full and rest * w[i] > ceiling * sizes[i] * share}
        if not above:
            return [float(ceiling * sizes[i]) if i in full else rest * w[i] / share for i in range(n)]
        full |= above


def split(quotas, shards, seed=0):
    """Rows of quotas for each shard: a binary tree of multivariate-hypergeometric draws. Every column sums to its quota."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(m, lo, hi):
        if hi - lo == 1:
            out[lo] = m
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(m, int(m.sum()) * (mid - lo) // (hi - lo)) if len(m) else m
        node(left, lo, mid)
        node(m - left, mid, hi)

    node(np.asarray(quotas, np.int64), 0, shards)
    return out


def sizes(docs, id_col="doc_id", text_col="text", source_col="source"):
    """(id, source, size) of every row: the words of the whole text, 0 for a null one."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, source_col)]

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                _, _, doc = words(data, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.bincount(doc, minlength=part.num_rows), pa.int64())], ["id", "source", "size"])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(source_col)).alias("source"))
    return rows.mapInArrow(run, f"id {kinds[0]}, source {kinds[1]}, size long")


def _quotas(rest, passes, words, order):
    """(times, numbers) of a source's blocks: whole passes over all, and of one more the blocks, in order, that still fit."""
    n = len(words)
    times, numbers = [passes] * n, [[j * n + i for j in range(passes)] for i in range(n)]
    at = passes * n
    for i in order:
        if words[i] <= rest:
            rest -= words[i]
            times[i] += 1
            numbers[i].append(at)
            at += 1
    return times, numbers


def plan(docs, weights=(5, 2, 1), ceiling=3, shards=16, seed=0, max_sources=300_000, id_col="doc_id", text_col="text", source_col="source"):
    """How often the mix takes each document, and where.

    Returns id_col, source_col, size, source_size, target, times (0 to ceiling), taken (size * times) and shards
    (the output shard of each copy). Sources are taken in code-point order, null last, and weights repeat along it.
    The last pass over a source takes, in a permuted order, every block that still fits: a source's taken words stay
    under its target by less than its least block left out, and never exceed it. One row per source goes to the driver
    (ValueError beyond max_sources: a mix is specified per source, and numpy draws from fewer than 10**9 block copies,
    3072 a source), nothing else does. Blocks and their order hang on a hash of id and seed alone, so reruns agree; rows
    that repeat an id share a block and are taken alike. An empty table gives no rows; a source without words has the
    target 0. Other columns are never read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    table = written(sizes(docs, id_col, text_col, source_col), "sizes")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(BLOCKS)).cast("int")
    rows = table.select("id", "source", "size", key.alias("name"), block.alias("block"))
    blocks = written(rows.groupBy("name", "block").agg(F.sum("size").alias("words"), F.min("source").alias("source")), "blocks")
    found = blocks.groupBy("name").agg(F.sum("words").alias("words"), F.min("source").alias("source")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["words"] for r in found], weights, ceiling)
    known = spark.createDataFrame(
        [(r["name"], r["words"], t, *_passes(t, r["words"], ceiling)) for r, t in zip(found, goal)],
        "name string, source_size long, target double, passes int, rest double",
    )

    def quotas(part):
        """One source: BLOCKS rows at most."""
        part = part.sort_by("turn")
        passes, rest = part.column("passes")[0].as_py(), part.column("rest")[0].as_py()
        times, numbers = _quotas(rest, passes, part.column("words").to_pylist(), range(part.num_rows))
        return pa.table([*(part.column(c) for c in ("name", "block", "source_size", "target")), pa.array(times, pa.int32()), pa.array(numbers, pa.list_(pa.int64()))], ["name", "block", "source_size", "target", "times", "numbers"])

    turn = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block"))
    drawn = blocks.join(known, "name").withColumn("turn", turn).select("name", "block", "words", "source_size", "target", "passes", "rest", "turn")
    drawn = written(drawn.groupBy("name").applyInArrow(quotas, "name string, block int, source_size long, target double, times int, numbers array<long>"), "quotas")
    discard(blocks)
    quota = {r["name"]: r["quota"] for r in drawn.groupBy("name").agg(F.sum("times").alias("quota")).collect()}
    shares = split([quota.get(r["name"], 0) for r in found], shards, seed)
    bounds = spark.createDataFrame([(r["name"], [int(x) for x in np.cumsum(shares[:, i])]) for i, r in enumerate(found)], "name string, bounds array<long>")
    # the copies of a source's blocks are numbered; a shard takes a run of these numbers
    where = F.transform("numbers", lambda number: F.size(F.filter(F.col("bounds"), lambda b: b <= number)))
    drawn = drawn.join(bounds, "name").select("name", "block", "source_size", "target", "times", where.alias("shards"))
    out = rows.join(drawn, ["name", "block"])
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), "shards")


def _passes(target, size, ceiling):
    """Whole passes over a source and the words of one more."""
    whole = min(ceiling, int(target // size)) if size else 0
    return whole, (float(target - whole * size) if 0 < size and whole < ceiling else -1.0)


def mix(docs, id_col="doc_id", text_col="text", source_col="source", seed=0, piece_words=8_000_000, **how):
    """The mixed rows themselves: the columns of docs, each row as often as the plan takes it, dealt to shards.

    Rows of a shard lie together in a local shuffle order, in pieces of about piece_words words (64 at least), so that
    the pieces written grow with the mix. Rows that repeat an id within a source are taken alike; other columns pass
    through, whatever their names.
    """
    drawn = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **how)
    drawn = drawn.select(F.col(quoted(id_col)).alias("drawn_id"), F.col(quoted(source_col)).alias("drawn_source"), "shards", "taken")
    # rows that repeat an id have the same times and shards
    times = written(drawn.groupBy("drawn_id", "drawn_source").agg(F.first("shards").alias("shards"), F.sum("taken").alias("taken")), "times")
    pieces = max(64, -(-int(times.agg(F.sum("taken")).first()[0] or 0) // (how.get("shards", 16) * piece_words)))
    rows = docs.select(every_column(docs).alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"))
    rows = rows.hint("merge").join(times, F.col("id").eqNullSafe(F.col("drawn_id")) & F.col("source").eqNullSafe(F.col("drawn_source")))
    dealt = rows.select("row", "id", F.posexplode("shards").alias("copy", "shard"))
    dealt = dealt.repartition("shard", F.pmod(F.xxhash64("id", "copy"), F.lit(pieces)))
    return dealt.sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "id", "copy")).select("row.*")
