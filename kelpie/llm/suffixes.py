"""Exact removal of repeated byte strings.

prefix_doubling() is the plain method: Spark sorts (rank, rank) pairs of all byte positions at offsets 8, 16, 32 and so
on, ranks them anew, and drops what is unique. It sends some hundred times the input through shuffles.

remove_repeats() finds the same bytes within a few times the input. Fingerprints name equal strings in place of sorted
ranks: 32-byte strings are compared at anchors only (about one position in 35, chosen by content, so equal strings have
equal anchors); an anchor whose whole context is one that an earlier document holds is past the threshold at once. The
others are told apart by what stands around them at growing lengths, until it is unique to one document; the windows
that remain are compared as pairs of the 64-byte strings at offsets 0 and 36, which spell their 100 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import chunks, discard, quoted, ship, written
from .repeats import Anchors, Sequence, _runs, covered, lists_of, shared_windows, text_tag

LENGTH, SEED, HALF = 100, 32, 64
#: Steps at which an anchor's surroundings are ranked, left of its seed and from its start on.
LEVELS = tuple((-1, n) for n in (8, 16, 32, 48)) + tuple((1, n) for n in (44, 60, 76, 92))


def remove_repeats(docs, length=LENGTH, seed=SEED, half=HALF, id_col="doc_id", text_col="text"):
    """Remove every byte that a string of `length` bytes covers which also starts earlier.

    Earlier: in a document with a smaller id, or before it in the same one. Returns id_col, n_bytes, n_removed,
    n_spans, kept_sha256 for every row. Null and short texts lose nothing. Rows that repeat an id are each judged
    against smaller ids and against themselves, not against each other; null ids are judged against themselves only.
    A text is worked on whole, at some 100 bytes of a worker's memory a byte; columns may bear any name.
    """
    found = _remove(docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text")), length, seed, half, "_id", "_text")
    return found.withColumnRenamed("_id", id_col)


def _remove(docs, length, seed, half, id_col, text_col):
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)

    def keys(seq, p):
        return seq.windows(p, half, 0), seq.windows(p + length - half, half, 0)

    runs, windows, _ = shared_windows(docs, id_col, text_col, "bytes", length, seed, keys, LEVELS)
    found = runs.where("covered").select("doc", "packed").union(windows.where("covered").select("doc", "packed"))
    found = found.groupBy("doc").agg(F.collect_list("packed").alias("packed"))
    rows = docs.select(F.col(id_col).alias("_row_id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).hint("merge").join(found, "doc", "left").select("_row_id", "text", "packed")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                seq = Sequence(data, offs, "bytes")
                tag = text_tag(seq)
                gone = covered(seq, Anchors(seq, length, seed).repeated_inside(), length)
                for d, packed in enumerate(lists_of(part.column(2))):
                    if len(packed):
                        _, count, lo = _runs(packed, tag, d)
                        edge = np.zeros(offs[d + 1] - offs[d] + 1, np.int64)
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, lo + count + length - 1, -1)
                        gone[offs[d] : offs[d + 1]] |= np.cumsum(edge[:-1]) > 0
                n = part.num_rows
                removed, spans_, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), []
                for d in range(n):
                    mask = gone[offs[d] : offs[d + 1]]
                    removed[d] = mask.sum()
                    spans_[d] = (mask[1:] & ~mask[:-1]).sum() + (len(mask) > 0 and mask[0])
                    raw = data[offs[d] : offs[d + 1]]
                    sha.append(hashlib.sha256((raw[~mask] if removed[d] else raw).tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(removed), pa.array(spans_), pa.array(sha, pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _ranked(pairs):
    """pairs (doc, pos, a, b) with rank: the place of (a, b) among all distinct pairs in their order. Unique pairs go."""
    several = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    parts = several.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("part", F.spark_partition_id())
    parts = written(parts, "pairs")
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")  # a row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy("a", "b"))
    ranks = written(parts.join(before, "part").select("a", "b", (own + F.col("before")).alias("rank")), "ranks")
    out = written(pairs.hint("merge").join(ranks, ["a", "b"]).select("doc", "pos", "rank"), "ranked")
    discard(parts, ranks)
    return out


def prefix_doubling(docs, length=LENGTH, id_col="doc_id", text_col="text"):
    """(doc, pos): starts of the strings of `length` bytes (8 at least) that also start earlier, by prefix doubling.

    Every byte position has a rank; the ranks at two offsets make a pair, pairs are sorted and ranked anew, and positions
    whose pair is unique drop out, until the ranks span `length` bytes. Texts and ids as in remove_repeats, but rows that
    repeat an id count as one document's, so ids must be unique. For small inputs: see the README for what it moves.
    """
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, text_col, 1 << 20):
                if len(data) < 8:
                    continue
                eight = np.lib.stride_tricks.sliding_window_view(data, 8).astype(np.uint64)
                value = (eight << (np.arange(56, -1, -8, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)
                p = np.arange(len(value))
                doc = np.searchsorted(offs, p, "right") - 1
                fits = p + 8 <= offs[doc + 1]
                p, doc = p[fits], doc[fits]
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array(p - offs[doc]), pa.array(value[fits])], ["doc", "pos", "rank"])

    rows = docs.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias(id_col), quoted(text_col))
    ranks = written(rows.mapInArrow(run, "doc long, pos long, rank long"), "ranked")
    have = 8
    while have < length:
        step = min(have, length - have)
        later = ranks.select("doc", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = written(ranks.withColumnRenamed("rank", "a").hint("merge").join(later, ["doc", "pos"]), "positions")
        discard(ranks)
        ranks = _ranked(pairs)
        discard(pairs)
        have += step
    first = ranks.groupBy("rank").agg(F.min(F.struct("doc", "pos")).alias("first"))
    return ranks.hint("merge").join(first, "rank").where(F.struct("doc", "pos") > F.col("first")).select("doc", "pos")
