"""Hard negatives by a two-dimensional block matrix multiply.

Vectors are cut in two directions: rows into blocks, dimensions into chunks. A task multiplies one block of anchors by
one block of rows over one chunk and sends the partial int64 tile on; a shuffle brings the tiles of a pair of blocks
together, where they are added up to exact scores. The first pass multiplies anchors by rows of their own label only and
keeps each tile's best rows, the positives; the second multiplies them by all rows and keeps, for each anchor and each
of its positives, the best rows of another label in the window below the positive's score. No task holds more than a
tile and its rows, and no scores are kept beyond it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import discard, quoted, ship, written
from .topk import _matrix

#: Rows and anchors of a tile, and dimensions of a chunk.
ROWS, ANCHORS, CHUNK = 1024, 256, 32
#: Anchors whose tiles pass through the shuffle at a time: bounds the disk that they take.
PANEL = 32768
_PLACE = ["cohort", "i", "j"]
_LONG = np.iinfo(np.int64)


def partial_scores(a, b, parts):
    """a @ b.T as int64; what could pass a long is held to a part of its range, so that `parts` of them add up."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**62 / parts:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(_LONG.max // parts), _LONG.max // parts).astype(np.int64)


def best(scores, ids, fits, k):
    """Numbers of the k best rows of those that fit: higher scores first, ties to the smaller id."""
    i = np.flatnonzero(fits)
    if len(i) > 4 * k:
        i = i[scores[i] >= np.partition(scores[i], len(i) - k)[len(i) - k]]
    return i[np.lexsort((ids[i], -scores[i]))][:k]


def _runs(columns):
    """(lo, hi) of each run of equal values in columns of numbers."""
    keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1)
    cut = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
    return [(lo, hi, tuple(keys[lo].tolist())) for lo, hi in zip([0, *cut], [*cut, len(keys)]) if lo < hi]


def _tiles(anchors, rows, chunks, width):
    """(place, chunk, key, scores): partial scores of each anchor with all rows of a block, in the order of their keys."""
    import pyarrow as pa

    cut = lambda df, kind: df.select(*_PLACE, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "key", "v").select(*_PLACE, "chunk", F.lit(kind).alias("kind"), "key", F.slice("v", F.col("chunk") * width + 1, width).alias("part"))
    here = [*_PLACE, "chunk"]
    both = cut(rows, 0).union(cut(anchors, 1)).repartition(*here).sortWithinPartitions(*here, "kind", "key")

    def run(batches):
        at, held, block = None, [], None
        wide = lambda x, to: np.pad(x, ((0, 0), (0, to - x.shape[1])))
        for batch in batches:
            for lo, hi, (*place, kind) in _runs(batch.columns[:5]):
                if place != at:
                    at, held, block = place, [], None
                x = _matrix(batch.column(6).slice(lo, hi - lo), width)
                if kind == 0:
                    held.append(x)
                    continue
                if block is None:
                    block, held = np.concatenate([np.zeros((0, width), np.int64), *held]), []
                scores = partial_scores(x, wide(block, x.shape[1]), chunks)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(x), p)) for p in at), batch.column(5).slice(lo, hi - lo), pa.array([s.tobytes() for s in scores], pa.binary())], [*here, "key", "scores"])

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in here) + ", key long, scores binary")


def _added(anchors, rows, chunks, width, find, names):
    """What find(anchor's key, label and wanted, scores, ids, labels, keys of the rows) yields from the added tiles, as long columns."""
    import pyarrow as pa

    tiles = _tiles(anchors, rows, chunks, width)
    place = [F.col(c).cast("long").alias(c) for c in _PLACE]
    none = F.lit(None)
    rows = rows.select(*place, F.lit(0).alias("kind"), "key", F.lit(-1).cast("long").alias("chunk"), "id", "label", none.cast("array<long>").alias("wanted"), none.cast("binary").alias("scores"))
    heads = anchors.select(*place, F.lit(1), "key", F.lit(-1).cast("long"), "id", "label", "wanted", none.cast("binary"))
    tiles = tiles.select(*_PLACE, F.lit(1), "key", "chunk", none.cast("long"), none.cast("long"), none.cast("array<long>"), "scores")
    # the rows of a block in the order of their keys; then each anchor, followed by its partial scores
    all_ = rows.union(heads).union(tiles).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "kind", "key", "chunk")

    def run(batches):
        at, held, block, who, total, out = None, [], None, None, None, []

        def flush():
            if total is not None:
                out.extend(find(*who, total, *block))

        def sent():
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out.clear()
            return made

        for batch in batches:
            for lo, hi, (*place, kind) in _runs(batch.columns[:4]):
                if place != at:
                    flush()
                    at, held, block, who, total = place, [], None, None, None
                part = batch.slice(lo, hi - lo)
                if kind == 0:
                    held.append([part.column(c).to_numpy() for c in (6, 7, 4)])
                    continue
                if block is None:
                    block, held = [np.concatenate(c) for c in zip(*held)] or [np.zeros(0, np.int64)] * 3, []
                for key, chunk, label, wanted, scores in zip(*(part.column(c).to_pylist() for c in (4, 5, 7, 8)), part.column(9)):
                    if chunk < 0:
                        flush()
                        who, total = (key, label, wanted), None
                        continue
                    scores = np.frombuffer(scores.as_buffer(), np.int64)
                    total = scores.copy() if total is None else total + scores
            if out:
                yield sent()
        flush()
        if out:
            yield sent()

    return all_.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _dealt(anchors, rows, row_blocks, anchor_blocks):
    """Anchors to every block of rows and rows to every block of anchors, of their cohort; a key always falls to one block."""
    own = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    i, j = own(row_blocks, 1).cast("long"), own(anchor_blocks, 2).cast("long")
    anchors = anchors.select("cohort", every(row_blocks).alias("i"), j.alias("j"), "key", "id", "label", "wanted", "v")
    return anchors, rows.select("cohort", i.alias("i"), every(anchor_blocks).alias("j"), "key", "id", "label", "v")


def _first(rows, by, score, id_, k):
    """The first k rows of each `by`, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_, "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors, every=100, positives=5, negatives=5, least=80, most=100, scale=256, rows_of=ROWS, anchors_of=ANCHORS, chunk=CHUNK, panel=PANEL, id_col="vec_id", vec_col="embedding", label_col="label"):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    Anchors are the rows whose id is divisible by `every`. A row's score is its integer inner product with the anchor,
    of components floor(scale * x); higher scores come first, ties by the smaller id. An anchor's positives are its first
    `positives` other rows of its label (all, if fewer). For each of them, the first `negatives` rows of another label
    with least * positive_score <= 100 * score <= most * positive_score are returned (all, if fewer; none where no row
    fits, as with most negative positive scores).

    Rows with a null id, label or vector or with a null or non-finite component take no part. An empty vector scores 0,
    shorter ones are padded with zeros. Rows that repeat an id are rows of their own, each an anchor where the id is one:
    they are other rows to each other. Labels that aren't whole numbers are told apart by 64-bit hashes of their text.
    Scores are exact within a long; partial scores that could pass it are held to an equal part of its range. No rows
    give no rows. Other columns are never read.
    """
    spark = vectors.sparkSession
    ship(spark)
    id_, v_, label = F.col(quoted(id_col)), F.col(quoted(vec_col)), F.col(quoted(label_col))
    usable = id_.isNotNull() & label.isNotNull() & v_.isNotNull() & F.forall(v_, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v_, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    kind = vectors.schema[label_col].dataType.simpleString()
    label = label.cast("long") if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else F.xxhash64(label.cast("string"))
    rows = vectors.where(usable).select(id_.cast("long").alias("id"), label.alias("label"), whole.alias("v"))
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    wide, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    asked = F.col("id") % every == 0
    m = rows.where(asked).count()
    chunks, panels = max(1, -(-(wide or 0) // chunk)), max(1, -(-m // panel))
    sizes = rows.groupBy(F.col("label").alias("cohort")).agg(F.count("*").alias("n"), F.count_if(asked).alias("m")).where("m > 0")
    sizes = written(sizes.select("cohort", F.ceil(F.col("n") / rows_of).alias("row_blocks"), F.ceil(F.col("m") / (panels * anchors_of)).alias("anchor_blocks")), "sizes")
    # rows of labels without an anchor have no part in the first pass
    cohorts = rows.withColumn("cohort", F.col("label")).hint("merge").join(sizes, "cohort")
    one = rows.withColumn("cohort", F.lit(0).cast("long"))
    row_blocks, anchor_blocks = (F.lit(max(1, -(-x // y))).cast("long") for x, y in ((n, rows_of), (min(m, panel), anchors_of)))

    def own_label(key, _, wanted, scores, ids, labels, keys):
        return [(key, ids[i], keys[i], scores[i]) for i in best(scores, ids, keys != key, positives).tolist()]

    def other_labels(key, label, wanted, scores, ids, labels, keys):
        other, out = labels != label, []
        for rank, score in enumerate(wanted):
            fits = other & (scores >= -(-least * score // 100)) & (scores <= most * score // 100)
            out += [(key, rank + 1, ids[i], keys[i], scores[i]) for i in best(scores, ids, fits, negatives).tolist()]
        return out

    found, scratch = None, []
    for p in range(panels):
        mine = asked & (F.pmod(F.xxhash64("key", F.lit(3)), F.lit(panels)) == p)
        a, b = _dealt(cohorts.where(mine).withColumn("wanted", F.array().cast("array<long>")), cohorts, F.col("row_blocks"), F.col("anchor_blocks"))
        near = _added(a, b, chunks, chunk, own_label, ["key", "id", "row", "score"])
        near = written(_first(near, ["key"], "score", "id", positives), "positives")
        wanted = near.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("wanted"))
        a, b = _dealt(one.where(mine).join(wanted, "key"), one, row_blocks, anchor_blocks)
        far = _added(a, b, chunks, chunk, other_labels, ["key", "positive", "id", "row", "score"])
        far = _first(far, ["key", "positive"], "score", "id", negatives).select("key", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        far = written(far, "negatives")
        both = far.join(near.select("key", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "positive"])
        both = both.join(rows.where(asked).select("key", F.col("id").alias("anchor_id")), "key")
        both = both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        found = both if found is None else found.union(both)
    discard(sizes)
    return found
