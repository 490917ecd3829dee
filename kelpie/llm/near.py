"""N-gram Jaccard join by MinHash banding.

Texts are sets of word n-grams. Rows per band and bands are chosen for a target recall at the threshold. Documents of
equal sets become one node; band hashes are shuffled, and each bucket links its members to one of them, which gives
candidate groups without ever emitting pairs. Within a group every pair is then verified on the full n-gram sets, in
square blocks of bounded size, so a group of any size spreads over many tasks; a block task returns link counts
and a spanning forest of its verified links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .common import chunks, discard, every_column, quoted, ship, written
from .graph import components
from .repeats import Sequence, lists_of
from .rolling import mix, spans

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Nodes in a block of a candidate group, at least and at most; a task verifies two blocks against each other. Between
#: the two a group has 16 blocks at most, so a set is sent 16 times at most in groups of up to 16,384 different texts.
BLOCK, WIDEST, SQUARES = 192, 1024, 16
_U = np.uint64
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 1 << 63, 512, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(0, 1 << 63, 512, dtype=np.uint64)


def banding(threshold=THRESHOLD, recall=RECALL, most=144):
    """(bands, rows): the most selective rows per band whose bands reach the recall at the threshold within `most` hashes."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall")
    return best


def ngram_sets(seq, n=NGRAM):
    """The sorted distinct n-gram fingerprints of each document; a shorter text is one gram, one without words none."""
    out = []
    count = np.diff(seq.at)
    grams = seq.windows(np.arange(max(0, seq.n - n + 1)), n, 0)
    for a, k in zip(seq.at[:-1].tolist(), count.tolist()):
        if k >= n:
            out.append(np.unique(grams[a : a + k - n + 1]))
        elif k:
            out.append(spans(seq.pre[0], np.array([a]), np.array([a + k]), 0))
        else:
            out.append(np.zeros(0, _U))
    return out


def node_key(s):
    """One number for a set; the key of equal texts."""
    sums = np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(1)], _U)
    return int(mix(sums[:1] ^ mix(sums[1:] + np.array([len(s)], _U))).view(np.int64)[0])


def signatures(sets, bands, rows):
    """Band hashes of each non-empty set."""
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    out = np.zeros((len(sets), bands), _U)
    for b in range(bands):
        h = np.full(len(sets), b + 1, _U)
        for r in range(rows):
            i = b * rows + r
            h = mix(h ^ np.minimum.reduceat((flat * _MUL[i] + _ADD[i]) >> _U(32), at)) if len(sets) else h
        out[:, b] = h
    return out


def _verify(keys, copies, sets, side, threshold):
    """Links between nodes of the two sides (or within one): counts per node, and a spanning forest.

    Returns (linked documents per node, [(i, j)]). Grams of a single node can't be shared and are left out; the rest
    are counted in dense column blocks.
    """
    m = len(keys)
    size = np.array([len(s) for s in sets])
    shared = np.zeros((m, m), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    column, owner = column[several], owner[several]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        step = max(256, (1 << 22) // max(m, 1))
        for lo in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, [lo, lo + step])
            x = np.zeros((m, step), np.float32)
            x[owner[a:b], column[a:b] - lo] = 1
            shared += x @ x.T
    union = size[:, None] + size[None, :] - shared
    linked = (shared >= threshold * union - 1e-9) & (size[:, None] > 0)
    linked &= (side[:, None] != side[None, :]) if side.any() and not side.all() else ~np.eye(m, dtype=bool)
    count = linked @ copies
    parent = list(range(m))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    for i, j in zip(*np.nonzero(np.triu(linked))):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((int(i), int(j)))
    return count, forest


def join(docs, n=NGRAM, threshold=THRESHOLD, recall=RECALL, block=BLOCK, id_col="doc_id", text_col="text"):
    """Every row's class of near duplicates: id_col, node, class_key, class_id, n_links, copies.

    class_id: the least id of the class, a connected component of links with Jaccard similarity >= threshold over word
    n-grams (words are unchanged runs without ASCII white space). n_links: other rows whose text is that similar, equal
    ones included. Null texts and texts without words link to nothing: their node and class_key are null and class_id is
    their own id. Rows that repeat an id count as rows of their own; null ids never name a class unless it has no other.
    Columns besides id and text are never read.
    """
    found = _classes(docs, n, threshold, recall, block, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "node", "class_key", "class_id", "n_links", "copies")


def _classes(docs, n, threshold, recall, block, id_col, text_col):
    """What join() returns, with the id as `id` and a hash of the text as `key`: together they name a row's text."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    bands, rows = banding(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    id_, text_ = F.col(quoted(id_col)), F.col(quoted(text_col))

    def sketch(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                sets = ngram_sets(Sequence(data, offs, "words"), n)
                some = [i for i, s in enumerate(sets) if len(s)]
                sketch_ = signatures([sets[i] for i in some], bands, rows).view(np.int64)
                keys = [None] * len(sets)
                where = np.zeros(len(sets) + 1, np.int32)
                for i in some:
                    keys[i] = node_key(sets[i])
                    where[i + 1] = bands
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(where), pa.int32()), pa.array(sketch_.ravel()))], ["id", "key", "node", "bands"])

    table = docs.select(id_.alias("id"), text_.alias("text"), F.xxhash64(text_).alias("key"))
    table = written(table.mapInArrow(sketch, f"id {kind}, key long, node long, bands array<long>"), "sketches")
    nodes = table.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    members = table.where(F.col("node").isNotNull()).select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail"))
    buckets = written(buckets.where(F.col("head") < F.col("tail")).select("bucket", "head"), "buckets")
    candidates = components(members.join(buckets, "bucket").select(F.col("node").alias("a"), F.col("head").alias("b")))
    candidates = written(candidates, "candidates")
    discard(buckets)
    sizes = candidates.groupBy("root").agg(F.count("*").alias("n"))
    wide = F.least(F.lit(max(block, WIDEST)), F.greatest(F.lit(block), F.ceil(F.col("n") / SQUARES))) if block >= BLOCK else F.lit(block)
    sizes = sizes.select("root", F.ceil(F.col("n") / wide).cast("int").alias("squares"))
    squares = written(sizes, "sizes")
    asked = candidates.join(squares, "root").join(nodes, "node").select(F.col("id").alias("_id"), "node", "root", "squares", "copies")
    asked = written(asked, "asked")
    discard(candidates, squares)
    rows_ = docs.select(id_.alias("id"), text_.alias("text"))
    # a merge join at every size: whether the candidates would fit a broadcast hangs on the data
    rows_ = rows_.hint("merge").join(asked, rows_["id"].eqNullSafe(asked["_id"])).select("text", "node", "root", "squares", "copies")

    def deal(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                sets = ngram_sets(Sequence(data, offs, "words"), n)
                roots, first, second, node, copies, side, out = [], [], [], [], [], [], []
                for s, k, root, g, c in zip(sets, *(part.column(i).to_pylist() for i in (1, 2, 3, 4))):
                    if not len(s) or node_key(s) != k:  # another text under the same id
                        continue
                    own = (k & 0x7FFFFFFFFFFFFFFF) % g
                    for other in range(g):
                        roots.append(root)
                        first.append(min(own, other))
                        second.append(max(own, other))
                        side.append(int(own > other))
                        node.append(k)
                        copies.append(c)
                        out.append(s.view(np.int64))
                flat = np.concatenate([np.zeros(0, np.int64), *out])
                where = np.cumsum([0, *map(len, out)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((roots, pa.int64()), (first, pa.int32()), (second, pa.int32()), (side, pa.int32()), (node, pa.int64()), (copies, pa.int64()))] + [pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat))], ["root", "first", "second", "side", "node", "copies", "grams"])

    dealt = rows_.mapInArrow(deal, "root long, first int, second int, side int, node long, copies long, grams array<long>")
    dealt = dealt.repartition("root", "first", "second").sortWithinPartitions("root", "first", "second", "node")

    def verify(batches):
        def flush(held):
            seen = {}
            for k, c, s, side in held:  # a node that repeats an id comes once a row
                seen.setdefault((k, side), (k, c, s, side))
            held = list(seen.values())
            if len(held) < 2:
                return None
            keys = [h[0] for h in held]
            count, forest = _verify(keys, np.array([h[1] for h in held], np.int64), [h[2] for h in held], np.array([h[3] for h in held]), threshold)
            a = [*keys, *(keys[i] for i, _ in forest)]
            b = [*([None] * len(keys)), *(keys[j] for _, j in forest)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*count.tolist(), *([0] * len(forest))], pa.int64())], ["a", "b", "links"])

        at, held = None, []
        for batch in batches:
            grams = lists_of(batch.column(6))
            for i, row in enumerate(zip(*(batch.column(j).to_pylist() for j in range(6)))):
                if row[:3] != at:
                    if (out := flush(held)) is not None:
                        yield out
                    at, held = row[:3], []
                held.append((row[4], row[5], grams[i].view(_U), row[3]))
        if (out := flush(held)) is not None:
            yield out

    links = written(dealt.mapInArrow(verify, "a long, b long, links long"), "links")
    discard(asked)
    roots = components(links.where(F.col("b").isNotNull()).select("a", "b"))
    count = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.join(roots, "node", "left").join(count, "node", "left").withColumn("class_key", F.coalesce("root", "node"))
    known = written(known.select("node", "class_key", F.col("id").alias("_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "known")
    discard(nodes, links)
    names = written(known.groupBy("class_key").agg(F.min("_id").alias("class_id")), "names")
    classes = written(known.join(names, "class_key").select("node", "class_key", "class_id", "n_links", "copies"), "classes")
    discard(known, names)
    known = classes
    out = table.select("id", "key", "node").join(known, "node", "left")
    return out.select("id", "key", "node", "class_key", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_one(docs, n=NGRAM, threshold=THRESHOLD, recall=RECALL, block=BLOCK, id_col="doc_id", text_col="text"):
    """The rows of docs without near duplicates: of each class one row stays, one of its least id.

    Rows without words all stay. Where texts of a class share that id, the one of the least hash stays; where whole rows
    or rows but for other columns repeat, any one of them. A null id leads a class only where no other row does. Other
    columns pass through, whatever their names.
    """
    found = written(_classes(docs, n, threshold, recall, block, id_col, text_col), "classes")
    texts = found.where(F.col("class_key").isNotNull()).groupBy("class_key", "id", "key").agg(F.count("*").alias("n"))
    lead = texts.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("lead"))
    lone = found.where(F.col("class_key").isNull()).select("id", "key", F.lit(1).cast("long").alias("n")).distinct()
    kept = written(lead.select("lead.id", "lead.key", "lead.n").union(lone), "kept").select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key"), "n")
    discard(found)
    rows = docs.select(every_column(docs).alias("row"), F.col(quoted(id_col)).alias("id"), F.xxhash64(quoted(text_col)).alias("key"))
    rows = rows.hint("merge").join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    several = rows.where("n > 1").dropDuplicates(["id", "key"])
    return rows.where("n = 1").select("row.*").union(several.select("row.*"))
