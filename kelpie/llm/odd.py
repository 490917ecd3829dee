"""Near-duplicate components by MinHash bands and odd sketches.

A document is the set of its distinct word shingles. Its MinHash samples serve twice: rows of them make the band hashes
that bring candidates together, and all of them are folded into an odd sketch, a bitmap in which every sample flips one
bit. Two sketches differ (XOR) in few bits where the sets share most samples, so a population count estimates high
similarities closely: pairs that can't reach the threshold are left, the others are confirmed on full sets.

Texts of equal sets are one node. Nodes that share buckets make candidate groups, which are cut into blocks of bounded
size. Pairs are verified within each block first; then the node of most links of a group meets all its blocks, which
joins a star of copies however large; only nodes that it doesn't reach meet every block. Pairs never leave a task, only
a spanning forest of confirmed links does.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .common import chunks, discard, quoted, ship, trim, written
from .graph import components
from .near import _verify, banding, ngram_sets, node_key
from .repeats import Sequence, lists_of
from .rolling import mix

#: Words of a shingle; links have 100 * intersection >= PERCENT * union; share of such pairs that the bands must meet.
SHINGLE, PERCENT, RECALL = 3, 85, 0.9999
#: MinHash samples of a set, and bits of its sketch.
SAMPLES, BITS = 256, 1024
#: Nodes of a block, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(0, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, 4096, dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data, offs, n=SHINGLE):
    """Sorted distinct fingerprints of the shingles of each text, A-Z lower-cased; a shorter text is one, none without words."""
    return ngram_sets(Sequence(_LOWER[data], offs, "words"), n)


def samples(sets, n=SAMPLES):
    """n MinHash samples (uint32) of each non-empty set."""
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.zeros((len(sets), n), np.uint32)
    if not len(sets):
        return out
    flat = (mix(np.concatenate(sets)) >> _U(32)).astype(np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(flat * _MUL[i] + _ADD[i], at)
    return out


def band_hashes(drawn, bands, rows):
    """Hashes of consecutive rows of samples, a column for each band."""
    out = np.zeros((len(drawn), bands), _U)
    for b in range(bands):
        h = np.full(len(drawn), b + 1, _U)
        for r in range(rows):
            h = mix(h ^ drawn[:, b * rows + r].astype(_U))
        out[:, b] = h
    return out


def odd_sketches(drawn, bits=BITS):
    """Parity bitmaps (uint8 rows): every sample, with its number, flips one bit."""
    m, n = drawn.shape
    if m > 512:  # counts of a few texts at a time
        return np.concatenate([odd_sketches(drawn[a : a + 512], bits) for a in range(0, m, 512)])
    bit = (mix(drawn.astype(_U) ^ (np.arange(1, n + 1, dtype=_U) << _U(32))[None, :]) % _U(bits)).astype(np.int64)
    flips = np.bincount((bit + np.arange(m)[:, None] * bits).ravel(), minlength=m * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(m, bits), axis=1)


def estimate(differing, n=SAMPLES, bits=BITS):
    """Jaccard similarity of two sets whose sketches differ in so many bits."""
    share = np.minimum(2.0 * np.asarray(differing) / bits, 1 - 1e-12)
    return np.maximum(0.0, 1 + bits / (4 * n) * np.log1p(-share))


def most_bits(threshold, n=SAMPLES, bits=BITS, sigmas=6):
    """Differing bits that a pair at the threshold passes with a chance of some 1e-9 only.

    Both how many samples differ and how many of their bits fall together vary; sigmas is in both together.
    """
    flips = 2 * n * (1 - threshold)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    slope = (1 - 2 / bits) ** flips
    spread = math.sqrt((2 * slope) ** 2 * n * threshold * (1 - threshold) + 2 * flips**2 / bits)
    return math.floor(mean + sigmas * spread)


def confirmed(sizes, sketches, sets, labels, side, percent=PERCENT):
    """Links (i, j) that join the labels of a block, and how many links each node has.

    Pairs are those of unlike sides (of any two nodes where all are on one side) whose labels differ. Sizes and sketches
    leave out what can't be linked; the rest is confirmed on full sets, one by one or, where many are left, by counting
    shared shingles of all at once. A spanning forest of the links is returned; the number of links is exact where all
    are on one side and have labels of their own.
    """
    m = len(sizes)
    one_side = not (side.any() and not side.all())
    words = sketches.view(_U)
    limit = most_bits(percent / 100, bits=sketches.shape[1] * 8)
    first, second = [], []
    for i in range(m):
        others = np.arange(i + 1, m)
        fits = (labels[others] != labels[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))
        if not one_side:
            fits &= side[others] != side[i]
        others = others[fits]
        if len(others):
            others = others[np.bitwise_count(words[others] ^ words[i]).sum(1, dtype=np.int64) <= limit]
            first.append(np.full(len(others), i))
            second.append(others)
    degree, forest = np.zeros(m, np.int64), []
    if not first:
        return degree, forest
    first, second = np.concatenate(first), np.concatenate(second)
    if len(first) > 8 * m:
        return _verify(np.arange(m), np.ones(m, np.int64), sets, side, percent / 100)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    for i, j in zip(first.tolist(), second.tolist()):
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (sizes[i] + sizes[j] - both):
            degree[i] += 1
            degree[j] += 1
            a, b = root(labels[i]), root(labels[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((i, j))
    return degree, forest


def _links(grams, places, percent):
    """(root, a, b, links): confirmed links (a, b), and with b null the links of node a, of nodes dealt to places.

    grams (node, size, sketch, grams); places (node, root, label, first, second, side): each of a node's places is one
    block task (root, first, second).
    """
    import pyarrow as pa

    where = ["root", "first", "second"]
    dealt = grams.hint("merge").join(places, "node").select(*where, "side", "node", "label", "size", "sketch", "grams")
    dealt = dealt.repartition(*where).sortWithinPartitions(*where, "side", "node")

    def run(batches):
        def flush():
            if len(held) < 2:
                return None
            node, label, size, side = (np.array([h[i] for h in held], np.int64) for i in (0, 1, 2, 3))
            sketches = np.frombuffer(b"".join(h[4] for h in held), np.uint8).reshape(len(held), -1)
            degree, forest = confirmed(size, sketches, [h[5] for h in held], label, side, percent)
            a = [*node.tolist(), *(int(node[i]) for i, _ in forest)]
            b = [*([None] * len(node)), *(int(node[j]) for _, j in forest)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*degree.tolist(), *([0] * len(forest))], pa.int64())], ["root", "a", "b", "links"])

        at, held = None, []
        for batch in batches:
            sets = lists_of(batch.column(8))
            for row in zip(*(batch.column(j).to_pylist() for j in range(8)), sets):
                if row[:3] != at:
                    if (out := flush()) is not None:
                        yield out
                    at, held = row[:3], []
                if not held or (row[4], row[3]) != (held[-1][0], held[-1][3]):
                    held.append((row[4], row[5], row[6], row[3], row[7], row[8].view(_U)))
        if (out := flush()) is not None:
            yield out

    return dealt.mapInArrow(run, "root long, a long, b long, links long")


def _edges(links):
    return links.where(F.col("b").isNotNull()).select("a", "b")


def _labelled(members, links):
    """members (node, root, ...) with label: the component of each node by the links so far."""
    found = components(_edges(links)).withColumnRenamed("root", "label")
    return members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _parts(rows, width, most):
    """Blocks that rows (of a groupBy("root")) are cut into: by their number and by their shingles."""
    return rows.agg(F.greatest(F.ceil(F.count("*") / width), F.ceil(F.sum("size") / most)).cast("int").alias("parts"))


def _own(parts, salt):
    return F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")


def near_duplicates(docs, shingle=SHINGLE, percent=PERCENT, recall=RECALL, block=BLOCK, block_shingles=BLOCK_SHINGLES, id_col="doc_id", text_col="text"):
    """(id_col, n_shingles, component_id, kept) of every row.

    Words are runs without ASCII white space, A-Z lower-cased; a text's set has its distinct shingles of `shingle`
    words, or with fewer words the whole sequence. Rows are linked where 100 * intersection >= percent * union;
    component_id is the least id that links lead to, kept whether it is the row's own. Null and empty texts and texts
    without words have no set and no link. Rows that repeat an id are rows of their own (all of the least id are kept);
    null ids never name a component unless it has no other (then the name is null and all its rows are kept). Texts of
    any length are taken whole: a block holds about block_shingles, or one longer text. Other columns are never read.

    Links are confirmed on sets of 61-bit fingerprints. A linked pair is missed by the bands with a chance of
    1 - recall at the threshold and far less above it, and by the sketches with some 1e-9.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    bands, rows = banding(percent / 100, recall, SAMPLES)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.xxhash64(quoted(text_col)).alias("key"))

    def sketch(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                sets = shingle_sets(data, offs, shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                drawn = samples([sets[i] for i in some])
                keys, maps, where = [None] * len(sets), [None] * len(sets), np.zeros(len(sets) + 1, np.int32)
                for i, bitmap in zip(some, odd_sketches(drawn)):
                    keys[i], maps[i], where[i + 1] = node_key(sets[i]), bitmap.tobytes(), bands
                hashes = pa.ListArray.from_arrays(pa.array(np.cumsum(where), pa.int32()), pa.array(band_hashes(drawn, bands, rows).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(maps, pa.binary()), hashes], ["id", "key", "node", "size", "sketch", "bands"])
                del sets, drawn, keys, maps, hashes
        trim()  # the worker stays while the next stages run

    table = written(texts.mapInArrow(sketch, f"id {kind}, key long, node long, size long, sketch binary, bands array<long>"), "sketches")
    full = table.where(F.col("node").isNotNull())
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("one")
    nodes = written(full.groupBy("node").agg(one, F.first("size").alias("size"), F.first("sketch").alias("sketch")).select("node", "one.id", "one.key", "size", "sketch"), "nodes")
    members = full.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail"))
    buckets = written(buckets.where(F.col("head") < F.col("tail")).select("bucket", "head"), "buckets")
    groups = components(members.join(buckets, "bucket").select(F.col("node").alias("a"), F.col("head").alias("b")))
    groups = written(groups, "groups")
    discard(buckets)
    asked = written(groups.join(nodes, "node").select("node", "root", F.col("id").alias("_id"), F.col("key").alias("_key"), "size", "sketch"), "asked")
    discard(groups)

    def full_sets(batches):
        done = set()  # the candidates of one partition; rows that repeat an id and a text are sent once
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                sets = shingle_sets(data, offs, shingle)
                keep = [i for i, (s, k) in enumerate(zip(sets, part.column(1).to_pylist())) if len(s) and k not in done and node_key(s) == k and not done.add(k)]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(sets[i]) for i in keep)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(sets[i].view(np.int64) for i in keep)])))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(keep, pa.int64())) for c in (1, 2, 3)), flat], ["node", "size", "sketch", "grams"])

    wanted = texts.hint("merge").join(asked, F.col("id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key"))).select("text", "node", "size", "sketch")
    grams = written(wanted.mapInArrow(full_sets, "node long, size long, sketch binary, grams array<long>"), "grams")
    sizes = written(_parts(asked.groupBy("root"), block, block_shingles), "sizes")
    members = written(asked.join(sizes, "root").select("node", "root", "size", "parts", _own(F.col("parts"), 1).alias("own")), "members")
    discard(asked, sizes)

    # within blocks
    places = members.select("node", "root", F.col("node").alias("label"), F.col("own").alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side"))
    links = written(_links(grams, places, percent), "links")
    several = members.where("parts > 1")
    if several.limit(1).count():
        # the node of most links against every block of its group
        inside = links.hint("merge").join(several.select("root").distinct(), "root")
        labelled = written(_labelled(several, inside), "labelled")
        # blocks of one node have told nothing of it; a group of such still has a hub
        degrees = inside.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        most = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.col("node").alias("hub"), F.col("label").alias("main"), F.col("parts").alias("blocks"))).alias("most")
        hubs = written(labelled.join(degrees, "node", "left").groupBy("root").agg(most).select("root", "most.hub", "most.main", "most.blocks"), "hubs")
        rest = labelled.join(hubs, "root").where(F.col("label") != F.col("main"))
        to_hub = hubs.select(F.col("hub").alias("node"), "root", F.col("main").alias("label"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("first"), F.lit(0).alias("second"), F.lit(1).alias("side"))
        stars = written(_links(grams, rest.select("node", "root", "label", F.col("own").alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side")).union(to_hub), percent), "stars")
        both = inside.union(stars)
        again = written(_labelled(several, both), "again")
        mains = written(again.join(hubs.select(F.col("hub").alias("node")), "node").select("root", F.col("label").alias("main")), "mains")
        apart = written(again.join(mains, "root").where(F.col("label") != F.col("main")), "apart")
        # nodes that it doesn't reach against every block
        lanes = written(_parts(apart.groupBy("root"), block, block_shingles).withColumnRenamed("parts", "lanes"), "lanes")
        mine = _own(F.col("lanes"), 2)
        askers = apart.join(lanes, "root").select("node", "root", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("first"), mine.alias("second"), F.lit(1).alias("side"))
        told = again.join(lanes, "root").select("node", "root", "label", F.col("own").alias("first"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("second"), F.lit(0).alias("side"))
        crossed = written(_links(grams, askers.union(told), percent), "crossed")
        links = links.union(stars).union(crossed)
        left = [labelled, hubs, stars, again, mains, apart, lanes, crossed]
    else:
        left = []
    roots = components(_edges(links))
    known = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("component"))
    known = written(known, "known")
    names = written(known.groupBy("component").agg(F.min("id").alias("component_id")), "names")
    named = written(known.join(names, "component").select("node", "component_id"), "named")
    discard(grams, members, nodes, known, names, *left)
    out = table.select("id", "node", "size").join(named, "node", "left")
    name = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), name.alias("component_id"))
    return out.withColumn("kept", F.col(quoted(id_col)).eqNullSafe(F.col("component_id")))
