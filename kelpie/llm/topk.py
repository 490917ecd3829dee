"""Exact top-k inner products by dual-tree search over cover trees.

Components are rounded to whole numbers, so scores are exact. Data and queries are indexed together: both fall to the
nearest of the same centres (rows drawn by a hash), which are the top of the tree, and each block of data below a centre
gets a cover tree, whose levels shrink by 1.3: a node covers its points within a radius, and the centres of its children
lie further apart than theirs. A pair of a query node and a data node is discarded when no pair below it can reach the
worst kth score of the query node: qc.xc + |qc| Rx + |xc| Rq + Rq Rx bounds every inner product between the two.
Queries first meet the block of their own centre; the kth scores found there discard whole blocks before any row is
copied to them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import discard, quoted, ship, written

#: Rows of a data block: a 32nd of all, within these bounds. Queries that meet one copy of a block, at most.
BLOCK, LANE = (8192, 65536), 65536
#: Centres at most; beyond, a centre has several blocks. Their vectors are broadcast.
CENTRES = 4096
#: Queries that share a tree.
GROUP = 1024
_LEAF, _BASE = 32, 1.3


class CoverTree:
    """Nodes in arrays: centre (row), radius, points order[lo:hi], and children."""

    def __init__(self, x, leaf=_LEAF):
        self.x, self.order, self.leaf = x, np.arange(len(x)), leaf
        self.lo, self.hi, self.centre, self.radius, self.kids = [], [], [], [], []
        if len(x):
            self._node(0, len(x), 0)
        self.lo, self.hi, self.centre, self.radius = map(np.array, (self.lo, self.hi, self.centre, self.radius))
        self.norm = np.sqrt((x[self.centre] ** 2).sum(1)) if len(x) else np.zeros(0)

    def _node(self, lo, hi, centre):
        """A node for order[lo:hi]. Its children are a net of the largest scale below its radius that parts its points."""
        me = len(self.lo)
        rows = self.order[lo:hi]
        radius = float(np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(1).max())) * (1 + 1e-9)
        for part, value in ((self.lo, lo), (self.hi, hi), (self.centre, centre), (self.radius, radius), (self.kids, [])):
            part.append(value)
        if hi - lo <= self.leaf or radius == 0:
            return me
        scale, groups = radius / _BASE, []
        while len(groups) < 2 and scale > radius * 1e-9:
            groups, left = [], rows
            while len(left):
                near = ((self.x[left] - self.x[left[0]]) ** 2).sum(1) <= scale * scale
                groups.append((left[0], left[near]))
                left = left[~near]
                if len(groups) == 64 and len(rows) - len(left) < 4 * len(groups):
                    return me  # distances are all alike: a net would hold almost every point, so they stay together
            scale /= _BASE
        if len(groups) < 2 or (hi - lo > 64 and 4 * len(groups) > hi - lo):
            return me
        at = lo
        for c, members in groups:
            self.order[at : at + len(members)] = members
            self.kids[me].append(self._node(at, at + len(members), c))
            at += len(members)
        return me


class Search:
    """The data of one block, ready for queries. `scored` counts the pairs whose product was computed."""

    def __init__(self, ids, vectors, k):
        self.ids, self.whole, self.k = ids, vectors, k
        self.tree = CoverTree(vectors.astype(float))
        self.centres = self.tree.x[self.tree.centre]
        self.biggest = float(np.abs(self.tree.x).max(initial=1))
        self.scored = 0

    def run(self, vectors, floors, own=None):
        """(query number, score, id) of the k best rows of each query whose score is at least its floor; own: ids left out, or None, of each query."""
        if not len(vectors) or not len(self.ids):
            return []
        width = max(vectors.shape[1], self.whole.shape[1])
        if width > self.whole.shape[1]:
            self.__init__(self.ids, np.pad(self.whole, ((0, 0), (0, width - self.whole.shape[1]))), self.k)
        self.asked = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        most = float(np.abs(self.asked).astype(float).max(initial=1)) * self.biggest * width
        # exact in each case: doubles up to 2**53, then 64-bit integers, then Python's, held to the range of a long
        self.kind = float if most < 2.0**53 else np.int64 if most < 2.0**62 else object
        self.q_tree = CoverTree(self.asked.astype(float), 8)
        self.least = np.iinfo(np.int64).min if self.kind is not float else -np.inf
        self.best = np.full((len(vectors), self.k), self.least, self.kind)
        self.best_id = np.full((len(vectors), self.k), np.iinfo(np.int64).max)
        self.floor = floors
        own = own if own is not None else [None] * len(vectors)
        self.own = np.array([x is not None for x in own]), np.array([x or 0 for x in own], np.int64)
        self._visit(0, np.zeros(1, np.int64))
        out = []
        for i, (scores, ids) in enumerate(zip(self.best.tolist(), self.best_id.tolist())):
            out += [(i, int(s), d) for s, d in zip(scores, ids) if s > self.least and s >= floors[i]]
        return out

    def _bounds(self, node, front):
        q, x = self.q_tree, self.tree
        qc, rq, nq = q.x[q.centre[node]], q.radius[node], q.norm[node]
        rx, nx = x.radius[front], x.norm[front]
        far = nq * rx + nx * rq + rq * rx
        return self.centres[front] @ qc + far + 1e-9 * (nq * nx + far) + 1e-6

    def _worst(self, members):
        """The worst kth score of some queries, as far as is known."""
        return np.maximum(self.best[members, -1].astype(float), self.floor[members]).min()

    def _visit(self, node, front):
        """Query node against data nodes: the wider side is opened, until both are leaves."""
        q, x = self.q_tree, self.tree
        members = q.order[q.lo[node] : q.hi[node]]
        while True:
            bounds = self._bounds(node, front)
            keep = bounds >= self._worst(members)
            front, bounds = front[keep], bounds[keep]
            if not len(front):
                return
            opens = np.array([len(x.kids[i]) > 0 for i in front.tolist()])
            if q.kids[node] and (not opens.any() or q.radius[node] >= x.radius[front][opens].max()):
                for kid in q.kids[node]:
                    self._visit(kid, front)
                return
            if not opens.any():
                break
            front = np.concatenate([front[~opens], *(np.array(x.kids[i]) for i in front[opens].tolist())])
        front = front[np.argsort(-bounds, kind="stable")]
        sizes = np.cumsum(x.hi[front] - x.lo[front])
        batch = 256  # few rows first: their scores may discard the rest
        while len(front):
            n = max(1, int(np.searchsorted(sizes, batch, "right")))
            batch = min(2 * batch, 4096)
            rows = np.concatenate([x.order[x.lo[i] : x.hi[i]] for i in front[:n].tolist()])
            for at in range(0, len(rows), 8192):
                self._score(members, rows[at : at + 8192])
            front = front[n:]
            front = front[self._bounds(node, front) >= self._worst(members)]
            sizes = np.cumsum(x.hi[front] - x.lo[front])

    def _score(self, members, rows):
        """Exact scores of all pairs of queries and rows, into the best lists; ties to the smaller id."""
        k = self.k
        self.scored += len(members) * len(rows)
        if self.kind is float:
            s = self.q_tree.x[members] @ self.tree.x[rows].T
        else:
            s = self.asked[members].astype(self.kind) @ self.whole[rows].astype(self.kind).T
            if self.kind is object:
                s = np.clip(s, np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max)
        some = np.flatnonzero(self.own[0][members])
        if len(some):
            s[some] = np.where(self.own[1][members[some]][:, None] == self.ids[rows][None, :], self.least, s[some])
        enough = np.maximum(self.best[members, -1], s.min(1)) if s.shape[1] < k else np.maximum(self.best[members, -1], np.partition(s, -k, axis=1)[:, -k])
        for row in np.flatnonzero((s >= enough[:, None]).any(1)).tolist():
            new = np.flatnonzero(s[row] >= enough[row])
            i = members[row]
            scores, ids = np.concatenate([self.best[i], s[row, new]]), np.concatenate([self.best_id[i], self.ids[rows[new]]])
            pick = np.argsort(ids, kind="stable")
            pick = pick[np.argsort(-scores[pick], kind="stable")][:k]
            self.best[i], self.best_id[i] = scores[pick], ids[pick]


def _matrix(column, width=1):
    """An Arrow column of lists as rows of whole numbers, padded with zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    length, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(length), max(width, int(length.max(initial=1)))), np.int64)
    x[np.arange(x.shape[1])[None, :] < length[:, None]] = flat
    return x


def _meet(data, asked, k):
    """(lead, id, score): each query against the block it is sent to. data (id, v, centre, salt); asked (lead, v, own, floor, centre, salt, lane)."""
    import pyarrow as pa

    place = ["centre", "salt", "lane"]
    none = F.lit(None)
    told = data.join(asked.select(*place).distinct(), ["centre", "salt"])
    rows = told.select(*place, F.lit(0).alias("kind"), "id", "v", none.cast("double").alias("floor"), none.cast("long").alias("own"))
    rows = rows.union(asked.select(*place, F.lit(1), F.col("lead"), "v", "floor", "own"))
    rows = rows.repartition(*place).sortWithinPartitions(*place, "kind")

    def run(batches):
        at, held, search = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if lo == hi:
                    continue
                here, kind = tuple(keys[lo, :3].tolist()), keys[lo, 3]
                if here != at:
                    at, held, search = here, [], None
                part = batch.slice(lo, hi - lo)
                ids, x = part.column(4).to_numpy(), _matrix(part.column(5))
                if kind == 0:
                    held.append((ids, x))
                    continue
                if search is None:
                    width = max(v.shape[1] for _, v in held) if held else 1
                    whole = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held]
                    search = Search(np.concatenate([np.zeros(0, np.int64), *(i for i, _ in held)]), np.concatenate([np.zeros((0, width), np.int64), *whole]), k)
                    held = []
                floors, own = part.column(6).fill_null(-np.inf).to_numpy(), part.column(7).to_pylist()
                for a in range(0, len(ids), GROUP):
                    found = search.run(x[a : a + GROUP], floors[a : a + GROUP], own[a : a + GROUP])
                    if found:
                        q, s, d = (np.array(c, np.int64) for c in zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + GROUP][q]), pa.array(d), pa.array(s)], ["lead", "id", "score"])

    return rows.mapInArrow(run, "lead long, id long, score long")


def top_k(vectors, k=20, every=20, scale=64, id_col="vec_id", vec_col="embedding"):
    """(query_id, rank, vec_id, score): for each query its k best rows by integer inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates all rows of another id. Components become
    floor(scale * x). Vectors that are null or hold a null or non-finite component, and null ids, take no part; an
    empty vector scores 0 and shorter ones are padded with zeros. Rows that repeat an id and a vector are candidates of
    their own, each with a rank; of an id with several rows the least vector is asked for, once. Scores beyond a long
    are held to its range. Equal vectors are searched once: as a query, and as candidates with as many of their first
    rows as a result can hold. The centres (CENTRES at most) go to the driver and are broadcast, with one count and
    radius each.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    ship(spark)
    id_, v_ = F.col(quoted(id_col)), F.col(quoted(vec_col))
    usable = id_.isNotNull() & v_.isNotNull() & F.forall(v_, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v_, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(usable).select(id_.cast("long").alias("id"), whole.alias("v")).groupBy("id", "v").agg(F.count("*").alias("n"))
    rows = written(rows, "vectors")
    if not rows.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    want = k + 1  # a query's own row may stand before its k results; own rows of an id with several are left out in the search
    # of one vector no result holds more than k rows of an id, and none after k of other ids
    data = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(want)).cast("int"))).alias("copy"))
    data = data.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= 2 * want).select("id", "v")
    data = written(data, "candidates")
    n = data.count()
    block = min(max(n // 32, BLOCK[0]), BLOCK[1])
    drawn = data.orderBy(F.xxhash64("id"), "id").limit(min(CENTRES, -(-n // block))).toArrow()
    centres = np.unique(_matrix(drawn.column("v")), axis=0).astype(float)
    shared = spark.sparkContext.broadcast(centres)

    def fitted(x):
        c = shared.value
        width = max(x.shape[1], c.shape[1])
        return np.pad(x.astype(float), ((0, 0), (0, width - x.shape[1]))), np.pad(c, ((0, 0), (0, width - c.shape[1])))

    def assign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, c = fitted(_matrix(part.column(1)))
                near = np.argmin((c**2).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
                far = np.sqrt(((x - c[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32)), pa.array(far)], ["id", "v", "centre", "far"])

    schema = "id long, v array<long>, centre int, far double"
    placed = written(data.mapInArrow(assign, schema), "placed")
    balls = {r["centre"]: (r["far"], -(-r["n"] // block)) for r in placed.groupBy("centre").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(c, s) for c, (_, s) in balls.items()], "centre int, salts int")
    blocks = placed.join(F.broadcast(salts), "centre").select("id", "v", "centre", F.pmod(F.xxhash64("id", F.lit(1)), "salts").cast("int").alias("salt"))

    # equal queries are asked once, under the least id of theirs; those of an id with several rows alone, without its rows
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), (F.sum("n") > 1).alias("several"))
    queries = written(queries, "queries")
    alone, shared_ = queries.where("several"), queries.where("not several")
    assigned = shared_.groupBy("v").agg(F.min("id").alias("id")).select("id", "v").union(alone.select("id", "v")).mapInArrow(assign, schema)
    leads = assigned.join(alone.select("id", F.col("id").alias("own")), "id", "left").select(F.col("id").alias("lead"), "v", "centre", "own")
    leads = written(leads, "leads")
    lanes = max(1, -(-leads.count() // LANE))
    lane = F.pmod(F.xxhash64("lead", F.lit(2)), F.lit(lanes)).cast("int").alias("lane")
    first = leads.select("lead", "v", "own", F.lit(None).cast("double").alias("floor"), "centre", F.lit(0).alias("salt"), lane)
    near = written(_meet(blocks, first, want), "near")
    floors = near.groupBy("lead").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
    floors = leads.join(floors, "lead", "left").select("lead", "v", "centre", F.when(F.col("n") == want, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor"))

    radius = np.array([balls.get(c, (-1.0, 0))[0] for c in range(len(centres))])
    parts = [balls.get(c, (0.0, 0))[1] for c in range(len(centres))]

    def reach(batches):
        """The blocks where a query may still find something, but the one that it has met."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x, c = fitted(_matrix(part.column(1)))
                size = np.sqrt((x * x).sum(1))[:, None]
                most = x @ c.T + size * np.maximum(radius, 0)
                most += 1e-6 + 1e-9 * size * (np.sqrt((c * c).sum(1)) + np.maximum(radius, 0))
                q, to = np.nonzero((most >= part.column(3).to_numpy()[:, None]) & (radius >= 0))
                home = part.column(2).to_numpy()
                q, to, salt = (np.array(z, np.int64) for z in (list(zip(*((a, b, s) for a, b in zip(q.tolist(), to.tolist()) for s in range(parts[b]) if s or b != home[a]))) or [()] * 3))
                ids, floor = part.column(0).to_numpy(), part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(floor[q]), pa.array(to.astype(np.int32)), pa.array(salt.astype(np.int32))], ["lead", "floor", "centre", "salt"])

    pairs = written(floors.mapInArrow(reach, "lead long, floor double, centre int, salt int"), "pairs")
    asked = pairs.join(leads.select("lead", "v", "own"), "lead").select("lead", "v", "own", "floor", "centre", "salt", lane)
    far = written(_meet(blocks, asked, want), "far")
    order = Window.partitionBy("lead").orderBy(F.desc("score"), "id")
    best = near.union(far).withColumn("n", F.row_number().over(order)).where(F.col("n") <= want)
    best = written(best.select("lead", "id", "score"), "best")
    members = shared_.join(leads.where("own is null").select("lead", "v"), "v").select(F.col("id").alias("query_id"), "lead")
    members = written(members.union(alone.select("id", F.col("id").alias("lead"))), "members")
    discard(data, placed, leads, near, pairs, far, rows, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = members.join(best, "lead").where(F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"), "score")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
