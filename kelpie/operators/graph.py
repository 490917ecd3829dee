"""The weighted entity graph: activation, communities, adjacency, link resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def symmetric(edges, default=0.6):
    """(node, other, weight) both ways; a missing weight is the default."""
    w = F.coalesce("weight", F.lit(default))
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), w.alias("weight")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), w.alias("weight")))


def spreading_activation(entities, edges, seeds, depth=2, hop_decay=0.6, threshold=0.12):
    """(eid, strength) of activated entities that aren't seeds; a node keeps its greatest activation.

    Each hop is a join with the adjacency and a partial max, so hubs combine before the shuffle. The depth is a small
    constant and the plan is static. Seeds that aren't entities start nothing.
    """
    adjacency = symmetric(edges).join(entities.select(F.col("eid").alias("other")), "other", "left_semi")
    active = seeds.select("eid").distinct().join(entities.select("eid"), "eid", "left_semi").withColumn("strength", F.lit(1.0))
    for _ in range(depth):
        moved = active.withColumnRenamed("eid", "node").join(adjacency, "node").select(F.col("other").alias("eid"), (F.col("strength") * F.col("weight") * hop_decay).alias("strength")).where(F.col("strength") > threshold)
        active = active.unionByName(moved).groupBy("eid").agg(F.max("strength").alias("strength"))
    return active.join(seeds.select("eid"), "eid", "left_anti")


def name_seeds(entities, query_tokens):
    """(query_id, eid): entities whose name shares two query tokens, or one that is 30 % of them. query_tokens: (query_id, q)."""
    names = entities.select("eid", F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}_]+")).alias("words"))
    terms = query_tokens.select("query_id", F.size("q").alias("_size"), F.explode(F.array_distinct("q")).alias("_word"))
    hits = names.select("eid", F.explode("words").alias("_word")).join(terms, "_word").groupBy("query_id", "eid", "_size").agg(F.count("*").alias("_n"))
    return hits.where((F.col("_n") >= 2) | (F.col("_n") / F.greatest("_size", F.lit(1)) >= 0.3)).select("query_id", "eid")


def source_seeds(entities, paths):
    """(eid): entities with one of the paths among their sources."""
    return entities.select("eid", F.explode("sources").alias("path")).join(paths.select("path"), "path", "left_semi").select("eid").distinct()


def activated_files(activated, entities, loaded, files, most=3):
    """(path, strength): existing, not yet loaded sources of activated entities, strongest first."""
    r = activated.join(entities.select("eid", "sources"), "eid").select(F.explode("sources").alias("path"), "strength")
    r = r.join(loaded.select("path"), "path", "left_anti").join(files.select("path"), "path", "left_semi")
    return r.groupBy("path").agg(F.max("strength").alias("strength")).orderBy(F.desc("strength"), "path").limit(most)


def rank_sources(activated, entities, most=8):
    """(source, score): activation x (half + half salience), summed over entities."""
    r = activated.join(entities.select("eid", "computed", "sources"), "eid")
    r = r.select(F.explode("sources").alias("source"), (F.col("strength") * (0.5 + 0.5 * F.coalesce("computed", F.lit(0.5)))).alias("s"))
    return r.groupBy("source").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), "source").limit(most)


def adjacency(edges, default=0.5):
    """(node, other, weight): undirected, parallel edges summed, self loops dropped."""
    return symmetric(edges, default).where("node <> other").groupBy("node", "other").agg(F.sum("weight").alias("weight"))


def degrees(edges):
    return adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def context_edges(edges, nodes, most=4):
    """(node, src, type, dst, rank): up to `most` edges of each node, outgoing before incoming."""
    out = edges.select(F.col("src").alias("node"), F.lit(0).alias("way"), "src", "type", "dst").unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("way"), "src", "type", "dst"))
    out = out.join(nodes.select("node"), "node", "left_semi")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("way", "src", "type", "dst"))).where(F.col("rank") <= most).drop("way")


def greedy_communities(edges, passes=5, least=3):
    """(node, community) by sequential greedy modularity: each move sees the moves before it.

    The order is part of the definition, so one task works through the whole adjacency (nodes in name order, in
    applyInPandas); meant for graphs of some hundred nodes. For large graphs use label_communities.
    """

    def run(pdf):
        import pandas as pd

        links = {}
        for a, b, w in sorted(zip(pdf["node"], pdf["other"], pdf["weight"])):
            links.setdefault(a, {})[b] = w
        own = {n: sum(x.values()) for n, x in links.items()}
        total = sum(own.values())
        home = {n: i for i, n in enumerate(links)}
        weight_of = dict(enumerate(own.values()))
        for _ in range(passes if total > 0 else 0):
            moved = False
            for n, near in links.items():
                into = {}
                for other, w in near.items():
                    into[home[other]] = into.get(home[other], 0) + w
                gains = {c: w - own[n] * weight_of[c] / total for c, w in into.items() if c != home[n]}
                best = max(gains, key=gains.get, default=None)
                if best is not None and gains[best] > 0:
                    weight_of[home[n]] -= own[n]
                    weight_of[best] += own[n]
                    home[n], moved = best, True
            if not moved:
                break
        sizes = {}
        for c in home.values():
            sizes[c] = sizes.get(c, 0) + 1
        names = {c: f"c{i}" for i, c in enumerate(sorted(sizes))}
        rows = [(n, names[c]) for n, c in home.items() if sizes[c] >= least]
        return pd.DataFrame(rows, columns=["node", "community"])

    return adjacency(edges).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "node string, community string")


def label_communities(edges, rounds=5):
    """(node, label) by synchronous weighted label propagation; ties to the smaller label. Scales with the edges."""
    adj = adjacency(edges)
    label = adj.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = adj.join(label.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        own = label.select("node", "label", F.lit(0.0).alias("w"))
        votes = votes.unionByName(own).groupBy("node", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        label = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label"))
    return label


def expand_communities(activated, members, threshold=0.5, soft=0.3):
    """Activation plus, for communities (community, eid) with a member at the threshold, soft times the greatest for the rest."""
    best = activated.join(members, "eid").groupBy("community").agg(F.max("strength").alias("best")).where(F.col("best") >= threshold)
    added = members.join(best, "community").join(activated.select("eid"), "eid", "left_anti").groupBy("eid").agg(F.max(F.col("best") * soft).alias("strength"))
    return activated.select("eid", "strength").unionByName(added)


def inject_priming(seeds, primed):
    """(eid, strength): a full outer merge; seeds gain 0.3 of their priming up to 1, primed nodes come in at 0.15."""
    r = seeds.select("eid", F.col("strength").alias("s")).join(primed.select("eid", F.col("strength").alias("p")), "eid", "full_outer")
    return r.select("eid", F.when(F.col("s").isNull(), F.col("p") * 0.15).when(F.col("p").isNull(), F.col("s")).otherwise(F.least(F.lit(1.0), F.col("s") + F.col("p") * 0.3)).alias("strength"))
