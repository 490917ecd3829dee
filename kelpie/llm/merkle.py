"""Merkle manifest of a dataset: one digest of all rows, and for each row the proof that leads from it to that digest.

Leaves are numbered in order within their tree by range partitions and their counts, so that no task sorts a whole tree,
and are gathered into ordered arrays of a fixed size. Higher-order SQL functions collapse several levels of such a block
at once; the roots of the blocks are the leaves of the next round. Proofs go back down the same blocks: a block passes
to each of its nodes the siblings on the way, in front of those that it was given itself. Everything is DataFrame
expressions; only digests are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import discard, quoted, written

#: Nodes that make one node of the level above. Levels that a block collapses at once: it has FAN ** LEVELS nodes.
FAN, LEVELS = 16, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<left:string,right:string>>"


def field(value):
    """A value as it enters a leaf: `-` for null, else the length of its UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*values):
    """Lowercase hex sha256 of the values one after the other."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaf(*values):
    """The leaf of a row with these columns."""
    return digest(*(field(v) for v in values))


def folded(node, proof):
    """The root that a node (hex) leads to by a proof (array of left and right siblings, level by level)."""
    return F.aggregate(proof, node, lambda x, p: digest(p["left"], x, p["right"]))


def _collapsed(nodes):
    """An array of nodes as the array of nodes one level up."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(FAN)).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "").cast("binary"), 256))


def _siblings(nodes, i):
    """Left and right siblings of node i (from 0) of an ordered array."""
    at = i % FAN
    left, right = F.slice(nodes, i - at + 1, at), F.slice(nodes, i + 2, F.lit(FAN - 1) - at)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _numbered(nodes, order):
    """nodes (tree, ...) with n, the place of each within its tree (from 0), and size, that of the tree."""
    sorted_ = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # the number of a partition in the upper bits, and of a row within it in the lower ones; kept, as it hangs on them
    sorted_ = written(sorted_.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = sorted_.select("tree", part.alias("part"), row.alias("row")).groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # a row for each tree and each range partition that holds some of it
    parts = written(parts, "parts")
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = parts.select("tree", "part", F.sum("n").over(whole).alias("size"), (before - F.col("first")).alias("shift"))
    found = sorted_.withColumn("part", part).withColumn("row", row).join(places, ["tree", "part"])
    return found.withColumn("n", F.col("row") + F.col("shift")).drop("at", "part", "row", "shift"), [sorted_, parts]


def _tree(leaves, order, carry):
    """(blocks of each round, roots) of leaves (tree, node, ...); roots are (tree, node), proofs come from _proofs()."""
    numbered, scratch = _numbered(leaves, order)
    rounds = []
    nodes = numbered.select("tree", "size", "n", "node", F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"))
    block = FAN**LEVELS
    while True:
        kept = F.array_sort(F.collect_list(F.struct("n", "node", "carried")), lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
        blocks = nodes.groupBy("tree", "size", F.floor(F.col("n") / block).cast("long").alias("block")).agg(kept.alias("held"))
        top, level = F.transform("held", lambda h: h["node"]), F.col("size")
        for _ in range(LEVELS):
            top, level = F.when(level > 1, _collapsed(top)).otherwise(top), F.ceil(level / F.lit(FAN))
        blocks = written(blocks.withColumn("top", top.getItem(0)), "blocks")
        if not rounds:
            discard(*scratch)
        rounds.append(blocks)
        size = blocks.agg(F.max(F.ceil(F.col("size") / block))).first()[0]
        if size is None or size <= 1:
            return rounds, blocks.select("tree", F.col("top").alias("node"))
        nodes = blocks.select("tree", F.ceil(F.col("size") / block).alias("size"), F.col("block").alias("n"), F.col("top").alias("node"), F.lit(None).cast("int").alias("carried"))


def _proofs(rounds, above):
    """(tree, block, node, carried, proof, and the columns of above but tree) of each leaf; above: (tree, proof, ...) of the roots."""
    rest = [c for c in above.columns if c not in ("tree", "proof")]
    given = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        both = blocks.join(given.hint("merge"), ["tree", "block"])
        first = F.transform("held", lambda h: h["node"])
        both = both.withColumn("lower", first).withColumn("upper", _collapsed(F.col("lower")))
        if LEVELS != 2:
            raise ValueError("a block has two levels")
        each = both.select("tree", "size", "block", "lower", "upper", "proof", *rest, F.posexplode("held").alias("i", "leaf"))
        own = F.when(F.col("size") <= 1, F.array().cast(_PROOF)).when(F.col("size") <= FAN, F.array(_siblings(F.col("lower"), F.col("i")))).otherwise(F.array(_siblings(F.col("lower"), F.col("i")), _siblings(F.col("upper"), F.floor(F.col("i") / FAN).cast("int"))))
        proof = F.concat(own, "proof")
        if blocks is rounds[0]:
            return each.select("tree", F.col("leaf.node").alias("node"), F.col("leaf.carried").alias("carried"), proof.alias("proof"), *rest)
        given = each.select("tree", F.col("leaf.n").alias("block"), proof.alias("proof"), *rest)


def manifest(docs, columns=COLUMNS, tree="source", order="doc_id", carry=()):
    """(order, tree, leaf, subroot, root, proof, columns in carry) of every row.

    A row's leaf is the digest of its columns (field()). The leaves of one value of the tree column, ascending by the
    order column, make a tree, every 16 consecutive nodes one node of the next level, while several remain; its root is
    the subroot. Subroots, ordered by the tree column as UTF-8 bytes, null first, make the root in the same way. A lone
    node is its own root. proof: (left, right) siblings of the row on the way to root, level by level, hex digests one
    after the other; folded(leaf, proof) is root.

    Nulls enter as `-`; null order values stand first, rows that repeat one are ordered by their leaves (whole rows that
    repeat have equal leaves, so it doesn't matter which is which). No rows give no rows. Texts of any length are read
    once, by the digests; other columns are never read, and any column may bear any name but those of the results
    (leaf, subroot, root, proof: ValueError where they are carried or name the tree or order).
    """
    if clash := {"leaf", "subroot", "root", "proof"} & {*carry, tree, order}:
        raise ValueError(f"columns have names of the results: {sorted(clash)}")
    named = lambda c: F.col(quoted(c))
    # null first, then the others, in one string
    key = F.coalesce(F.concat(F.lit("1"), named(tree).cast("string")), F.lit("0"))
    kept = F.struct(named(order).alias("order"), named(tree).alias("tree"), *(named(c).alias(f"c{i}") for i, c in enumerate(carry)))
    leaves = docs.select(key.alias("tree"), leaf(*(named(c) for c in columns)).alias("node"), kept.alias("kept"))
    # rows that are equal throughout are told apart by where they were written, so that no range holds too many
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    rounds, roots = _tree(leaves, ["kept.order", "node", "tie"], ["kept"])
    discard(leaves)
    above, tops = _tree(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"], ["name"])
    tops = tops.select("tree", F.array().cast(_PROOF).alias("proof"), F.col("node").alias("root"))
    subroots = _proofs(above, tops).select(F.col("carried.name").alias("tree"), "proof", "root", F.col("node").alias("subroot"))
    subroots = written(subroots, "subroots")
    discard(*above)
    out = _proofs(rounds, subroots)
    shown = [F.col("carried.kept.order").alias(order), F.col("carried.kept.tree").alias(tree), F.col("node").alias("leaf"), "subroot", "root", "proof"]
    return out.select(*shown, *(F.col(f"carried.kept.c{i}").alias(c) for i, c in enumerate(carry)))


def audit(docs, every=5):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents.

    The proof of each row is held against the row as it may have been tampered with: where crc32 of the decimal doc_id
    is divisible by `every`, A-Z in its text are lower-cased (null ids and null texts stay as they are). verified: the
    leaf of that row still leads to root. proof_sha256: the digest of all siblings on the way, level by level, left to
    right. Nulls, empty and long texts, repeated rows and no rows as in manifest().
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    changed = F.when(hit, leaf(*(lower if c == "text" else F.col(c) for c in COLUMNS)))
    found = manifest(docs.select(*COLUMNS, changed.alias("changed")), carry=["changed"])
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    found = found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
