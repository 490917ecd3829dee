"""The Merkle manifest against a tree built in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kelpie.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, `a.b` int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, siblings of each node level by level)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, places):
            run = i // 16 * 16
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        places = [i // 16 for i in places]
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def wanted(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    root, above = climb([below[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (_, _, own, r), path in zip(sorted(trees[s], key=lambda x: x[:3]), below[s][1]):
            path = path + up
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                node = sha(a, node, b)
            out.append((r[0], own, below[s][0], root, sha(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("many", [1, 16, 17, 600])
def test_against_python(spark, many):
    rows = [(i, "big", "en", i * 7, f"Text {i} É") for i in range(many)]
    rows += [(i, f"s{i % 3}", None, None, None if i % 4 else "") for i in range(40)] + [(5, None, "de", 1, "Null Source"), (None, None, "de", 1, "X"), (None, "é", "de", 1, "Lone"), (-7, "", "x", -1, "Y" * 5000)]
    rows += [(5, "dup", "en", 3, "Same")] * 18 + [(5, "dup", "en", 3, "Other"), (5, "dup", "en", None, "Other")]
    rows += [(10_000 + i, f"t{i}", "en", 1, "Lone") for i in range(20)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    assert found(merkle.audit(df)) == wanted(rows)


def test_hot_tree_of_equal_rows(spark):
    row = (None, "s", "en", 1, "Same text")
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("Same text").alias("text"))
    assert found(merkle.audit(df)) == wanted([row] * 5000)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "s", "en", 1, "A", "clash", 1)], SCHEMA)
    assert found(merkle.audit(one)) == wanted([(1, "s", "en", 1, "A")])
    assert merkle.audit(one.limit(0)).count() == 0


def test_general_form(spark):
    df = spark.createDataFrame([(i, f"g{i % 2}", f"v{i}") for i in range(50)], "`k.1` long, `t.2` string, value string")
    out = merkle.manifest(df, columns=("k.1", "value"), tree="t.2", order="k.1", carry=["value"])
    again = out.withColumn("again", merkle.folded(F.col("leaf"), F.col("proof")))
    assert again.where("again = root").count() == 50 and set(out.columns) == {"k.1", "t.2", "leaf", "subroot", "root", "proof", "value"}
    assert out.where(F.col("value") != F.concat(F.lit("v"), F.col("`k.1`"))).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(df.withColumnRenamed("value", "root"), columns=("k.1",), tree="t.2", order="k.1", carry=["root"])
