"""Hard negatives against all scores computed in Python."""

import math
import random

import numpy as np
import pytest

from kelpie.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, `a.b` int"


def usable(r):
    return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])


def wanted(rows, every=100):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in filter(usable, rows)]
    out = []
    for a, anchor in enumerate(rows):
        if anchor[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(anchor[1], r[1])), r[0], b, r[2]) for b, r in enumerate(rows) if b != a)
        for s, p, _, _ in [x for x in scored if x[3] == anchor[2]][:5]:
            fits = [x for x in scored if x[3] != anchor[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(anchor[0], p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"rows_of": 16, "anchors_of": 2, "chunk": 5, "panel": 4}])
def test_against_python(spark, sizes):
    r = random.Random(len(sizes))
    kinds = [[r.gauss(0, 0.3) for _ in range(12)] for _ in range(4)]
    rows = [(i * 20 - 400, [x + r.gauss(0, 0.1) for x in kinds[i % 4][: r.choice([12, 12, 7])]], r.choice([0, 1, 1, 1, 2, None])) for i in range(240)]
    rows += [(i * 3 + 1, [0.5, 0.5], i % 2) for i in range(30)]  # ties
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan")], 1), (400, [float("inf")], 1), (None, [1.0], 1), (900_000, [], 0), (900_100, [1.0], 77)]
    rows += [rows[25]] * 3 + [(rows[25][0], [0.1] * 12, 1)]  # rows that repeat an anchor's id
    assert found(negatives.hard_negatives(frame(spark, rows), **sizes)) == wanted(rows)


def test_one_label_and_a_hot_vector(spark):
    rows = [(i, [0.5, 0.25], 1) for i in range(300)] + [(1000 + i, [0.5 - i / 256, 0.25], 2) for i in range(60)]
    assert found(negatives.hard_negatives(frame(spark, rows), rows_of=32)) == wanted(rows)
    assert found(negatives.hard_negatives(frame(spark, rows[:300]))) == []


def test_no_rows(spark):
    assert negatives.hard_negatives(frame(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert negatives.hard_negatives(frame(spark, [(1, [1.0], 1)])).count() == 0
    assert negatives.hard_negatives(frame(spark, [(100, [1.0], 1)])).count() == 0


def test_other_labels_and_names(spark):
    rows = [(i, [1.0, i / 64], "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "`v.id` long, `e.v` array<double>, `l.b` string")
    got = found(negatives.hard_negatives(df, id_col="v.id", vec_col="e.v", label_col="l.b"))
    assert got == wanted(rows) and got


def test_partial_scores_hold_the_range():
    a = np.array([[2**40, 2**40], [3, -4]])
    whole = sum(negatives.partial_scores(a[:, c : c + 1], a[:, c : c + 1], 2).astype(object) for c in (0, 1))
    assert whole[0, 0] == 2 * ((2**63 - 1) // 2) and whole[1, 1] == 25
