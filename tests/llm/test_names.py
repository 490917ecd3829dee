"""Awkward column names, and rows that repeat an id in the search."""

import random

from kelpie.llm import passages, suffixes, topk, urls


def test_names_with_dots(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "x", "http://a.com/", "<a href='http://b.net/x'>"), (2, text + " more", "y", None, None)], "`a.b` long, `t.x` string, `c.``d` string, `u.r` string, `h.t` string")
    out = {r["a.b"]: r for r in passages.remove_passages(df, id_col="a.b", text_col="t.x", carry=["c.`d"], with_text=True).collect()}
    assert out[2]["n_removed"] == 40 and out[2]["kept_text"] == "more" and out[2]["c.`d"] == "y" and out[1]["n_removed"] == 0
    out = {r["a.b"]: r["n_removed"] for r in suffixes.remove_repeats(df, id_col="a.b", text_col="t.x").collect()}
    assert out == {1: 0, 2: len(text)}
    out = {r["a.b"]: r["host"] for r in urls.judge(df, id_col="a.b", url_col="u.r", html_col="h.t").collect()}
    assert out == {1: "a.com", 2: ""}


def found(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(map(tuple, topk.top_k(df, k=k).select("query_id", "rank", "vec_id", "score").collect()))


def wanted(rows, k):
    scale = [(i, tuple(int(64 * x // 1) for x in v)) for i, v in rows]
    queries = {}
    for i, v in scale:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in scale if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_rows_that_repeat_have_ranks_of_their_own(spark):
    assert found(spark, [(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [1.0])], 3) == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, 4096)]
    r = random.Random(8)
    rows = [(i, [r.randint(-8, 8) / 8 for _ in range(4)]) for i in range(120)]
    rows += [rows[r.randrange(120)] for _ in range(200)] + [(40, rows[7][1])] * 9 + [(40, rows[0][1])] * 30 + [(60, rows[60][1])] * 30 + [(3, rows[60][1])] * 30
    for k in (1, 5, 12):
        assert found(spark, rows, k) == wanted(rows, k)


def test_an_id_of_very_many_rows(spark):
    r = random.Random(9)
    rows = [(20, [r.randint(-64, 64) / 64, r.randint(-64, 64) / 64]) for _ in range(20_000)] + [(i, [i / 64, 0.5]) for i in range(0, 60)]
    assert found(spark, rows, 3) == wanted(rows, 3)
