import difflib
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from kelpie.operators import search
from kelpie.operators.index import Index
from kelpie.operators.matching import close_terms
from kelpie.plans.tables import AS_OF

SCHEMA = "path string, stem string, body string, size_bytes long, mtime timestamp"


def corpus(spark, n, seed=1, changed=()):
    r = random.Random(seed)
    pool = [f"word{i}" for i in range(40)] + ["Alpha", "deploying", "deployed", "naïve", "the"]
    rows = []
    for i in range(n):
        body = " ".join(r.choice(pool) if r.random() < 0.9 else f"rare{r.randint(0, 200)}" for _ in range(r.choice([0, 3, 40, 300])))
        rows.append((f"MEMORY/{'accounts' if i % 2 else 'weekly'}/f{i}.md", f"f{i}", body + (" Anderson fresh news" if i in changed else ""), max(60, len(body)), "2024-01-30 10:00:00"))
    return spark.createDataFrame([(*r[:4], __import__("datetime").datetime.fromisoformat(r[4])) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "word1 word2 rare7"), (2, "Alpha deploying news"), (3, "the"), (4, "nothing known here"), (5, "rare1 rare2 rare3 rare4 rare199"), (6, "Andersen word3")]
    return spark.createDataFrame(rows, "query_id int, query string")


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def hold(index, files, asked):
    want = rows(search.bm25(files, asked), "query_id", "path", "score")
    assert rows(index.bm25(asked), "query_id", "path", "score") == want
    best = {}
    for q, p, s in want:
        best.setdefault(q, []).append((-s, p))
    expected = sorted((q, p, n + 1) for q, v in best.items() for n, (_, p) in enumerate(sorted(v)[:5]))
    assert rows(index.top(asked, 5), "query_id", "path", "rank") == expected
    names = ("query_id", "path", "overlap", "stem_hits", "effective", "score")
    for fuzzy in (False, True):
        whole = rows(search.keyword_score(files, asked, AS_OF, fuzzy=fuzzy), *names)
        assert rows(search.keyword_score(files, asked, AS_OF, fuzzy=fuzzy, index=index), *names) == whole
    return want


def test_index_through_changes(spark, asked, tmp_path):
    index = Index(spark, str(tmp_path / "index"), search.keyword_fields())
    files = corpus(spark, 500)
    index.build(files)
    first = hold(index, files, asked)
    assert index.refresh(files) == (0, 0, 0) and index.versions.numbers() == [1]
    later = corpus(spark, 520, changed=(3, 10, 200)).where("stem not in ('f5', 'f6')")
    assert index.refresh(later) == (20, 3, 2)
    assert hold(index, later, asked) != first
    assert index.refresh(files) == (2, 3, 20)  # back again: what was replaced twice
    assert hold(index, files, asked) == first


def test_blocks_are_skipped(spark, tmp_path):
    rare = "concat('common ', repeat('filler ', cast(id % 50 as int)), if(id % 997 = 5, 'needle needle needle', ''))"
    files = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("path"), F.expr(rare).alias("body"))
    index = Index(spark, str(tmp_path / "index"))
    index.build(files)
    asked = spark.createDataFrame([(1, "common needle")], "query_id int, query string")
    found = index.top(asked, 5)
    want = sorted((-s, p) for _, p, s in rows(search.bm25(files, asked), "query_id", "path", "score"))[:5]
    assert [p for _, p in want] == [r["path"] for r in found.orderBy("rank").collect()]
    assert index.skipped > 100


def test_only_terms_asked_for_are_read(spark, asked, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.build(corpus(spark, 50))
    plan = index.postings(spark.createDataFrame([("rare7",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan) and "rare7" in plan
    heads = index.postings(spark.createDataFrame([("rare7",)], "term string")).select("most")._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in heads.split("ReadSchema")[1]


def test_empty_index_and_many_queries(spark, tmp_path):
    files = corpus(spark, 30)
    index = Index(spark, str(tmp_path / "a"), search.keyword_fields())
    index.build(files.limit(0))
    many = spark.range(2500).select(F.col("id").cast("int").alias("query_id"), F.concat(F.lit("word"), (F.col("id") % 60).cast("string")).alias("query"))
    assert index.bm25(many).count() == 0 and index.top(many).count() == 0
    assert index.refresh(files) == (30, 0, 0)
    want = rows(search.bm25(files, many), "query_id", "path", "score")
    assert len(want) > 2500 and rows(index.bm25(many), "query_id", "path", "score") == want
    shutil.rmtree(tmp_path / "a")


def test_close_terms_against_all_pairs(spark):
    r = random.Random(2)
    vocabulary = {"".join(r.choice("abcde") for _ in range(r.randint(1, 12))) for _ in range(1500)} | {"anderson", "andersen", "aaaaa", "aaaaaa", "aaaaaaaa"}
    words = sorted(w for w in vocabulary if len(w) >= 5)[::9] + ["andersn", "aaaaaaa", "abcd"]
    v = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    for ratio in (0.85, 0.82, 0.8):
        got = {(x["word"], x["term"]) for x in close_terms(spark.createDataFrame([(w,) for w in words], "word string"), v, ratio).collect()}
        assert got == {(w, t) for w in words if len(w) >= 5 for t in vocabulary if difflib.SequenceMatcher(None, t, w).ratio() >= ratio}
    with pytest.raises(ValueError):
        close_terms(v.withColumnRenamed("term", "word"), v, 0.5)


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    index, plans = Index(spark, str(tmp_path / "index"), search.keyword_fields()), {}
    write = index.versions.write
    monkeypatch.setattr(index.versions, "write", lambda name, df, *a: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(name, df, *a))
    index.build(corpus(spark, 300))
    # one exchange, of the texts to their block: words, counts and postings stay where they are made
    assert plans["postings"].count("Exchange") == 1
    kept = index.versions.read("docs").collect()
    assert len({(r["block"], r["doc"]) for r in kept}) == 300 and max(r["doc"] for r in kept) <= 300
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "twice")).build(corpus(spark, 5).unionAll(corpus(spark, 5)))
