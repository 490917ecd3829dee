"""What an index holds against brute force, and how its texts are read."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators import index as index_
from kelpie.operators import search
from kelpie.operators.index import Index


def texts(spark, n, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "deploying", "deployments", "deploy", "naïve", "ions", "eee", "a", "movies", "movie"] + [f"w{i}" for i in range(30)]
    rows = [(f"p/{i}.md", None if i % 17 == 0 else " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60])))) for i in range(n)]
    return spark.createDataFrame(rows, "path string, body string")


def held(index, field):
    """{(path, word): (tf, len)} by the postings of a field, the null word for the lengths."""
    rows = index_._heads(index.versions.read("postings").where(F.col("field") == list(index.fields).index(field)), "term")
    names = index.versions.read("docs")
    found = rows.select("term", "segment", "block", "n", "most", "least", F.size("entries.doc").alias("size"), index_._each()).join(names, ["segment", "block", "doc"]).collect()
    assert all(r["n"] == r["size"] and r["tf"] <= r["most"] and r["len"] >= r["least"] for r in found)
    got = {(r["path"], r["term"]): (r["tf"], r["len"]) for r in found}
    assert len(got) == len(found)
    return got


def test_postings_against_brute_force(spark, tmp_path, monkeypatch):
    files = texts(spark, 700)
    words = F.filter(F.split(F.lower("body"), T.NON_WORD), lambda t: t != "")
    fields = {"words": F.array_append(words, None), "stems": ("words", T.stem_of())}
    plain = files.select("path", words.alias("w"), T.stemmed(words).alias("s")).collect()
    for name, at_once in (("whole", index_.AT_ONCE), ("pieces", 300)):
        monkeypatch.setattr(index_, "AT_ONCE", at_once)
        index = Index(spark, str(tmp_path / name), fields, reads=["path", "body"])
        index.build(files)
        for field, column in (("words", "w"), ("stems", "s")):
            want = {}
            for r in plain:
                if r[column]:
                    want |= {(r["path"], t): (n, len(r[column])) for t, n in Counter(r[column]).items()} | {(r["path"], None): (0, len(r[column]))}
            assert held(index, field) == want
        asked = spark.createDataFrame([(1, "alpha movies w3"), (2, "deploying naïve")], "query_id int, query string")
        values = lambda df: sorted((r["query_id"], r["path"], round(r["score"], 6)) for r in df.collect())
        assert values(index.bm25(asked, "words")) == values(search.bm25(files, asked))
        assert values(index.top(asked, 2000, "words")) == values(search.bm25(files, asked))


def test_stems_in_python_are_those_of_the_expression(spark):
    r = random.Random(4)
    tokens = ["", "s", "es", "ies", "ions", "bees", "eeee", "tree", "straße", "naïveté", "𝒜𝒜s", "a_s", "12ed", "sses"]
    tokens += ["".join(r.choice(["a", "e", "s", "ing", "ed", "ly", "ions", "ment", "é", "𝒜", "_", "7"]) for _ in range(r.randint(1, 6))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", T.stemmed(F.array("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [[s] if (s := T.stem_of()(r["t"])) is not None else [] for r in rows]


def test_texts_are_split_once_and_terms_stand_once_a_task(spark, tmp_path, monkeypatch):
    index, plans = Index(spark, str(tmp_path / "index"), search.keyword_fields(), reads=["path", "body"]), {}
    write = index.versions.write
    monkeypatch.setattr(index.versions, "write", lambda name, df, *a: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(name, df, *a))
    index.build(texts(spark, 2000))
    split = re.escape("split(lower(")
    # once for the words of bodies, once for tokens; stems are made of tokens, marks and lengths need no words
    assert len(re.findall(split, plans["postings"])) == 2 and not re.findall(split, plans["docs"] + plans["stats"])
    most = index.versions.read("postings").groupBy("field", "term").count().agg(F.max("count")).first()[0]
    assert most <= spark.sparkContext.defaultParallelism
