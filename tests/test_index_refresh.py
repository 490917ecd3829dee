"""Registered indexes follow their documents."""

from pyspark.sql import functions as F

from kelpie.operators import index as index_
from kelpie.operators import search
from kelpie.operators.index import Index
from kelpie.plans import registry


def test_indexes_follow_their_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    queries, rows = registry.queries(), lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    run = lambda name: rows(queries[name](spark, str(tmp_path)))
    first = {name: run(name) for name in ("indexed_bm25", "indexed_top", "indexed_keyword_score")}
    assert first["indexed_bm25"] == run("bm25") and first["indexed_keyword_score"] == run("keyword_score")
    # removed, changed (a text of another file) and new ones
    changed = docs.where("doc_id >= 5").withColumn("text", F.when(F.col("doc_id") < 20, F.concat(F.col("text"), F.lit(" source review weekly"))).otherwise(F.col("text")))
    later = changed.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    later.write.parquet(f"{tmp_path}/later")
    spark.read.parquet(f"{tmp_path}/later").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert run("bm25") != first["indexed_bm25"]
    assert run("indexed_bm25") == run("bm25") and run("indexed_keyword_score") == run("keyword_score")
    fresh = tmp_path / "fresh"
    later.write.parquet(f"{fresh}/documents.parquet")
    assert run("indexed_top") == rows(queries["indexed_top"](spark, str(fresh))) != first["indexed_top"]


def test_words_that_move_between_fields_are_a_change(spark, tmp_path):
    files = lambda a, b: spark.createDataFrame([("p", a, b), ("q", "x", "y")], "path string, a string, b string")
    index = Index(spark, str(tmp_path / "index"), {"a": F.split("a", " "), "b": F.split("b", " ")})
    index.build(files("one two", "three"))
    assert index.refresh(files("one", "two three")) == (0, 1, 0)
    assert index.refresh(files("one", "two three")) == (0, 0, 0)
    found = index.matches({"b": spark.createDataFrame([(1, "two"), (1, "x")], "query_id int, term string")}).collect()
    assert [(r["query_id"], r["path"], r["b"]) for r in found] == [(1, "p", ["two"])]


def test_segments_are_made_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_, "SEGMENTS", 2)
    files = lambda n: spark.range(n, numPartitions=2).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("all w"), F.col("id") % 3).alias("body"))
    index = Index(spark, str(tmp_path / "index"))
    index.build(files(10))
    segments, asked = [], spark.createDataFrame([(1, "all w1")], "query_id int, query string")
    for n in (12, 9, 11):
        index.refresh(files(n))
        segments.append(len(index.versions.tables()["docs"]))
        rows = lambda df: sorted((r["path"], round(r["score"], 6)) for r in df.collect())
        assert rows(index.bm25(asked)) == rows(search.bm25(files(n), asked))
    assert segments == [2, 1, 2]
