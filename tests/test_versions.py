import pytest
from pyspark.sql import functions as F

from kelpie.sources.versions import Taken, Versions, changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, values):
    return spark.createDataFrame(values, "`a.id` long, name string, tags array<string>")


OLD = [(1, "one", ["x"]), (2, None, []), (3, "three", None), (None, "none", [])]
NEW = [(1, "one", ["x"]), (2, "two", []), (4, "four", None), (None, "none", ["y"])]
DIFF = sorted([(2, "changed"), (3, "removed"), (4, "added"), (None, "changed")], key=str)


def test_changes(spark):
    assert rows(changes(frame(spark, OLD), frame(spark, NEW), "a.id")) == DIFF
    assert rows(changes(frame(spark, OLD), frame(spark, OLD), "a.id")) == []
    with pytest.raises(ValueError):
        changes(frame(spark, OLD), frame(spark, OLD).drop("name"), "a.id")


def test_dry_run_equals_the_write_and_readers_keep_their_version(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    assert v.numbers() == [] and v.tables() == {}
    assert rows(v.replace("t", frame(spark, OLD), "a.id", dry_run=True)) == sorted([(1, "added"), (2, "added"), (3, "added"), (None, "added")], key=str)
    assert v.numbers() == [] and not (tmp_path / "data").exists()
    v.replace("t", frame(spark, OLD), "a.id")
    before = v.read("t")
    planned = rows(v.replace("t", frame(spark, NEW), "a.id", dry_run=True))
    assert planned == DIFF and v.numbers() == [1] and rows(v.read("t")) == sorted(OLD, key=str)
    assert rows(v.replace("t", frame(spark, NEW), "a.id")) == planned
    assert rows(before) == sorted(OLD, key=str) and rows(v.read("t")) == sorted(NEW, key=str) and rows(v.read("t", 1)) == sorted(OLD, key=str)
    assert v.restore(1) == 3 and rows(v.read("t")) == sorted(OLD, key=str)
    assert len(v.forget(keep=1)) == 1 and rows(v.read("t")) == sorted(OLD, key=str) and v.numbers() == [3]


def test_a_write_that_fails_names_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    v.replace("t", frame(spark, OLD), "a.id")
    with pytest.raises(Exception):
        v.replace("t", frame(spark, NEW).withColumn("name", F.raise_error(F.lit("stop")).cast("string")), "a.id")
    assert v.numbers() == [1] and rows(v.read("t")) == sorted(OLD, key=str)


def test_two_writers(spark, tmp_path):
    a, b = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    a.replace("t", frame(spark, OLD), "a.id")
    path = b.write("t", frame(spark, NEW))
    a.replace("u", frame(spark, NEW), "a.id")
    with pytest.raises(Taken):
        b.publish(b.tables(1) | {"t": path}, 1)
    assert rows(b.read("t")) == sorted(OLD, key=str) and b.numbers() == [1, 2]
