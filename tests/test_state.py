import datetime
import itertools
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from kelpie.operators import ingest
from kelpie.plans import assembly
from kelpie.sources import filetree, watched
from kelpie.streaming import jobs, state


@pytest.fixture(autouse=True)
def rocksdb(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def simulate(rows, cap):
    held, out = {}, []
    for key, at, fp in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = held.setdefault(key, [])
        if not fp or fp not in mine:
            out.append((key, at, fp))
            if fp:
                mine.append(fp)
                del mine[:-cap]
    return sorted(out, key=str)


SCHEMA = "box string, at long, fp string"


def test_newest_fingerprints(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.choice([None, "", *(f"f{j}" for j in range(8))])) for i in range(300)]
    want = simulate(rows, 5)
    whole = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, ingest.unseen_newest(whole, "box", order=["at"], cap=5).collect()), key=str) == want
    assert len(want) < 250
    for n, cuts in enumerate([[300], [1, 2, 150, 300], [100, 100, 290, 300]]):  # any split into batches, over restarts
        root = tmp_path / str(n)
        for k, (a, b) in enumerate(itertools.pairwise([0, *cuts])):
            spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
            jobs.run_once(state.unseen_newest(stream, "box", order=["at"], cap=5), None, f"{root}/ck", f"{root}/out")
        assert sorted(map(tuple, spark.read.parquet(f"{root}/out").select("box", "at", "fp").collect()), key=str) == want


def test_the_cap_is_exact(spark):
    rows = [("a", 0, "first"), *(("a", i, f"f{i}") for i in range(1, 5000)), ("a", 5000, "first"), ("a", 5001, "last"), ("a", 5002, "first"), ("a", 5003, "last")]
    kept = [x["at"] for x in ingest.unseen_newest(spark.createDataFrame(rows, SCHEMA), "box", order=["at"]).where("at >= 5000").collect()]
    assert sorted(kept) == [5001, 5002]  # within 5000 it doesn't pass; one more, and it does


TURNS = "session string, turn long, user string, ts timestamp"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_harvests(spark, tmp_path):
    # (minute, session, turn): a's first at once, then hourly; b is alone; z moves the watermark
    batches = [[(0, "a", 1), (0, "b", 1)], [(10, "a", 2), (20, "a", 3)], [(30, "a", 4)], [(200, "z", 1)], [(210, "z", 2), (205, "a", 5)], [(400, "z", 3)], [(800, "z", 4)]]
    given = []
    for batch in batches:
        spark.createDataFrame([(s, t, f"{s}{t}", at(m)) for m, s, t in batch], TURNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(TURNS).parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute")
        jobs.run_once(state.harvests(stream, time="ts"), None, f"{tmp_path}/ck", f"{tmp_path}/out")
    given = sorted((r["session"], r["turn"], r["user"], r["harvest_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [g[:3] for g in given] == sorted((s, t, f"{s}{t}") for b in batches for _, s, t in b)  # once each, none lost
    a = {t: h for s, t, _, h in given if s == "a"}
    assert a[1] == at(0) and a[2] == a[3] == a[4] == at(60) and a[5] == at(205)
    times = sorted({h for s, _, _, h in given if s == "z"})
    assert all((y - x).total_seconds() >= 3600 for x, y in itertools.pairwise(times))
    # the batch form: due exactly where the stream gave at once
    index = spark.createDataFrame([("a", 1, at(0))], "session string, turn_count int, last_at timestamp")
    turns = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "session string, turn long")
    due = {r["session"]: (r["from_turn"], r["due"]) for r in assembly.due_sessions(turns, index, "2024-01-01 00:20:00").collect()}
    assert due == {"a": (1, False), "b": (0, True)}
    due = {r["session"]: r["due"] for r in assembly.due_sessions(turns, index, "2024-01-01 01:00:00").collect()}
    assert due == {"a": True, "b": True}


def test_refreshes(spark, tmp_path):
    schema = "path string, mtime timestamp"
    rows = [("x", 0), ("x", 0.2), ("x", 0.4), ("y", 0.1), ("x", 5), ("z", 60)]
    spark.createDataFrame([(p, at(m)) for p, m in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", at(500))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_once(jobs.refreshes(stream), None, f"{tmp_path}/ck", f"{tmp_path}/out")
    got = sorted((r["path"], r["changes"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [g for g in got if g[0] != "end"] == [("x", 1), ("x", 3), ("y", 1), ("z", 1)]


def test_changed_files(spark, tmp_path):
    root = tmp_path / "cal"
    root.mkdir()

    def run():
        jobs.run_once(watched.changed_files(spark, str(root)), None, str(tmp_path / "ck"), str(tmp_path / "out"))
        return sorted((os.path.basename(r["path"]), r["content"]) for r in spark.read.schema("path string, content string").parquet(str(tmp_path / "out")).collect())

    (root / "a.ics").write_text("one")
    (root / "b.ics").write_text("two")
    (root / "c.txt").write_text("other")
    assert run() == [("a.ics", "one"), ("b.ics", "two")]
    assert run() == [("a.ics", "one"), ("b.ics", "two")]  # a restart reads nothing again
    time.sleep(0.02)
    (root / "a.ics").write_text("edited")
    os.utime(root / "b.ics")  # touched, not edited
    (root / "d.ics").write_text("new")
    want = [("a.ics", "edited"), ("a.ics", "one"), ("b.ics", "two"), ("d.ics", "new")]
    assert run() == want and run() == want


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names if filetree.STAGING not in d}


def test_one_file_a_row(spark, tmp_path):
    root = str(tmp_path / "out")
    os.makedirs(root)
    df = lambda rows: spark.createDataFrame(rows, "path string, content string")
    filetree.write_files(df([(f"d{i % 3}/f{i}.md", f"body {i} é") for i in range(30)] + [("empty.md", None)]), root)
    first = tree(root)
    assert len(first) == 31 and first["d1/f4.md"] == "body 4 é" and first["empty.md"] == ""
    for rows in ([("new.md", "x"), ("d0/f0.md", "again")], [("twice.md", "x"), ("twice.md", "y")], [("ok.md", "x"), ("../out.md", "y")], [("ok.md", "x"), ("/etc/x", "y")]):
        with pytest.raises(Exception):
            filetree.write_files(df(rows), root)
        assert tree(root) == first
    # a task that dies after others have written leaves nothing
    dies = spark.range(40, numPartitions=4).select(F.concat(F.lit("t"), "id").alias("path"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("content"))
    with pytest.raises(Exception):
        filetree.write_files(dies, root)
    assert tree(root) == first
    filetree.write_files(df([("d0/f0.md", "replaced")]), root, replace=True)
    assert tree(root) == first | {"d0/f0.md": "replaced"}


def test_a_commit_that_dies_is_finished(tmp_path):
    root = tmp_path / "out"
    staged = root / filetree.STAGING / "batch" / "attempt"
    staged.mkdir(parents=True)
    (staged / "a.md").write_text("A")
    (staged / "b.md").write_text("B")
    moves = [[str(staged / n), str(root / n)] for n in ("a.md", "b.md")]
    os.rename(staged / "a.md", root / "a.md")  # the first move was done when the driver died
    (root / filetree.STAGING / "batch" / "journal").write_text(json.dumps(moves))
    (root / filetree.STAGING / "other").mkdir()  # a batch without a journal never was
    filetree.finish(str(root))
    assert tree(root) == {"a.md": "A", "b.md": "B"} and not (root / filetree.STAGING / "batch").exists()
