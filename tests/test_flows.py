import datetime
import json

import pytest
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators import ingest
from kelpie.plans import flows, runs
from kelpie.plans import tables
from kelpie.plans.completion import Completions

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) if isinstance(v, list) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_a_run_goes_on_where_it_was(spark, tmp_path):
    inputs = [f(spark, SF) for f in (tables.memory_files, tables.entities, tables.edges, tables.triples)]
    whole = runs.Run(spark, str(tmp_path / "whole"))
    want = runs.sleep_cycle(whole, *inputs, tables.AS_OF)
    steps = list(whole.did)
    assert len(steps) == 6
    for stop in (3,):
        root = str(tmp_path / f"stop{stop}")

        class Stopping(runs.Run):
            def step(self, name, make):
                if len(self.did) == stop and name not in self.versions.tables():
                    raise KeyboardInterrupt
                return super().step(name, make)

        first = Stopping(spark, root)
        with pytest.raises(KeyboardInterrupt):
            runs.sleep_cycle(first, *inputs, tables.AS_OF)
        second = runs.Run(spark, root)
        got = runs.sleep_cycle(second, *inputs, tables.AS_OF)
        assert first.did + second.did == steps and len(first.did) == stop
        assert rows(got["briefing"]) == rows(want["briefing"]) and rows(got["orphans"]) == rows(want["orphans"])


def test_batches_are_worked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def reply(prompt, folder=str(calls)):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return json.dumps({"page": "wiki/" + prompt.split()[-1], "body": "B"}) if "bad" not in prompt else "no"

    files = spark.createDataFrame([(f"p{i:02d}", f"text {i}" if i != 7 else "bad") for i in range(23)], "path string, body string")
    done = spark.createDataFrame([("p00",), ("p01",)], "path string")

    class Stopping(runs.Run):
        def step(self, name, make):
            if name == "pages:2":
                raise KeyboardInterrupt
            return super().step(name, make)

    root = str(tmp_path / "run")
    with pytest.raises(KeyboardInterrupt):
        runs.wiki_ingest(Stopping(spark, root), files, done, Completions(spark, str(tmp_path / "memo"), reply, retries=0), size=5)
    assert len(list(calls.iterdir())) == 10
    again = runs.Run(spark, root)
    more = files.union(spark.createDataFrame([("a-new", "text new")], files.schema))  # batches don't move
    got = runs.wiki_ingest(again, more, done, Completions(spark, str(tmp_path / "memo"), reply, retries=0), size=5)
    assert again.did == ["pages:2", "pages:3", "pages:4"] and len(list(calls.iterdir())) == 21
    pages = {r["path"]: r["page"] for r in got.collect()}
    assert len(pages) == 21 and pages["p05"] == "wiki/5" and pages["p07"] is None
    assert runs.wiki_ingest(runs.Run(spark, str(tmp_path / "none")), files, files, None) is None


def mail(sender, subject, body):
    return f"**From:** {sender}\n----## {subject}\n{body}\n" + "filler words to be long enough " * 8


def test_ingest_from_file_to_named_markdown(spark):
    at = lambda m: datetime.datetime(2024, 1, 15, 10, m)
    files = [
        ("short.md", "tiny", at(0)),
        ("one.eml", mail("Ann.Lee@x.org", "Budget plan", "Numbers for March"), at(1)),
        ("two.eml", mail("Ann.Lee@x.org", "Budget plan", "Numbers for March"), at(2)),
        ("seen.eml", mail("bob@y.org", "Old", "Known before"), at(3)),
        ("promo.eml", mail("News <news@booking.com>", "Deals", "Book now"), at(4)),
        ("page.html", "<html><head><title>x</title></head><body><p>" + "Real words here. " * 30 + "</p></body></html>", at(5)),
        ("notes & plans.txt", "plain text " * 30, at(6)),
        ("scan.pdf", "extracted text " * 30, at(7)),
        ("scan.docx", "other extracted text " * 30, at(8)),
        ("three.eml", mail("Ann.Lee@x.org", "Budget plan", "Other numbers"), at(9)),
    ]
    df = spark.createDataFrame(files, "name string, content string, mtime timestamp")
    none = spark.createDataFrame([], "fp string")
    nowhere = spark.createDataFrame([], "path string")
    first = {r["name"]: r for r in flows.ingest_files(df, none, nowhere, "Ann Lee", "ann.lee@x.org").collect()}
    assert {n: r["action"] for n, r in first.items()} == {"short.md": "placeholder", "one.eml": "written", "two.eml": "duplicate", "seen.eml": "written", "promo.eml": "promotion", "page.html": "written", "notes & plans.txt": "written", "scan.pdf": "written", "scan.docx": "written", "three.eml": "written"}
    assert first["promo.eml"]["reason"].startswith("marketing-domain") and first["promo.eml"]["path"] is None
    assert first["one.eml"]["path"].startswith("MEMORY/daily/emails/email_2024-01-15__Budget_plan") and first["one.eml"]["refresh_tone"] and not first["seen.eml"]["refresh_tone"]
    assert first["notes & plans.txt"]["path"].endswith("/notes___plans.txt") and first["scan.pdf"]["path"].endswith("/scan.md")
    assert first["scan.docx"]["path"].startswith("MEMORY/daily/emails/scan__") and "<p>" not in first["page.html"]["markdown"]
    paths = [r["path"] for r in first.values() if r["path"]]
    assert len(set(paths)) == len(paths)
    # what was seen, and what is there
    seen = spark.createDataFrame([(first["seen.eml"]["markdown"],)], "m string").select(T.fingerprint(F.col("m")).alias("fp"))
    there = spark.createDataFrame([(first["one.eml"]["path"],)], "path string")
    again = {r["name"]: r for r in flows.ingest_files(df, seen, there).collect()}
    assert again["seen.eml"]["action"] == "duplicate" and again["one.eml"]["path"] not in paths
    assert ingest.split_blocks is not None


def test_transcripts(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\n<v Ann>Hello there</v>\n\n00:00:04.000 --> 00:00:05.000\n<v Ann>again</v>\n\n00:01:00.000 --> 00:01:09.500\nBob Ray: Hi\n"
    r = flows.transcripts(spark.createDataFrame([("x/Team_sync-1.vtt", vtt)], "file string, body string")).first()
    assert r["title"] == "Team sync 1" and r["speakers"] == ["Ann", "Bob Ray"] and r["duration"] == 69.5
    assert r["markdown"].startswith("# Team sync 1\n\n**Speakers:** Ann, Bob Ray\n") and "Hello there again" in r["markdown"] and r["markdown"].count("**") == 8
