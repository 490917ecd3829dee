"""Readers, sinks, streams and functions on literal inputs, with Python as the judge."""

import datetime
import difflib
import html
import json
import re

import pytest
from pyspark.sql import functions as F

from kelpie.functions import scoring as S
from kelpie.functions import text as X
from kelpie.operators import graph, ingest, memory, ordered, search
from kelpie.plans import assembly
from kelpie.sources import readers, sinks
from kelpie.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


def test_stem_is_the_first_suffix_that_fits(spark):
    words = "meetings hiring decided decisions companies businesses strategic ing sing quickly ations nations sees free agreements".split()

    def slow(w):
        for s in X.SUFFIXES:
            if w.endswith(s) and len(w) - len(s) >= 3:
                return w[: -len(s)]
        return w

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got} == {w: slow(w) for w in words}
    assert value(spark, X.stem_token(lit("hires"))) == "hir"


def test_synonyms_go_both_ways(spark):
    got = value(spark, X.expand_synonyms(X.query_tokens(lit("vehicle price")), {"auto": ["car", "vehicle"]}))
    assert set(got) == {"vehicle", "price", "auto", "car"}


def test_html(spark):
    raw = "<!-- x --><style>p{a:b}</style><p>Tom &amp; Ann&nbsp;&lt;3</p>\n\n\n\n<br>end  "
    got = value(spark, X.strip_html(lit(raw)))
    assert got == "Tom & Ann <3\n\n end" and html.unescape("&amp;") == "&"


def test_reply_cut_and_marketing(spark):
    long = "x" * 230 + "\nOn Mon, Jan 1, 2024 someone wrote:\nold"
    assert value(spark, X.truncate_replies(lit(long))).endswith("[... reply chain truncated ...]")
    assert value(spark, X.truncate_replies(lit(long[200:]))) == long[200:]
    reason = lambda f, s, b: value(spark, X.marketing_reason(lit(f), lit(s), lit(b)))
    assert reason("A <a@mail.pilot.com>", "hi", "b") == "marketing-domain:mail.pilot.com"
    assert reason("a@b.org", "50% off today", "b") == "marketing-subject"
    assert reason("a@b.org", "hi", "unsubscribe shop now " + "y" * 1500) == "marketing-cta-pattern" and reason("a@b.org", "hi", "b") == ""


def test_redaction_in_order(spark):
    text = "mail a.b@c.de, call +49 170 1234, id 123-45-6789, pay €50k or 20 EUR, card 4111 1111 1111 1111"
    want, n = text, 0
    for label, p in X.REDACTIONS:
        want, k = re.subn(p, f"[{label}]", want)
        n += k
    rows = ingest.redact(spark.createDataFrame([(text,), ("[EMAIL] of a [PHONE]",), (None,), ("plain",)], "t string"), "t").collect()
    assert [(r["redacted"], r["n_redacted"]) for r in rows] == [(want, n), ("[EMAIL] of a [PHONE]", 0), (None, None), ("plain", 0)]


def test_blocks_and_fingerprints(spark):
    mail = lambda i: f"**From:** u{i}@x.de\n**To:** me\n\n----## Subject {i}\nbody {i}\n"
    rows = spark.createDataFrame([("a", mail(1) + mail(2)), ("b", mail(1)), ("c", "no mail"), ("d", mail(3) + mail(3))], "id string, content string")
    blocks = ingest.split_blocks(rows)
    assert blocks.groupBy("id").count().collect() and {r["id"]: r["count"] for r in blocks.groupBy("id").count().collect()} == {"a": 2, "b": 1, "c": 1, "d": 2}
    seen = blocks.where("id = 'b'").select(X.fingerprint(F.col("block")).alias("fp"))
    fresh = ingest.new_blocks(blocks.where("id <> 'b'"), seen, order=("id", "block_no"))
    assert sorted(r["block"].split("\n")[-1] for r in fresh.collect()) == ["body 2", "body 3", "no mail"]


def test_fuzzy_names(spark):
    files = spark.createDataFrame([(1, "MEMORY/context/a.md", "a", "the betamotors plan " + "z" * 60, 100, datetime.datetime(2024, 1, 1))], "doc_id int, path string, stem string, body string, size_bytes long, mtime timestamp_ntz")
    q = spark.createDataFrame([(1, "What of BetaMotorss")], "query_id int, query string")
    assert difflib.SequenceMatcher(None, "betamotors", "betamotorss").ratio() > 0.85
    r = search.keyword_score(files, q, "2024-01-31 00:00:00", fuzzy=True).first()
    assert r["effective"] == 1.5 and r["proper_hits"] == 1 and search.keyword_score(files, q, "2024-01-31 00:00:00").count() == 0


def test_paragraphs(spark):
    cues = [(0, 0.0, 1.0, "one"), (1, 9.0, 10.0, "two."), (2, 11.0, 12.0, "three."), (3, 30.0, 31.0, "four")]
    r = ordered.merge_paragraphs(spark.createDataFrame([("f", *c) for c in cues], "file string, n int, start double, end double, text string")).first()
    assert r["paragraphs"] == ["one two. three.", "four"]


def test_numbered_follows_the_order(spark):
    rows = spark.createDataFrame([(f"p{i * 37 % 211:03d}",) for i in range(211)], "path string").repartition(5)
    assert [r["no"] for r in ordered.numbered(rows, "path").orderBy("path").collect()] == list(range(211))


def test_proposals_fold_newest_first(spark):
    rows = [("p", "1", 1, "alpha beta gamma"), ("p", "2", 2, "alpha beta gamma delta"), ("p", "3", 3, "other words here"), ("q", "4", 1, "alpha beta gamma")]
    got = {r["uid"]: r["kept"] for r in ordered.near_duplicate_proposals(spark.createDataFrame(rows, "path string, uid string, ts int, reason string")).collect()}
    assert got == {"1": False, "2": True, "3": True, "4": True}


def test_incompatible_relations(spark):
    e = spark.createDataFrame([("a", "b", "owns", 0.9, "semantic")], "src string, dst string, type string, weight double, tier string")
    n = spark.createDataFrame([("a", "A", "semantic"), ("b", "B", "semantic")], "eid string, name string, tier string")
    t = spark.createDataFrame([("a", "b", "owned_by", 0.9, "x"), ("a", "b", "owned_by", 0.1, "x"), ("a", None, "owned_by", 0.9, "x")], "src string, dst string, type string, confidence double, source string")
    got = memory.find_contradictions(t, e, n).collect()
    assert len(got) == 1 and got[0]["kind"] == "ownership_conflict" and got[0]["severity"] == "high"


def test_communities(spark):
    stars = [(g, f"{g}{i}") for g in ("x", "y") for i in range(1, 5)] + [("x", "y")]
    e = spark.createDataFrame([(a, b, 1.0 if a[0] == b[0] else 0.1) for a, b in stars], "src string, dst string, weight double")
    groups = {}
    for r in graph.greedy_communities(e).collect():
        groups.setdefault(r["community"], set()).add(r["node"][0])
    assert sorted(map(sorted, groups.values())) == [["x"], ["y"]]


def test_calendar(spark):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Plan\\, long\r\n  er\r\nDTSTART;TZID=UTC:20240105T100000Z\r\nATTENDEE;CN=\"Ann B\":mailto:a@x\r\nATTENDEE:mailto:c@x\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Day\r\nDTSTART;VALUE=DATE:20240106\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nEND:VCALENDAR"
    rows = readers.calendar(spark.createDataFrame([("f", ics)], "file string, body string")).orderBy("n").collect()
    assert (rows[0]["summary"], rows[0]["attendees"], str(rows[0]["end"])) == ("Plan, long er", ["Ann B", "c@x"], "2024-01-05 11:00:00")
    assert rows[1]["all_day"] and str(rows[1]["end"]) == "2024-01-07 00:00:00"
    files = sinks.event_files(readers.calendar(spark.createDataFrame([("f", ics)], "file string, body string")), "2024-01-10 00:00:00").collect()
    assert [f["name"] for f in files] == ["2024-01-05_1000_plan-long-er.md"]


def test_transcript(spark):
    vtt = "WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:03.500\n<v Ann>Hello\nthere.\n\n00:00:05.000 --> 00:00:06.000\nBob Lee: yes\n\n01:00:00.000 --> 01:00:01.000\nplain"
    rows = readers.transcript(spark.createDataFrame([("f", vtt)], "file string, body string")).orderBy("n").collect()
    assert [(r["start"], r["end"], r["speaker"], r["text"]) for r in rows] == [(1.0, 3.5, "Ann", "Hello there."), (5.0, 6.0, "Bob Lee", "yes"), (3600.0, 3601.0, "", "plain")]
    md = sinks.transcript_markdown(ordered.merge_cues(readers.transcript(spark.createDataFrame([("f", vtt)], "file string, body string")))).first()["markdown"]
    assert md.startswith("**Ann** (0:00:01): Hello there.")


def test_mail(spark):
    raw = b"From: A <a@x.de>\nTo: b@y\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>h</p>\n--q\nContent-Type: text/plain\n\nplain\n--q--\n"
    r = readers.mail(spark.createDataFrame([("m", bytearray(raw))], "path string, content binary")).first()
    assert (r["subject"], r["body"].strip(), r["sender"]) == ("Grüße", "plain", "A <a@x.de>")


def test_json_stores(spark, tmp_path):
    g = {"entities": {"a": {"name": "A", "salience": 0.7, "sources": ["s"]}, "b": {"name": "B", "salience": {"base": 0.4, "computed": 0.6}}}, "edges": [{"from": "a", "to": "b", "type": "knows"}]}
    (tmp_path / "graph.json").write_text(json.dumps(g))
    nodes, edges = readers.graph(spark, str(tmp_path / "graph.json"))
    assert {r["eid"]: (r["base"], r["computed"]) for r in nodes.collect()} == {"a": (0.7, 0.7), "b": (0.4, 0.6)} and edges.first()["weight"] is None
    for name, content in (("list", [{"id": "1"}]), ("dict", {"questions": [{"id": "1"}]})):
        (tmp_path / name).write_text(json.dumps(content))
        assert [r["id"] for r in readers.records(spark, str(tmp_path / name), "questions", "id:string").collect()] == ["1"]
    (tmp_path / "log").write_text('{"model": "m", "cost_usd": 1.5}\nnot json\n')
    assert [r["cost_usd"] for r in readers.json_lines(spark, str(tmp_path / "log"), "model string, cost_usd double").collect()] == [1.5]


def test_markdown_stores(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("x" * 60)
    (tmp_path / "tiny.md").write_text("x")
    (tmp_path / "b.digest.md").write_text("x" * 60)
    assert [r["stem"] for r in readers.markdown_tree(spark, str(tmp_path)).collect()] == ["a"]
    idx = spark.createDataFrame([("t", "# T\n- [[p/one|One]] - first page\n* [[two]]\n- [[three]] — dash")], "topic string, body string")
    assert [(r["page_ref"], r["description"]) for r in readers.wiki_index(idx).orderBy("ord").collect()] == [("p/one", "first page"), ("two", ""), ("three", "")]
    turns = spark.createDataFrame([("s", "## 10:00\n**User:** hi\n**Assistant:** yes\n\n## 10:05\n**User:** more")], "session string, body string")
    assert [(r["ts"], r["user"], r["assistant"]) for r in readers.session_turns(turns).orderBy("turn").collect()] == [("10:00", "hi", "yes"), ("10:05", "more", "")]
    assert {r["name"] for r in readers.people_names(spark.createDataFrame([("## Ann\n**Bob Lee** x",)], "body string")).collect()} == {"Ann", "Bob"}


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "w")], "k int, v string")
    assert sorted(map(tuple, sinks.merge(a, b, "k", ["v"]).collect())) == [(1, "x"), (2, "w")]
    assert spark.read.parquet(sinks.snapshot(a, str(tmp_path / "s"))).count() == 1
    sinks.append_log(a, str(tmp_path / "l"))
    sinks.append_log(b, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    assert "- [[a|A]] - s" in sinks.index_page(spark.createDataFrame([("t", "a", "A", "s")], "topic string, name string, title string, summary string")).first()["markdown"]


def test_link_rewriting(spark):
    pages = spark.createDataFrame([("wiki/a.md", "see [[b]] and [[gone]] ![[pic.png]] [x](http://y)"), ("wiki/b.md", "[[Wiki_A?]] [[a#top|t]]"), ("wiki/c.md", "")], "path string, body string")
    r = ingest.resolve_links(ingest.extract_links(pages), pages)
    got = {(x["path"], x["target"]): x["resolved"] for x in r.collect()}
    assert got[("wiki/a.md", "b")] == "wiki/b.md" and got[("wiki/a.md", "gone")] is None and got[("wiki/b.md", "a")] == "wiki/a.md" and ("wiki/a.md", "pic.png") not in got
    assert [x["path"] for x in ingest.orphans(pages, r).collect()] == ["wiki/c.md"]
    fixed = ingest.delink(pages, r.where("not external and resolved is null").select("path", "target"))
    assert {x["path"]: x["fixed"] for x in fixed.collect()}["wiki/a.md"].startswith("see [[b]] and gone")


def test_completer(spark):
    rows = spark.createDataFrame([("say this now",), (None,)], "p string")
    out = assembly.row_function(rows, F.col("p"), assembly.stub_completer, "summary string", F.struct(F.lit("none").alias("summary"))).collect()
    assert out[0]["answer"]["summary"] == "say this now" and out[1]["answer"]["summary"] == ""
    bad = assembly.row_function(rows, F.col("p"), lambda p: "no json", "summary string", F.struct(F.lit("none").alias("summary"))).first()
    assert bad["answer"]["summary"] == "none"
    assert value(spark, assembly.salvage_json(lit('```json\nok {"summary": "a\nb"} end```'), "summary string"))["summary"] == "a\nb"


def test_settings():
    s = assembly.Settings.load({"retrieval": {"max_files": "12", "unknown": 1}}, {"KELPIE_DEPTH": "3"})
    assert (s.max_files, s.depth, s.max_pages) == (12, 3, 4)


def test_rates_and_kinds(spark):
    assert value(spark, S.token_rate(lit("claude-haiku-4-5-2099")))["output"] == 0.004 and value(spark, S.token_rate(lit("x")))["input"] == 0.003
    assert value(spark, S.query_kind(lit("Which file has it"))) == "provenance" and value(spark, S.query_kind(lit("hello"))) == "quick_answer"
    assert value(spark, S.edge_tier(lit("working"), lit("odd"), lit("knows"))) == "working" and value(spark, X.vtt_stamp(lit(3661.5))) == "1:01:01"


@pytest.fixture
def stream_dir(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def test_inbox_reads_each_content_once(spark, stream_dir):
    (stream_dir / "in" / "a.md").write_text("same")
    (stream_dir / "in" / "b.md").write_text("same")
    (stream_dir / "in" / "c.md").write_text("other")
    for _ in range(2):
        jobs.run_once(jobs.unseen(jobs.inbox(spark, str(stream_dir / "in"))), None, str(stream_dir / "ck"), str(stream_dir / "out"))
    assert sorted(r["body"] for r in spark.read.parquet(str(stream_dir / "out")).collect()) == ["other", "same"]


def test_cost_windows(spark, stream_dir):
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, 10), "m", 1.0), (datetime.datetime(2024, 1, 1, 11), "m", 2.0), (datetime.datetime(2024, 1, 20), "m", 4.0)], "ts timestamp, model string, cost_usd double").write.parquet(str(stream_dir / "log"))
    s = spark.readStream.schema("ts timestamp, model string, cost_usd double").parquet(str(stream_dir / "log"))
    got = []
    jobs.run_once(jobs.daily_costs(s), lambda df, i: got.extend(df.collect()), str(stream_dir / "ck"), mode="update")
    assert {(str(r["day"])[:10], r["calls"], r["cost"]) for r in got} == {("2024-01-01", 2, 3.0), ("2024-01-20", 1, 4.0)}


def test_priming_stream(spark, stream_dir):
    now = datetime.datetime(2024, 1, 1)
    rows = [("s", 1, now, "a", 1.0), ("s", 2, now, "b", 0.4), ("t", 1, now, "a", 0.05)]
    spark.createDataFrame(rows, "session string, query int, ts timestamp, eid string, strength double").write.parquet(str(stream_dir / "in2"))
    s = spark.readStream.schema("session string, query int, ts timestamp, eid string, strength double").parquet(str(stream_dir / "in2"))
    got = []
    jobs.run_once(jobs.priming(s), lambda df, i: got.extend(df.collect()), str(stream_dir / "ck"), mode="update")
    assert {(r["session"], r["eid"]): round(r["strength"], 6) for r in got} == {("s", "a"): 0.35, ("s", "b"): 0.2}
    assert jobs.prime({"a": 0.06}, {}) == {}
