"""Parts that SQL doesn't reach: entities, links, names close to others, replies of a completer, meetings in the graph."""

import datetime
import difflib
import html
import html.entities
import itertools

import pytest
from pyspark.sql import functions as F

from kelpie.functions import text as X
from kelpie.operators import export, graph, ingest, memory, naming, search, signals
from kelpie.operators.cut import in_slices, spread
from kelpie.plans import assembly


def test_unescape_matches_the_standard(spark):
    rows = ["&eacute;&#233;&#xE9; &amp;lt; &amp;amp; &unknown; &hellip;&nbsp;&quot;x&quot; &#39; &lt;b&gt;", "&#x1F642; &#0; &#55296; &notin;", "no entity & none", None, "", "&", "&&amp;&", "&;&#;&#x;&#xg;"]
    rows += ["&#38;lt; &AMP;lt; &copy 2024 AT&T &amp &notit; &notin &ampx; &ltt &copyx", "&#150; &#x80; &#129; &#0128 x", "&#99999999999999999999; &#x110000; &#xFFFE; &#1; &#13;&#x0D &#x7f;", "a&" + "x" * 40 + ";&lt;", "&#00000000065;&#x00000000041;"]
    rows += ["".join(f"[&{k}]" for k in part) for part in itertools.batched(sorted(html.entities.html5), 300)]
    rows += [" ".join(f"&#{n};&#x{n:X}" for n in part) for part in itertools.batched([*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000], 100)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(X.unescape(F.col("t"))).collect()]
    for g, x in zip(got, rows):
        assert g == (None if x is None else html.unescape(x))


def test_truths_of_many_values_purge_nothing(spark):
    edges = spark.createDataFrame([("a", "b", "knows"), ("a", "b", "reports_to"), ("a", "c", "reports_to"), ("d", "b", "based_in")], "src string, dst string, type string")
    entities = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "eid string, name string")
    none = spark.createDataFrame([("D", "based_in", "B")], "subject string, relation string, object string")
    truths = spark.createDataFrame([("A", "knows", "Z", 1), ("A", "reports_to", "C", 1), ("a", "reports_to", "B", 2)], "subject string, relation string, object string, at int")
    left = sorted(map(tuple, memory.purge_rejected(edges, entities, none, truths).collect()))
    assert left == [("a", "b", "knows"), ("a", "b", "reports_to")]  # the last truth counts
    assert ("a", "c", "reports_to") in set(map(tuple, memory.purge_rejected(edges, entities, none, truths.drop("at")).collect()))


def test_what_is_never_compressed(spark):
    import datetime

    old, size = datetime.datetime(2023, 6, 1), 5000
    rows = [(f"MEMORY/{d}/x.md", "text", size, old) for d in ("weekly", "crystallised", "working", "context")]
    rows += [("MEMORY/weekly/done.md", "y" * 500 + "[Compressed 2023]" + "z" * 100, size, old), ("MEMORY/weekly/was.md", "[Compressed 2023]" + "z" * 400, size, old), ("MEMORY/context.md", "t", size, old), ("MEMORY/weekly/a.txt", "t", size, old)]
    files = spark.createDataFrame(rows, "path string, body string, size_bytes long, mtime timestamp")
    assert sorted(r["path"] for r in memory.select_for_compression(files, "2024-01-31 00:00:00").collect()) == ["MEMORY/context.md", "MEMORY/weekly/was.md", "MEMORY/weekly/x.md"]


def test_links_in_every_form(spark):
    body = "![[embed]] [[a b#part|x]] [[note [1] of]] [[t\\|alias]]\n[m](c%20d.md#top) ![i](x.png) [e](mailto:x@y) [f](../top.md) [g](javascript:x)"
    pages = spark.createDataFrame([("w/p.md", body), ("w/a b.md", ""), ("w/c d.md", ""), ("top.md", ""), ("w/note [1] of.md", ""), ("w/t.md", ""), ("x/t.md", "")], "path string, body string")
    links = ingest.extract_links(pages)
    got = {(r["kind"], r["target"]): (r["resolved"], r["external"]) for r in ingest.resolve_links(links, pages).collect()}
    assert got == {
        ("wikilink", "a b"): ("w/a b.md", False), ("wikilink", "note [1] of"): ("w/note [1] of.md", False), ("wikilink", "t"): ("w/t.md", False), ("markdown", "c%20d.md"): ("w/c d.md", False),
        ("markdown", "mailto:x@y"): (None, True), ("markdown", "../top.md"): ("top.md", False), ("markdown", "javascript:x"): (None, False),
    }


def test_suggestions_and_mentions(spark):
    pages = spark.createDataFrame([("w/a.md", "[[Big: Plan?]] [[gone]]"), ("w/big plan.md", ""), ("w/index.md", "")], "path string, body string")
    got = {r["target"]: (r["resolved"], r["suggestion"]) for r in ingest.resolve_links(ingest.extract_links(pages), pages).collect()}
    assert got == {"Big: Plan?": (None, "w/big plan.md"), "gone": (None, None)}
    raw = spark.createDataFrame([("see big plan.md and xa",), ("bigplan ab",), (None,)], "text string")
    assert {r["path"] for r in ingest.raw_mentions(pages, raw).collect()} == {"w/big plan.md"}


def test_expired_names_that_are_taken(spark):
    rows = [("MEMORY/working/a/n.md", 10), ("MEMORY/working/b/n.md", 10), ("MEMORY/working/m.md", 10), ("MEMORY/episodic/m.md", 1), ("MEMORY/working/new.md", 1), ("MEMORY/daily/x.md", 10)]
    files = spark.createDataFrame(rows, "path string, days int").withColumn("mtime", F.lit("2024-01-31").cast("timestamp_ntz") - F.make_dt_interval("days"))
    got = {r["path"]: r["new_path"] for r in memory.expire_working(files, "2024-01-31 00:00:00").collect()}
    at = 1705795200  # 2024-01-21
    assert got == {"MEMORY/working/a/n.md": "MEMORY/episodic/n.md", "MEMORY/working/b/n.md": f"MEMORY/episodic/n_{at}.md", "MEMORY/working/m.md": f"MEMORY/episodic/m_{at}.md"}


def test_fuzzy_page_names(spark):
    index = spark.createDataFrame([("p/Waymo_deal.md", "Waymo_deal", "x"), ("p/other.md", "other", "y")], "page string, name string, description string")
    q = spark.createDataFrame([(1, "about Waymoo and Waymi")], "query_id int, query string")
    assert search.wiki_scan(index, q).count() == 0
    (r,) = search.wiki_scan(index, q, fuzzy=True).collect()
    close = [w for w in ("waymoo", "waymi") if difflib.get_close_matches(w, ["waymo", "deal"], n=1, cutoff=0.82)]
    # close ones count less; proper nouns of five characters or more only
    assert (r["page"], round(r["score"], 6)) == ("p/Waymo_deal.md", round(2.4 * len(close), 6)) if close else r is None


def test_name_seeds_and_limits(spark):
    e = spark.createDataFrame([("a", "Ann Lee"), ("b", "Lee Lee"), ("c", "Big Co")], "eid string, name string")
    q = spark.createDataFrame([(1, ["ann", "lee"]), (2, ["lee", "x", "y", "z"]), (3, [])], "query_id int, q array<string>")
    assert {tuple(r) for r in graph.name_seeds(e, q).collect()} == {(1, "a"), (1, "b")}
    asked = spark.range(25).withColumnRenamed("id", "query_id")
    parts = []
    found = in_slices(asked, lambda q: parts.append(q) or q, most=10)
    assert len(parts) == 3 and sorted(r[0] for r in found.collect()) == list(range(25))
    assert spread(spark.range(10)).count() == 10


def test_replies_are_read_twice(spark):
    rows = ['x ```json\n{"a": 1, "t": "one"}\n```', '{"a": 2, "t": "two\nlines\tand tab"}', "none", None, '{\n "a": 3,\n "t": "x"\n}']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(assembly.salvage_json(F.col("t"), "a int, t string")).collect()]
    assert [g and (g["a"], g["t"]) for g in got] == [(1, "one"), (2, "two\nlines\tand tab"), None, None, (3, "x")]


def test_meetings_replace_old_ones(spark):
    e = spark.createDataFrame([("m:old", "Old", "meeting"), ("p:1", "Ann Lee", "person"), ("c:1", "Big Co", "company"), ("p:2", "Lee", "person")], "eid string, name string, type string")
    edges = spark.createDataFrame([("m:old", "p:1", "attended_by", 0.6), ("p:1", "c:1", "works_at", 0.5)], "src string, dst string, type string, weight double")
    rows = [(1, "Weekly Sync", "2024-01-03", "external", "high", False, True, True, ["ann_lee", "lee", "who"], ["Big Co"]), (2, "Lunch", "2024-01-02", "personal", "high", False, True, False, [], []), (3, "Gone", "2024-01-02", "x", None, True, True, False, [], [])]
    events = spark.createDataFrame(rows, "event_id int, summary string, iso string, kind string, urgency string, is_cancelled boolean, is_high_stakes boolean, is_recurring boolean, people_links array<string>, account_links array<string>")
    nodes, links = signals.write_meetings(e, edges, signals.calendar_order(events))
    assert {r["eid"] for r in nodes.collect()} == {"p:1", "p:2", "c:1", "meeting:weekly_sync"}
    m = "meeting:weekly_sync"
    want = {("p:1", "c:1", "works_at", 0.5), (m, "c:1", "about_account", 0.7), ("c:1", m, "discussed_in", 0.7), (m, "p:1", "attended_by", 0.6), ("p:1", m, "attends", 0.6)}
    assert {tuple(r) for r in links.select("src", "dst", "type", "weight").collect()} == want


def test_priors(spark):
    primed = spark.createDataFrame([("s", f"e{i}", i / 10) for i in range(8)], "session string, eid string, strength double")
    names = spark.createDataFrame([(f"e{i}", f"N{i}") for i in range(1, 8)], "eid string, name string")
    q = spark.createDataFrame([("open", "why?", 0.9), ("closed", "no", 1.0), (None, "how?", None)], "status string, text string, salience double")
    (r,) = assembly.priors(primed, names, q).collect()
    assert r["focus"] == "Recent session focus: N7, N6, N5, N4, N3, N2" and r["open"] == "Unresolved open questions:\n  • why?\n  • how?"


def test_sections_and_html(spark):
    text = "# Top **x**\n\nfirst line\nsecond **bold**\n## Part\n- one **b**\n\u2022 two\n### Sub\n**Bold head:**\ntext <&>\n"
    (r,) = spark.createDataFrame([(text, "doc")], "t string, h string").select(export.sections("t", "h").alias("s")).select("s", export.html(F.col("s")).alias("html")).collect()
    got = [(x["title"], x["subtitle"], x["bullets"], x["is_title"]) for x in r["s"]]
    assert got == [("Top **x**", "first line", ["second bold"], True), ("Part", "", ["one b", "two", "  Sub"], False), ("Bold head", "", ["text <&>"], False)]
    assert "<h1>Top **x**</h1><p>first line</p>" in r["html"] and "<li>text &lt;&amp;&gt;</li>" in r["html"]
    rows = spark.createDataFrame([("### a\nb", "doc"), ("plain", "doc"), ("", ""), (None, None)], "t string, h string").select(export.sections("t", "h").alias("s")).collect()
    assert [(r["s"][0]["title"], r["s"][0]["bullets"]) for r in rows] == [("Summary", ["  a", "b"]), ("doc", ["plain"]), ("Summary", []), ("Summary", [])]


def test_resolutions_are_recorded_once(spark):
    old_no = spark.createDataFrame([("Ann", "reports_to", "Bob")], "subject string, relation string, object string")
    old_yes = spark.createDataFrame([("Ann", "reports_to", "Cy")], "subject string, relation string, object string")
    rows = [(1, "resolved_A", "ann", "reports_to", "Dan", "bob"), (2, "resolved_B", "Eve", "reports_to", "X", "Y"), (3, "both_false", "Eve", "knows", "P", "Q"), (4, "dismissed", "Z", "knows", "P", "Q"), (5, "resolved_A", "Fay", "knows", "P", "Q")]
    no, yes = memory.record_resolutions(spark.createDataFrame(rows, "id int, status string, subject string, relation string, object_a string, object_b string"), old_no, old_yes)
    assert {tuple(r) for r in no.collect()} == {("Ann", "reports_to", "Bob"), ("Eve", "reports_to", "X"), ("Eve", "knows", "P"), ("Eve", "knows", "Q"), ("Fay", "knows", "Q")}
    assert {tuple(r) for r in yes.collect()} == {("Ann", "reports_to", "Cy"), ("Eve", "reports_to", "Y")}


def test_rename_plan(spark):
    import hashlib

    d = "MEMORY/daily/emails/"
    files = spark.createDataFrame([(d + "a.md",), (d + "b.md",), (d + "email_x__topics_y.md",), (d + "taken.md",), ("MEMORY/z.md",), (d + "c.md",)], "path string")
    names = spark.createDataFrame([(d + "a.md", "n"), (d + "b.md", "n"), (d + "c.md", "taken"), (d + "email_x__topics_y.md", "q"), ("MEMORY/z.md", "z"), (d + "taken.md", "")], "path string, name string")
    mark = lambda x: hashlib.md5(x.encode()).hexdigest()[:6]
    assert {tuple(r) for r in naming.rename_plan(files, names).collect()} == {(d + "a.md", d + "n.md"), (d + "b.md", f"{d}n__{mark('b.md')}.md"), (d + "c.md", f"{d}taken__{mark('c.md')}.md")}


def test_next_due():
    now = datetime.datetime(2024, 1, 5, 3, 30)
    at = lambda d, h, m=0: datetime.datetime(2024, 1, d, h, m)
    assert assembly.next_due(now, "02:00") == now and assembly.next_due(now, "02:00", "2024-01-05") == at(6, 2)
    assert assembly.next_due(now, "04:15") == at(5, 4, 15) and assembly.next_due(now, "what", "2024-01-05") == at(6, 2)
