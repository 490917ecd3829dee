"""What is dear is worked out once a text, and gives what plain Python gives."""

import html
import re

import duckdb
from pyspark.sql import functions as F

from kelpie.functions import text as X
from kelpie.operators import ingest, search
from kelpie.plans import queries as Q
from kelpie.plans.tables import AS_OF

PAGES = [
    "<!-- a --><p>x &amp y&ampz &copy 1 &lt;b&gt; &amp;lt; &#39;q&#39;</p>  end \n\n\n\nlast\t\t \n", "cut&&&amp", "", "plain", "a​b c \t d \r\ne  \n", None,
    "@media x{a:b}\n.rule {c}\nq { no", "<style>p{}</style><script>1</script>&nbsp;t<svg>s</svg>", "a {b\n@import {x} c", "<open",
]
MAIL = "**From:** user1@mail1.example.com\n----## Hi\n"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stripped(text):
    for pattern, to in X.HTML_STEPS:
        text = re.sub(pattern, to, text)
    text = html.unescape(text)
    for pattern, to in X._SPACES:
        text = re.sub(pattern, to, text)
    return text.strip(X.WHITE)


def test_html_strip_agrees_with_sql_on_entities_without_semicolon(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(Q.ORACLE["html_strip"]).fetchall())
    got = sorted(tuple(r) for r in Q.html_strip(spark, str(tmp_path)).collect())
    # the SQL spells out names with their semicolon; &copy and &amp without stay as they are
    assert got == want and "&copy 1" in dict(got)[0] and dict(got)[1] == "cut&&&amp"


def test_cleaning_is_once_a_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(PAGES)], "id int, raw string")
    got = {r["id"]: r["t"] for r in rows.select("id", X.strip_html(F.col("raw")).alias("t")).collect()}
    assert got == {i: None if t is None else stripped(t) for i, t in enumerate(PAGES)}
    assert plan(ingest.clean_summary(ingest.clean_emails(rows))).count("<!--.*?-->") == 1


def test_replies_and_promotions(spark):
    long = "x" * 250
    raw = [MAIL + long + "\nOn Mon, Jan 5, 2024 at 1 Ann wrote:\nold", MAIL + long + "\nFrom: a\nSent: b\nold", MAIL + long + " wrote: nothing", MAIL + "unsubscribe order now " + long * 7, MAIL.replace("mail1", "klm.com") + "x", "wrote:", None]
    rows = ingest.clean_emails(spark.createDataFrame(list(enumerate(raw)), "id int, raw string")).orderBy("id").collect()
    assert ["truncated" in (r["cleaned"] or "") for r in rows] == [True, True, False, False, False, False, False]
    assert [r["reason"] for r in rows] == ["", "", "", "marketing-cta-pattern", "marketing-domain:mail1.example.com".replace("mail1", "klm.com"), "", ""]


def test_questions_are_found_once_and_all(spark):
    texts = ["Is this open? Yes it is so.  It is unclear to us!\nTBD is what it is.", "We don't know. We need to  check. It needs to be decided now. Was it resolved? It isn't yet answered?", "A? É pending thing that nobody knows? x", " need to check it all ", None, "..? \t\n ? what is this all about?\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = ingest.open_questions(rows, "doc_id", "text")
    want = set()
    for i, t in enumerate(texts):
        for n, s in enumerate(re.split(r"(?<=[.!?])\s+", t) if t else []):
            s = s.strip(X.WHITE)
            if 15 <= len(s) <= 400 and re.search(X.OPEN_QUESTION, s.lower()) and not re.search(X.CLOSED, s.lower()):
                want.add((i, n, s))
    assert {tuple(r) for r in found.collect()} == want and len(want) == 5
    linked = ingest.link_questions(found, spark.createDataFrame([("e1", "this", "t", "working")], "eid string, name string, type string, tier string"))
    assert "split(" not in plan(linked)  # what takes texts apart isn't done again by each join


def test_search_takes_words_from_a_text_once(spark):
    bodies = ["Apaches and apache apaché sourcing", "\U00010400pache license", "xapache unlicensed", "APACHE_x licensed-apache", "eeee see", "none of these"]
    files = spark.createDataFrame([(f"MEMORY/a/f{i}.md", f"f{i}", b + " " * 60, 80) for i, b in enumerate(bodies)], "path string, stem string, body string, size_bytes long").withColumn("mtime", F.lit("2024-01-30").cast("timestamp"))
    asked = spark.createDataFrame([(1, "Apache license sources"), (2, "eeee")], "query_id int, query string")
    scored = search.keyword_score(files, asked, AS_OF)
    assert plan(scored).count("regexp_extract_all(hay") == 1
    tokens = {i: {w for w in re.split(r"[^\w]+", b.lower()) if w} for i, b in enumerate(bodies)}
    hits = {(r["query_id"], r["path"][-4]) for r in scored.where("overlap > 0").collect()}
    assert hits == {(1, str(i)) for i, w in tokens.items() if w & {"apache", "license", "sources"}} | {(2, "4")}
    assert {r["path"][-4] for r in scored.where("stem_hits > 0").collect()} == {"0", "3"}
