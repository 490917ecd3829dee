"""Readers of text stores: Markdown trees, JSON snapshots and logs, calendars, transcripts, mail."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.functions import text as X


def markdown_tree(spark, root, least=50):
    """memory_files of a folder of *.md: path, stem, body, size_bytes, mtime; bodies are read whole, columns pruned."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.where((F.col("length") >= least) & ~name.startswith(".") & ~name.endswith(".digest.md"))
    return f.select("path", F.regexp_replace(name, r"\.md$", "").alias("stem"), F.decode("content", "UTF-8").alias("body"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))


_NODE = "name string, type string, description string, tier string, salience string, confidence double, ris_accumulated double, activation_count int, last_activated string, priority_floor boolean, weight double, sources array<string>"
_EDGE = "struct<from:string,to:string,type:string,weight:double,base_strength:double,confidence:double,tier:string,salience:string,ris_accumulated:double,source_credibility:double,activation_count:int,last_activated:string,priority_floor:boolean,sources:array<string>>"


def _salience(column):
    """A plain number and a struct both become (base, computed)."""
    s = F.from_json(column, "base double, computed double")
    plain = F.expr("try_cast(salience AS double)")
    return F.coalesce(plain, s["base"], F.lit(0.5)), F.coalesce(plain, s["computed"], s["base"], F.lit(0.5))


def graph(spark, path):
    """(entities, edges) of a graph file; a missing weight stays null, an unreadable file gives empty tables."""
    schema = T.StructType([T.StructField("entities", T.MapType(T.StringType(), T._parse_datatype_string(_NODE))), T.StructField("edges", T.ArrayType(T._parse_datatype_string(_EDGE)))])
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    nodes = raw.select(F.explode("entities").alias("eid", "v")).select("eid", "v.*")
    base, computed = _salience(F.col("salience"))
    nodes = nodes.select("eid", "name", "type", "tier", base.alias("base"), computed.alias("computed"), F.coalesce("activation_count", F.lit(0)).alias("activation_count"), "last_activated", F.coalesce("priority_floor", F.lit(False)).alias("priority_floor"), F.coalesce("ris_accumulated", F.lit(0.0)).alias("ris"), "weight", "sources")
    e = raw.select(F.explode("edges").alias("e")).select("e.*")
    e = e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "type", "weight", "base_strength", "confidence", "tier", "activation_count", "last_activated", "priority_floor", "sources")
    return nodes, e


def records(spark, path, key, schema):
    """Rows of a JSON file that is a list, or an object whose `key` is one (contradictions, questions, proposals, registries)."""
    text = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json(F.get_json_object("value", f"$.{key}"), f"array<struct<{schema}>>"), F.from_json("value", f"array<struct<{schema}>>"))
    return text.select(F.explode(rows).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def json_lines(spark, path, schema):
    """A log of one JSON object a line; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def wiki_index(texts, text_col="body"):
    """(…, ord, page_ref, description) of index lines `- [[ref|alias]] - description`; only a hyphen starts a description."""
    rest = [c for c in texts.columns if c != text_col]
    lines = texts.select(*rest, F.posexplode(F.split(F.col(text_col), "\n")).alias("ord", "line"))
    entry = r"^\s*[-*]\s*\[\[([^\]|]+)(?:\|[^\]]*)?\]\](?:\s*-+\s*(.*?))?\s*$"
    r = lines.where(F.col("line").rlike(r"^\s*[-*]\s*\[\[[^\]]+\]\]"))
    ref = F.regexp_extract("line", r"\[\[([^\]|]+)", 1)
    return r.select(*rest, "ord", F.trim(ref).alias("page_ref"), F.coalesce(F.regexp_extract("line", entry, 2), F.lit("")).alias("description"))


def session_turns(texts, text_col="body"):
    """(…, turn, ts, user, assistant) of a transcript with `## time` heads and User and Assistant blocks."""
    rest = [c for c in texts.columns if c != text_col]
    parts = F.filter(F.split(F.col(text_col), r"(?m)^(?=## )"), lambda p: p.startswith("## "))
    r = texts.select(*rest, F.posexplode(parts).alias("turn", "part"))
    grab = lambda who: F.regexp_replace(F.regexp_extract("part", rf"(?s)\*\*{who}:\*\*\s*(.*?)(?=\*\*(?:User|Assistant):\*\*|\z)", 1), r"\s+$", "")
    r = r.select(*rest, "turn", F.trim(F.regexp_extract("part", r"^## ([^\n]*)", 1)).alias("ts"), grab("User").alias("user"), grab("Assistant").alias("assistant"))
    return r.where(F.col("user") != "")


def calendar(texts, text_col="body"):
    """(…, n, start, end, all_day, summary, location, status, attendees) of VEVENT blocks; lines unfolded, escapes undone.

    Times ending in Z and plain ones are read as UTC; a missing end is one hour, or one day for dates.
    """
    rest = [c for c in texts.columns if c != text_col]
    flat = F.regexp_replace(F.col(text_col), r"\r?\n[ \t]", "")
    events = F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1))
    r = texts.select(*rest, F.posexplode(events).alias("n", "e"))

    def prop(name):
        found = F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:([^\r\n]*)", 1)
        return F.when(found != "", F.replace(F.replace(F.replace(found, F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")), F.lit("\\n"), F.lit("\n")))

    when = lambda p: F.coalesce(F.try_to_timestamp(F.regexp_replace(p, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(p, F.lit("yyyyMMdd")))
    r = r.withColumn("_s", prop("DTSTART")).withColumn("start", when(F.col("_s"))).withColumn("all_day", ~F.col("_s").contains("T"))
    default = F.when(F.col("all_day"), F.expr("start + INTERVAL 1 DAY")).otherwise(F.expr("start + INTERVAL 1 HOUR"))
    people = F.regexp_extract_all("e", F.lit(r"(?m)^ATTENDEE([^\r\n]*)"), F.lit(1))
    name = lambda a: F.when(F.regexp_extract(a, r'CN="?([^";:]+)', 1) != "", F.regexp_extract(a, r'CN="?([^";:]+)', 1)).otherwise(F.regexp_extract(a, r"(?i)mailto:(\S+)", 1))
    return r.where(F.col("start").isNotNull()).select(*rest, "n", "start", F.coalesce(when(prop("DTEND")), default).alias("end"), "all_day", F.coalesce(prop("SUMMARY"), F.lit("")).alias("summary"), prop("LOCATION").alias("location"), F.coalesce(prop("STATUS"), F.lit("")).alias("status"), F.transform(people, name).alias("attendees"))


def transcript(texts, text_col="body"):
    """(file, n, start, end, speaker, text) of WebVTT cues; the speaker is a <v> tag, else up to four words before a colon."""
    body = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r", ""), r"(?s)^﻿?WEBVTT.*?\n\n", "")
    blocks = F.filter(F.split(body, r"\n\s*\n"), lambda b: b.contains("-->") & ~b.startswith("NOTE"))
    r = texts.select("file", F.posexplode(blocks).alias("n", "b"))
    stamp = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})"
    side = lambda i: X.vtt_seconds(F.regexp_extract("b", rf"{stamp}\s*-->\s*{stamp}", i))
    said = F.trim(F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s*\n\s*", " "))
    tag, colon = F.regexp_extract(said, r"^<v(?:\.[^ >]*)?\s+([^>]+)>", 1), F.regexp_extract(said, r"^((?:[^\s:]+\s+){0,3}[^\s:]+):\s", 1)
    plain = F.when(tag != "", F.regexp_replace(said, r"</?v[^>]*>", "")).when(colon != "", F.regexp_replace(said, r"^[^:]+:\s+", "")).otherwise(said)
    return r.select("file", "n", side(1).alias("start"), side(2).alias("end"), F.when(tag != "", tag).when(colon != "", colon).otherwise("").alias("speaker"), F.trim(plain).alias("text"))


def mail(files, content_col="content"):
    """(…, sender, to, subject, date, body) of MIME messages: text/plain over text/html, attachments skipped.

    MIME decoding has no JVM form; messages are decoded in Arrow batches with the standard library.
    """
    @F.pandas_udf("sender string, to string, subject string, date string, body string")
    def decode(content: pd.Series) -> pd.DataFrame:
        from email import message_from_bytes, policy

        rows = []
        for raw in content:
            m = message_from_bytes(bytes(raw or b""), policy=policy.default)
            part = m.get_body(preferencelist=("plain", "html"))
            try:
                body = part.get_content() if part is not None else ""
            except (LookupError, ValueError):
                body = ""
            received = str(m.get("Received") or "").rpartition(";")[2].strip()
            rows.append((str(m.get("From") or ""), str(m.get("To") or ""), str(m.get("Subject") or ""), str(m.get("Date") or received), body))
        return pd.DataFrame(rows, columns=["sender", "to", "subject", "date", "body"])

    rest = [c for c in files.columns if c != content_col]
    return files.select(*rest, decode(F.col(content_col)).alias("m")).select(*rest, "m.*")


def office(files, content_col="content", path_col="path"):
    """(…, text) of office and PDF files; where the optional library is missing the text is empty."""
    @F.pandas_udf("string")
    def extract(path: pd.Series, content: pd.Series) -> pd.Series:
        import io

        out = []
        for p, raw in zip(path, content):
            text = ""
            try:
                if p.endswith(".docx"):
                    import docx

                    text = "\n".join(x.text for x in docx.Document(io.BytesIO(raw)).paragraphs)
                elif p.endswith(".xlsx"):
                    import openpyxl

                    book = openpyxl.load_workbook(io.BytesIO(raw), read_only=True, data_only=True)
                    text = "\n".join("\t".join("" if c is None else str(c) for c in row) for sheet in book for row in sheet.iter_rows(max_row=500, values_only=True))
                elif p.endswith(".pptx"):
                    import pptx

                    text = "\n".join(s.text_frame.text for slide in pptx.Presentation(io.BytesIO(raw)).slides for s in slide.shapes if s.has_text_frame)
                elif p.endswith(".pdf"):
                    import pypdf

                    text = "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages)
            except ImportError:
                text = ""
            out.append(text)
        return pd.Series(out)

    return files.withColumn("text", extract(F.col(path_col), F.col(content_col))).drop(content_col)


def latest(files, suffix):
    """The path of the newest file with a suffix that isn't in a processed folder, as one row."""
    f = files.where(F.col("path").endswith(suffix) & ~F.col("path").contains("/_processed/"))
    return f.agg(F.max_by("path", F.struct("mtime", "path")).alias("path")).where(F.col("path").isNotNull())


def people_names(texts, text_col="body"):
    """Distinct names that a people page lists as `## Name` heads or bold starts."""
    grab = lambda p: F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(1))
    return texts.select(F.explode(F.concat(grab(r"(?m)^##\s+([A-Z][a-z]+)"), grab(r"\*\*([A-Z][a-z]+)"))).alias("name")).distinct()
