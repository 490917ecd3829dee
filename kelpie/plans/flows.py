"""Ingest as one flow: from files of an inbox, or transcripts, to named Markdown."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import scoring as S
from kelpie.functions import text as T
from kelpie.operators import ingest, naming, ordered, people
from kelpie.operators.cut import cut
from kelpie.sources import readers, sinks

#: Kinds of files whose text was taken out of them, and such as may be cleaned.
EXTRACTED = [".pdf", ".docx", ".pptx", ".xlsx", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".gif", ".bmp", ".webp"]
MARKUP = [".eml", ".html", ".htm", ".md"]
_SUFFIX = r"(?i)\.(eml|html?|txt|pdf|docx|pptx|xlsx|png|jpe?g|tiff?|gif|bmp|webp)$"


def ingest_files(files, seen, there, user_name="", user_email="", folder="MEMORY/daily/emails/"):
    """(name, action, reason, path, markdown, refresh_deadlines, refresh_tone) of every file (name, content, mtime) of an inbox.

    action: placeholder (under 200 characters), promotion (reason says why), duplicate (nothing of it is new), or written.
    Mail is cleaned and cut into blocks; blocks whose fingerprint was seen (fp) or stands earlier in this batch, by time and
    name, go. path: a descriptive name for mail and chat digests, else the file's own, made safe; a path that is there
    (path) or that an earlier file takes gets six digits of a hash. Own mail asks for a refresh of the tone as well.
    """
    content, low = F.col("content"), F.lower("name")
    ext = F.regexp_extract(low, r"(\.[^.]*)$", 1)
    small = F.char_length(T.strip(content)) < 200
    mail = (ext.isin(*MARKUP) & F.contains(F.lower(F.substring(content, 1, 8000)), F.lit("<html"))) | (ext == ".eml") | F.contains(F.substring(content, 1, 2000), F.lit("From:"))
    rows = files.select("name", "content", "mtime", small.alias("_small"), mail.alias("_mail"), ext.isin(*EXTRACTED).alias("_taken"))
    rows = ingest.clean_emails(rows.withColumn("raw", content)).drop("raw", "dropped")
    cleaned = F.col("_mail") & (F.char_length("cleaned") > 50)
    rows = sinks.email_markdown(rows).withColumn("_changed", cleaned | F.col("_taken"))
    rows = rows.withColumn("body", F.when(cleaned, F.col("markdown")).otherwise(content)).drop("markdown")
    rows = rows.withColumn("action", F.when(F.col("_small"), "placeholder").when(F.col("_mail") & (F.col("reason") != ""), "promotion"))
    rows = cut(rows.drop("content", "cleaned", "sender", "subject"))  # read for blocks, names and the result
    blocks = ingest.split_blocks(rows.where(F.col("action").isNull() & F.col("_changed")).select("name", "mtime", "body"), "body")
    kept = ingest.new_blocks(blocks, seen, "block", ("mtime", "name", "block_no"))
    left = kept.groupBy("name").agg(F.count("*").alias("_kept"), F.count_if(F.col("fp") != "").alias("_new"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda x: x["block"]), "\n\n").alias("_left"))
    every = blocks.groupBy("name").agg(F.count("*").alias("_all")).join(left, "name", "left").fillna(0, ["_kept", "_new"])
    rows = rows.join(every, "name", "left")
    twice = F.coalesce(F.col("_kept") < F.col("_all"), F.lit(False))
    rows = rows.withColumn("action", F.coalesce("action", F.when(twice & (F.col("_new") == 0), "duplicate").otherwise("written")))
    rows = rows.withColumn("body", F.when(twice, F.coalesce("_left", F.lit(""))).otherwise(F.col("body")))
    rows = cut(rows.drop("_left", "_kept", "_new", "_all"))
    written = rows.where("action = 'written'")
    return _named(written, there, user_name, user_email, folder).unionByName(
        rows.where("action <> 'written'").select("name", "action", F.when(F.col("action") == "promotion", F.col("reason")).alias("reason"), *(F.lit(None).cast("string").alias(c) for c in ("path", "markdown")), F.lit(False).alias("refresh_deadlines"), F.lit(False).alias("refresh_tone"))
    )


def _named(rows, there, user_name, user_email, folder):
    shape, day = S.document_shape(F.col("name"), F.substring("body", 1, 3000)), F.date_format("mtime", "yyyy-MM-dd")
    parts = rows.select(F.col("name").alias("file"), F.col("body").alias("raw"), "mtime", day.alias("day"))
    own = tuple(user_name.split())
    mails = naming.mail_name(naming.mail_parts(parts, user=own), F.col("day")).select("file", F.col("name").alias("_mail_name"))
    chats = naming.chat_name(naming.chat_parts(parts, exclude=own), F.col("day")).select("file", F.col("name").alias("_chat_name"))
    r = rows.withColumn("_shape", shape).withColumn("file", F.col("name")).join(mails, "file").join(chats, "file")
    safe = F.substring(F.regexp_replace("name", r"[^\p{L}\p{N}_.\-]", "_"), 1, 120)
    plain = F.regexp_replace(safe, _SUFFIX, ".md")
    plain = F.when(F.col("_changed"), F.when(F.endswith(plain, F.lit(".md")), plain).otherwise(F.concat(plain, F.lit(".md")))).otherwise(safe)
    spoken = F.when(F.col("_shape") == "email", F.col("_mail_name")).when(F.col("_shape") == "slack", F.col("_chat_name"))
    r = r.withColumn("_path", F.concat(F.lit(folder), F.coalesce(F.concat(F.substring(spoken, 1, 200), F.lit(".md")), plain)))
    order = F.row_number().over(Window.partitionBy("_path").orderBy("mtime", "name"))
    taken = there.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    r = r.withColumn("_n", order).join(taken, "_path", "left")
    marked = F.concat(F.regexp_replace("_path", r"\.[^./]*$", ""), F.lit("__"), F.substring(F.md5("name"), 1, 6), F.regexp_extract("_path", r"(\.[^./]*)$", 1))
    r = r.withColumn("path", F.when((F.col("_n") > 1) | F.coalesce("_there", F.lit(False)), marked).otherwise(F.col("_path")))
    return r.select("name", "action", F.lit(None).cast("string").alias("reason"), "path", F.col("body").alias("markdown"), F.lit(True).alias("refresh_deadlines"), people.from_user(F.col("body"), user_name, user_email).alias("refresh_tone"))


def transcripts(texts, text_col="body"):
    """(file, title, speakers, duration, markdown) of WebVTT texts: cues of a speaker merged, and a head that says who spoke and how long."""
    cues = readers.transcript(texts, text_col)
    body = sinks.transcript_markdown(ordered.merge_cues(cues))
    title = F.regexp_replace(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.vtt$", ""), "[_-]+", " ")
    r = body.join(ordered.speakers(cues), "file").withColumn("title", title)
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n**Speakers:** "), F.array_join("speakers", ", "), F.lit("\n**Duration:** "), T.vtt_stamp(F.col("duration")), F.lit("\n\n"))
    return r.select("file", "title", "speakers", "duration", F.concat(head, F.col("markdown")).alias("markdown"))
