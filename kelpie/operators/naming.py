"""Topics and participants of mails and chat digests, and the file names that carry them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import text as T

#: Forms of topics, in the order in which they count.
BOLD_HEAD = r"\*\*([A-Z][A-Za-z0-9 &/'\-]{2,40})\*\*\s*[:.]"
PAREN_LIST = r"\(([A-Z][\p{L}\p{N}_\s,&/'\-]{4,80})\)"
PROPER_NOUN = r"\b([A-Z][a-zA-Z0-9]{2,20}(?:\s+[A-Z][a-zA-Z0-9]{2,20}){0,2})\b"
#: Forms of chat digests.
CHAT_HEAD = r"(?m)^###\s+(.+?)$"
BOLD_NAME = r"\*\*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\*\*"
#: Capitalised words that are no topic.
TOPIC_STOP = (
    "Hi Hello Thanks Thank Dear Regards Best Kind Re Fwd Fw Subject From To Cc Bcc "
    "May June July August September October November December January February March April "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday AM PM CEST CET PST EST UTC "
    "Status Update Updates Review Meeting Call Recording Microsoft Teams Outlook Office SharePoint OneDrive "
    "Link Document Pptx Docx Pdf Privacy Statement Notification Confidential"
).split()


def _all(text, pattern):
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _first_word(x):
    return F.regexp_extract(x, r"^(\S+)", 1)


def _by_count(column, most):
    """The most frequent values of an array column, at most `most`, as (less, place, value): by count, then by first appearance."""
    ranked = F.transform(F.array_distinct(column), lambda x: F.struct((-F.size(F.filter(column, lambda y: y == x))).alias("less"), F.array_position(F.col(column), x).alias("place"), x.alias("value")))
    return F.slice(F.array_sort(ranked), 1, most)


def with_topics(rows, text, exclude, user=(), most=5, first=12_000):
    """rows with topics, up to `most`: bold heads, capitalised members of lists in brackets, proper nouns named twice or more.

    text: a column name; exclude: the name of an array of words in lower case that are known already; user: parts of the
    user's name. Topics differ but for case, are 40 characters at most and don't begin with a word that is no topic.
    Arrays that are looked through more than once are columns of their own, so that no pattern runs twice.
    """
    stop, known = F.array(*(F.lit(w) for w in TOPIC_STOP)), F.col(exclude)
    heads = F.transform(_all(F.col(text), BOLD_HEAD), T.strip)
    members = F.flatten(F.transform(_all(F.col(text), PAREN_LIST), lambda x: F.filter(F.transform(F.split(x, ","), T.strip), lambda p: p.rlike(r"^\p{Lu}"))))
    nouns = F.filter(F.transform(_all(F.substring(text, 1, first), PROPER_NOUN), T.strip), lambda x: ~F.array_contains(stop, _first_word(x)) & ~F.array_contains(known, F.lower(_first_word(x))))
    r = rows.withColumn("_nouns", nouns).withColumn("_often", F.transform(F.filter(_by_count("_nouns", 20), lambda x: x["less"] <= -2), lambda x: x["value"]))
    every = F.transform(F.concat(heads, members, F.col("_often")), lambda c: T.strip(F.regexp_replace(c, r"\s+", " ")))
    own = F.array(*(F.lit(p.lower()) for p in user)) if user else F.array().cast("array<string>")
    r = r.withColumn("_good", F.filter(every, lambda c: (c != "") & ~F.array_contains(known, F.lower(c)) & ~F.array_contains(stop, _first_word(c)) & ~F.arrays_overlap(own, F.split(F.lower(c), " ")) & (F.char_length(c) <= 40)))
    r = r.withColumn("_low", F.transform("_good", F.lower))
    return r.withColumn("topics", F.slice(F.filter("_good", lambda c, i: F.array_position(F.col("_low"), F.lower(c)) == i + 1), 1, most)).drop("_nouns", "_often", "_good", "_low")


def mail_parts(mails, column="raw", user=()):
    """mails with subject, sender (a name from the address) and topics, which leave out the words of both."""
    raw = F.col(column)
    plain = T.strip(F.regexp_extract(raw, r"(?m)^\*\*Subject:\*\*\s*(.+?)$", 1))
    r = mails.withColumn("subject", F.when(plain != "", plain).otherwise(T.strip(F.regexp_extract(raw, r"(?m)^-+##\s*(.+?)$", 1))))
    address = T.strip(F.regexp_extract(raw, r"(?m)^\*\*From:\*\*\s*(.+?)$", 1))
    local = F.regexp_extract(address, r"([\p{L}\p{N}_.\-]+)@", 1)
    local = F.when(local != "", local).otherwise(address)
    r = r.withColumn("sender", T.word_slug(F.translate(local, ".-", "  "), 40))
    r = r.withColumn("_known", F.concat(F.regexp_extract_all(F.lower("subject"), F.lit("([a-z]+)"), F.lit(1)), F.split(F.lower("sender"), "_")))
    return with_topics(r, column, "_known", user).drop("_known")


def mail_name(parts, date):
    """email_<date>__<subject>[__topics_<a>_<b>]__from_<sender>; date: an ISO date column."""
    subject = F.when(F.col("subject") != "", T.word_slug(F.col("subject"), 60)).otherwise("no_subject")
    slugs = F.filter(F.transform("topics", lambda t: T.word_slug(t, 20)), lambda s: s != "")
    middle = F.when(F.size(slugs) > 0, F.concat(F.lit("__topics_"), F.array_join(slugs, "_"))).otherwise("")
    sender = F.when(F.col("sender") != "", F.col("sender")).otherwise("unknown")
    return parts.withColumn("name", F.concat(F.lit("email_"), date, F.lit("__"), subject, middle, F.lit("__from_"), sender))


def chat_parts(digests, column="raw", exclude=()):
    """digests with topics (the first two third-level heads, bare) and people (the three boldest first names)."""
    heads = F.transform(_all(F.col(column), CHAT_HEAD), lambda t: F.regexp_replace(F.regexp_replace(T.strip(t), r"\s*[—\-]\s*.*$", ""), r"^\d+\.\s*", ""))
    no = [e.lower() for e in exclude]
    r = digests.withColumn("topics", F.slice(F.filter(heads, lambda t: t != ""), 1, 2)).withColumn("_named", _all(F.col(column), BOLD_NAME))
    named = F.transform(_by_count("_named", 8), lambda x: x["value"])
    if no:
        named = F.filter(named, lambda n: ~F.exists(F.array(*(F.lit(e) for e in no)), lambda e: F.contains(F.lower(n), e)))
    return r.withColumn("people", F.slice(F.transform(named, _first_word), 1, 3)).drop("_named")


def chat_name(parts, date):
    """slack_<date>__<topic>[__<topic>]__with_<people>."""
    first = F.when(F.size("topics") > 0, T.word_slug(F.get("topics", F.lit(0)), 50)).otherwise("digest")
    second = F.when(F.size("topics") > 1, F.concat(F.lit("__"), T.word_slug(F.get("topics", F.lit(1)), 40))).otherwise("")
    people = F.when(F.size("people") > 0, F.array_join("people", "_")).otherwise("general")
    return parts.withColumn("name", F.concat(F.lit("slack_"), date, F.lit("__"), first, second, F.lit("__with_"), people))


def rename_plan(files, names, folder="MEMORY/daily/emails/"):
    """(path, new_path): a descriptive sibling for each file of a folder that has none yet.

    names: (path, name). Files whose name says its topics already stay. A name that is taken gets six digits of a hash of
    the old one; where that is taken too, the file stays.
    """
    base = F.element_at(F.split("path", "/"), -1)
    r = files.where(F.col("path").startswith(folder)).where(~(base.rlike("^(?:email|slack)_") & base.contains("__topics_"))).join(names, "path").where(F.coalesce("name", F.lit("")) != "")
    there = files.select(F.col("path").alias("_there")).distinct()
    plain, marked = F.concat(F.lit(folder), "name", F.lit(".md")), F.concat(F.lit(folder), "name", F.lit("__"), F.substring(F.md5(base), 1, 6), F.lit(".md"))
    r = r.select("path", plain.alias("_plain"), marked.alias("_marked")).where(F.col("path") != F.col("_plain"))
    r = r.withColumn("_taken", F.row_number().over(Window.partitionBy("_plain").orderBy("path")) > 1)
    r = r.join(there, F.col("_plain") == F.col("_there"), "left").withColumn("new_path", F.when(F.col("_there").isNotNull() | F.col("_taken"), F.col("_marked")).otherwise(F.col("_plain"))).drop("_there")
    return r.join(there, F.col("new_path") == F.col("_there"), "left_anti").select("path", "new_path")
