"""Names of people: the canonical form of a subject, paths that follow it, and whether a mail is the user's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import text as T


def _words(column):
    return F.split(F.lower(F.trim(column)), r"\s+")


def name_index(entities, order="eid"):
    """(key, canonical) of the persons among entities: full names, and first and last words where no full name is equal.

    Of equal full names the last entity counts, of equal words the first one, and there the first word before the last.
    """
    p = entities.where((F.col("type") == "person") & (F.trim("name") != "")).select(F.trim("name").alias("name"), F.col(order).alias("ord"))
    full = p.groupBy(F.lower("name").alias("key")).agg(F.max_by("name", "ord").alias("canonical"))
    w = _words(F.col("name"))
    ends = p.select("name", "ord", F.posexplode(F.array(F.get(w, F.lit(0)), F.element_at(w, -1))).alias("end", "key"))
    ends = ends.groupBy("key").agg(F.min_by("name", F.struct("ord", "end")).alias("canonical"))
    return full.unionByName(ends.join(full, "key", "left_anti"))


def canonical_names(rows, column, index):
    """rows with canonical: what the index has for the whole subject, its first or its last word; else the subject itself."""
    w = _words(F.col(column))
    keys = {"_full": F.lower(F.trim(column)), "_first": F.get(w, F.lit(0)), "_last": F.when(F.size(w) > 1, F.element_at(w, -1))}
    r = rows
    for name, key in keys.items():
        r = r.withColumn(name, key).join(index.select(F.col("key").alias(name), F.col("canonical").alias(name + "_is")), name, "left")
    return r.withColumn("canonical", F.coalesce("_full_is", "_first_is", "_last_is", F.trim(column))).drop(*keys, *(k + "_is" for k in keys))


def canonical_paths(rows, index, column="path"):
    """rows with canonical_path: pages of people under their canonical name, older ones (context/people) under its slug."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(column), "/"), -1), r"(?<=.)\.[^.]+$", "")
    wiki, old = F.col(column).startswith("wiki/people/"), F.col(column).startswith("context/people/")
    r = rows.withColumn("_subject", F.when(wiki, stem).when(old, F.replace(stem, F.lit("_"), F.lit(" "))))
    r = canonical_names(r, "_subject", index)
    named = F.coalesce(F.col("canonical"), F.lit("")) != ""
    to = F.when(wiki & named, F.concat(F.lit("wiki/people/"), "canonical", F.lit(".md"))).when(old & named, F.concat(F.lit("context/people/"), T.under_slug(F.col("canonical")), F.lit(".md")))
    return r.withColumn("canonical_path", F.coalesce(to, F.col(column))).drop("_subject", "canonical")


#: How much of a mail is looked at for its sender, and the line that names the sender.
HEAD, FROM_LINE = 2500, r"(?im)^\s*\*{0,2}From:\*{0,2}\s*(.+?)$"


def from_user(content, name="", email=""):
    """Whether the From line (in the first 2500 characters) holds the user's address, or every part of the user's name."""
    sender = F.lower(F.trim(F.regexp_extract(F.substring(content, 1, HEAD), FROM_LINE, 1)))
    parts = [p for p in name.lower().split() if len(p) > 1]
    by_mail = F.contains(sender, F.lit(email.lower())) if email else F.lit(False)
    by_name = F.forall(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(sender, p)) if parts else F.lit(False)
    return F.coalesce((sender != "") & (by_mail | by_name), F.lit(False))
