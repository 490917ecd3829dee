"""Row-level ingest: cleaning, deduplication, questions, watch lists and wiki links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators.cut import cut


def clean_emails(emails):
    """(…, cleaned, sender, subject, reason, dropped) from raw (name, raw): headers, HTML strip, reply cut, promotion verdict."""
    r = emails.withColumn("sender", T.header(F.col("raw"), "From")).withColumn("subject", T.header(F.col("raw"), "Subject"))
    r = r.withColumn("cleaned", T.truncate_replies(T.strip_html(F.col("raw"))))
    r = r.withColumn("reason", F.coalesce(T.marketing_reason(F.col("sender"), F.col("subject"), F.col("cleaned")), F.lit("")))
    return r.withColumn("dropped", F.col("reason") != "")


def clean_summary(cleaned):
    """One row: dropped, cleaned, untouched, bytes before and after, share saved."""
    before, after = F.octet_length("raw"), F.when(F.col("dropped"), 0).otherwise(F.octet_length("cleaned"))
    r = cleaned.agg(
        F.count(F.when(F.col("dropped"), 1)).alias("n_dropped"), F.count(F.when(~F.col("dropped") & (F.col("cleaned") != F.col("raw")), 1)).alias("n_cleaned"),
        F.count(F.when(~F.col("dropped") & (F.col("cleaned") == F.col("raw")), 1)).alias("n_untouched"), F.coalesce(F.sum(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum(after), F.lit(0)).alias("bytes_after"),
    )
    return r.withColumn("saved_pct", F.when(F.col("bytes_before") > 0, F.round(100.0 * (F.col("bytes_before") - F.col("bytes_after")) / F.col("bytes_before"), 1)).otherwise(0.0))


def redact(rows, column="text"):
    """rows with redacted and n_redacted. One pass a rule, and none where a rule's sign (an @, a digit) is missing.

    No rule touches a mark that another has left, so what was replaced is counted by the marks that were added.
    """
    out = rows.withColumn("redacted", F.col(column))
    for label, pattern in T.REDACTIONS:
        may = F.contains("redacted", F.lit("@")) if label == "EMAIL" else F.col("redacted").rlike("[0-9]")
        out = out.withColumn("redacted", F.when(may, F.regexp_replace("redacted", pattern, f"[{label}]")).otherwise(F.col("redacted")))
    added = sum(T.occurrences(F.col("redacted"), F.lit(f"[{x}]")) - T.occurrences(F.col(column), F.lit(f"[{x}]")) for x, _ in T.REDACTIONS)
    return out.withColumn("n_redacted", F.when(F.col("redacted") == F.col(column), F.lit(0).cast("long")).otherwise(added))


def _strip(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_blocks(rows, column="content"):
    """(…, block_no, block): multi-email files cut before each head; a file with fewer than two heads stays whole."""
    head = r"(?=^\*\*From:\*\*[ \t]+\S[^\n]*\n\*\*To:\*\*[ \t]+\S[^\n]*\n\s*\n----##[ \t]+)"
    heads = F.regexp_count(F.col(column), F.lit(r"(?m)" + head[3:-1]))
    parts = F.when(heads > 1, F.filter(F.transform(F.split(F.col(column), r"(?m)" + head), _strip), lambda b: b.startswith("**From:**"))).otherwise(F.array(_strip(F.col(column))))
    return rows.select("*", F.posexplode(F.filter(parts, lambda b: b != "")).alias("block_no", "block"))


def new_blocks(blocks, seen, column="block", order=("block_no",)):
    """Blocks whose fingerprint is neither seen before nor earlier in the batch; blocks without one stay."""
    r = blocks.withColumn("fp", T.fingerprint(F.col(column)))
    bare = r.where(F.col("fp") == "")
    keyed = r.where(F.col("fp") != "").join(seen.select("fp"), "fp", "left_anti")
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("fp").orderBy(*order))).where("_n = 1").drop("_n")
    return first.unionByName(bare)


def unseen_newest(rows, key, fp="fp", order=("ts",), cap=5000):
    """Rows whose fingerprint isn't among the `cap` that were last added to those of their key; rows without one pass.

    A fingerprint is added when it passes, and goes when `cap` newer ones have been added: a repeat doesn't renew it, so
    what passes hangs on all before it. Rows of a key stream in order through one task that holds `cap` fingerprints.
    """
    key = [key] if isinstance(key, str) else list(key)
    at, fp_at = [rows.columns.index(k) for k in key], rows.columns.index(fp)

    def run(batches):
        import pyarrow as pa

        here, held = None, {}
        for batch in batches:
            keep = []
            for k, x in zip(zip(*(batch.column(i).to_pylist() for i in at)), batch.column(fp_at).to_pylist()):
                if k != here:
                    here, held = k, {}
                new = not x or x not in held
                keep.append(new)
                if x and new:
                    held[x] = None
                    if len(held) > cap:
                        del held[next(iter(held))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, rows.schema)


def open_questions(rows, id_col, text_col, asks=T.OPEN_QUESTION):
    """(id, pos, question): sentences of 15 to 400 characters that ask (a pattern over lower case), and aren't settled."""
    signs = T.OPEN_SIGNS if asks == T.OPEN_QUESTION else ("",)
    s = rows.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "question")).withColumn("question", F.btrim("question", F.lit(T.WHITE)))
    open_ = T.once(F.lower("question"), lambda low: T.holds(low, signs) & low.rlike(asks) & ~low.rlike(T.CLOSED))
    return s.where(F.char_length("question").between(15, 400)).where(open_)


def link_questions(questions, entities, most=8, order="eid"):
    """(…, linked): up to `most` entity ids whose name (three characters or more) the question contains.

    Where a question has the first three characters of some names, its piece of each of their lengths is taken, and
    an equi-join of pieces and names finds any that are equal: no substring is missed, and questions aren't paired with
    names. Where more than `most` fit, the first by the order column are taken, in that order.
    """
    key = [c for c in questions.columns]
    questions = cut(questions)  # few rows of much text, read twice below and by what follows
    names = entities.where(F.char_length("name") >= 3).groupBy(F.lower("name").alias("_name")).agg(F.slice(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), "eid"))), 1, most).alias("_eids"))
    starts = names.groupBy(F.substring("_name", 1, 3).alias("_start")).agg(F.collect_set(F.char_length("_name")).alias("_lengths"))
    words = questions.withColumn("_low", F.lower("question")).where(F.char_length("_low") >= 3)
    grams = F.transform(F.sequence(F.lit(1), F.char_length("_low") - 2), lambda i: F.substring(F.col("_low"), i, F.lit(3)))
    pieces = words.select(*key, "_low", F.posexplode(grams).alias("_at", "_start")).join(starts, "_start")
    pieces = pieces.select(*key, F.explode(F.transform("_lengths", lambda n: F.substring(F.col("_low"), F.col("_at") + 1, n))).alias("_name"))
    hits = pieces.join(names, "_name").select(*key, F.explode("_eids").alias("_eid")).groupBy(*key).agg(F.transform(F.slice(F.array_sort(F.collect_set("_eid")), 1, most), lambda x: x["eid"]).alias("linked"))
    return cut(questions.join(hits, key, "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>"))))


def question_priority(linked, entities):
    """(…, priority): high for pressing words, or links to crystallised entities, deals and decisions."""
    key = [c for c in linked.columns if c != "linked"]
    weighty = entities.where((F.col("tier") == "crystallised") | F.lower("type").isin("deal", "decision")).select("eid")
    touched = linked.select(*key, F.explode("linked").alias("eid")).join(weighty, "eid", "left_semi").select(*key).distinct().withColumn("_hit", F.lit(True))
    r = linked.join(touched, key, "left")
    return r.withColumn("priority", F.when(F.lower("question").rlike("decision|deadline|blocker|risk|board|ceo") | F.col("_hit").isNotNull(), "high").otherwise("medium")).drop("_hit")


def surface_questions(linked, new_ids, threshold=0.4):
    """Questions with enough of their links among new entities (eid): relevance, may_answer."""
    key = [c for c in linked.columns if c != "linked"]
    r = linked.select(*key, F.size("linked").alias("n"), F.explode("linked").alias("eid")).join(new_ids.select("eid").distinct(), "eid").groupBy(*key, "n").agg(F.count("*").alias("hits"))
    return r.withColumn("relevance", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 2)).where(F.col("hits") / F.greatest("n", F.lit(1)) >= threshold).withColumn("may_answer", F.col("hits") / F.col("n") > 0.7)


def watch_list(rows, rules, id_col, text_col):
    """(id, rule, line): the first line on which each rule hits, case-insensitive; rules: plain strings or re:pattern."""
    table = rows.sparkSession.createDataFrame([(r, r[3:] if r.startswith("re:") else None, None if r.startswith("re:") else r.lower()) for r in rules], "rule string, pattern string, plain string")
    lines = rows.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "content")).withColumn("content", F.lower("content"))
    hit = F.when(F.col("pattern").isNotNull(), F.expr("content rlike pattern")).otherwise(F.contains("content", "plain"))
    return lines.join(F.broadcast(table), hit).groupBy(id_col, "rule").agg((F.min("line") + 1).alias("line"))


#: Link forms of pages, prefixes of external targets, and file types that a target may leave out or name.
WIKI_LINK = r"(?<!!)\[\[((?:[^\]|#\n\\]|\\(?!\|)|\](?!\]))+)"
MD_LINK = r"(?<!!)\[[^\]]*\]\(([^)#\n]+?)(?:#[^)]*)?\)"
EXTERNAL = ["http://", "https://", "ftp://", "mailto:"]
EXTENSIONS = [".md", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".webp"]
_KNOWN = r"(?i)(?<=[^/])\.(?:md|png|jpe?g|gif|svg|pdf|webp)$"


def skipped_page(path):
    """Whether a page is left out of scans: in a hidden folder, an index or entry page, a skill file or the log."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith("."))
    return hidden | name.isin("SKILL.md", "index.md", "_index.md", "START_HERE.md") | (path == "wiki/log.md")


def front_flag(body, name, value):
    """Whether the front matter (between a first line --- and the next --- or ...) has a line `name: value`."""
    lines = F.split(body, "\r?\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    end = F.array_position(F.transform(rest, lambda x: F.trim(x).isin("---", "...")), F.lit(True))
    block = F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int"))).otherwise(rest)
    return F.coalesce((T.strip(F.get(lines, F.lit(0))) == "---") & F.exists(block, lambda x: x.rlike(rf"^\s*{name}\s*:\s*{value}\s*$")), F.lit(False))


def extract_links(pages, id_col="path", body_col="body"):
    """(id, line, kind, target) of wiki and Markdown links, without anchors and aliases; external ones are marked."""
    lines = pages.select(id_col, F.posexplode(F.split(F.col(body_col), "\n")).alias("_n", "content"))
    grab = lambda pattern, kind: F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), F.trim(t).alias("target")))
    r = lines.select(id_col, (F.col("_n") + 1).alias("line"), F.explode(F.concat(grab(WIKI_LINK, "wikilink"), grab(MD_LINK, "markdown"))).alias("l"))
    outside = F.exists(F.array(*(F.lit(p) for p in EXTERNAL)), lambda p: F.startswith("l.target", p))
    return r.select(id_col, "line", "l.kind", "l.target", outside.alias("external"))


def _inside(path):
    """A path without ./ and with ../ taken up, as an expression."""
    step = lambda done, x: F.when((x == "") | (x == "."), done).when((x == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_links(links, pages):
    """Links with resolved (a path, or null) and suggestion (for those that lead nowhere: the one page of an alike name).

    Markdown targets are percent-decoded, and looked for beside their page, then from the root. Wiki targets: as they
    are; without a known extension with each of them; then any page of that name, the least path where several have it.
    A few candidates a link are looked up by one join, so that pages aren't scanned a link. Skipped pages have no names.
    """
    bare = F.regexp_replace(F.element_at(F.split("target", "/"), -1), _KNOWN, "")
    decoded = F.coalesce(F.try_url_decode(F.replace(F.col("target"), F.lit("+"), F.lit("%2B"))), F.col("target"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    wiki = F.concat(F.array("target"), F.when(F.col("target").rlike(_KNOWN), F.array().cast("array<string>")).otherwise(F.array(*(F.concat("target", F.lit(e)) for e in EXTENSIONS))))
    markdown = F.array(_inside(F.concat(folder, decoded)), _inside(decoded))
    distinct = links.select("path", "kind", "target").where(~F.col("external")).distinct() if "external" in links.columns else links.select("path", "kind", "target").distinct()
    tries = distinct.select("path", "kind", "target", F.posexplode(F.when(F.col("kind") == "wikilink", wiki).otherwise(markdown)).alias("_at", "_p"))
    files = pages.select(F.col("path").alias("_p")).distinct()
    exact = tries.join(files, "_p").groupBy("path", "kind", "target").agg(F.min_by("_p", "_at").alias("_exact"))
    named = pages.where(~skipped_page(F.col("path"))).select(F.col("path").alias("_q"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("_stem"))
    stems = named.groupBy("_stem").agg(F.min("_q").alias("_by_stem"))
    alike = named.groupBy(T.normal_page(F.col("_stem")).alias("_key")).agg(F.min("_q").alias("_by_name"), F.count("*").alias("_many"))
    found = distinct.withColumn("_stem", F.when(F.col("kind") == "wikilink", bare)).withColumn("_key", F.when(F.col("kind") == "wikilink", T.normal_page(bare)))
    found = found.join(exact, ["path", "kind", "target"], "left").join(stems, "_stem", "left").join(alike, "_key", "left")
    resolved = F.coalesce("_exact", "_by_stem")
    found = found.select("path", "kind", "target", resolved.alias("resolved"), F.when(resolved.isNull() & (F.col("_many") == 1), F.col("_by_name")).alias("suggestion"))
    return links.join(found, ["path", "kind", "target"], "left")


def raw_mentions(pages, raw):
    """(path): pages whose name a raw text (text) holds as a whole word, with or without .md.

    Names meet texts by their first run of word characters, which must stand in the text as a whole run; only then is
    the pattern tried. Names without any word character are never found.
    """
    run = r"[\p{L}\p{N}_]+"
    stems = pages.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("_stem"))
    stems = stems.withColumn("_run", F.regexp_extract("_stem", f"({run})", 1)).where("_run <> ''")
    raw = raw.select(F.xxhash64("text").alias("_id"), F.col("text").alias("_text"))
    runs = raw.select("_id", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(f"({run})"), F.lit(1)))).alias("_run"))
    near = stems.join(runs, "_run").select("path", "_stem", "_id").distinct()
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), "_stem", F.lit(r"\E(?:\.md)?(?![\p{L}\p{N}_])"))
    return near.join(raw.dropDuplicates(["_id"]), "_id").where(F.rlike(F.col("_text"), pattern)).select("path").distinct()


def orphans(pages, resolved):
    """Pages that no link of another page leads to."""
    linked = resolved.where(F.col("resolved").isNotNull() & (F.col("resolved") != F.col("path"))).select(F.col("resolved").alias("path")).distinct()
    return pages.join(linked, "path", "left_anti")


def backlinks(resolved):
    """(path, backlinks): how many pages link to each page."""
    return resolved.where(F.col("resolved").isNotNull()).select("path", "resolved").distinct().groupBy(F.col("resolved").alias("path")).agg(F.count("*").alias("backlinks"))


def large_files(files, id_col, least):
    """Files of `least` bytes or more, the largest first."""
    return files.where(F.col("size_bytes") >= least).orderBy(F.desc("size_bytes"), id_col)


def lint_summary(pages, resolved):
    n = pages.agg(F.count("*").alias("files"))
    r = resolved.agg(F.count("*").alias("links"), F.count(F.when(~F.col("external") & F.col("resolved").isNull(), 1)).alias("broken"), F.count(F.when(F.col("external"), 1)).alias("external"))
    return n.crossJoin(r)


def delink(pages, broken, body_col="body"):
    """Bodies with broken wiki links (path, target) replaced by their text."""
    b = broken.groupBy("path").agg(F.array_sort(F.collect_set("target")).alias("_t"))
    r = pages.join(b, "path", "left")
    return r.withColumn("fixed", F.aggregate(F.coalesce("_t", F.array().cast("array<string>")), F.col(body_col), lambda text, t: F.replace(text, F.concat(F.lit("[["), t, F.lit("]]")), t))).drop("_t")


def archive_plan(files, stamp, folders=("accounts", "decisions"), root="MEMORY/"):
    """(folder, destination, n_files): legacy folders that exist, each to move below a dated archive."""
    name = F.get(F.split(F.substring("path", len(root) + 1, 10_000), "/"), F.lit(0))
    r = files.where(F.col("path").startswith(root)).withColumn("folder", name).where(F.col("folder").isin(*folders) & F.col("path").contains("/"))
    return r.groupBy("folder").agg(F.count("*").alias("n_files")).select("folder", F.concat(F.lit(f"{root}_archive/{stamp}/"), "folder").alias("destination"), "n_files")
