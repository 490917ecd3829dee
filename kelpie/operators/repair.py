"""Repair of links in pages: fixed, marked, delinked or deleted by one table of edits, and links added for orphans.

An edit (path, target, action, new) holds for every link of its page to that target, with any heading or alias. Pages
meet their own edits by a join; each body is rewritten in its row by expressions, its edits one after the other in the
order of ACTIONS and then of targets, so nothing grows but with a page's own links.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators.ingest import _KNOWN, MD_LINK, WIKI_LINK, skipped_page

#: What an edit does, in the order of work. fix and relink need a new target.
ACTIONS = ["fix", "relink", "mark", "break", "delink", "delete", "delete_markdown"]
#: What marks a broken link, and the target that stands for any broken one.
MARKED, BROKEN = "(broken link) ", "broken-link"
#: A line of which nothing but a list sign and empty quotes is left; what plain references are not looked for in.
_BARE = r"^\s*(?:[-*+]|\d+\.)?\s*(?:\"\"|''|\x{201c}\x{201d}|\x{2018}\x{2019})?\s*$"
_LINKED = r"(\[\[[^\]\n]+\]\]|\[(?:[^\]\n]*)\]\([^)\n]*\)|`[^`\n]*`)"


def link_places(pages, body_col="body"):
    """(path, line, column, kind, target, raw) of wiki and Markdown links, both from 1; links that are marked as broken are left out."""
    lines = pages.select("path", F.posexplode(F.split(F.col(body_col), "\n")).alias("n", "content")).where(F.contains("content", F.lit("](")) | F.contains("content", F.lit("[[")))
    out = None
    for kind, pattern in (("wikilink", WIKI_LINK), ("markdown", MD_LINK)):
        between = F.split("content", pattern, -1)
        found, raw = F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        each = lines.select("path", "n", between.alias("between"), raw.alias("raw"), F.posexplode(found).alias("i", "target"))
        total = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, x: s + F.char_length(x))
        column = 1 + total(F.col("between"), F.col("i") + 1) + total(F.col("raw"), F.col("i"))
        follows = F.get("between", F.col("i") + 1)
        each = each.where(~follows.rlike(r"^\\?\|\(broken link\)")) if kind == "wikilink" else each
        each = each.select("path", (F.col("n") + 1).alias("line"), column.alias("column"), F.lit(kind).alias("kind"), T.strip(F.col("target")).alias("target"), F.get("raw", F.col("i")).alias("raw"))
        out = each if out is None else out.unionByName(each)
    return out


def fixes(resolved, pages):
    """Edits (path, target, action, new) for wiki links that lead nowhere but to one page of an alike name.

    A target with a folder is looked for in that folder only, and keeps it; another must name one page of all.
    """
    broken = resolved.where((F.col("kind") == "wikilink") & F.col("resolved").isNull()).select("path", "target").distinct()
    name = F.regexp_replace(F.element_at(F.split("target", "/"), -1), _KNOWN, "")
    broken = broken.withColumn("_key", T.normal_page(name)).withColumn("_folder", F.regexp_extract("target", "^(.*)/[^/]*$", 1)).where("_key <> ''")
    page = pages.select("path").where(F.endswith("path", F.lit(".md"))).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("_folder"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("_stem"), (~skipped_page(F.col("path"))).alias("_seen"))
    page = page.withColumn("_key", T.normal_page(F.col("_stem")))
    beside = page.groupBy("_folder", "_key").agg(F.min("_stem").alias("_new"))
    alone = page.where("_seen").groupBy("_key").agg(F.min("_stem").alias("_new"), F.count("*").alias("n")).where("n = 1")
    there = broken.where("_folder <> ''").join(beside, ["_folder", "_key"]).select("path", "target", F.concat("_folder", F.lit("/"), "_new").alias("new"))
    anywhere = broken.where("_folder = ''").join(alone, "_key").select("path", "target", F.col("_new").alias("new"))
    return there.union(anywhere).select("path", "target", F.lit("fix").alias("action"), "new")


def _literal(text):
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _inserted(text):
    """A text as a regular expression's replacement has it."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _stem(target):
    return F.regexp_replace(F.element_at(F.split(F.rtrim(target, F.lit("/")), "/"), -1), r"(?<=[^.])\.[^.]*$", "")


def _edited(body, e):
    """body after one edit that works on links alone."""
    at, to, stem = _literal(e["target"]), _inserted(e["target"]), _inserted(_stem(e["target"]))
    open_, head, close = F.concat(F.lit(r"(?<!!)\[\["), at), r"(#[^|\\\]]*)?", r"\]\]"
    alias, plain = F.concat(open_, F.lit(head + r"\\?\|([^\]\n]*)" + close)), F.concat(open_, F.lit(head + close))
    wide = F.concat(open_, F.lit(r"(?:#[^|\\\]]*)?\\?\|([^\]]*)" + close))
    swap = lambda text, pattern, new: F.regexp_replace(text, pattern, new)
    links = lambda text, with_alias, without: swap(swap(text, plain, without), alias, with_alias)
    # a link without an alias gets one and would match again, so those with one come first there
    first = lambda text, with_alias, without: swap(swap(text, alias, with_alias), plain, without)
    new = _inserted(F.coalesce(e["new"], F.lit("")))
    action = e["action"]
    return (
        F.when(action == "fix", swap(body, F.concat(open_, F.lit(r"(?=[\]|#\n])")), F.concat(F.lit("[["), new)))
        .when(action == "relink", swap(body, F.concat(F.lit(r"(?<!!)\[([^\]]*)\]\("), at, F.lit(r"(?:#[^)]*)?\)")), F.concat(F.lit("[$1]("), new, F.lit(")"))))
        .when(action == "mark", first(body, F.concat(F.lit("[["), to, F.lit("$1|" + MARKED + "$2]]")), F.concat(F.lit("[["), to, F.lit("$1|" + MARKED), to, F.lit("]]"))))
        .when(action == "break", first(body, F.lit(f"[[{BROKEN}|$2]]"), F.concat(F.lit(f"[[{BROKEN}|"), to, F.lit("]]"))))
        .when(action == "delink", swap(swap(body, wide, F.lit("$1")), plain, stem))
        .otherwise(body)
    )


def _shortened(line, e):
    """A line without the links of one edit: spaces on both sides become one, else they go with the link."""
    at = _literal(e["target"])
    wiki = F.concat(F.lit(r"(?<!!)\[\["), at, F.lit(r"(?:#[^|\\\]]*)?(?:\\?\|[^\]]*)?\]\]"))
    markdown = F.concat(F.lit(r"(?<!!)\[[^\]]*\]\("), at, F.lit(r"(?:#[^)]*)?\)"))
    link = F.when(e["action"] == "delete", wiki).otherwise(markdown)
    return F.regexp_replace(line, F.concat(F.lit("( )"), link, F.lit(" | ?"), link, F.lit(" ?")), F.lit("$1"))


def repair(pages, edits, body_col="body"):
    """pages with `fixed`, the body after its edits; pages without any keep theirs.

    edits: (path, target, action, new). fix puts a new target in place of the old one; relink does for Markdown links,
    whose headings go; mark shows that a link is broken, break sends it to one page for all of them; delink leaves alias
    or name as text; delete and delete_markdown take the link out, and its line if nothing else stood there.
    """
    rank = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("action"))
    each = edits.select("path", F.struct(rank.alias("rank"), "target", "action", "new").alias("e")).distinct()
    per_page = each.groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("_edits"))
    p = pages.join(per_page, "path", "left")
    body = F.aggregate(F.filter("_edits", lambda e: ~F.startswith(e["action"], F.lit("delete"))), F.col(body_col), _edited)
    p = p.withColumn("_body", F.when(F.col("_edits").isNull(), F.col(body_col)).otherwise(body))
    deletes = F.filter("_edits", lambda e: F.startswith(e["action"], F.lit("delete")))
    cut = lambda line: F.aggregate(deletes, F.struct(line.alias("text"), F.lit(False).alias("gone")), lambda s, e: _step(s, e))
    lines = F.transform(F.split("_body", "\n", -1), cut)
    kept = F.transform(F.filter(lines, lambda x: ~x["gone"]), lambda x: x["text"])
    # a last line that goes takes its line break along with it only where another line follows
    joined = F.concat(F.array_join(kept, "\n"), F.when(F.element_at(lines, -1)["gone"] & (F.size(kept) > 0), "\n").otherwise(""))
    return p.withColumn("fixed", F.when(F.size(F.coalesce(deletes, F.array())) > 0, joined).otherwise(F.col("_body"))).drop("_edits", "_body")


def _step(state, e):
    shorter = _shortened(state["text"], e)
    gone = (shorter != state["text"]) & F.regexp_replace(shorter, r"[\r\n]+$", "").rlike(_BARE)
    return F.struct(F.when(state["gone"], state["text"]).otherwise(shorter).alias("text"), (state["gone"] | gone).alias("gone"))


def link_orphans(pages, orphans, body_col="body", least=3):
    """pages with `fixed` and n_linked: plain mentions of orphans' names (with or without .md) become links to them.

    Not in front matter, links and inline code, and not on the orphan's own page. Names of under `least` characters are
    left alone. Names meet pages by a join on their words (raw_mentions' rule), and only pages that mention one are
    rewritten, name by name in order.
    """
    named = orphans.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("_stem")).where(F.char_length("_stem") >= least)
    run = r"[\p{L}\p{N}_]+"
    starts = named.select(F.col("path").alias("_orphan"), "_stem", F.regexp_extract("_stem", f"({run})", 1).alias("_run")).where("_run <> ''")
    runs = pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.col(body_col), F.lit(f"({run})"), F.lit(1)))).alias("_run"))
    wanted = runs.join(starts, "_run").where(F.col("path") != F.col("_orphan")).groupBy("path").agg(F.array_sort(F.collect_set(F.struct("_orphan", "_stem"))).alias("_stems"))
    lines = F.split(F.col(body_col), "\n", -1)
    end = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(F.rtrim(x, F.lit("\r"))).isin("---", "...")), F.lit(True))
    front = F.when((T.strip(lines[0]) == "---") & (end > 0), (end + 1).cast("int")).otherwise(0)
    p = pages.join(wanted, "path", "left").withColumn("_front", front)
    p = p.withColumn("_head", F.slice(lines, F.lit(1), F.col("_front"))).withColumn("_rest", F.array_join(F.slice(lines, F.col("_front") + 1, F.size(lines)), "\n"))
    start = F.struct(F.col("_rest").alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.aggregate(F.coalesce("_stems", F.array().cast(wanted.schema["_stems"].dataType)), start, lambda s, x: _linked(s, x["_stem"]))
    p = p.withColumn("_done", done)
    fixed = F.array_join(F.concat("_head", F.array("_done.text")), "\n")
    return p.withColumn("fixed", F.when(F.col("_done.n") > 0, fixed).otherwise(F.col(body_col))).withColumn("n_linked", F.col("_done.n")).drop("_stems", "_front", "_head", "_rest", "_done")


def _linked(state, stem):
    mention = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), _literal(stem), F.lit(r"(?:\.md)?(?![\p{L}\p{N}_])"))
    between, held = F.split(state["text"], _LINKED, -1), F.regexp_extract_all(state["text"], F.lit(_LINKED), F.lit(1))
    n = F.aggregate(between, F.lit(0).cast("long"), lambda s, x: s + F.regexp_count(x, mention))
    new = F.transform(between, lambda x: F.regexp_replace(x, mention, F.concat(F.lit("[["), _inserted(stem), F.lit("]]"))))
    pieces = F.transform(F.arrays_zip(new.alias("a"), held.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit(""))))
    return F.struct(F.when(n > 0, F.array_join(pieces, "")).otherwise(state["text"]).alias("text"), (state["n"] + n).alias("n"))
