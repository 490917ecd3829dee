"""Keyword, wiki and bundle search as joins of a few queries with the corpus."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators.cut import cut, in_slices
from kelpie.operators.index import body_words
from kelpie.operators.matching import close_terms

#: Fixed values.
PATH_BOOSTS = {"/accounts/": 2.5, "/decisions/": 1.8, "/weekly/": 1.6, "/context/": 1.4, "/saved/": 1.4, "/research/": 1.3, "/daily/emails/": 1.0, "/daily/": 0.9, "/episodic/": 1.1, "/archive/": 0.6}
EXCLUDED = ["/sessions/", "/_raw/", "/_pre_compression_backups/", "/proposals/", "/priming/", "/health/", "/_archive/", ".bak_", ".bak/"]
RECENCY_WORDS = ["latest", "recent", "update", "current", "now", "today", "this morning", "this afternoon", "this evening", "tonight", "yesterday", "just", "fresh"]


def _any(column, parts):
    return F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(column, p))


def corpus(files, excluded=EXCLUDED):
    """Files worth scanning: 50 bytes or more, no excluded path fragment, no dot file or digest."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where((F.col("size_bytes") >= 50) & ~_any(F.col("path"), excluded) & ~name.startswith(".") & ~name.endswith(".digest.md"))


def _asked(queries, synonyms=None):
    """queries with their tokens q and proper nouns pn; those without tokens find nothing."""
    q = queries.withColumn("q", T.query_tokens(F.col("query")))
    if synonyms:
        q = q.withColumn("q", T.expand_synonyms(F.col("q"), synonyms))
    return q.where(F.size("q") > 0).withColumn("pn", T.proper_nouns(F.col("query"), F.col("q")))


def _union(column):
    return F.array_distinct(F.flatten(F.collect_list(column)))


def _hay(body_chars):
    return F.concat_ws(" ", F.translate(F.lower("path"), "_/", "  "), F.lower(F.substring("body", 1, body_chars)))


def _words_from(hay, roots):
    """Distinct words of a text in lower case that begin with one of the roots (words themselves), found in one pass by those that it holds."""
    word = T.NON_WORD.replace("^", "").removesuffix("+")
    pattern = lambda here: F.concat(F.lit(f"(?:^|{T.NON_WORD[:-1]})((?:"), F.array_join(here, "|"), F.lit(f"){word}*)"))
    found = lambda here: F.when(F.size(here) > 0, F.array_distinct(F.regexp_extract_all(hay, pattern(here), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return T.once(F.filter(roots, lambda r: F.contains(hay, r)), found)


def keyword_fields(body_chars=8000):
    """Fields of an index that bm25 (body) and keyword_score (tokens, stems) read."""
    return {"body": body_words(), "tokens": T.all_tokens(_hay(body_chars)), "stems": ("tokens", T.stem_of())}


def _close_lists(q, vocabulary, ratio):
    """q with near: of its proper nouns of five characters or more those with close matches, and these."""
    words = q.select("query_id", F.explode("pn").alias("word")).where(F.char_length("word") >= 5)
    found = close_terms(words, vocabulary, ratio).groupBy("word").agg(F.collect_set("term").alias("terms"))
    near = words.join(found, "word").groupBy("query_id").agg(F.collect_list(F.struct("word", "terms")).alias("near"))
    return q.join(near, "query_id", "left")


def _close_hits(tokens):
    """How many proper nouns are close to one of the tokens, and none of them."""
    hits = F.filter("near", lambda x: ~F.array_contains(tokens, x["word"]) & F.arrays_overlap(tokens, x["terms"]))
    return F.coalesce(F.size(F.when(F.col("near").isNotNull(), hits)), F.lit(0))


def keyword_score(files, queries, as_of, body_chars=8000, synonyms=None, fuzzy=False, claim_boosts=None, index=None):
    """(query_id, path, overlap, stem_hits, effective, proper_hits, tf, boost, score) of every file that a query touches.

    queries: (query_id, query), any number. Without an index the corpus is scanned once for every thousand queries, and
    only words that begin like one of their terms and stems (one row) are taken from it; only files that hold any are
    paired with queries. An index of keyword_fields(body_chars) names these files instead, and only they are read and joined.
    as_of: the clock. fuzzy adds close matches of long proper nouns, found among the distinct tokens of the corpus.
    claim_boosts: (path, boost). An empty query finds nothing.
    """
    search = partial(_keyword_score, files, as_of=as_of, body_chars=body_chars, synonyms=synonyms, fuzzy=fuzzy, claim_boosts=claim_boosts, index=index)
    return search(queries) if index is not None else in_slices(queries, search)


def _touched(index, q):
    """(query_id, path, tokens, stems) of the files that hold a term, a stem or a close match of a query, and which they hold."""
    ask = lambda column: q.select("query_id", F.explode(column).alias("term"))
    terms = ask("q")
    if "near" in q.columns:
        terms = terms.union(ask(F.flatten(F.transform("near", lambda x: x["terms"]))))
    return index.matches({"tokens": terms, "stems": ask("q_stems")})


def _keyword_score(files, queries, as_of, body_chars, synonyms, fuzzy, claim_boosts, index):
    q = _asked(queries, synonyms).withColumn("q_stems", T.stemmed(F.col("q")))
    q = q.withColumn("recent", _any(F.lower("query"), RECENCY_WORDS))
    q = q.withColumn("names", F.when(T.is_meeting_query(F.col("q")), F.transform(T.person_names(F.col("query")), F.lower)).otherwise(F.array().cast("array<string>")))
    f = corpus(files).select("path", "stem", "size_bytes", "mtime", F.substring("body", 1, 1500).alias("_start"), _hay(body_chars).alias("hay"))
    if fuzzy:
        words = f.select(F.explode(F.split("hay", T.NON_WORD)).alias("term"))
        q = cut(_close_lists(q, words if index is None else index.vocabulary("tokens"), 0.85))
    if index is not None:
        r = f.join(_touched(index, q), "path").join(q, "query_id")
        r = r.withColumn("_hits", F.col("tokens")).withColumn("_stem_hits", F.col("stems")).withColumn("_close", F.col("tokens"))  # its proper nouns are among its terms
    else:
        none = F.array().cast("array<string>")
        every = q.agg(_union("q").alias("_terms"), _union("q_stems").alias("_stems"), _union(F.flatten(F.transform("near", lambda x: F.array_append(x["terms"], x["word"]))) if fuzzy else none).alias("_near"))
        # a stem is the beginning of its word: what can hit begins with a stem, or with a term too short to have one
        roots = F.array_union("_stems", F.filter("_terms", lambda t: F.char_length(t) < 3))
        f = f.crossJoin(F.broadcast(every.withColumn("_roots", roots)))
        close = F.array_intersect("_near", F.split("hay", T.NON_WORD)) if fuzzy else none
        # by generators: filters on what follows would otherwise work it out from the text again
        f = f.select("*", F.inline(F.array(F.struct(_words_from(F.col("hay"), F.col("_roots")).alias("hay_toks"), close.alias("_close")))))
        f = f.select("*", F.inline(F.array(F.struct(F.array_intersect("_terms", "hay_toks").alias("_hits"), F.array_intersect("_stems", T.stemmed(F.col("hay_toks"))).alias("_stem_hits")))))
        f = f.where((F.size("_hits") > 0) | (F.size("_stem_hits") > 0) | (F.size("_close") > 0)).drop("_terms", "_stems", "_near", "_roots", "hay_toks")
        r = f.crossJoin(F.broadcast(q))
    overlap = F.size(F.array_intersect("q", "_hits"))
    r = r.withColumn("overlap", overlap).withColumn("stem_hits", F.greatest(F.lit(0), F.size(F.array_intersect("q_stems", "_stem_hits")) - overlap))
    r = r.withColumn("fuzzy_hits", _close_hits(F.col("_close")) if fuzzy else F.lit(0))
    r = r.withColumn("effective", F.col("overlap") + F.col("stem_hits") * 0.6 + F.col("fuzzy_hits") * 1.5).where("effective > 0")
    hay = F.col("hay")
    r = r.withColumn("proper_hits", F.size(F.filter("pn", lambda p: F.contains(hay, p))) + F.col("fuzzy_hits"))
    r = r.withColumn("tf", F.aggregate("q", F.lit(0).cast("long"), lambda a, t: a + F.when(F.contains(hay, t), F.least(T.occurrences(hay, t), F.lit(12).cast("long"))).otherwise(0)))
    boost = F.lit(1.0)
    for fragment, value in reversed(PATH_BOOSTS.items()):
        boost = F.when(F.contains("path", F.lit(fragment)), value).otherwise(boost)
    low = F.lower("path")
    named = F.arrays_overlap("q", F.split(F.lower("stem"), r"[^\p{L}\p{N}]+"))
    boost = boost * F.when(named, 3.0).when(F.exists("q", lambda t: F.contains(low, t)), 1.5).otherwise(1.0)
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp"))) / 86400.0
    start = F.lower("_start")
    sent = F.exists("names", lambda n: F.contains(start, F.concat(F.lit("from: "), n)) | F.contains(start, F.concat(F.lit("<"), n, F.lit("."))) | F.contains(start, F.concat(F.lit("<"), n, F.lit("@"))))
    mail = 2.0 * F.when(F.col("size_bytes") < 1500, 6.0).otherwise(1.0) * F.when(days < 7, 4.0).when(days < 14, 2.0).otherwise(1.0)
    boost = boost * F.when(F.contains("path", F.lit("/daily/emails/")) & sent, mail).otherwise(1.0)
    fresh = F.when(days < 0.25, 5.0).when(days < 1, 3.0).when(days < 3, 1.8).when(days < 7, 1.3).otherwise(1.0) * F.when(F.contains("path", F.lit("/weekly/")), 1.5).otherwise(1.0)
    r = r.withColumn("boost", boost * F.when(F.col("recent"), fresh).otherwise(1.0))
    if claim_boosts is not None:
        r = r.join(claim_boosts.withColumnRenamed("boost", "_claim"), "path", "left").withColumn("boost", F.col("boost") * F.coalesce("_claim", F.lit(1.0)))
    b, e = F.col("boost"), F.col("effective")
    score = e * b * F.log1p(e) + 3.0 * F.col("proper_hits") * b + 0.4 * F.log1p(F.col("tf").cast("double")) * b
    return r.select("query_id", "path", "overlap", "stem_hits", "effective", "proper_hits", "tf", "boost", score.alias("score"), (F.size("pn") > 0).alias("has_proper"), (F.size("names") > 0).alias("has_names"))


def top_files(scored, most=8):
    """The best files of each query: ties keep path order; queries with proper nouns or names have their own caps.

    The scores, without any text, are kept once; totals are counted by a combining aggregate and joined back, so that
    only the best rows of each task are ranked.
    """
    scored = cut(scored)
    wide = max(min(12, 3 * most), most, 15)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.split("path", "/")))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= wide)
    total = scored.groupBy("query_id").agg(F.count("*").alias("total"))
    cap = F.when(F.col("has_proper") & (F.col("total") > 2 * most), min(12, 3 * most)).otherwise(most)
    cap = F.when(F.col("has_names"), F.greatest(cap, F.lit(15))).otherwise(cap)
    return best.join(total, "query_id").where(F.col("rank") <= cap).drop("total")


def wiki_scan(index, queries, most=4, boost=3.0, count_cap=5, fuzzy=False):
    """(query_id, page, score, rank): token scores of index entries (page, name, description); exact counts, else stems.

    fuzzy: a proper noun of five characters or more that is close (0.82) to a word of a page's name, and none of them,
    adds 0.8 of the boost. Entries are read once for every thousand queries.
    """
    return in_slices(queries, partial(_wiki_scan, index, most=most, boost=boost, count_cap=count_cap, fuzzy=fuzzy))


def _wiki_scan(index, queries, most, boost, count_cap, fuzzy):
    q = _asked(queries)
    entry = index.withColumn("search", F.concat_ws(" ", F.lower(F.translate("name", "_-", "  ")), F.lower("description")))
    entry = entry.withColumn("stems", T.stemmed(T.all_tokens(F.col("search"))))
    name = F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if fuzzy:
        q = cut(_close_lists(q, index.select(F.explode(name).alias("term")), 0.82))
    r = entry.crossJoin(F.broadcast(q))
    search, stems, pn = F.col("search"), F.col("stems"), F.col("pn")
    value = lambda t: F.when(F.array_contains(pn, t), boost).otherwise(1.0) * F.when(F.contains(search, t), F.least(T.occurrences(search, t), F.lit(count_cap).cast("long")).cast("double")).when(F.array_contains(stems, T.stem_token(t)), 0.6).otherwise(0.0)
    r = r.withColumn("score", F.aggregate("q", F.lit(0.0), lambda a, t: a + value(t)))
    if fuzzy:
        r = r.withColumn("score", F.col("score") + _close_hits(name) * (0.8 * boost))
    r = r.where("score > 0")
    best = r.groupBy("query_id", "page").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "page"))).where(F.col("rank") <= most)


def domain_bundles(files, queries, bundles):
    """(query_id, path, ord): files that an active bundle forces in; bundles: [(name, triggers, patterns)]; first pattern counts."""
    rows = [(i, name, list(triggers), p, j) for i, (name, triggers, patterns) in enumerate(bundles) for j, p in enumerate(patterns)]
    table = files.sparkSession.createDataFrame(rows, "bundle int, name string, triggers array<string>, pattern string, position int")
    q = queries.withColumn("words", F.split(F.lower("query"), T.NON_WORD))
    active = q.join(F.broadcast(table), F.arrays_overlap("words", "triggers"))
    found = files.select("path").join(F.broadcast(active), F.contains("path", "pattern"))
    return found.groupBy("query_id", "path").agg(F.min(F.col("bundle") * 1000 + F.col("position")).alias("ord"))


def bm25(files, queries, k1=1.2, b=0.75):
    """(query_id, path, score): BM25 over whole bodies, without an index (with one: Index.bm25 and Index.top).

    One scan for every thousand queries counts the words of each file and, of these, the terms of the queries; no text
    and no other word is shuffled. Files without words count for nothing.
    """
    return in_slices(queries, partial(_bm25, files, k1=k1, b=b))


def _bm25(files, queries, k1, b):
    terms = queries.select("query_id", F.explode(T.query_tokens(F.col("query"))).alias("term"))
    every = terms.agg(F.collect_set("term").alias("_terms"))
    words = files.select("path", F.filter(F.split(F.lower("body"), T.NON_WORD), lambda t: t != "").alias("words")).crossJoin(F.broadcast(every))
    words = words.select("path", F.size("words").alias("len"), F.filter("words", lambda t: F.array_contains("_terms", t)).alias("hits")).where("len > 0")
    words = cut(words)
    n = words.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = words.where(F.size("hits") > 0).select("path", "len", F.explode(F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda x: x == t)).alias("tf")))).alias("h")).select("path", "len", "h.*")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # one row, and one row a term of the queries
    r = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return r.withColumn("part", part).join(F.broadcast(terms), "term").groupBy("query_id", "path").agg(F.sum("part").alias("score"))


def past_occurrences(files, events, as_of, days=90, most=4):
    """(event_id, path, score, rank): earlier notes of a recurring event: shared title words in the stem, else in the first 600 characters.

    Events meet files by their words: those of the stem by an equi-join; in the first characters, where a word may stand
    within another, by every place that begins like one.
    """
    e = events.withColumn("words", T.event_tokens(F.col("title"))).where(F.size("words") > 0)
    asked = cut(e.select("event_id", F.size("words").alias("n"), F.explode("words").alias("word")))
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp"))) / 86400.0
    f = files.where((age >= 0) & (age <= days)).select("path", "mtime", T.event_tokens(F.translate("stem", "_-", "  ")).alias("stem_words"), F.lower(F.substring("body", 1, 600)).alias("head"))
    stems = f.select("path", "mtime", F.explode("stem_words").alias("word")).withColumn("where", F.lit("stem"))
    words = asked.select("word").distinct().withColumn("start", F.substring("word", 1, 3))  # words have three characters or more
    longest = words.agg(F.max(F.char_length("word")).alias("longest"))
    places = F.transform(F.sequence(F.lit(1), F.char_length("head") - 2), lambda i: F.substring("head", i, F.col("longest")))
    heads = f.where(F.char_length("head") >= 3).crossJoin(F.broadcast(longest)).select("path", "mtime", F.explode(F.array_distinct(places)).alias("place"))
    heads = heads.withColumn("start", F.substring("place", 1, 3)).join(words, "start").where(F.startswith("place", F.col("word"))).select("path", "mtime", "word").distinct()
    both = stems.unionByName(heads.withColumn("where", F.lit("head"))).join(asked, "word")
    counts = both.groupBy("event_id", "path", "mtime", "n").agg(F.count_if(F.col("where") == "stem").cast("int").alias("in_stem"), F.count_if(F.col("where") == "head").cast("int").alias("in_head"))
    need = F.greatest(F.lit(2), F.floor(F.col("n") / 2))
    r = counts.withColumn("score", F.when(F.col("in_stem") > 0, F.col("in_stem")).when(F.col("in_head") >= need, F.col("in_head")).otherwise(0)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), F.desc("mtime"), "path"))
    return r.withColumn("rank", rank).where(F.col("rank") <= most).select("event_id", "path", "score", "rank")
