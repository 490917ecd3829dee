"""An inverted index that outlives a query: postings on disk, a delta for what changed, and top-k that skips blocks.

Files fall to blocks of some hundred by a hash. A row of the postings is one term in the blocks of a task (or of what a
task counts at once): the files that hold it, how often, and each block's greatest count and shortest file, which bound
what the term can add to any score there. The null term stands for all files with words, and has their lengths. Rows
are partitioned by a hash of the term, one file for every eight thousand texts or so, and sorted, so a search opens the
files of the terms asked for, and of those only the row groups that hold them. A refresh writes postings of new and changed files only, as another segment, and marks
what they replace; all of it becomes current at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators.cut import cut
from kelpie.sources.versions import Versions

#: Partitions of the postings, and files of a block, about.
BUCKETS, BLOCK = 32, 128
#: Blocks of a task that builds an index; each task writes one file a bucket at most.
TASK = 64
#: Entries that a task counts at once, about, before it gives back their rows: some hundred MB.
AT_ONCE = 4_000_000
#: Segments of an index; the refresh that would add one more writes all files as one again.
SEGMENTS = 16
#: Terms that are looked for by a pushed list; beyond, by a join alone.
LISTED = 2000
_PLACE = ["segment", "block", "doc"]
_LISTS = {"heads": ["block", "at", "n", "most", "least"], "entries": ["doc", "tf", "len"]}
_POSTINGS = ", ".join(["field int", "term string", *(f"{name} struct<{', '.join(f'{c}: array<int>' for c in each)}>" for name, each in _LISTS.items())])


def body_words(body="body"):
    """Words of a whole text, as often as they stand there."""
    return F.filter(F.split(F.lower(body), T.NON_WORD), lambda t: t != "")


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """An index of files below a root. fields: {name: array<string> expression over the columns of files}.

    A field may also be (name, f): for each distinct word of another one, f (in Python) gives the word that a file then
    holds, once however many words give it, or None; so f is called for words of many files once.
    A field without words in a file doesn't count the file (BM25's number and mean length are of files with words).
    Paths are unique; null words are left out. reads: the columns of files that fields hang on; a refresh compares them,
    or else all words.
    """

    def __init__(self, spark, root, fields=None, reads=None):
        self.spark, self.versions = spark, Versions(spark, root)
        self.fields, self.reads = fields or {"body": body_words()}, reads

    # --- writing

    def build(self, files):
        """Index all files anew, in one segment."""
        return self._commit({}, self._segment(files, 0))

    def refresh(self, files):
        """Index the files (all that there are now) that are new or have changed; returns (added, changed, removed).

        Each refresh that finds any adds a segment, which every search reads; beyond SEGMENTS they are made one.
        """
        tables = self.versions.tables()
        if not tables:
            raise ValueError("nothing is indexed yet")
        marked = cut(self._marked(files).select("path", "mark"))
        live = self._live()
        both = live.select("segment", "block", "doc", "path", F.col("mark").alias("was")).join(marked, "path", "full")
        both = cut(both.where(F.col("was").isNull() | F.col("mark").isNull() | (F.col("was") != F.col("mark"))).select("path", *_PLACE, F.col("was").isNull().alias("new"), F.col("mark").isNull().alias("gone")))
        counts = both.agg(F.count_if("new"), F.count_if(~F.col("new") & ~F.col("gone")), F.count_if("gone")).first()
        if not any(counts):
            return tuple(counts)
        if len(tables["docs"]) >= SEGMENTS:
            self.build(files)
            return tuple(counts)
        segment = len(tables["docs"]) - 1
        fresh = files.join(both.where(~F.col("gone")).select("path"), "path", "left_semi")
        new = self._segment(fresh, segment + 1)
        replaced = both.where(~F.col("new")).select(*_PLACE)
        gone = self.versions.write("gone", replaced)
        lens = self._lengths(self.versions.read("postings")).join(replaced, _PLACE)
        new["stats"] = [*new["stats"], self.versions.write("stats", self._stats(lens, -1))]
        self._commit(tables, new | {"gone": [gone]})
        return tuple(counts)

    def _plain(self):
        """Numbers of the fields that are expressions."""
        return [i for i, e in enumerate(self.fields.values()) if not isinstance(e, tuple)]

    def _words(self, files):
        """files with the words of field i, if it is an expression, as _w{i}."""
        every = list(self.fields.values())
        return files.withColumns({f"_w{i}": every[i] for i in self._plain()})

    def _marked(self, files):
        """files with mark: equal as long as what is indexed of a file is. Nulls and the ends of arrays count, which a hash by itself leaves out."""
        if self.reads is None:
            files, seen = self._words(files), [x for i in self._plain() for x in (F.size(f"_w{i}"), F.col(f"_w{i}"))]
        else:
            seen = [x for c in self.reads for x in (F.col(c).isNull(), F.col(c))]
        return files.withColumn("mark", F.xxhash64(*seen))

    def _segment(self, files, segment):
        n = files.count()
        block = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(max(1, -(-n // BLOCK)))).cast("int")
        # files are numbered within their block: small numbers cost a byte where hashes cost eight
        number = lambda block: F.row_number().over(Window.partitionBy(block).orderBy("path"))
        table = self._marked(files).select(F.lit(segment).alias("segment"), block.alias("block"), "path", "mark")
        table = table.select("segment", "block", number("block").alias("doc"), "path", "mark")
        path = self.versions.write("docs", table.sortWithinPartitions("block"))
        kept = self.spark.read.schema(table.schema).parquet(path)
        if kept.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError("a path stands twice")
        # texts go to the task of their block, which counts words and writes postings: they are many times the texts, and no shuffle takes them
        parts = max(1, min(-(-n // BLOCK), max(self.spark.sparkContext.defaultParallelism, -(-n // (TASK * BLOCK)))))
        held = self._words(files.withColumn("_block", block).repartition(parts, "_block").withColumn("_doc", number("_block")))
        held = held.select("_block", "_doc", *(f"_w{i}" for i in self._plain()))
        made = [(list(self.fields).index(e[0]), e[1]) if isinstance(e, tuple) else None for e in self.fields.values()]
        rows = held.mapInArrow(_counting(made, _LISTS, AT_ONCE), _POSTINGS)
        rows = rows.select(F.lit(segment).alias("segment"), "*", bucket_of(F.col("term")).alias("bucket")).sortWithinPartitions("bucket", "field", "term")
        postings = self.versions.write("postings", rows, ["bucket"])
        lens = self._lengths(self.spark.read.schema(rows.schema).parquet(postings))
        return {"docs": [path], "postings": [postings], "stats": [self.versions.write("stats", self._stats(lens, 1))]}

    def _lengths(self, postings):
        """(field, segment, block, doc, len) of all files with words, live or not."""
        every = postings.where((F.col("bucket") == bucket_of(F.lit(None).cast("string"))) & F.col("term").isNull())
        return _heads(every, "field").select("field", "segment", "block", _each()).drop("tf")

    def _stats(self, lens, sign):
        return lens.groupBy("field").agg((sign * F.count("*")).alias("n"), (sign * F.sum(F.col("len").cast("long"))).alias("total")).coalesce(1)

    def _commit(self, tables, new):
        base = (self.versions.numbers() or [0])[-1]
        return self.versions.publish({k: [*tables.get(k, []), *new.get(k, [])] for k in {*tables, *new}}, base)

    # --- reading

    def _gone(self):
        return self.versions.read("gone") if "gone" in self.versions.tables() else None

    def _live(self):
        docs, gone = self.versions.read("docs"), self._gone()
        return docs if gone is None else docs.join(gone, _PLACE, "left_anti")

    def postings(self, terms, field="body"):
        """Rows of the postings of terms (a DataFrame with a column term): one partition filter, and one on the terms where few are asked for."""
        asked = terms.select("term").distinct()
        buckets = [r[0] for r in asked.select(bucket_of(F.col("term"))).distinct().collect()]  # BUCKETS at most
        some = [r[0] for r in asked.limit(LISTED + 1).collect()]
        rows = self.versions.read("postings").where(F.col("bucket").isin(buckets) & (F.col("field") == list(self.fields).index(field)))
        return _heads(rows.where(F.col("term").isin(some)) if len(some) <= LISTED else rows.join(asked, "term", "left_semi"), "term")

    def entries(self, terms, field="body"):
        """(term, segment, block, doc, tf, len) of the live files that hold terms."""
        rows = self.postings(terms, field).select("term", "segment", "block", _each())
        gone = self._gone()
        return rows if gone is None else rows.join(gone, _PLACE, "left_anti")

    def vocabulary(self, field="body"):
        """(term) of a field; some may stand in replaced files only."""
        return self.versions.read("postings").where((F.col("field") == list(self.fields).index(field)) & F.col("term").isNotNull()).select("term").distinct()

    def matches(self, asked):
        """(query_id, path, a column of each field: its terms that the file holds) of the files that hold any; asked: {field: (query_id, term)}."""
        one = lambda field, terms: self.entries(terms, field).join(terms.select("query_id", "term").distinct(), "term").select("query_id", *_PLACE, F.lit(field).alias("field"), "term")
        found = reduce(DataFrame.unionByName, (one(field, terms) for field, terms in asked.items())).groupBy("query_id", *_PLACE)
        return self._named(found.agg(*(F.collect_set(F.when(F.col("field") == field, F.col("term"))).alias(field) for field in asked)))

    def _named(self, found):
        return found.join(self.versions.read("docs").select(*_PLACE, "path"), _PLACE).drop(*_PLACE)

    def _totals(self, field):
        """One row: n files with words, and their mean length."""
        s = self.versions.read("stats").where(F.col("field") == list(self.fields).index(field))
        return s.agg(F.sum("n").alias("N"), (F.sum("total") / F.sum("n")).alias("mean"))

    def _frequencies(self, terms, field):
        """(term, df): live files of each term, from the counts of its blocks; only where files were replaced, entries are read."""
        heads = self.postings(terms, field).groupBy("term").agg(F.sum("n").alias("df"))
        gone = self._gone()
        if gone is None:
            return heads
        dead = self.postings(terms, field).join(gone.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
        dead = dead.select("term", "segment", "block", _each()).join(gone, _PLACE, "left_semi").groupBy("term").agg(F.count("*").alias("dead"))
        return heads.join(dead, "term", "left").select("term", (F.col("df") - F.coalesce("dead", F.lit(0))).alias("df")).where("df > 0")

    def _weights(self, terms, field):
        """(query_id, term, idf, mean) of the terms that stand anywhere."""
        one = self._totals(field)
        w = terms.select("query_id", "term").distinct().join(self._frequencies(terms, field), "term").crossJoin(F.broadcast(one))
        return cut(w.select("query_id", "term", F.log1p((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean"))

    def bm25(self, queries, field="body", k1=1.2, b=0.75):
        """(query_id, path, score) of all files that hold a word of a query (query_id, query); any number of queries."""
        terms = queries.select("query_id", F.explode(T.query_tokens(F.col("query"))).alias("term"))
        weights = self._weights(terms, field)
        r = self.entries(terms, field).join(weights, "term").withColumn("part", _part("tf", "len", k1, b))
        return self._named(r.groupBy("query_id", *_PLACE).agg(F.sum("part").alias("score")))

    def top(self, queries, k=10, field="body", k1=1.2, b=0.75):
        """(query_id, path, score, rank): the k best files of each query by BM25, ties by path; blocks that can't hold any are skipped.

        A block's bound adds up what its terms could give at most. The best blocks of each query are scored first; of
        the others only those whose bound reaches the kth score that was found there.
        """
        terms = queries.select("query_id", F.explode(T.query_tokens(F.col("query"))).alias("term"))
        weights = self._weights(terms, field)
        heads = self.postings(terms, field).select("term", "segment", "block", "most", "least", "n").join(weights, "term")
        bounds = cut(heads.groupBy("query_id", "segment", "block").agg(F.sum(_part("most", "least", k1, b)).alias("bound"), F.max("n").alias("n")))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        first = cut(bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("query_id", "segment", "block"))

        def scored(blocks):
            wanted = blocks.join(weights, "query_id")
            r = self.postings(terms, field).join(wanted, ["term", "segment", "block"]).select("query_id", "segment", "block", "idf", "mean", _each())
            gone = self._gone()
            r = r if gone is None else r.join(gone, _PLACE, "left_anti")
            return r.groupBy("query_id", *_PLACE).agg(F.sum(_part("tf", "len", k1, b)).alias("score"))

        some = cut(scored(first))
        kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
        floor = some.withColumn("at", F.row_number().over(kth)).where(F.col("at") == k).select("query_id", (F.col("score") * (1 - 1e-9)).alias("floor"))
        rest = bounds.join(first, ["query_id", "segment", "block"], "left_anti").join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        self.skipped = bounds.count() - first.count() - (rest := cut(rest.select("query_id", "segment", "block"))).count()
        both = some.union(scored(rest))
        worst = both.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor")
        named = self._named(worst)
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "path")
        return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "path", "score", "rank")


def _zipped(name):
    return F.inline(F.arrays_zip(*(f"{name}.{c}" for c in _LISTS[name])))


def _heads(rows, key):
    """Rows of the postings, one for each block: (key, segment, block, n, most, least, entries)."""
    rows = rows.select(key, "segment", "entries", _zipped("heads"))
    return rows.withColumn("entries", F.struct(*(F.slice(f"entries.{c}", F.col("at"), F.col("n")).alias(c) for c in _LISTS["entries"]))).drop("at")


def _each():
    """The entries of rows as rows (doc, tf, len)."""
    return _zipped("entries")


def _counting(made, lists, most_entries):
    """The postings of files in the order of their blocks, from their words (_block, _doc, _w0, ...); made: for each field None, or of which other one it is made, and how."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def of_files(batch, dictionary, both, tf):
            """Words of a field, and for each word of each file: its place among them, block, doc, tf, len; for each file with words (block, doc, len); and the files of the words."""
            block, doc = (batch.column(c).to_numpy().astype("int32") for c in ("_block", "_doc"))
            word, file = np.divmod(both, len(doc))
            length = np.bincount(file, weights=tf, minlength=len(doc)).astype("int32")
            some = np.flatnonzero(length)
            return dictionary, word.astype("int32"), block[file], doc[file], tf.astype("int32"), length[file], block[some], doc[some], length[some], file

        def words(batch, field):
            lists = batch.column(f"_w{field}")
            flat, at = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
            if flat.null_count:
                at, flat = at[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
            coded = flat.dictionary_encode()
            return of_files(batch, coded.dictionary, *np.unique(coded.indices.to_numpy().astype("int64") * batch.num_rows + at, return_counts=True))

        def others(batch, found, f, known):
            if len(known) > 500_000:
                known.clear()
            old = found[0].to_pylist()
            known.update((w, f(w)) for w in old if w not in known)
            coded = pa.array([known[w] for w in old], pa.string()).dictionary_encode()
            place = coded.indices.fill_null(-1).to_numpy()[found[1]].astype("int64")
            both = np.unique((place * batch.num_rows + found[9])[place >= 0])
            return of_files(batch, coded.dictionary, both, np.ones(len(both), "int32"))

        def rows(field, held):
            ends = np.cumsum([0, *(len(x[0]) for x in held)])
            coded = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
            place, null = coded.indices.to_numpy(), len(coded.dictionary)
            joined = lambda *a: np.concatenate(a)
            word = joined(*(place[x[1] + e] for x, e in zip(held, ends)), *(np.full(len(x[6]), null, "int32") for x in held))
            # files come in the order of their blocks, which this one keeps
            order = np.argsort(word, kind="stable")
            word, block, doc = word[order], joined(*(x[2] for x in held), *(x[6] for x in held))[order], joined(*(x[3] for x in held), *(x[7] for x in held))[order]
            tf, length = joined(*(x[4] for x in held), *(np.zeros(len(x[6]), "int32") for x in held))[order], joined(*(x[5] for x in held), *(x[8] for x in held))[order]
            at = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))  # heads
            first = np.searchsorted(word, np.arange(null + 2))  # entries of each word
            heads = {"block": block[at], "at": at - first[word[at]] + 1, "n": np.diff(at, append=len(word)), "most": np.maximum.reduceat(tf, at), "least": np.minimum.reduceat(length, at)}
            listed = {"heads": (np.searchsorted(word[at], np.arange(null + 2)), heads), "entries": (first, {"doc": doc, "tf": tf, "len": length})}
            ints = lambda x: pa.array(x, pa.int32())
            structs = [pa.StructArray.from_arrays([pa.ListArray.from_arrays(ints(listed[k][0]), ints(listed[k][1][c])) for c in each], list(each)) for k, each in lists.items()]
            terms = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
            return pa.table([pa.repeat(pa.scalar(field, pa.int32()), null + 1), terms, *structs], ["field", "term", *lists]).to_batches(20_000)

        held, known, n = {}, {}, 0

        def given():
            for field in list(held):
                yield from rows(field, held.pop(field))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece, found = batch.slice(start, 256), {}
                for field in sorted(range(len(made)), key=lambda i: made[i] is not None):
                    found[field] = words(piece, field) if made[field] is None else others(piece, found[made[field][0]], made[field][1], known.setdefault(field, {}))
                for field, x in found.items():
                    if len(x[1]):
                        held.setdefault(field, []).append(x[:9])
                        n += len(x[1])
                if n >= most_entries:
                    yield from given()
                    n = 0
        yield from given()

    return run


def _part(tf, length, k1, b):
    tf = F.col(tf)
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(length) / F.col("mean")))
