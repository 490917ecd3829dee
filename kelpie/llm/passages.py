"""Removal of passages that stand in earlier text, located by sharded Aho-Corasick automata.

Fingerprints propose which windows recur and where each first stands; windows that follow their source in step are one
passage, whose words are fetched from there. Documents are dealt to shards of bounded text, and a shard gets the phrases proposed for any of its documents. Each shard
compiles them into an Aho-Corasick automaton and streams all its documents through it: only what the automaton finds,
word for word, is removed. Windows that fingerprints propose within one document are compared there, word for word too.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import chunks, discard, quoted, ship, written
from .repeats import Anchors, Sequence, lists_of, shared_windows, text_tag, unpack
from .rolling import run_cover

WINDOW, SEED = 20, 8
#: Bytes of text in a shard, about.
SHARD_BYTES = 2 << 20
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _merge(proposed):
    """(doc, sdoc, stag, slo, n): runs of covered windows that follow their source in step, each as one passage of n windows.

    A passage that a document holds many times over (text of a short period falls out of step at every turn) comes once.
    """
    import pyarrow as pa

    per_doc = proposed.groupBy("doc").agg(*(F.collect_list(c).alias(c) for c in ("packed", "sdoc", "spacked")))

    def run(batches):
        for batch in batches:
            out = []
            for doc, packed, sdoc, spacked in zip(batch.column(0).to_pylist(), *(lists_of(batch.column(i)) for i in (1, 2, 3))):
                (tag, count, lo), (stag, _, slo) = unpack(packed), unpack(spacked)
                order = np.lexsort((lo, slo - lo, stag, sdoc, tag))
                tag, count, lo, sdoc, stag, slo = (x[order] for x in (tag, count, lo, sdoc, stag, slo))
                same = (tag[1:] == tag[:-1]) & (sdoc[1:] == sdoc[:-1]) & (stag[1:] == stag[:-1]) & (slo[1:] - lo[1:] == slo[:-1] - lo[:-1])
                first = np.flatnonzero(np.append(True, ~(same & (lo[1:] <= lo[:-1] + count[:-1]))))
                end = np.append(first[1:], len(lo)) - 1
                runs = np.unique(np.stack([sdoc[first], stag[first], slo[first], lo[end] + count[end] - lo[first]]), axis=1)
                out.append(np.concatenate([np.full((1, runs.shape[1]), doc), runs]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(out, axis=1)], ["doc", "sdoc", "stag", "slo", "n"])

    return per_doc.mapInArrow(run, "doc long, sdoc long, stag long, slo long, n long")


def _phrases(texts, passages, window):
    """passages (sdoc, stag, slo, n) with text: their words where they first stand."""
    import pyarrow as pa

    per_doc = passages.groupBy("sdoc").agg(*(F.collect_list(c).alias(c) for c in ("stag", "slo", "n")))
    per_doc = texts.hint("merge").join(per_doc, texts["doc"] == per_doc["sdoc"]).select("sdoc", "text", "stag", "slo", "n")

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                seq = Sequence(data, offs, "words")
                tags = text_tag(seq)
                raw = data.tobytes()
                rows = []
                for d, (doc, tag, lo, n) in enumerate(zip(part.column(0).to_pylist(), *(lists_of(part.column(i)) for i in (2, 3, 4)))):
                    for t, i, k in zip(tag.tolist(), lo.tolist(), n.tolist()):
                        if t == tags[d]:
                            at = seq.at[d] + i
                            rows.append((doc, t, i, k, b" ".join(raw[seq.start[at] : seq.end[at + k + window - 2]].split()).decode()))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["sdoc", "stag", "slo", "n", "text"])

    return per_doc.mapInArrow(run, "sdoc long, stag long, slo long, n long, text string")


def _again(starts, keys, words, window):
    """Of the window starts (all of some fingerprints, in order) those whose words stood at an earlier one."""
    seen, out = set(), []
    for p, key in zip(starts, keys):
        text = (key, *words[p : p + window])
        if text in seen:
            out.append(p)
        seen.add(text)
    return np.array(out, np.int64)


class _Shard:
    """Phrases of one shard, then its documents."""

    def __init__(self):
        self.first = {}
        self.automaton = None

    def add(self, phrase, doc):
        have = self.first.get(phrase)
        if have is None or doc < have:
            self.first[phrase] = doc

    def starts(self, doc, words):
        """(first word, words) of each phrase found in a document that first stands in one of a smaller id."""
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for phrase, first in self.first.items():
                self.automaton.add_word(f" {phrase} ", (first, len(phrase) + 2, phrase.count(" ") + 1))
            self.automaton.make_automaton()
        if doc is None or not self.first or not words:
            return []
        found = [(end + 1 - length, n) for end, (first, length, n) in self.automaton.iter(f" {' '.join(words)} ") if first < doc]
        if not found:
            return []
        at = np.cumsum([0, *(len(w) + 1 for w in words)])
        return [(int(i), n) for i, (_, n) in zip(np.searchsorted(at, [f[0] for f in found]), found)]


def remove_passages(docs, window=WINDOW, seed=SEED, id_col="doc_id", text_col="text", carry=(), with_text=False):
    """Remove every word that a window of `window` words covers whose words also start earlier.

    Earlier: in a document with a smaller id, or before it in the same one. Returns id_col, n_words, n_removed,
    kept_sha256, the columns in carry and, with_text, kept_text (the text itself where nothing is removed, else the kept
    words joined by one space). Null and short texts lose nothing. Rows that repeat an id are each judged against
    smaller ids and against themselves, not against each other; null ids against themselves only. Columns in carry may
    not bear the names of the results (ValueError; pack them into a struct); other columns are never read, and any
    may bear any name. A text is worked on whole, at some 100 bytes of a worker's memory a byte.
    """
    if clash := {id_col, "n_words", "n_removed", "kept_sha256", "kept_text"} & set(carry):
        raise ValueError(f"columns to carry have names of the results: {sorted(clash)}")
    plain = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"), *(F.col(quoted(c)).alias(p) for c, p in zip(carry, plain)))
    found = _remove(rows, window, seed, "_id", "_text", plain, with_text)
    names = dict(zip(["_id", *plain], [id_col, *carry]))
    return found.select(*(F.col(c).alias(names.get(c, c)) for c in found.columns))


def _remove(docs, window, seed, id_col, text_col, carry, with_text):
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)

    def keys(seq, p):
        return seq.windows(p, window, 0), seq.windows(p, window, 1)

    runs, windows, scratch = shared_windows(docs, id_col, text_col, "words", window, seed, keys)
    proposed = runs.union(windows)
    sources = proposed.where("first").groupBy("key").agg(F.min("doc").alias("sdoc"), F.min("packed").alias("spacked"))
    sources = written(sources, "sources")
    merged = written(_merge(proposed.where("covered").select("doc", "packed", "key").join(sources, "key")), "merged")
    discard(sources)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    place = ["sdoc", "stag", "slo", "n"]
    phrases = written(_phrases(texts, merged.select(*place).distinct(), window), "phrases")
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    discard(*scratch)
    shards = max(1, -(-int(size) // SHARD_BYTES))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    wanted = merged.select(shard(F.col("doc")).alias("shard"), *place).distinct()
    carried = F.struct(F.col(id_col).alias("id"), *(F.col(c) for c in carry))
    none = F.lit(None).cast(docs.select(carried.alias("c")).schema["c"].dataType)
    told = wanted.join(phrases, place).select("shard", F.lit(0).alias("kind"), F.col("sdoc").alias("doc"), "text", none.alias("carried"))
    own = docs.select(F.coalesce(F.when(F.col(id_col).isNotNull(), shard(F.col(id_col).cast("long"))), shard(F.col(text_col))).alias("shard"), F.lit(1).alias("kind"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), carried.alias("carried"))
    rows = told.union(own).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches):
        here, shard_ = None, None
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                seq = Sequence(data, offs, "words")
                inside, keys = Anchors(seq, window, seed).repeated_inside(all_=True)
                inside_doc = seq.doc_of(inside)
                n, removed, sha, texts_, keep = [], [], [], [], []
                numbers, kinds, ids, column = (part.column(i).to_pylist() for i in range(4))
                for d, (number, kind, doc, text) in enumerate(zip(numbers, kinds, ids, column)):
                    if number != shard_:
                        here, shard_ = _Shard(), number
                    if kind == 0:
                        here.add(text, doc)
                        continue
                    words = _WORDS.findall(text or "")
                    lo, hi = np.searchsorted(inside_doc, [d, d + 1])
                    found = here.starts(doc, words)
                    again = _again((inside[lo:hi] - seq.at[d]).tolist(), keys[lo:hi].tolist(), words, window) if hi > lo else inside[:0]
                    gone = run_cover(again, window, len(words))
                    for i, k in found:
                        gone[i : i + k] = True
                    kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
                    joined = " ".join(kept)
                    keep.append(d)
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    texts_.append(text if len(kept) == len(words) else joined)
                if keep:
                    was = part.column(4).take(pa.array(keep))
                    cols = [was.field(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), *(was.field(1 + i) for i in range(len(carry)))]
                    if with_text:
                        cols.append(pa.array(texts_, pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "n_removed", "kept_sha256", *carry] + ["kept_text"] * with_text)

    kinds = docs.schema
    schema = StructType([StructField(id_col, kinds[id_col].dataType), *(StructField(c, t) for c, t in zip(("n_words", "n_removed", "kept_sha256"), (LongType(), LongType(), StringType()))), *(StructField(c, kinds[c].dataType) for c in carry), *[StructField("kept_text", StringType())][: int(with_text)]])
    return rows.mapInArrow(run, schema)
