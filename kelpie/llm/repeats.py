"""Repeated windows: which runs of L symbols also start earlier in a corpus.

Symbols are bytes or words. A window's anchor is its least seed (a run of K symbols, by fingerprint; the leftmost of
equals), so equal windows have equal anchors at equal offsets, and neighbouring windows share one: there are about
2 / (L - K + 2) anchors per symbol. An anchor's context is the text of all its windows. This narrows the search
without loss: a seed that stands in one document only can't belong to a window shared by two; anchors of equal
context have equal windows throughout; only windows of seeds with several contexts must be told apart one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .common import chunks, discard, written
from .rolling import byte_prefix, doc_bounds, mix, prefix, repeated, run_cover, sliding_min, spans, words

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


class _Prefixes(dict):
    """Prefix sums by number of their base, made when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, k):
        self[k] = out = self.make(k)
        return out


class Sequence:
    """Concatenated texts as symbols: values, and offsets of the documents counted in symbols."""

    def __init__(self, data, offs, by):
        self.data, self.offs, self.n_docs, self.by = data, offs, len(offs) - 1, by
        if by == "bytes":
            self.pre = _Prefixes(lambda k: byte_prefix(data, k))
            self.at, self.n = offs, len(data)
        else:
            self.start, self.end, doc = words(data, offs)
            values = spans(byte_prefix(data, 0), self.start, self.end, 0)
            self.values = values
            self.pre = _Prefixes(lambda k: prefix(mix(values) if k else values, k))
            self.at, self.n = doc_bounds(doc, self.n_docs), len(values)

    def windows(self, p, length, k=0):
        """Fingerprints of the windows that start at p."""
        return spans(self.pre[k], p, p + length, k)

    def seeds(self, length):
        """Hashes of all runs of `length` symbols: equal for equal ones, and cheap; unlike ones may agree now and then."""
        n = self.n - length + 1
        if self.by == "bytes":
            if length < 8:
                return self.windows(np.arange(n), length)
            units = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, 8)).view(np.uint64).ravel()
            places = [*range(0, length - 8, 8), length - 8]
        else:
            units, places = self.values, range(length)
        out = np.empty(n, _U)
        for a in range(0, n, 1 << 15):
            b = min(n, a + (1 << 15))
            x = np.zeros(b - a, _U)
            for i, place in enumerate(places):
                x += units[a + place : b + place] * _FACTORS[i % len(_FACTORS)]
            out[a:b] = mix(x)
        return out

    def doc_of(self, p):
        return np.searchsorted(self.at, p, "right") - 1


class Anchors:
    """The anchors of a sequence, in order: seed, context, doc, first window and number of windows."""

    def __init__(self, seq, length, seed):
        self.seq, self.length = seq, length
        width, n = length - seed + 1, seq.n
        if n < length:
            self.x = self.lo = self.count = self.doc = np.zeros(0, np.int64)
            self.seed = self.context = np.zeros(0, _U)
            return
        seeds = seq.seeds(seed)
        packed = (seeds & ~_U(0xFFFFFFFF)) | np.arange(len(seeds), dtype=_U)
        anchor = (sliding_min(packed, width) & _U(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(seq.n_docs), np.diff(seq.at))
        p = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
        anchor = anchor[p]
        first = np.ones(len(p), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
        run = np.flatnonzero(first)
        self.x, self.lo = anchor[run], p[run]
        self.count = np.diff(np.append(run, len(p)))
        self.doc = doc[self.lo]
        self.seed = seeds[self.x]
        offset = (self.x - self.lo).astype(_U)
        self.context = mix(spans(seq.pre[1], self.lo, self.lo + self.count - 1 + length, 1) ^ (offset * _GOLD))

    def starts(self, which):
        """All window starts of the given anchors."""
        count = self.count[which]
        return np.repeat(self.lo[which] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else self.lo[which], count) + np.arange(count.sum())

    def repeated_inside(self, all_=False):
        """Window starts whose window also starts earlier in the same document, by fingerprint.

        all_: instead the starts of every window that stands twice in its document, in order, and their fingerprints.
        """
        _, often = repeated(self.seed ^ mix(self.doc.astype(_U) + _U(1)))
        p = self.starts(np.flatnonzero(often))
        keys = self.seq.windows(p, self.length) ^ mix(self.seq.doc_of(p).astype(_U) + _U(1))
        before, often = repeated(keys)
        if all_:
            order = np.argsort(p[often], kind="stable")
            return p[often][order], keys[often][order]
        return p[before]


def covered(seq, starts, length):
    """Mask of the symbols that the windows at starts cover."""
    return run_cover(starts, length, seq.n)


def text_tag(seq):
    """26 bits of each document's whole content: tells rows that repeat an id apart."""
    return (spans(seq.pre[1], seq.at[:-1], seq.at[1:], 1) >> _U(38)).astype(np.int64)


#: Windows that a run may have: its count takes 7 bits.
MOST_WINDOWS = 127


def pack(tag, count, lo):
    """One number for a run of windows: 26 bits of tag, 7 of count, 31 of the first start."""
    return (tag.astype(np.int64) << 38) | (count.astype(np.int64) << 31) | lo.astype(np.int64)


def unpack(packed):
    packed = np.asarray(packed, np.int64)
    return (packed >> 38) & 0x3FFFFFF, (packed >> 31) & 0x7F, packed & 0x7FFFFFFF


def _anchor_rows(docs, id_col, text_col, by, length, seed):
    """(s, f, doc, packed) of every anchor: seed, context, document and windows. Documents with a null id have none."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, text_col, 1 << 20):
                seq = Sequence(data, offs, by)
                a = Anchors(seq, length, seed)
                tag = text_tag(seq)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(a.seed.view(np.int64)), pa.array(a.context.view(np.int64)), pa.array(ids[a.doc], pa.int64()), pa.array(pack(tag[a.doc], a.count, a.lo - seq.at[a.doc]))], ["s", "f", "doc", "packed"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "s long, f long, doc long, packed long")


def _runs(lists, tag, d):
    """The packed runs of row d that belong to its text, as (which, count, lo)."""
    t, count, lo = unpack(lists)
    which = np.flatnonzero(t == tag[d])
    return which, count[which], lo[which]


def lists_of(column):
    """An Arrow list<long> column as one numpy array per row (nulls: empty)."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat, offs = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(offs)[:-1]) if len(offs) else []


def _probes(asked, by, length, seed, levels):
    """(key, doc, packed, bit): what stands left and right of open anchors, at growing lengths."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                seq = Sequence(data, offs, by)
                a = Anchors(seq, length, seed)
                tag = text_tag(seq)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                which = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(a.lo, seq.at[d] + _runs(wanted, tag, d)[2]) for d, wanted in enumerate(lists_of(part.column(2))))]).astype(np.int64)
                keys, at, bits = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for bit, (side, size) in enumerate(levels):
                    x, lo, last = a.x[which], a.lo[which], a.lo[which] + a.count[which] - 1
                    fits = which[(x - lo >= size) if side < 0 else (length - (x - last) >= size)]
                    x = a.x[fits]
                    text = spans(seq.pre[0], x - size, x, 0) if side < 0 else spans(seq.pre[0], x, x + size, 0)
                    keys.append(mix(a.seed[fits] ^ mix(text + _U(bit + 1))))
                    at.append(fits)
                    bits.append(np.full(len(fits), bit))
                keys, at, bits = map(np.concatenate, (keys, at, bits))
                doc = a.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(pack(tag[doc], a.count[at], a.lo[at] - seq.at[doc])), pa.array(bits, pa.int32())], ["key", "doc", "packed", "bit"])

    return asked.mapInArrow(run, "key long, doc long, packed long, bit int")


def shared_windows(docs, id_col, text_col, by, length, seed, window_keys, levels=()):
    """Tables of what is repeated across documents, before text is compared again.

    Returns (runs, windows, scratch tables they read): runs (doc, packed, key, first, covered) for anchors whose context stands in several
    documents, windows (doc, packed, key, first, covered) likewise for single windows of seeds with several contexts.
    covered: it also stands in a document with a smaller id. first: it stands in no smaller one.
    window_keys(seq, p) gives two fingerprints of the windows at p. levels: (side, size) steps, growing on each side
    (-1: left of the seed, 1: from its start on), at which open anchors are ranked before their windows are: where no
    other document agrees over `size` symbols, no window that reaches so far is repeated. The least left and right
    steps add up to length + 1 at most.
    """
    import pyarrow as pa

    if not 0 < seed <= length or length - seed + 1 > MOST_WINDOWS:
        raise ValueError(f"the seed must be 1 to {MOST_WINDOWS - 1} symbols shorter than the window, or as long")
    rows = lambda: _anchor_rows(docs, id_col, text_col, by, length, seed)  # noqa: E731  computed twice: cheaper than keeping it
    seeds = rows().groupBy("s").agg(F.min("doc").alias("m"), F.max("doc").alias("most"), F.min("f").alias("f0"), F.max("f").alias("f1"))
    seeds = written(seeds.where(F.col("m") < F.col("most")).select("s", (F.col("f0") != F.col("f1")).alias("several")), "seeds")
    shared = anchors = written(rows().hint("merge").join(seeds, "s"), "anchors")
    discard(seeds)
    contexts = shared.groupBy("s", "f").agg(F.min("doc").alias("m"), F.max("doc").alias("most"))
    contexts = written(contexts, "contexts")
    shared = shared.hint("merge").join(contexts, ["s", "f"]).select("doc", "packed", F.col("f").alias("key"), "several", (F.col("doc") == F.col("m")).alias("first"), (F.col("m") < F.col("most")).alias("again"), (F.col("doc") > F.col("m")).alias("covered"))
    shared = written(shared, "shared")
    discard(anchors, contexts)

    # windows of seeds with several contexts, where the context is new
    per_doc = shared.where(F.col("several") & F.col("first")).groupBy("doc").agg(F.collect_list("packed").alias("open"))
    # merge joins at every size: whether what is asked for would fit a broadcast hangs on the data
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).hint("merge")
    if levels:
        probes = written(_probes(texts.join(per_doc.select("doc", "open"), "doc"), by, length, seed, levels), "probes")
        agreed = probes.groupBy("key").agg(F.min("doc").alias("m"), F.max("doc").alias("most"))
        agreed = written(agreed.where(F.col("m") < F.col("most")).select("key"), "agreed")
        keys = agreed
        agreed = probes.hint("merge").join(keys, "key").groupBy("doc").agg(F.collect_list("packed").alias("packed"), F.collect_list(F.col("bit").cast("long")).alias("bits"))
        per_doc = written(per_doc.join(agreed, "doc"), "open")
        discard(probes, keys)
    else:
        per_doc = per_doc.withColumn("packed", F.array().cast("array<long>")).withColumn("bits", F.array().cast("array<long>"))
    asked = texts.join(per_doc.select("doc", "open", "packed", "bits"), "doc")

    def run(batches):
        left, right = ([(bit, size) for bit, (side, size) in enumerate(levels) if side == which] for which in (-1, 1))
        for batch in batches:
            for part, data, offs in chunks(batch, "text", 1 << 20):
                seq = Sequence(data, offs, by)
                a = Anchors(seq, length, seed)
                tag = text_tag(seq)
                agreed = np.zeros((len(levels), len(a.x)), bool)
                which = [np.zeros(0, np.int64)]
                for d, (wanted, packed, bits) in enumerate(zip(*(lists_of(part.column(i)) for i in (2, 3, 4)))):
                    which.append(np.searchsorted(a.lo, seq.at[d] + _runs(wanted, tag, d)[2]))
                    mine, _, lo = _runs(packed, tag, d)
                    agreed[bits[mine], np.searchsorted(a.lo, seq.at[d] + lo)] = True
                which = np.concatenate(which).astype(np.int64)
                # how far any other document agrees, at most
                reach = np.full((2, len(a.x)), length)
                for side, steps in enumerate((left, right)):
                    for bit, size in reversed(steps):
                        reach[side][~agreed[bit]] = size - 1
                p = a.starts(which)
                anchor = np.repeat(which, a.count[which])
                back = a.x[anchor] - p
                p = p[(back <= reach[0][anchor]) & (length - back <= reach[1][anchor])]
                k1, k2 = window_keys(seq, p)
                doc = seq.doc_of(p)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(pack(tag[doc], np.ones(len(p), np.int64), p - seq.at[doc]))], ["k1", "k2", "doc", "packed"])

    single = written(asked.mapInArrow(run, "k1 long, k2 long, doc long, packed long"), "windows")
    pairs = single.groupBy("k1", "k2").agg(F.min("doc").alias("m"), F.max("doc").alias("most"))
    pairs = written(pairs.where(F.col("m") < F.col("most")).select("k1", "k2", "m"), "pairs")
    windows = single.hint("merge").join(pairs, ["k1", "k2"]).select("doc", "packed", F.col("k1").alias("key"), (F.col("doc") == F.col("m")).alias("first"), (F.col("doc") > F.col("m")).alias("covered"))
    runs = shared.where("again").select("doc", "packed", "key", "first", "covered")
    windows = written(windows, "repeated")
    discard(single, pairs, *([per_doc] if levels else []))
    return runs, windows, [shared, windows]
