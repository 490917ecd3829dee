"""License scan: exact phrases, and a fuzzy search for short notices.

A notice of which at most k edits are forgiven is cut into k + 1 pieces: wherever it occurs, one piece stands
unchanged (pigeonhole). The pieces are found exactly with an Aho-Corasick automaton over the normalised text, and
each candidate place is verified by the regex library's bounded-error matching, which also tells where it ends.
"""

from __future__ import annotations

import bisect

import numpy as np

from .common import chunks, quoted, ship
from .rolling import byte_prefix, doc_bounds, spans

#: Phrases and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices and their labels, as words in lower case. Fixed values.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def pieces(notice, k):
    """k + 1 stretches of the notice as (offset, text)."""
    cut = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


class Finder:
    """Finds phrases exactly and notices with a bounded share of edits."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, edits=0.1):
        import ahocorasick
        import regex

        self.phrases = []
        for phrase, label in phrases.items():
            raw = phrase.encode()
            ends = np.cumsum([len(w) + 1 for w in phrase.split()])
            starts = np.concatenate([[0], ends[:-1]])
            self.phrases.append((label, spans(byte_prefix(np.frombuffer(raw, np.uint8), 0), starts, ends - 1, 0)))
        self.notices, found = [], {}
        for n, (notice, label) in enumerate(notices.items()):
            k = max(1, int(edits * len(notice)))
            self.notices.append((notice, label, k, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            for at, piece in pieces(notice, k):
                found.setdefault(piece, []).append((n, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in found.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def fuzzy(self, text):
        """(label, start, end, edits, share kept) of each place of a notice in normalised text; places of one notice don't overlap."""
        out, windows = [], {}
        for end, (length, where) in self.seeds.iter(text):
            for n, at in where:
                k = self.notices[n][2]
                start = end + 1 - length - at
                windows.setdefault(n, []).append((max(0, start - k), start + len(self.notices[n][0]) + k))
        for n, ranges in windows.items():
            lo, hi = 0, 0
            for a, b in [*sorted(ranges), (1 << 62, 1 << 62)]:
                if a <= hi:
                    hi = max(hi, b)
                else:
                    out += self._places(n, text, lo, min(hi, len(text)))
                    lo, hi = a, b
        return out

    def _places(self, n, text, lo, hi):
        """Every place of notice n in text[lo:hi]: the best one first, then what is left and right of it.

        A long stretch is searched in overlapping slices, so that the work stays in proportion to its length.
        """
        notice, label, k, pattern = self.notices[n]
        out, todo, most = [], [(lo, hi)], len(notice) + k
        while todo:
            a, b = todo.pop()
            if b - a < len(notice) - k:
                continue
            at = text.find(notice, a, b)  # unchanged: nothing to forgive
            if at >= 0:
                found = (label, at, at + len(notice), 0, 1.0)
            elif b - a > 8 * most:
                todo += [(x, min(x + 8 * most, b)) for x in range(a, b - most, 7 * most)]
                continue
            elif m := pattern.search(text, a, b):
                edits = sum(m.fuzzy_counts)
                found = (label, m.start(), m.end(), edits, 1 - edits / len(notice))
            else:
                continue
            out.append(found)
            todo += [(a, found[1]), (found[2], b)]
        # slices overlap: of places that do, the best stays
        kept = []
        for f in sorted(set(out), key=lambda f: (f[3], f[1], f[2])):
            i = bisect.bisect(kept, f[1], key=lambda g: g[1])
            if (i == 0 or kept[i - 1][2] <= f[1]) and (i == len(kept) or f[2] <= kept[i][1]):
                kept.insert(i, f)
        return kept


def scan(docs, phrases=PHRASES, notices=NOTICES, edits=0.1, id_col="doc_id", text_col="text"):
    """License words of every whole text.

    Returns id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (array<struct<label, first_word, n_words, edits>>, the notices that were found). A null text is empty: no words,
    null places, empty labels, score 0. score: 1 for an exact phrase, else the share of the best notice that stands
    unedited. Of equally good places of a notice that overlap, the first stays; a very long text is searched whole.
    Repeated rows are each scanned; other columns are never read.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])

    def run(batches):
        finder = Finder(phrases, notices, edits)
        for batch in batches:
            for part, data, offs in chunks(batch, text_col):
                n = part.num_rows
                low = _LOWER[data]
                solid = _WORD[low]
                opens = solid.copy()
                opens[1:] &= ~solid[:-1]
                opens[offs[:-1][offs[:-1] < len(data)]] = solid[offs[:-1][offs[:-1] < len(data)]]
                closes = solid.copy()
                closes[:-1] &= ~solid[1:]
                last = offs[1:][offs[1:] > 0] - 1
                closes[last] = solid[last]
                start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                doc = np.searchsorted(offs, start, "right") - 1
                at = doc_bounds(doc, n)
                key = spans(byte_prefix(low, 0), start, end, 0)
                base = [[] for _ in range(n)]
                for label, words in finder.phrases:
                    m = len(words)
                    if len(key) < m:
                        continue
                    hit = doc[: len(doc) - m + 1] == doc[m - 1 :]
                    for i, w in enumerate(words):
                        hit &= key[i : len(key) - m + 1 + i] == w
                    for i in np.flatnonzero(hit).tolist():
                        base[doc[i]].append((i - at[doc[i]], label))
                # words separated by single spaces, all at once
                gap = np.zeros(len(low), bool)
                gap[1:] = ~solid[1:] & solid[:-1]
                gap[offs[:-1][offs[:-1] < len(data)]] = False
                keep = solid | gap
                flat = np.where(solid, low, 32).astype(np.uint8)[keep]
                where = np.concatenate([[0], np.cumsum(keep)])[offs]
                rows = {k: [] for k in ("n_base", "first", "last", "base", "labels", "score", "spans")}
                for d in range(n):
                    text = flat[where[d] : where[d + 1]].tobytes().decode("utf-8", "replace")
                    found = sorted(finder.fuzzy(text), key=lambda f: (f[1], f[2], f[0]))
                    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32) if found else None
                    words = [np.searchsorted(gaps, f[1:3]).tolist() for f in found]
                    places = [p for p, _ in base[d]]
                    own = {label for _, label in base[d]}
                    rows["n_base"].append(len(places))
                    rows["first"].append(min(places, default=None))
                    rows["last"].append(max(places, default=None))
                    rows["base"].append(",".join(sorted(own)))
                    rows["labels"].append(",".join(sorted(own | {f[0] for f in found})))
                    rows["score"].append(1.0 if own else max((f[4] for f in found), default=0.0))
                    rows["spans"].append([{"label": f[0], "first_word": a, "n_words": b - a + 1, "edits": f[3]} for f, (a, b) in zip(found, words)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at), pa.int64()), *(pa.array(rows[k], pa.int64()) for k in ("n_base", "first", "last")), *(pa.array(rows[k], pa.string()) for k in ("base", "labels")), pa.array(rows["score"], pa.float64()), pa.array(rows["spans"], pa.list_(span))],
                    [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:int>>")
