"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every whole text are computed once and written to the shared folder. A bounded sample of labelled
rows (`max_train`, the least by a hash of doc_id) goes to the driver, where the trees are grown on 64-bin
histograms; flattened into arrays they are broadcast, and every document is scored by a vectorised numpy walk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .common import chunks, discard, every_column, quoted, ship, written
from .rolling import byte_prefix, doc_bounds, prefix, repeated, spans, words

_SYMBOLS = [ord(c) for c in "#$%&*|!<>@_{}~^=+/\\"]
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "punctuation", "symbol", "non_ascii", "lines_per_word",
    "stops_per_word", "commas_per_word", "upper_words", "repeats_previous", "distinct_words", "dup_lines", "repeat_5grams",
    "hash", "dollar", "percent", "ampersand", "star", "bar", "bang", "longest_word", "mean_line_words",
)


def _table(codes):
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


_CLASSES = {
    "upper": _table(range(65, 91)),
    "lower": _table(range(97, 123)),
    "digit": _table(range(48, 58)),
    "punctuation": _table(c for c in range(33, 127) if not chr(c).isalnum()),
    "symbol": _table(_SYMBOLS),
    "non_ascii": _table(range(128, 256)),
    "newline": _table([10]),
    "stop": _table([ord("."), ord("?")]),
    "comma": _table([ord(",")]),
    "hash": _table([ord("#")]),
    "dollar": _table([ord("$")]),
    "percent": _table([ord("%")]),
    "ampersand": _table([ord("&")]),
    "star": _table([ord("*")]),
    "bar": _table([ord("|")]),
    "bang": _table([ord("!")]),
}


def statistics(data, offs):
    """FEATURES of each of the concatenated UTF-8 texts, as float32 rows."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    count = {k: np.diff(np.concatenate([[0], np.cumsum(t[data])])[offs]).astype(float) for k, t in _CLASSES.items()}
    start, end, doc = words(data, offs)
    at = doc_bounds(doc, n)
    n_words = np.diff(at).astype(float)
    w, b = np.maximum(n_words, 1), np.maximum(size, 1)
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
    pre = byte_prefix(data, 0)
    key = spans(pre, start, end, 0)
    upper = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
    same_doc = doc[1:] == doc[:-1]
    follows = np.zeros(len(key))
    if len(key) > 1:
        follows[1:] = (key[1:] == key[:-1]) & same_doc
    salted = key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again, _ = repeated(salted)
    long_repeat = np.zeros(len(key))
    if len(key) >= 5:
        pre5 = prefix(key, 1)
        five = spans(pre5, np.arange(len(key) - 4), np.arange(5, len(key) + 1), 1) + salted[: len(key) - 4]
        inside = doc[:-4] == doc[4:]
        again5, _ = repeated(np.where(inside, five, np.arange(len(five), dtype=np.uint64)))
        long_repeat[: len(five)] = again5 & inside
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offs[:-1][size > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    line_key = spans(pre, line_start, line_end, 0) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    dup, _ = repeated(line_key)
    dup_lines = np.bincount(line_doc[dup], minlength=n).astype(float)
    lines = np.maximum(np.bincount(line_doc, minlength=n).astype(float), 1)
    length = (end - start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    columns = [
        np.log1p(size), np.log1p(n_words), sums(length) / w, count["upper"] / b, count["lower"] / b, count["digit"] / b, count["punctuation"] / b, count["symbol"] / b, count["non_ascii"] / b, count["newline"] / w,
        count["stop"] / w, count["comma"] / w, sums((upper[end] - upper[start]) * 2 > (end - start)) / w, sums(follows) / w, 1 - sums(again) / w, dup_lines / lines, sums(long_repeat) / w,
        count["hash"] / b, count["dollar"] / b, count["percent"] / b, count["ampersand"] / b, count["star"] / b, count["bar"] / b, count["bang"] / b, longest, n_words / lines,
    ]
    return np.stack(columns, 1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


class Trees:
    """Boosted trees for a 0/1 label, flattened: node i of tree t splits on feature[t, i] at bin cut[t, i]."""

    def __init__(self, trees=80, depth=4, rate=0.15, bins=64, least=20, l2=1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.edges, self.base = None, 0.0
        self.feature = self.cut = self.value = None

    def _bin(self, x):
        x = np.nan_to_num(x, posinf=np.finfo(np.float32).max, neginf=np.finfo(np.float32).min)
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int64) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x, y):
        """Grow the trees. Without rows, or with one label only, every score is the (smoothed) share of label 1."""
        n = len(y)
        p = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(p / (1 - p)))
        m = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        inner = (1 << self.depth) - 1
        rounds = self.trees if 0 < y.sum() < n else 0
        self.feature, self.cut = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), self.bins, np.int64)
        self.value = np.zeros((rounds, inner + 1))
        binned, raw, b = self._bin(x), np.full(n, self.base), self.bins
        for t in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                for j in range(m):
                    at = node * b + binned[:, j]
                    g, h, c = (np.bincount(at, k, width * b).reshape(width, b).cumsum(1) for k in (grad, hess, None))
                    gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + self.l2) + (gt - g) ** 2 / (ht - h + self.l2) - gt**2 / (ht + self.l2)
                    gain[(c < self.least) | (ct - c < self.least)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(width), k] > best + 1e-9
                    best[better] = gain[np.arange(width), k][better]
                    self.feature[t, first : first + width][better] = j
                    self.cut[t, first : first + width][better] = k[better]
                node = 2 * node + (binned[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node])
            g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
            self.value[t] = self.rate * g / (h + self.l2)
            raw += self.value[t][node]
        return self

    def score(self, x):
        """The probability of label 1 of each row."""
        binned, raw = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (binned[rows, feature[at]] > cut[at])
            raw += value[node]
        return 1 / (1 + np.exp(-raw))


def document_statistics(docs, id_col="doc_id", text_col="text"):
    """(id_col, features array<float>) of every row; a null text counts as empty."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, text_col):
                x = statistics(data, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], [id_col, "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"`{id_col}` {kind}, features array<float>")


def held_out(id_col="doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def taught(labels, label="quality", id_col="doc_id"):
    """(id_col, y): the labels that may be learnt from."""
    rows = labels.select(quoted(id_col), F.col(quoted(label)).cast("int").alias("_label"))
    return rows.where(F.col("_label").isin(0, 1) & ~held_out(id_col)).groupBy(quoted(id_col)).agg(F.min("_label").alias("_label"))


def fit(stats, labels, label="quality", max_train=30_000, id_col="doc_id", **trees):
    """Trees grown on at most max_train labelled rows: of those not held out, the least by a hash of their id.

    An id labelled twice has its smaller label; null labels and null ids teach nothing.
    """
    rows = stats.join(taught(labels, label, id_col), id_col).orderBy(F.xxhash64(quoted(id_col)), quoted(id_col)).limit(max_train).toPandas()
    x = np.array(rows["features"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return Trees(**trees).fit(x, rows["_label"].to_numpy(np.float64))


def score_documents(docs, labels, label="quality", threshold=0.3, max_train=30_000, id_col="doc_id", text_col="text", **trees):
    """Score every whole text: (id_col, held_out, score, predicted).

    max_train bounds the labelled rows that are learnt from (see fit); the rest of the work covers every row. Null and
    empty texts have statistics of zero and are scored too. Rows that repeat an id are each scored. Without any usable
    label every score is 0.5. Columns besides id, text and the label are never read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    model = spark.sparkContext.broadcast(fit(stats, labels, label, max_train, id_col, **trees))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                s = model.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stats.select(quoted(id_col), "features", held_out(id_col).alias("held_out")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs, labels, label="quality", threshold=0.3, max_train=30_000, id_col="doc_id", text_col="text", **trees):
    """The rows of docs that score at least threshold, unchanged; scored as in score_documents, without a shuffle of texts.

    Statistics are computed once of every text, and before that of the texts that are learnt from: the ids of these,
    max_train at most, are broadcast. Other columns pass through, whatever their names.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ids = docs.select(quoted(id_col)).distinct()
    chosen = taught(labels, label, id_col).join(ids, id_col, "left_semi").orderBy(F.xxhash64(quoted(id_col)), quoted(id_col)).limit(max_train)
    chosen = written(chosen.select(F.col(quoted(id_col)).alias("id")), "chosen")
    some = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(chosen), "id", "left_semi")
    stats = written(document_statistics(some, "id", "text").withColumnRenamed("id", id_col), "statistics")
    model = spark.sparkContext.broadcast(fit(stats, labels, label, max_train, id_col, **trees))
    discard(chosen, stats)

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(pa.RecordBatch.from_struct_array(batch.column(0)), text_col):
                good = model.value.score(statistics(data, offs)) >= threshold
                yield pa.RecordBatch.from_arrays([part.filter(pa.array(good)).to_struct_array()], ["row"])

    rows = docs.select(every_column(docs).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
