"""Quality rules as weak supervision: rules vote or abstain, and a latent-class model weighs their votes.

Every rule looks at the counts of one whole text and says good (1), bad (-1) or nothing (0). Expectation-maximisation
over the counts of vote patterns estimates each rule's accuracy and the share of good documents; the posterior
probability of each pattern then decides, in place of a filter that all rules must pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .common import chunks, quoted, ship, written
from .rolling import byte_prefix, doc_bounds, prefix, repeated, spans, words

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stops", "n_bang", "n_twins")


def counts(data, offs):
    """COUNTS of each of the concatenated UTF-8 texts, as int64 rows."""
    n = len(offs) - 1
    start, end, doc = words(data, offs)
    at = doc_bounds(doc, n)
    per_doc = lambda t: np.diff(np.concatenate([[0], np.cumsum(t)])[offs])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points: bytes that don't continue one
    chars = np.concatenate([[0], np.cumsum(points[end] - points[start])])
    pre = byte_prefix(data, 0)
    key = spans(pre, start, end, 0)
    covered = np.zeros(len(key), bool)
    if len(key) >= 5:
        five = spans(prefix(key, 1), np.arange(len(key) - 4), np.arange(5, len(key) + 1), 1) ^ (doc[:-4].astype(np.uint64) * _GOLD)
        inside = np.flatnonzero(doc[:-4] == doc[4:])
        _, often = repeated(five[inside])
        for k in range(5):
            covered[inside[often] + k] = True
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offs[line_doc + 1])
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 10) * (line_end > line_start)
    has_word = np.searchsorted(start, line_end, "left") > np.searchsorted(start, line_start, "left")
    line_key = spans(pre, line_start, line_end, 0) ^ (line_doc.astype(np.uint64) * _GOLD)
    again, _ = repeated(line_key[has_word])
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    twin = doc[1:][(key[1:] == key[:-1]) & (doc[1:] == doc[:-1])]
    columns = [
        np.diff(at), np.diff(chars[at]), per_doc(_SYMBOL[data]), np.bincount(line_doc[has_word][again], minlength=n),
        np.diff(np.concatenate([[0], np.cumsum(covered)])[at]), np.bincount(line_doc[has_word], minlength=n), per_doc(upper), per_doc(letter), per_doc(data == 46), per_doc(data == 33), np.bincount(twin, minlength=n),
    ]
    return np.stack(columns, 1).astype(np.int64) if n else np.zeros((0, len(COUNTS)), np.int64)


def document_counts(docs, id_col="doc_id", text_col="text"):
    """id_col and COUNTS of every row; a null text has no words."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, text_col):
                x = counts(data, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, j]) for j in range(len(COUNTS)))], [id_col, *COUNTS])

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def default_rules():
    """(name, good, bad): column conditions under which a rule votes for or against a document; else it abstains."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    mean, symbols, repeats = F.col("word_chars") / w, F.col("n_symbols") / w, F.col("n_repeat_words") / w
    letters, lines = F.greatest(F.col("n_letters"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    upper, dup, spelt = F.col("n_upper") / letters, F.col("n_dup_lines") / lines, F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    stops, bangs, twins = F.col("n_stops") / w, F.col("n_bang") / w, F.col("n_twins") / w
    signs = (F.col("n_symbols") + F.col("n_bang")) / F.greatest(F.col("word_chars"), F.lit(1))
    return [
        ("word_length", (mean >= 4.5) & (mean <= 12), (mean < 4) | (mean > 20)),
        ("symbols", symbols < 0.02, symbols > 0.1),
        ("repeated_words", repeats < 0.05, repeats > 0.15),
        ("repeated_lines", dup < 0.1, dup > 0.5),
        ("capitals", upper < 0.15, upper > 0.3),
        ("letters", spelt > 0.9, spelt < 0.85),
        ("sentences", stops > 0.02, stops == 0),
        ("length", F.col("n_words") >= 50, F.col("n_words") < 10),
        ("shouting", bangs < 0.02, bangs > 0.1),
        ("twins", twins < 0.02, twins > 0.1),
        ("signs", signs < 0.01, signs > 0.03),
    ]


def fit(patterns, weights, rounds=500):
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) that occur weights times.

    Each rule has two accuracies: how often its vote is right on a good document, and on a bad one; an abstention says
    nothing. The start is the filter that all rules must pass; one pseudo-vote each way keeps accuracies off 0 and 1 and
    a class of no members defined. Classes may trade places on the way: at the end, the class whose expected vote is
    the higher one is the good one. Returns (prior, accuracies on good, accuracies on bad, posterior of each pattern).
    """
    v = np.array(patterns, float).reshape(len(patterns), -1) if len(patterns) else np.zeros((0, 0))
    weights = np.asarray(weights, float)
    plus, minus = v > 0, v < 0
    voted = plus | minus
    # rows: the first class, the other one
    share = np.where(minus.any(1), 0.001, 0.999)
    share = np.stack([share, 1 - share])
    last = None
    for _ in range(rounds if len(v) else 0):
        mass = share * weights
        for_it = (mass @ plus + 1) / (mass @ voted + 2)
        prior = (mass.sum(1) + 1) / (weights.sum() + 2)
        logit = np.log(prior)[:, None] + np.log(for_it) @ plus.T + np.log(1 - for_it) @ minus.T
        share = np.exp(logit - logit.max(0))
        share /= share.sum(0)
        if last is not None and np.abs(for_it - last).max() < 1e-9:
            break
        last = for_it
    if not len(v):
        return 0.5, np.zeros(0), np.zeros(0), np.zeros(0)
    reach = voted.T @ weights
    good = int(((2 * for_it[1] - 1) @ reach) > ((2 * for_it[0] - 1) @ reach))
    return float(prior[good]), for_it[good], 1 - for_it[1 - good], share[good]


def judge(docs, rules=None, threshold=0.5, id_col="doc_id", text_col="text"):
    """id_col, COUNTS, base_failed, posterior and kept of every row.

    base_failed: fewer than 10 words, or over 20 % of them in repeated 5-word windows. kept: false if base_failed, else
    posterior >= threshold. The vote patterns are counted over all documents; there are at most 3 to the number of
    rules of them, whatever the input (177,147 for the default eleven), so they go to the driver and back by broadcast; more
    than 12 rules are refused (ValueError). Null and empty texts have no words and fail; repeated rows are each judged;
    columns besides id and text are never read.
    """
    spark = docs.sparkSession
    rules = rules or default_rules()
    if len(rules) > 12:
        raise ValueError("more than 12 rules")
    vote = [F.when(good, 1).when(bad, -1).otherwise(0) for _, good, bad in rules]
    table = written(document_counts(docs, id_col, text_col), "counts")
    pattern = sum((v + 1) * 3**i for i, v in enumerate(vote))
    seen = table.groupBy(pattern.cast("int").alias("pattern")).count().orderBy("pattern").collect()
    patterns = [[r["pattern"] // 3**i % 3 - 1 for i in range(len(rules))] for r in seen]
    posterior = fit(patterns, [r["count"] for r in seen])[-1]
    known = spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(seen, posterior)], "pattern int, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = table.withColumn("pattern", pattern.cast("int")).join(F.broadcast(known), "pattern", "left")
    return out.select(quoted(id_col), *COUNTS, failed.alias("base_failed"), "posterior", (~failed & (F.col("posterior") >= threshold)).alias("kept"))
