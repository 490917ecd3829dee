"""Close matches of words: pairs that can reach a ratio by an index of letter pairs, the ratio only for those."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kelpie.functions import text as T


@F.pandas_udf(DoubleType())
def _ratio(words: pd.Series, terms: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which SQL can't express."""
    return pd.Series([difflib.SequenceMatcher(None, t, w).ratio() for w, t in zip(words, terms)], dtype=float)


def _grams(word):
    """Letter pairs of a word, numbered where they stand more than once, so that an equi-join counts as multisets do."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))
    return T.once(pairs, lambda pairs: F.transform(pairs, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == g)).alias("nth"))))


def close_terms(words, vocabulary, ratio=0.85):
    """(word, term, ratio): pairs of words (word) and vocabulary (term) of at least that ratio, each distinct pair once.

    Two words of together L letters need M = ratio * L / 2 letters in matching runs. What is left over parts them into
    L - 2 M + 1 runs at most, so they share 3 M - L - 1 letter pairs at least: pairs with fewer aren't compared. That is
    one pair or more for words of five letters and ratios from 0.8 on (ValueError below). Null words and such of under
    five letters have no close matches.
    """
    if not 0.8 <= ratio <= 1:
        raise ValueError("the ratio must be between 0.8 and 1")
    w = words.select("word").distinct().where(F.char_length("word") >= 5)
    bounds = w.agg(F.min(F.char_length("word")).alias("a"), F.max(F.char_length("word")).alias("b"))
    n = F.char_length("term")
    v = vocabulary.select("term").distinct().crossJoin(F.broadcast(bounds)).where((n >= 2) & (n * (2 - ratio) >= ratio * F.col("a")) & (n * ratio <= (2 - ratio) * F.col("b"))).select("term")
    x = w.select("word", F.char_length("word").alias("wn"), F.inline(_grams(F.col("word"))))
    y = v.select("term", n.alias("tn"), F.inline(_grams(F.col("term"))))
    both = x.join(y, ["gram", "nth"])
    least = F.ceil(ratio * (F.col("wn") + F.col("tn")) / 2 - 1e-9)
    both = both.where(F.least("wn", "tn") >= least)
    found = both.groupBy("word", "term", "wn", "tn").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.greatest(F.lit(1), 3 * least - F.col("wn") - F.col("tn") - 1))
    return found.select("word", "term", _ratio("word", "term").alias("ratio")).where(F.col("ratio") >= ratio)
