"""From raw documents to token ids in five stages, each over all rows that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage returns is to be written before the next stage begins, for that one deletes the scratch tables of the one before.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from kelpie.llm import bpe, mixing, near, passages, quality
from kelpie.llm.common import collecting, discard, quoted, written
from kelpie.llm.queries import tokenizer_path

_left = []


def _stage(f):
    """f as a stage: scratch tables of the stage before go first, unless docs still reads them (it wasn't written)."""

    @functools.wraps(f)
    def run(spark, docs, sf_dir):
        reads = " ".join(docs.inputFiles())
        here = [t for t in _left if t.sparkSession is spark]
        gone = [t for t in here if t._kelpie_path.rsplit("/", 1)[1] not in reads]
        if len(gone) == len(here):
            discard(*gone)
            _left.clear()
        with collecting(_left):
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality_classifier(spark, docs, sf_dir):
    """Drop the documents that the classifier rejects (score under 0.3)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def jaccard_join(spark, docs, sf_dir):
    """Keep one document of each group of near duplicates, the one of the least id."""
    return near.keep_one(docs)


@_stage
def passage_dedup(spark, docs, sf_dir):
    """Cut passages that stand in earlier text; n_chars follows, and documents that lose every word go."""
    rest = F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")))
    cut = passages.remove_passages(docs.select("doc_id", "text", rest.alias("rest")), carry=["rest"], with_text=True)
    cut = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    same = {c: F.col("rest").getField(c) for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in same:
        same["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(same["n_chars"])
    same |= {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    return cut.select(*(same[c].alias(c) for c in docs.columns))


@_stage
def source_mixing(spark, docs, sf_dir):
    """Mix the sources to their target weights; a row comes as often as the mix takes it."""
    return mixing.mix(docs)


@_stage
def bpe_round_trip(spark, docs, sf_dir):
    """Token counts and digests of the ids and the decoded text of every row."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", passage_dedup),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: SQL can't express the classifier, the automata or the tokenizer; tests hold the rows against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what passes between two of them is written, read again and deleted once it was used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
