"""More brute force: tree walk, phrases and notices, source mixing, rows that repeat ids, awkward columns, the pipeline."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

from kelpie.llm import bpe, licences, mixing, near, passages, quality, suffixes
from kelpie.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_tree_walk_matches_one_row_at_a_time():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0) ^ (r.random(800) < 0.05)).astype(float)
    trees = quality.Trees(trees=20).fit(x, y)
    for row, score in zip(x[:100], trees.score(x[:100])):
        raw = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            for _ in range(trees.depth):
                at = np.searchsorted(trees.edges[feature[node]], row[feature[node]], "left")
                node = 2 * node + (2 if at > cut[node] else 1)
            raw += value[node - (2**trees.depth - 1)]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))
    assert ((trees.score(x) >= 0.5) == (y > 0)).mean() > 0.9


def test_classifier_stage_scores_as_the_query_does(spark):
    src = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{src}/documents.parquet"), spark.read.parquet(f"{src}/labels.parquet")
    kept = {r["doc_id"] for r in quality.keep_good(docs.withColumn("n_words", docs["doc_id"]), labels).collect()}
    assert kept == {r["doc_id"] for r in quality.score_documents(docs, labels).collect() if r["predicted"]}


def test_phrases_match_brute_force(spark):
    r = random.Random(1)
    pool = "gnu general public license apache cc by mit GNU License MIT, license; cc-by x".split()
    rows = [(i, r.choice(["", " ", "é"]).join(["", *(r.choice(pool) + r.choice([" ", "  ", "-", "\n", "_", "."]) for _ in range(r.randint(0, 40)))])) for i in range(150)]
    got = {x["doc_id"]: x for x in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for phrase, label in licences.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        f = got[i]
        assert (f["n_words"], f["n_base"]) == (len(words), len(at)) and f["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert (f["first_word"], f["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(f["base_labels"].split(",")) - {""} <= set(f["labels"].split(","))


def test_notices_beside_each_other(spark):
    notice = "licensed under the gnu general public license version"
    edited = notice.replace("gnu", "gnv").replace("version", "versoin")
    text = f"x {edited} y {notice} z {edited} " + "é " * 3
    (row,) = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    spans = sorted((s["first_word"], s["n_words"], s["edits"] > 0) for s in row["spans"] if s["label"] == "gpl" and s["n_words"] == 8)
    assert spans == [(1, 8, True), (10, 8, False), (19, 8, True)]
    began = time.perf_counter()
    finder = licences.Finder()
    dense = " ".join([notice, edited, "under the terms of the gnu"] * 300)
    found = finder.fuzzy(dense)
    assert sum(f[0] == "gpl" and f[3] == 0 for f in found) >= 300 and time.perf_counter() - began < 60


def test_mixing_against_an_independent_plan(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 10, 200])), r.choice(["b", "a", "ü", None, "c"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df, shards=4).collect()
    size, least = collections.Counter(), {}
    for _, text, s in rows:
        size[s] += len(text.split())
    # targets by water filling, step by step
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, sum(size.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= full
    taken = collections.Counter()
    for x in got:
        taken[x["source"]] += x["taken"]
        assert x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == size[x["source"]] and x["taken"] <= 3 * x["size"]
    for s in names:  # never above the target, and below it by less than a block of one or two texts
        assert 0 <= target[s] - taken[s] < 400
    for _ in range(50):
        words = [r.randint(0, 50) for _ in range(r.randint(1, 40))]
        rest = r.random() * sum(words)
        times, numbers = mixing._quotas(rest, 1, words, range(len(words)))
        left_out = [w for w, t in zip(words, times) if t == 1]
        assert 0 <= (gap := rest - sum(w for w, t in zip(words, times) if t == 2)) and (not left_out or gap < min(left_out))
        assert sorted(sum(numbers, [])) == list(range(sum(times)))
    shards = collections.Counter(s for x in got for s in x["shards"])
    assert max(shards.values()) - min(shards.values()) <= 8  # equal in block copies; a few blocks hold two texts
    # a tree of draws over many seeds gives each shard its fair part of a source
    parts = np.mean([mixing.split([8, 40, 16], 4, seed) for seed in range(400)], axis=0)
    assert np.abs(parts - np.array([2, 10, 4])).max() < 0.3
    assert least == {}


AWKWARD = ["n_words", "n_removed", "kept_text", "kept_sha256", "_n", "_shards", "_shard", "_copy", "row", "id", "key", "node", "shards", "copy", "rest", "a.b", "with space", "score", "features", "tick`s"]


@pytest.fixture(scope="module")
def awkward(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("this is plain prose and it goes on for a while with many words in it".split()) for _ in range(60)) for _ in range(30)]
    texts += texts[:4] + [None, "", texts[5] + " tail " + texts[6]]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in AWKWARD)
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), *(f"{c}{i}" for c in AWKWARD)) for i, t in enumerate(texts)], columns)


def test_stages_carry_columns_of_any_name(spark, awkward, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = awkward
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert docs.columns == awkward.columns, name
        for x in docs.collect():
            assert all(x[c] == f"{c}{x['doc_id']}" for c in AWKWARD), name
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_keep_one_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(0, a, "p"), (1, a, "q"), (1, b, "r"), (1, b, "r"), (2, b + " more", "s"), (None, c, "t"), (None, c, "t"), (None, None, "u"), (None, None, "u"), (5, c + " x", "v"), (6, "", "w"), (6, "", "w")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _n string")).collect())
    assert got == {(0, a): 1, (1, b): 1, (5, c + " x"): 1, (None, None): 2, (6, ""): 2}


def test_periodic_text_names_a_passage_once(spark):
    pair = "left right " * 200
    texts = [f"start{i} " + " ".join(f"u{i}x{j}" for j in range(30)) + " " + pair for i in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, seen = {r["doc_id"]: r for r in passages.remove_passages(rows).collect()}, set()
    for i, t in enumerate(texts):
        w = WORDS.findall(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = True
            seen.add(k)
        assert got[i]["n_removed"] == gone.sum()
    with pytest.raises(ValueError):
        passages.remove_passages(rows, window=300)
    with pytest.raises(ValueError):
        suffixes.remove_repeats(rows, length=400)


def test_pipeline_against_brute_force(spark):
    """Classifier scores come from the query (tested for accuracy elsewhere); every later stage is done again in Python."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{src}/documents.parquet"), spark.read.parquet(f"{src}/labels.parquet")
    good = {r["doc_id"] for r in quality.score_documents(docs, labels).collect() if r["predicted"]}
    rows = sorted((r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect() if r["doc_id"] in good)
    sets = []
    for _, t, _ in rows:
        w = WORDS.findall(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    seen, cut = set(), []
    for d, t, s in rows:
        w = WORDS.findall(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = True
            seen.add(k)
        if not w or not gone.all():
            cut.append((d, " ".join(x for x, g in zip(w, gone) if not g) if gone.any() else t, s))
    plan = {r["doc_id"]: r["times"] for r in mixing.plan(spark.createDataFrame(cut, "doc_id long, text string, source string")).collect()}
    lib = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for d, t, _ in cut:
        ids = lib.encode(t, add_special_tokens=False).ids
        if plan[d]:
            want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += plan[d]
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, src).collect())
    assert got == want and bpe is not None


def test_prefix_doubling_agrees_with_anchors(spark):
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abc é") for _ in range(n))
    shared = say(260)
    texts = [say(150) + shared[:130] + say(50), shared, say(80) + shared[40:] + say(20), "ab" * 150, "xx" + "ab" * 120, None, "short", say(400), shared[:99]]
    df = spark.createDataFrame([(7 * i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    starts = collections.defaultdict(list)
    for x in suffixes.prefix_doubling(df).collect():
        starts[x["doc"]].append(x["pos"])
    for x in suffixes.remove_repeats(df).collect():
        assert x["n_removed"] == len({p + k for p in starts[x["doc_id"]] for k in range(100)})
    assert sum(map(len, starts.values())) > 300
