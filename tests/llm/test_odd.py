"""Near-duplicate components against all pairs compared in Python, and the sketches against their formula."""

import random
import re

import numpy as np
import pytest

from kelpie.llm import odd

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, node string, size int, `a.b` string"


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}


def wanted(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(find(i), []).append(d)
    names = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return sorted(((d, len(sets[i]), names[find(i)], d == names[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(3000)] + ["É", "ÀB", "x-y"]
    say = lambda n: [r.choice(pool) for _ in range(n)]
    rows = [None, "", " \t\n", "one", "ONE", "two words", "Two Words", "a b c", "A B C d", "a b c", "x " * 500, "x " * 900]
    for _ in range(12):  # stars: copies of a base that are less like each other
        base = say(r.randint(60, 300))
        for _ in range(r.randint(2, 14)):
            copy = list(base)
            for i in r.sample(range(len(copy)), max(1, len(copy) * r.choice([1, 2, 3, 4]) // 100)):
                copy[i] = r.choice(pool)
            rows.append(" ".join(copy))
        rows.append(" ".join(base).upper())
    chain = say(200)  # each like the next, the ends unlike
    for _ in range(30):
        chain = chain[3:] + say(3)
        rows.append("\n".join(chain))
    rows += [" ".join(say(80)) for _ in range(40)] + [" ".join(say(15_000))]
    rows += rows[20:30] + [rows[-1] + " tail"]
    r.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block, most", [(256, 1 << 20), (4, 1 << 20), (256, 600)])
def test_against_all_pairs(spark, block, most):
    rows = corpus(block + most)
    df = spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], SCHEMA).repartition(3)
    got = found(odd.near_duplicates(df, block=block, block_shingles=most))
    assert got == wanted(rows)
    assert len({x[2] for x in got}) < len(rows) - 60


def test_star_of_many_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(400):
        copy = list(base)
        for j in r.sample(range(200), 4):  # 12 of 198 shingles: 0.886 to the base, far less to other copies
            copy[j] = f"v{i}-{j}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(odd.near_duplicates(df, block=32)) == wanted(rows)


def test_ids_that_repeat_or_are_null(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(None, a), (None, b), (1, b), (1, b), (1, a), (2, b), (3, b + " more"), (4, None), (4, None), (None, None), (None, "lone text here"), (None, "lone text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = found(odd.near_duplicates(df)), wanted(rows)
    want = sorted(((d, n, c, d == c) for d, n, c, _ in want), key=str)
    assert got == want


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert odd.near_duplicates(df).count() == 0
    assert odd.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_sketches_estimate_and_never_lose():
    r = np.random.default_rng(4)
    for jaccard in (0.85, 0.9, 0.95):
        sets, off = [], []
        for _ in range(300):
            n = 2000
            shared = round(n * jaccard / (1 + jaccard) * 2 / 2 * 1)
            x = r.integers(1, 1 << 62, 2 * n, dtype=np.uint64)
            only = round(shared * (1 - jaccard) / jaccard / 2)
            sets += [np.unique(x[: shared + only]), np.unique(np.concatenate([x[:shared], x[shared + only : shared + 2 * only]]))]
        words = odd.odd_sketches(odd.samples(sets)).view(np.uint64)
        bits = np.bitwise_count(words[::2] ^ words[1::2]).sum(1, dtype=np.int64)
        off = odd.estimate(bits) - jaccard
        assert abs(off.mean()) < 0.01 and off.std() < 0.03 and bits.max() <= odd.most_bits(0.85)
    unlike = [r.integers(1, 1 << 62, 500, dtype=np.uint64) for _ in range(200)]
    words = odd.odd_sketches(odd.samples(unlike)).view(np.uint64)
    assert (np.bitwise_count(words[::2] ^ words[1::2]).sum(1) > odd.most_bits(0.85)).all()
    assert 0.6 < odd.estimate(odd.most_bits(0.85)) < 0.8
