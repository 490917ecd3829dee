"""Texts of much structure, on which polynomials modulo a power of two agree for every base."""

import random

import numpy as np
import pytest

from kelpie.llm import near, quality, rolling, rules, suffixes


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_spans_differ():
    for n in (64, 256, 1024, 4096):
        x = np.array(thue_morse(n, 0, 1), np.uint8)
        both = np.concatenate([x, 1 - x])
        for k in (0, 1):
            pre = rolling.byte_prefix(both, k)
            one, two = rolling.spans(pre, np.array([0, n]), np.array([n, 2 * n]), k)
            assert one != two and (one ^ two) >> np.uint64(32)


def test_prefix_is_the_polynomial():
    r = random.Random(3)
    prime, base = rolling._PRIME, rolling._BASES
    for k, values in ((0, np.array([r.randrange(256) for _ in range(70_000)], np.uint8)), (1, np.array([r.randrange(1 << 64) for _ in range(70_000)], np.uint64))):
        pre, total, power = rolling.prefix(values, k), 0, 1
        for i, v in enumerate(values.tolist()):
            total, power = (total + (v + (k == 0)) * power) % prime, power * base[k] % prime
            if i % 997 == 0:
                assert int(pre[i + 1]) % prime == total
        starts = np.array([5, 40_000])
        again = np.concatenate([values, values])
        pre = rolling.prefix(again, k)
        assert (rolling.spans(pre, starts, starts + 29_000, k) == rolling.spans(pre, starts + 70_000, starts + 99_000, k)).all()


@pytest.fixture(scope="module")
def pair(spark):
    t, u = ("".join(thue_morse(1024, *x)) for x in ("ab", "ba"))
    return spark.createDataFrame([(1, t), (2, u), (3, f"{t}\n{u}"), (4, f"{t} {u} " * 3)], "doc_id long, text string")


def test_counts_tell_them_apart(pair):
    found = {r["doc_id"]: r for r in rules.judge(pair).collect()}
    assert found[3]["n_dup_lines"] == 0 and found[3]["n_repeat_words"] == 0


def test_sets_and_removals_tell_them_apart(pair):
    classes = {r["doc_id"]: r["class_id"] for r in near.join(pair).collect()}
    assert classes[1] == 1 and classes[2] == 2
    texts = [r["text"].encode() for r in pair.orderBy("doc_id").collect()]
    removed = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(pair).collect()}
    seen = set()
    for i, raw in enumerate(texts):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        assert removed[i + 1] == gone.sum()


def test_statistics_tell_them_apart():
    t, u = ("".join(thue_morse(1024, *x)) for x in ("ab", "ba"))
    raw = [f"{t}\n{u}".encode(), f"{t}\n{t}".encode()]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    x = quality.statistics(data, offs)
    assert (x[0] != x[1]).any()
