import datetime
import random
import re

from kelpie.operators import ordered

SCHEMA = "path string, uid string, ts timestamp, reason string, source string, status string"
START = datetime.datetime(2024, 1, 1)


def words(reason):
    return {w for w in re.findall(r"[a-z][a-z0-9\-']+", (reason or "").lower()) if len(w) > 2}


def fold(rows, threshold=0.55):
    out = {}
    for path in {r[0] for r in rows}:
        kept = []
        for _, uid, _, reason, *_ in sorted((r for r in rows if r[0] == path), key=lambda r: (-r[2].timestamp(), r[1])):
            w = words(reason)
            best = max((len(w & k) / len(w | k) for k in kept if w and k), default=0.0)
            out[path, uid] = (best < threshold, None if best < threshold else round(best, 6))
            if best < threshold:
                kept.append(w)
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return {(r["path"], r["uid"]): (r["kept"], r["similarity"]) for r in ordered.near_duplicate_proposals(df, **how).collect()}


def test_near_duplicates_equal_the_fold(spark):
    r = random.Random(3)
    pool = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = []
    for i in range(900):
        base = random.Random(i % 40).sample(pool, r.choice([1, 2, 5, 9]))
        for _ in range(r.choice([0, 0, 1, 2])):
            base[r.randrange(len(base))] = r.choice(pool)
        reason = r.choice([None, "", "a b", "42"]) if i % 50 == 0 else " ".join(base)
        rows.append((f"p{i % 3}", f"u{i:04d}", START + datetime.timedelta(minutes=r.randint(0, 300)), reason, "s", "pending"))
    want = fold(rows)
    assert found(spark, rows) == want
    assert 100 < sum(not k for k, _ in want.values()) < 800
    assert found(spark, rows, threshold=0.8) == fold(rows, 0.8)


def test_a_hot_path(spark):
    r = random.Random(5)
    rows = [("hot", f"u{i:06d}", START + datetime.timedelta(seconds=r.randint(0, 10**6)), f"alpha{r.randint(0, 3000)} beta{r.randint(0, 3000)} gamma{r.randint(0, 3000)}" if i % 3 else "the same words again", "s", "pending") for i in range(20_000)]
    got = found(spark, rows)
    first = {}
    for _, uid, ts, reason, *_ in sorted(rows, key=lambda x: (-x[2].timestamp(), x[1])):
        first.setdefault(frozenset(words(reason)), uid)
    assert len(got) == len(rows) and sum(got["hot", x[1]][0] for x in rows if x[3] == "the same words again") == 1
    assert got["hot", first[frozenset(words("the same words again"))]][0]


def test_supersede_equals_all_pairs(spark):
    r = random.Random(7)
    rows = [(f"p{r.randint(0, 3)}", f"u{i}", START + datetime.timedelta(minutes=r.randint(0, 20)), "x", f"s{r.randint(0, 2)}", r.choice(["pending", "pending", "accepted"])) for i in range(200)]
    pending = [x for x in rows if x[5] == "pending"]
    want = {}
    for x in pending:
        later = [(y[2], y[1]) for y in pending if y[0] == x[0] and y[4] != x[4] and (y[2], y[1]) > (x[2], x[1])]
        if later:
            want[x[0], x[1]] = min(later)[1]
    got = {(g["path"], g["uid"]): g["superseded_by"] for g in ordered.supersede(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(want) > 50
