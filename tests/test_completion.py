import collections
import json
import os

import pytest
from pyspark.sql import functions as F

from kelpie.plans.completion import Completions, compress, council, reconsolidate, specialists


def counting(folder, answer):
    """A completer that leaves a file for every call."""
    def run(prompt):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").write(prompt)
        return answer(prompt)

    return run


def asked(folder):
    return collections.Counter(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def test_a_prompt_is_asked_once(spark, tmp_path, calls):
    c = Completions(spark, str(tmp_path / "memo"), counting(calls, lambda p: p.upper()), tasks=3)
    rows = spark.createDataFrame([(i, f"p{i % 7}") for i in range(50)] + [(50, None), (51, "")], "id int, prompt string")
    first = {r["id"]: (r["reply"], r["status"]) for r in c.answer(rows).collect()}
    assert first[8] == ("P1", "asked") and first[50] == (None, None) and first[51] == ("", "asked") and len(first) == 52
    assert asked(calls) == collections.Counter({**{f"p{i}": 1 for i in range(7)}, "": 1})
    more = rows.union(spark.createDataFrame([(60, "new")], rows.schema))
    again = {r["id"]: r["status"] for r in Completions(spark, str(tmp_path / "memo"), counting(calls, lambda p: "x")).answer(more).collect()}
    assert again[8] == "known" and again[60] == "asked" and sum(asked(calls).values()) == 9
    log = [(r["run"], r["wanted"], r["known"], r["asked"], r["failed"], r["calls"], r["held_back"]) for r in c.log().orderBy("run").collect()]
    assert log == [(0, 8, 0, 8, 0, 8, 0), (1, 9, 8, 1, 0, 1, 0)]


def test_retries_and_the_budget(spark, tmp_path, calls):
    def flaky(prompt):
        if prompt.startswith("bad"):
            raise ValueError("no")
        return prompt

    c = Completions(spark, str(tmp_path / "memo"), counting(calls, flaky), budget=9, retries=2, pause=0.01)
    rows = spark.createDataFrame([(f"bad{i}",) for i in range(10)], "prompt string")
    status = collections.Counter(r["status"] for r in c.answer(rows).collect())
    assert status == {"failed": 3, "held": 7} and c.calls() == 9 == sum(asked(calls).values())
    assert collections.Counter(r["status"] for r in c.answer(rows).collect()) == {"held": 10} and sum(asked(calls).values()) == 9
    wider = Completions(spark, str(tmp_path / "memo"), counting(calls, flaky), budget=13, retries=2, pause=0.01)
    wider.answer(spark.createDataFrame([("good1",), ("good2",)], "prompt string")).count()
    assert 10 <= wider.calls() == sum(asked(calls).values()) <= 13


PERSONAS = [("contrarian", "Contrarian", "Doubt."), ("strategy", "Strategy", "Look far."), ("commercial", "Commercial", "Sell."), ("cfo", "CFO", "Count.")]


def test_council(spark, tmp_path, calls):
    def reply(p):
        if p.startswith("Who of"):
            return '```json\n{"personas": ["cfo", "nobody", "strategy"], "rationale": "money"}\n```' if "budget" in p else "I can't say"
        if p.startswith("Conclude"):
            return json.dumps({"conclusion": f"done {p.count('###')}", "options": list("abcd"), "decision_required": True}) if "budget" in p else "plain words"
        return ("second " if "The others:" in p else "first ") + p.split(".")[0]

    c = Completions(spark, str(tmp_path / "memo"), counting(calls, reply))
    questions = spark.createDataFrame([(1, "raise the budget?", "ctx"), (2, "hello", None), (3, "hello", None)], "query_id int, query string, context string")
    got = {r["query_id"]: r for r in council(questions, spark.createDataFrame(PERSONAS, "key string, label string, system string"), c).collect()}
    assert got[1]["asked"] == ["cfo", "strategy"] and got[1]["rationale"] == "money" and got[1]["conclusion"] == "done 2" and got[1]["options"] == ["a", "b", "c"]
    assert got[2]["asked"] == ["contrarian", "strategy", "commercial"] and got[2]["rationale"] == "fallback" and got[2]["conclusion"] == "plain words" and not got[2]["decision_required"]
    assert [(t["key"], t["take"], t["revised"]) for t in got[1]["takes"]] == [("cfo", "first Count", "second Count"), ("strategy", "first Look far", "second Look far")]
    assert got[3]["takes"] == got[2]["takes"] and max(asked(calls).values()) == 1


def test_specialists(spark):
    rows = ["What is the cost of this deal?", "Should we hire?", "hello", None, "explain", "cost deal brand people"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "q string").select(specialists(F.col("q"))).collect()]
    assert got == [["cfo", "commercial"], ["contrarian", "hr"], ["contrarian", "strategy", "commercial"], ["contrarian", "strategy", "commercial"], ["strategy", "commercial"], ["contrarian", "cfo", "commercial"]]


def test_reconsolidation_and_compression(spark, tmp_path, calls):
    def reply(p):
        if p.startswith("Known:"):
            return json.dumps({"findings": [{"kind": "contradiction", "entity": "Ann", "summary": "left", "confidence": 0.8}, {"kind": "enrichment", "entity": "Bob", "summary": "joined"}]}) if "moved" in p else '{"findings": []}'
        return "short" if "tiny" in p else "kept text " * 6 + "[Compressed now]"

    c = Completions(spark, str(tmp_path / "memo"), counting(calls, reply))
    turns = spark.createDataFrame([("s", 1, "Ann moved on", "x" * 120), ("s", 2, "Ann moved on", "short"), ("s", 3, "nothing new", "y" * 120), ("s", 4, "Ann moved on", "z" * 120)], "session string, turn int, user string, assistant string")
    active = spark.createDataFrame([("s", t, f"e{i}", i / 20) for t in (1, 2, 3) for i in range(14)], "session string, turn int, eid string, strength double")
    entities = spark.createDataFrame([(f"e{i}", f"N{i}", "person", "d" * 300) for i in range(14)], "eid string, name string, type string, description string")
    got = reconsolidate(turns, active, entities, c, "2024-01-31").collect()
    assert [(r["turn"], r["n_findings"]) for r in got] == [(1, 2)] and "contradicts memory (2 update[s])" in got[0]["reason"]
    assert got[0]["content"].endswith('- ⚡ **Ann** — left _(conf 0.80)_\n- ➕ **Bob** — joined _(conf 0.50)_')
    prompts = [p for p in asked(calls) if p.startswith("Known:")]
    assert all(p.count("\n- ") + p.startswith("- ") == 10 and "N13" in p and "N3 " not in p for p in prompts) and len(prompts) == 2
    files = spark.createDataFrame([("M/a/x.md", "long " * 100), ("M/a/tiny.md", "tiny " * 100)], "path string, body string")
    chosen = files.select("path", F.lit(40.0).alias("age_days"), F.lit(100).alias("savings"))
    out = {r["path"]: r for r in compress(files, chosen, c, "170").collect()}
    assert out["M/a/x.md"]["status"] == "ok" and out["M/a/x.md"]["backup"] == "M/a/_pre_compression_backups/x_170.md" and out["M/a/x.md"]["actual_savings"] == 500 - out["M/a/x.md"]["new_chars"]
    assert out["M/a/tiny.md"]["status"] == "error" and out["M/a/tiny.md"]["body"] is None
