"""Links of questions to entities against brute force."""

import random

from kelpie.operators import ingest


def test_links_are_all_names_that_a_question_contains(spark):
    r = random.Random(1)
    names = ["red widget", "Iran", "\u6771\u4eac\u90fd", "abc", "ab", "#tag", "Widget", "iran", "a" * 40, "..."] + ["".join(r.choices("ab c", k=r.randint(1, 6))) for _ in range(60)]
    asked = ["Is the bored widget here?", "Who asked the Iranian envoy?", "\u65b0\u6771\u4eac\u90fd\u5e81\u306f\uff1f", "ab", "", "has #tags...", "a" * 45, None] + ["".join(r.choices("abAB c", k=r.randint(1, 30))) for _ in range(60)]
    entities = [(f"e{i:02d}", n, "t", "active") for i, n in enumerate(names)] + [("none", None, "t", "active")]
    questions = [(i, 0, q) for i, q in enumerate(asked)]
    got = ingest.link_questions(spark.createDataFrame(questions, "doc_id long, pos int, question string"), spark.createDataFrame(entities, "eid string, name string, type string, tier string"), most=3)
    found = {row["doc_id"]: row["linked"] for row in got.where("question is not null").collect()}
    want = {i: sorted(e for e, n, *_ in entities if n and len(n) >= 3 and n.lower() in q.lower())[:3] for i, _, q in questions if q is not None}
    assert found == want and want[0] == ["e00", "e06"] and want[1] == ["e01", "e07"] and want[2] == ["e02"]
