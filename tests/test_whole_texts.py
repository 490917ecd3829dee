"""Queries over whole texts, against SQL without any cut."""

import hashlib
import re

import duckdb

from kelpie.plans import registry

SF = "/root/testdata/sf0.001"


def whole_sql(spark, name, table):
    """Rows of a query, and of its SQL, as sorted tuples."""
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert not re.search(r"substring\(text, 1, \d+\)", registry.oracle_sql()[name])
    found = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    return sorted(tuple(r[n] for n in names) for r in registry.queries()[name](spark, SF).collect()), sorted(found.fetchall())


def test_merge_cues_keeps_whole_texts(spark):
    got, want = whole_sql(spark, "merge_cues", "conversations")
    assert got == want and max(len(r[-1]) for r in got) > 500


def test_merge_paragraphs_decides_on_whole_texts(spark):
    files = {}
    for file, n, text in duckdb.sql(f"select conv_id, turn, text from '{SF}/conversations.parquet' order by conv_id, turn").fetchall():
        files.setdefault(file, []).append((n * 10.0 + (130 if n % 5 == 4 else 0), n * 10.0 + 8, text))
    want = set()
    for file, cues in files.items():
        done, cur, end = [], None, 0.0
        for start, stop, text in cues:
            if cur is None:
                cur = text
            elif not cur.endswith(".") or (start - end < 3 and len(cur) + 1 + len(text) <= 500):
                cur += " " + text
            else:
                done, cur = [*done, cur], text
            end = stop
        done.append(cur)
        want.add((file, len(done), hashlib.sha256("\n".join(done).encode()).hexdigest()))
    assert {tuple(r) for r in registry.queries()["merge_paragraphs"](spark, SF).select("file", "n", "digest").collect()} == want


def test_names_and_slugs_take_whole_texts(spark):
    got, want = whole_sql(spark, "names_and_slugs", "documents")
    assert got == want and max(len(r[3]) for r in got) > 1000
