"""Queries over whole tables: cases that filters on their input would hide."""

import os

import pandas as pd
import pytest

from attesta import queries
from attesta.operators import claims
from tests.test_queries import HERE

tables = pytest.mark.skipif(not os.path.isdir(HERE), reason="the tables are not here")


def test_compared_answers_by_kind_symbol_and_all_ranges(spark):
    cols = "answer_id string, claim_id string, kind string, symbol string, text string, path string, start_line int, end_line int"
    rows = [
        ("a", "1", "FACT", None, "some words", "p", 5, 6), ("a", "1", "FACT", None, "some words", "p", 1, 1),
        ("b", "1", "FACT", None, "other words", "p", 1, 1), ("b", "1", "FACT", None, "other words", "p", 5, 6),
        ("c", "1", "FACT", None, "some words", "p", 6, 9),
        ("d", "1", "FACT", "f", "some words", "p", 1, 1),
        ("e", "1", "LACUNA", None, "x", None, None, None), ("f", "1", "FACT", None, "x", None, None, None),
    ]
    got = {}
    for r in claims.compared_answers(spark.createDataFrame(rows, cols)).collect():
        got.setdefault(r.content, {})[r.answer_id] = r.state
    two = [g for g in got.values() if g["a"] == "equal"]
    assert two == [{"a": "equal", "b": "equal", "c": "partial", "d": "absent", "e": "absent", "f": "absent"}]
    assert {"a": "absent", "b": "absent", "c": "absent", "d": "absent", "e": "equal", "f": "partial"} in got.values()
    assert len(got) == 5


@tables
def test_answer_compare_of_all_turns_and_texts(spark):
    """Against plain loops over each turn's lines."""
    turns = pd.read_parquet(f"{HERE}/conversations.parquet")
    content = {}
    for r in turns.itertuples():
        lines = r.text.replace("\r\n", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        content.setdefault((r.role, tuple(enumerate(lines))), set()).add(r.conv_id % 6)
    want = {}
    for c, has in content.items():
        for answer in set(turns.conv_id % 6):
            near = any(answer in h and (set(c[1]) & set(o[1]) or c[0] != o[0] and c[1] == o[1]) for o, h in content.items())
            state = "equal" if answer in has else "partial" if near else "absent"
            n, ids = want.get((state, len(has)), (0, set()))
            want[state, len(has)] = n + 1, ids | {c}
    got = {(r.state, r.shared): (r.n, r.contents) for r in queries.QUERIES["answer_compare"](spark, HERE).collect()}
    assert got == {k: (n, len(ids)) for k, (n, ids) in want.items()}


@tables
def test_resolve_cascade_resolves_every_line(spark):
    got = queries.QUERIES["resolve_cascade"](spark, HERE).select("occ_id").distinct().count()
    lines = pd.read_parquet(f"{HERE}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"]).drop_duplicates()
    assert got == len(lines)


def test_partition_issues_expects_every_customer(spark, tmp_path):
    spark.range(1, 1001).toDF("c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.id, r.issue) for r in queries.QUERIES["partition_issues"](spark, str(tmp_path)).collect()}
    assert got == {(i, "several") for i in range(8, 1001, 8)} | {(i, "absent") for i in range(3, 1001, 4)}


def test_claims_have_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, " " * 20 + "said late"), (2, " " * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.claim_id for r in queries.QUERIES["claim_issues"](spark, str(tmp_path)).where("code = 'empty_text'").collect()}
    assert got == {"2"}
    codes = {r.answer_id: r.codes.split(",") for r in queries.QUERIES["answer_outcome"](spark, str(tmp_path)).collect()}
    assert "empty_text" not in codes[1] and "empty_text" in codes[2]
