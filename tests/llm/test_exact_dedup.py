import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import collected, docs, table
from timeweave.llm import exact_dedup as module
from timeweave.llm.exact_dedup import exact_dedup, keep_distinct


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(rows, pick):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    return {(d, pick(ids), len(ids), d == pick(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids}


def test_edge_cases(spark):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "x" * 199_999 + "y")]
    for keep, pick in (("smallest", min), ("largest", max)):
        got = exact_dedup(docs(spark, rows), keep=keep)
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()} == expected(rows, pick)


def test_many_copies_and_empty_table(spark):
    rows = [(i, "same Text" if i % 3 else f"text {i}") for i in range(600)]
    got = exact_dedup(docs(spark, rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == expected(rows, min)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_real_rows_and_pipeline_form(spark):
    frame = table("documents")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = exact_dedup(df, keep="largest").collect()
    want = expected(list(zip(frame.doc_id, frame.text)), max)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    kept = keep_distinct(df)
    assert kept.columns == df.columns and set(collected(kept)) == {x[0] for x in want if x[3]}


@pytest.mark.parametrize("share", [4, 0.2])
def test_texts_of_one_digest_are_told_apart(spark, monkeypatch, share):
    """With one digest for all texts, and salted or not, the neighbours alone decide."""
    monkeypatch.setattr(module, "_digest", lambda text: F.lit("x"))
    monkeypatch.setattr(module, "SHARE", share)
    rows = [(i, ["Same text", "same texT", "same head of thirty-two characters " + "ab"[i % 2], None, "", f"own {i}"][i % 6]) for i in range(400)]
    for keep, pick in (("smallest", min), ("largest", max)):
        got = exact_dedup(docs(spark, rows), keep=keep).collect()
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == expected(rows, pick) and len(got) == len(rows)


def test_rows_without_an_id_and_repeated_rows(spark):
    rows = [(None, "a"), (3, "A"), (3, "a"), (4, "a"), (3, "b"), (None, None)]
    got = exact_dedup(docs(spark, rows), keep="largest").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(3, 3, 1, True), (3, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True)]
    assert sorted(r.doc_id for r in keep_distinct(docs(spark, rows)).collect()) == [3, 3, 3, 4]
