"""What physical plans must and must not have."""

from __future__ import annotations

import re

import pytest

from groundcheck.operators import claims, passages, vectors
from groundcheck.plans import queries as Q


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [("reference_id", "page_id,url"), ("content_hash_wordcount", "doc_id,text"), ("pdf_url_flag", "page_id,url"), ("cost_summary", "doc_id")])
def test_scans_read_what_is_used(spark, small, name, columns):
    text = plan(Q.QUERIES[name](spark, small))
    assert [",".join(c.split(":")[0] for c in m.split(",")) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)] == [columns]


def test_claims_are_split_without_a_shuffle(spark, small):
    text = plan(claims.segments(Q._cited(spark, small)))
    assert "Exchange" not in text and "Python" not in text and "ArrowEval" not in text


def test_marks_join_answers_not_claims(spark, small):
    text = plan(claims.claims(Q._cited(spark, small), Q._marked_refs(spark, small)))
    assert text.count("Join") == 1 and text.index("Generate") < text.index("Join")


def test_top_k_is_cut_before_the_shuffle(spark, small):
    text = plan(vectors.top_full(Q._asked(spark, small), Q._passages(spark, small), 5))
    assert text.count("WindowGroupLimit") == 2
    scoped = plan(vectors.top_scoped(Q._asked(spark, small), Q._passages(spark, small), 5))
    assert "FlatMapCoGroupsInPandas" in scoped and "CartesianProduct" not in scoped and "NestedLoop" not in scoped


def test_dense_ids_sort_no_whole_table(spark, small):
    rows = passages.with_ids(passages.word_windows(Q._documents(spark, small)))
    text = plan(rows)
    single = re.findall(r"Exchange SinglePartition.*\n(.*\n.*)", text)
    assert len(single) == 1 and "block" in single[0]  # only the ranges' totals
    ids = [r["embedding_id"] for r in rows.select("embedding_id").collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_functions_stay_in_the_jvm(spark, small):
    for name in ("url_normalize", "marker_canonicalize", "strip_source_section", "excerpt", "tolerant_json", "fetch_outcome", "report_row"):
        assert not re.search(r"Python|Pandas|ArrowEval", plan(Q.QUERIES[name](spark, small))), name


def test_hot_reference_is_spread(spark, small, monkeypatch):
    monkeypatch.setattr(vectors, "CLAIMS_PER_TASK", 7)
    asked, held = Q._asked(spark, small), Q._passages(spark, small)
    few = vectors.top_scoped(asked, held, 3).select("claim_id", "embedding_id", "score", "rank").collect()
    monkeypatch.setattr(vectors, "CLAIMS_PER_TASK", 10**9)
    assert sorted(few) == sorted(vectors.top_scoped(asked, held, 3).select("claim_id", "embedding_id", "score", "rank").collect())
