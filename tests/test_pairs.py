"""Pairs of jobs and library documents are formed last, and never move."""

import random
from collections import Counter

import pytest

from casebook.operators import scope


@pytest.mark.parametrize("block", [4, 4096])
def test_unattached_pairs_equal_the_plain_loop(spark, monkeypatch, capsys, block):
    monkeypatch.setattr(scope, "JOB_BLOCK", block)
    monkeypatch.setattr(scope, "DOCUMENT_BLOCK", 2 * block)
    rng = random.Random(7)
    pick = lambda *of: rng.choice([None, *of])
    jobs = [(pick(*range(30)), pick(1, 2, 3)) for _ in range(60)]
    held = [(pick(*range(100, 160)), pick(1, 2, 4)) for _ in range(150)]
    links = [(pick(*range(32)), pick(*range(100, 165))) for _ in range(600)]
    got = scope.unattached(spark.createDataFrame(held, "doc_id bigint, library bigint"), spark.createDataFrame(links, "job_id bigint, doc_id bigint"),
                           spark.createDataFrame(jobs, "job_id bigint, library bigint"))
    known = {(a, b) for a, b in links if a is not None and b is not None}
    want = Counter((a, b) for a, x in jobs for b, y in held if x is not None and x == y and (a, b) not in known)
    assert Counter((r.job_id, r.doc_id) for r in got.collect()) == want
    got.explain()
    plan = capsys.readouterr().out
    # the pairs' explode stands above every exchange of the plan
    assert plan.index("Generate explode(CASE") < plan.index("Exchange")


def test_links_to_documents_of_other_libraries_are_left_out_before_lists(spark, capsys):
    jobs = spark.createDataFrame([(1, 7), (2, 8)], "job_id bigint, library bigint")
    held = spark.createDataFrame([(10, 7), (11, 8)], "doc_id bigint, library bigint")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "job_id bigint, doc_id bigint")
    got = scope.unattached(held, links, jobs)
    assert [tuple(r) for r in got.collect()] == [(2, 11)]
    got.explain()
    plan = capsys.readouterr().out
    assert "LeftSemi" in plan and plan.index("collect_set") < plan.index("LeftSemi")
