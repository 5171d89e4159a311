"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from casebook.catalog.base import ORACLES, QUERIES
from tests.conftest import SMALL

QUICK = (
    "token_estimate", "lexical_top40", "knn_top40", "hybrid_retrieval", "hash_duplicates", "wide_facts", "sheet_records", "chunks_across_segments",
    "visible_documents", "scope_sizes", "history", "exchange_pairs", "heat_input", "dates", "whole_document", "citations", "check_log_process", "check_continuity",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
    assert set(QUICK) <= set(ORACLES)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    verdict, _, _, info = check.compare(spark, SMALL, name, QUERIES[name], ORACLES[name])
    assert verdict == "ok", info


def test_entry(spark):
    assert len(entry.entry(spark).take(1)) == 1
