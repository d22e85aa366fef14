"""The plans of the queries: no all-pairs joins, narrow scans, few shuffles."""

import pytest

from galley import registry
from galley.plans import inspect

FOLDER = "/root/testdata/sf0.001"
#: Sides of a fixed size (totals, the newest time, the lenses of a profile) may be joined with everything.
ONE_ROW = {"a01_recall_precision", "a08_drift", "k07_expired", "s02_stage_batch", "t06_pass_schedule"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_all_pairs(spark, name):
    assert name in ONE_ROW or not inspect.all_pairs(registry.QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize(("name", "columns"), [("l05_repeated_lines", {"doc_id", "text"}), ("a16_health", {"ts", "value"}), ("x15_similarity", {"p_partkey", "p_name", "p_type", "p_brand"}), ("a03_burden", {"o_orderkey", "l_orderkey", "l_discount", "l_quantity", "l_partkey", "l_linenumber", "l_tax"})])
def test_scans_read_only_what_is_needed(spark, name, columns):
    assert inspect.columns_read(registry.QUERIES[name](spark, FOLDER)) <= columns


@pytest.mark.parametrize(("name", "most"), [("a16_health", 2), ("x26_confidence", 1), ("t08_last_answer", 1), ("b01_exact_dedupe", 1), ("a11_status_rollup", 1)])
def test_shuffles(spark, name, most):
    assert inspect.exchanges(registry.QUERIES[name](spark, FOLDER)) <= most
