"""Plans: filters and columns reach the scan, no Python on Column-only paths, no nested loops over tables."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("PLUMBLINE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
PYTHON = {"envelope_verify"}


def plan(spark, name):
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "scan_filter")
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,purchase\), GreaterThan\(value,100.0\)", text)
    assert "props" not in re.search(r"ReadSchema: (\S+)", text)[1]
    assert re.search(r"ReadSchema: struct<doc_id:bigint>", plan(spark, "stable_sample"))


@pytest.mark.parametrize("name", ["rubric_score", "toxicity", "instruction_following", "l1_clear", "event_correlation", "bm25_topk", "rule_repetition", "sentence_split"])
def test_no_python_and_no_products(spark, name):
    text = plan(spark, name).split("== Physical Plan ==")[1]
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|CartesianProduct", text)


def test_range_joins_are_equi_joins(spark):
    text = plan(spark, "event_correlation").split("== Physical Plan ==")[1]
    assert "NestedLoop" not in text and re.search(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", text)


@pytest.mark.parametrize("name", ["event_correlation", "drift_causation"])
def test_alerts_meet_no_buckets_of_raw_events(spark, name):
    """What an alert meets is numbered: no join has the time bucket as its only key between alerts and events."""
    text = plan(spark, name).split("== Physical Plan ==")[1]
    assert "_number" in text and "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["vector_topk", "retrieval_quality", "fabrication"])
def test_vectors_do_not_meet_row_by_row(spark, name):
    text = plan(spark, name).split("== Physical Plan ==")[1]
    assert "FlatMapCoGroupsInArrow" in text and "NestedLoop" not in text and "CartesianProduct" not in text


def test_aggregates_are_partial_before_they_shuffle(spark):
    text = plan(spark, "capability_rollup").split("== Physical Plan ==")[1]
    assert text.count("partial_") >= 1


def test_only_named_queries_use_python(spark):
    for name in ("run_diff_flips", "drift_trend", "threshold_sweep", "queue_stats"):
        assert name not in PYTHON and not re.search("Python|Pandas", plan(spark, name).split("== Physical Plan ==")[1])
