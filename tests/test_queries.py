"""Every query against its SQL equivalent, and plans that must not scan texts twice."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__
import oracle
from talktrace.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(name, spark, con):
    frame = QUERIES[name](spark, SF)
    assert oracle.difference(con, ORACLES[name], frame) is None
    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    described = con.execute(ORACLES[name]).description
    assert {c: types[t] for c, t in frame.dtypes} == {d[0]: str(d[1]) for d in described}


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() == 6


def _final_plan(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


ONE_PASS = [
    "mention_counts", "mention_counts_outer", "mention_counts_tokens", "daily_mentions",
    "daily_mention_stats", "daily_mentions_with_average", "daily_series_long", "daily_sentiment_with_average", "mean_sentiment", "day_totals",
    "day_mean_sentiment", "moments", "moments_sentiment", "post_exit_daily", "post_exit_stats",
    "post_exit_with_average", "mentioned_lists", "comention_pairs", "edges_daily", "picked_subgraph",
    "closest_neighbor", "partner_breakdown",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_texts_are_matched_once(name, spark):
    frame = QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) == 1


@pytest.mark.parametrize("name", ["daily_sentiment", "daily_sentiment_zerofill", "post_exit_stats"])
def test_whole_dictionaries_are_not_collected(name, spark):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) <= 1
    assert not re.search(r"collect_(set|list)\(entity", plan)


@pytest.mark.parametrize("name", ["mention_counts", "mentioned_lists", "comention_pairs", "flatten_messages"])
def test_per_message_work_needs_no_shuffle(name, spark):
    assert "Exchange" not in _final_plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_joins(name, spark):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_selection_does_not_shuffle_the_events(spark):
    plan = QUERIES["event_entities"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_date_range_reaches_the_scan(spark):
    plan = QUERIES["messages_between"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ts,[^\]]*LessThan\(ts,", plan)
