"""Plan-shape guards for the scale properties the operators are written for."""

import pytest

from __spark_entry__ import queries
from cartwheel.operators import funnel
from cartwheel.operators.joins import materialize_table
from cartwheel.plans import reports
from cartwheel.sources.testviews import shop_tables

SF = "/root/testdata/sf0.001"


def _plan(spark, name, executed=False):
    df = queries()[name](spark, SF)
    if executed:
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["funnel_counts", "page_order_effect", "traffic_channel",
                                  "channel_monthly_conversion"])
def test_no_expand_for_distinct_counts(spark, name):
    assert "Expand" not in _plan(spark, name)


def test_iqr_bounds_reach_the_scan(spark):
    plan = _plan(spark, "remove_outliers_iqr")
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value," in plan
    assert "Exchange" not in plan


def test_scans_are_pruned(spark):
    # the page URL depends only on the event type and id: nothing else is read
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in _plan(spark, "most_viewed_pages")


def test_order_filter_pushed(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in _plan(spark, "orders_monthly")


def test_funnel_cut_is_a_broadcast(spark):
    """What the funnel stores first: page views are cut to the chosen sessions without a shuffle,
    and its statements read no more than what is stored."""
    t = shop_tables(spark, SF)
    sessions = t["website_sessions"]
    chosen = materialize_table(sessions.where(reports._funnel_where(sessions)).select("website_session_id"), "chosen")
    views = funnel.views_of(chosen, t["website_pageviews"])
    views.collect()
    plan = views._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    for name in ("funnel_sessions", "funnel_counts", "funnel_click_rates", "funnel_pageviews"):
        assert not any("testdata" in f for f in queries()[name](spark, SF).inputFiles())


@pytest.mark.parametrize("name", ["funnel_sessions", "billing_pages", "duplicate_rows", "nunique"])
def test_no_rows_are_gathered_in_one_task(spark, name):
    """What goes to a single partition is partial sums, never rows (a limit before a count)."""
    plan = _plan(spark, name, executed=True)
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "SinglePartition" in line:
            assert "partial_" in below or "Aggregate" in below, plan


def test_nunique_copies_no_rows(spark):
    assert "Expand" not in _plan(spark, "nunique")
