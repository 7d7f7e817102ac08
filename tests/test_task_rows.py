"""Tasks of the race queries hold a bounded number of rows, however large the tables are."""

import pytest

from paceline.plans import bindings, catalogue


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(bindings, "TASK_ROWS", 500)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_are_dealt_by_rows(spark, sf, small_tasks):
    t = bindings.Tables(spark, sf)
    assert t.tasks >= t.table("lineitem").count() / 500
    assert t.long_splits.rdd.getNumPartitions() == t.tasks


def test_cumulative_segments_hold_few_rows_a_task(spark, sf, small_tasks):
    n = bindings.Tables(spark, sf).tasks
    assert "hashpartitioning(id#" in (p := plan(catalogue.queries()["cumulative_segments"](spark, sf)))
    # both sides of the join by participation, once for the labels and once for the sums
    assert sum(f", {n})" in line.replace("), REPARTITION_BY_NUM", ")") and "REPARTITION_BY_NUM" in line for line in p.splitlines()) >= 3


def test_rank_evolution_sorts_few_rows_a_task(spark, sf, small_tasks):
    n = bindings.Tables(spark, sf).tasks
    p = plan(catalogue.queries()["rank_evolution"](spark, sf))
    assert any("hashpartitioning(course_id#" in x and f", {n}), REPARTITION_BY_NUM" in x for x in p.splitlines())


def test_planned_splits_join_few_rows_a_task(spark, sf, small_tasks):
    n = bindings.Tables(spark, sf).tasks
    p = plan(catalogue.queries()["planned_splits"](spark, sf))
    assert sum("hashpartitioning(id#" in x and f", {n}), REPARTITION_BY_NUM" in x for x in p.splitlines()) >= 2


def test_final_passages_hold_few_rows_a_task(spark, sf, small_tasks):
    n = bindings.Tables(spark, sf).tasks
    p = plan(catalogue.queries()["final_passages"](spark, sf))
    assert sum("Exchange" in x for x in p.splitlines()) == 1 and f", {n}), REPARTITION_BY_NUM" in p
