"""What many rows have in common is worked out once."""

from paceline.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_improvement_reads_totals_once(spark, sf):
    p = plan(catalogue.queries()["improvement_whatif"](spark, sf))
    assert sum("FileScan" in x and "o_totalprice" in x for x in p.splitlines()) == 1


def test_chains_are_walked_once_for_equal_legs(spark, sf):
    """The walk stands above the grouping by legs and nowhere below it, so it isn't done for each participation."""
    p = plan(catalogue.queries()["segment_chains"](spark, sf))
    walks = [i for i, x in enumerate(p.splitlines()) if "-999" in x]
    grouped = [i for i, x in enumerate(p.splitlines()) if "min(legs" in x]
    assert walks and grouped and max(walks) < min(grouped)
