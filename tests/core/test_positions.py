from ledgerline.operators import names
from ledgerline.plans import flow_queries


def test_words_are_never_sent_to_the_driver(spark, sf_dir):
    """The words of rows look small to the planner and are not: the positions are the side that is sent."""
    rows = flow_queries._named(spark, sf_dir)
    plan = names.extract(rows, names.learn_positions(rows), ["p_partkey"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan
