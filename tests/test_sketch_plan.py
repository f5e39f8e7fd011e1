from corpusmill.queries import QUERIES


def test_lines_are_not_dealt_by_flag(spark, small):
    """The few rows of sketches go to the lines: three flags and two columns would be six tasks for all lines."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["merged_sketch_stats"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
