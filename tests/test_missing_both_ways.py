from corpusmill.operators import joins


def test_nulls_repeats_and_empty_sides(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "key long")
    b = spark.createDataFrame([(2,), (2,), (3,), (3,), (None,)], "key long")
    got = sorted(map(tuple, joins.both_way_missing(a, b, "key").collect()), key=repr)
    assert got == sorted([(1, "only_left"), (3, "only_right"), (None, "only_left"), (None, "only_right")], key=repr)
    assert joins.both_way_missing(a.filter("false"), b.filter("false"), "key").count() == 0
    assert {tuple(r) for r in joins.both_way_missing(a, b.filter("false"), "key").collect()} == {(1, "only_left"), (2, "only_left"), (None, "only_left")}


def test_keys_are_grouped_once_without_a_join(spark):
    keys = spark.range(1000).withColumnRenamed("id", "key")
    plan = joins.both_way_missing(keys.filter("key % 3 <> 0"), keys.filter("key % 2 = 0"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1, plan
