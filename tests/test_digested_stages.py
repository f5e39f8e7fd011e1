from pyspark.sql import functions as F

from corpusmill.plans.pipeline import Stage, plan_digest, run_digested


def stages(spark, root, least=10, factor=2):
    """Two inputs, a stage on each, and one on both."""

    def read(name):
        return spark.read.parquet(f"{root}/in/{name}")

    return [
        Stage("large", lambda r: read("a").filter(F.col("id") >= least)),
        Stage("scaled", lambda r: read("b").withColumn("id", F.col("id") * factor)),
        Stage("both", lambda r: r["large"].join(r["scaled"], "id")),
        Stage("count", lambda r: r["both"].groupBy().count(), params={"version": 1}),
    ]


def built(root):
    return {str(p.parent.relative_to(root / "out")): p.stat().st_mtime_ns for p in (root / "out").glob("*/*/_SUCCESS")}


def test_exactly_the_right_stages_run_again(spark, tmp_path):
    def go(**options):
        before = built(tmp_path)
        out = run_digested(spark, stages(spark, tmp_path, **options), f"file://{tmp_path}/out")
        after = built(tmp_path)
        assert all(after[k] == v for k, v in before.items())  # no table is written twice
        return {k.split("/")[0] for k in after.keys() - before.keys()}, out["count"].first()[0]

    for name in "ab":
        spark.range(40).write.parquet(f"{tmp_path}/in/{name}")
    assert go() == ({"large", "scaled", "both", "count"}, 15)
    assert go() == (set(), 15)
    assert go(least=20) == ({"large", "both", "count"}, 10)
    assert go(factor=3) == ({"scaled", "both", "count"}, 10)
    assert go() == (set(), 15)  # back to what is there
    spark.range(100, 110).write.mode("append").parquet(f"{tmp_path}/in/b")
    assert go() == ({"scaled", "both", "count"}, 15)


def test_digest_follows_plan_names_params_and_session(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    one = plan_digest(df.filter("id > 1"), {"x": 1})
    assert one == plan_digest(spark.newSession().read.parquet(f"{tmp_path}/t").filter("id > 1"), {"x": 1})
    others = [plan_digest(df.filter("id > 2"), {"x": 1}), plan_digest(df.filter("id > 1"), {"x": 2}), plan_digest(df.filter("id > 1").withColumnRenamed("id", "i"), {"x": 1})]
    assert len({one, *others}) == 4
    wide = [df.select(*((F.col("id") + (n if i == 59 else i)).alias(f"c{i}") for i in range(60))) for n in (1, 2)]
    assert plan_digest(wide[0]) != plan_digest(wide[1])
