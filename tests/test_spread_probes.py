from demolake.operators import sampling


def test_probes_of_many_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS a", "'x' AS b").repartition(5)
    for k in (7, 50, 999, 3000):
        step = max(1, 1000 // k)
        assert sorted(r.a for r in sampling.spread_probes(df, k, ["a"]).collect()) == list(range(0, 1000, step))[:k]
    assert sampling.spread_probes(df.limit(0), 5, ["a"]).count() == 0


def test_rows_are_not_numbered_in_one_task(spark):
    plan = sampling.spread_probes(spark.range(100).toDF("a"), 5, ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_p" in plan
