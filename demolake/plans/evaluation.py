"""Queries over evaluation trials and feature metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from demolake.operators import evaluation, sampling
from demolake.plans.catalog import query
from demolake.plans.fixtures import table
from demolake.sources.tables import nan_to_null

_POOL = "pool AS (SELECT task, sampling, npoints, step, count(*) FILTER (success) AS k, count(*) AS n, count(DISTINCT seed) AS n_seeds FROM trials GROUP BY ALL)"
_MID, _D = "(k / CAST(n AS DOUBLE) + 19208e-4 / n)", "(1 + 38416e-4 / n)"
_REACH = "(196e-2 * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + 38416e-4 / (4 * n * n)))"


@query(f"WITH {_POOL} SELECT task, sampling, npoints, step, k AS successes, n AS num_trials, n_seeds, k / CAST(n AS DOUBLE) AS rate, round(greatest(({_MID} - {_REACH}) / {_D}, 0), 9) AS low, round(least(({_MID} + {_REACH}) / {_D}, 1), 9) AS high FROM pool")
def a20_pool_success(spark, sf_dir):
    """A20, A21."""
    out = evaluation.pool_success(table(spark, sf_dir, "trials"))
    return out.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query(f"""WITH {_POOL}, c AS (SELECT task, npoints, sampling, printf('%.1f', 1e2 * k / n) AS v FROM pool WHERE step = 50000)
SELECT task, npoints, coalesce(max(v) FILTER (sampling = 'uniform'), '--') AS uniform, coalesce(max(v) FILTER (sampling = 'eef'), '--') AS eef, coalesce(max(v) FILTER (sampling = 'oracle'), '--') AS oracle FROM c GROUP BY ALL""")
def a22_success_table(spark, sf_dir):
    return evaluation.success_table(evaluation.pool_success(table(spark, sf_dir, "trials")), 50000, ["uniform", "eef", "oracle"])


_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY checkpoint, task, variation ORDER BY line) AS r FROM records) WHERE r = 1)"


@query(f"""WITH {_FIRST}, t AS (SELECT checkpoint, task, avg(sr) AS sr, count(*) AS n FROM first GROUP BY ALL)
SELECT checkpoint, round(avg(sr), 9) AS sr, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_tasks, CAST(regexp_extract(checkpoint, '(\\d+)$', 1) AS BIGINT) AS step FROM t GROUP BY checkpoint""")
def a23_rollup_tasks_first(spark, sf_dir):
    out = evaluation.sr_rollup(table(spark, sf_dir, "records"), "line", tasks_first=True)
    return out.withColumn("sr", F.round("sr", 9))


@query(f"""WITH {_FIRST} SELECT checkpoint, round(sum(sr * num_episodes) / sum(num_episodes), 9) AS sr, count(*) AS n_records, count(DISTINCT task) AS n_tasks, CAST(regexp_extract(checkpoint, '(\\d+)$', 1) AS BIGINT) AS step FROM first GROUP BY checkpoint""")
def a23_rollup_by_episodes(spark, sf_dir):
    """A23, W10."""
    return evaluation.sr_rollup(table(spark, sf_dir, "records"), "line", by_episodes=True).withColumn("sr", F.round("sr", 9))


@query("WITH r AS (SELECT checkpoint, max(sr) AS sr FROM records GROUP BY 1) SELECT * FROM r WHERE sr = (SELECT max(sr) FROM r)")
def t11_best_checkpoints(spark, sf_dir):
    return evaluation.best_checkpoints(table(spark, sf_dir, "records").groupBy("checkpoint").agg(F.max("sr").alias("sr")))


@query("""WITH t AS (SELECT *, trial // 8 AS scene FROM trials), p AS (SELECT a.success AS a, b.success AS b FROM t a JOIN t b USING (scene, seed, task) WHERE a.sampling = 'uniform' AND b.sampling = 'eef'),
c AS (SELECT count(*) AS n_pairs, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM p)
SELECT *, CASE WHEN only_a + only_b > 0 THEN greatest(abs(only_a - only_b) - 1, 0) * greatest(abs(only_a - only_b) - 1, 0) / CAST(only_a + only_b AS DOUBLE) END AS mcnemar FROM c""")
def j17_paired_arms(spark, sf_dir):
    t = table(spark, sf_dir, "trials").withColumn("scene", F.floor(F.col("trial") / 8))
    return evaluation.paired_arms(t, "sampling", "uniform", "eef", ["scene", "seed", "task"])


@query("""WITH e AS (SELECT config, arg_min(steps, steps) AS s0, arg_min(seconds, steps) AS t0, arg_max(steps, steps) AS s1, arg_max(seconds, steps) AS t1 FROM (SELECT config, steps, CASE WHEN steps = 50 THEN min(seconds) ELSE max(seconds) END AS seconds FROM runs GROUP BY config, steps) GROUP BY config),
r AS (SELECT config, CASE WHEN s1 > s0 AND t1 > t0 THEN (s1 - s0) / (t1 - t0) END AS rate FROM e)
SELECT config, rate, rate / (SELECT rate FROM r WHERE config = 1) AS speedup FROM r""")
def a34_marginal_rate(spark, sf_dir):
    runs = table(spark, sf_dir, "runs")
    return evaluation.marginal_rate(runs, base=1)


@query("""WITH n AS (SELECT count(*) AS n FROM frames) SELECT config, steps, seconds, run, n / 128e0 AS steps_per_epoch, steps / (n / 128e0) AS epochs, seconds * 4 / 3600e0 AS gpu_hours FROM runs, n""")
def a24_exposure(spark, sf_dir):
    return evaluation.exposure(table(spark, sf_dir, "runs"), table(spark, sf_dir, "frames"), batch=128, gpus=4)


@query("""WITH e AS (SELECT config, arg_min(steps, steps) AS s0, arg_min(seconds, steps) AS t0, arg_max(steps, steps) AS s1, arg_max(seconds, steps) AS t1 FROM (SELECT config, steps, CASE WHEN steps = 50 THEN min(seconds) ELSE max(seconds) END AS seconds FROM all_runs GROUP BY config, steps) GROUP BY config),
r AS (SELECT config, CASE WHEN s1 > s0 AND t1 > t0 THEN (s1 - s0) / (t1 - t0) END AS rate FROM e)
SELECT config, rate, rate / (SELECT rate FROM r WHERE config = 1) AS speedup FROM r""")
def a34_marginal_rate_all(spark, sf_dir):
    """A34 over all customers; each configuration has short and long runs."""
    runs = table(spark, sf_dir, "all_runs")
    return evaluation.marginal_rate(runs, base=1)


@query("""WITH n AS (SELECT count(*) AS n FROM frames) SELECT config, steps, seconds, run, n / 128e0 AS steps_per_epoch, steps / (n / 128e0) AS epochs, seconds * 4 / 3600e0 AS gpu_hours FROM all_runs, n""")
def a24_exposure_all(spark, sf_dir):
    """A24 over all customers."""
    return evaluation.exposure(table(spark, sf_dir, "all_runs"), table(spark, sf_dir, "frames"), batch=128, gpus=4)


@query("""WITH g AS (SELECT DISTINCT t.task AS task, s.step, d.seed FROM trials t, (SELECT unnest([10000, 20000, 30000, 60000]) AS step) s, (SELECT unnest([0, 1, 2]) AS seed) d), r AS (SELECT task, step, seed, bool_or(success) AS f FROM trials WHERE trial % 16 = 1 GROUP BY ALL)
SELECT g.task, CAST(g.step AS INT) AS step, CAST(g.seed AS INT) AS seed, CASE WHEN f THEN 'ok' WHEN f IS NOT NULL THEN 'partial' ELSE 'missing' END AS state FROM g LEFT JOIN r ON r.task = g.task AND r.step = g.step AND r.seed = g.seed""")
def u05_completeness(spark, sf_dir):
    t = table(spark, sf_dir, "trials")
    axis = lambda name, *v: spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in v))).alias(name))
    return evaluation.completeness(t.select("task").distinct(), axis("step", 10000, 20000, 30000, 60000), axis("seed", 0, 1, 2), t.filter("trial % 16 = 1").select("task", "step", "seed", F.col("success").alias("final")))


@query("""SELECT trial, task || '-' || sampling || '-n' || npoints || '-s' || seed AS name, task, sampling, npoints, seed FROM trials""")
def f30_run_names(spark, sf_dir):
    """Names made and read back."""
    t = table(spark, sf_dir, "trials")
    named = t.select("trial", evaluation.run_name(F.col("task"), F.col("sampling"), F.col("npoints"), F.col("seed")).alias("name"))
    return named.select("trial", "name", *(c.alias(k) for k, c in evaluation.parse_run(F.col("name")).items()))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY task, step, seed, success ORDER BY trial) AS r FROM trials), n AS (SELECT task, step, seed, count(DISTINCT success) AS c FROM trials GROUP BY ALL)
SELECT task, step, seed, trial, success FROM k JOIN n USING (task, step, seed) WHERE r <= CASE WHEN c = 2 THEN 1 ELSE 2 END""")
def t10_pick_rollouts(spark, sf_dir):
    return sampling.pick_rollouts(table(spark, sf_dir, "trials"), ["task", "step", "seed"]).select("task", "step", "seed", "trial", "success")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 64e0 AS p, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_linenumber, l_partkey) AS k FROM c)
SELECT l_orderkey, l_partkey, p FROM r WHERE k = 1""")
def t12_bin_argmax(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 64.0).alias("p"), "l_partkey", (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey")).alias("o"))
    return sampling.bin_argmax(c, ["l_orderkey"], "l_partkey", "p", "o")


@query("""WITH c AS (SELECT f.episode_index, f.frame_index, ex, unnest([-2, -1, 0, 1]) AS shift FROM grip f), d AS (SELECT *, (floor(ex * 8) / 8e0) + shift * 625e-4 AS candidate FROM c), g AS (SELECT *, abs(candidate - ex) AS gap FROM d),
w AS (SELECT *, max(CASE WHEN gap < 625e-4 THEN 1 ELSE 0 END) OVER k AS any_, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY gap, shift) AS r FROM g WINDOW k AS (PARTITION BY episode_index, frame_index)),
v AS (SELECT *, CASE WHEN any_ = 1 THEN CASE WHEN gap < 625e-4 THEN 1e0 ELSE 0e0 END ELSE CASE WHEN r = 1 THEN 1e0 ELSE 0e0 END END AS x FROM w)
SELECT episode_index, frame_index, CAST(shift AS INT) AS shift, candidate, round(x / sum(x) OVER (PARTITION BY episode_index, frame_index), 9) AS weight FROM v""")
def f10_soft_labels(spark, sf_dir):
    g = table(spark, sf_dir, "grip").select("episode_index", "frame_index", "ex", (F.floor(F.col("ex") * 8) / 8.0).alias("centre"))
    out = sampling.soft_labels(g, "ex", ["centre"], bins=4, size=0.0625, key=["episode_index", "frame_index"])
    return out.withColumn("weight", F.round("weight", 9))


@query("""WITH c AS (SELECT episode_index, frame_index, ex, unnest([-2, -1, 0, 1]) AS shift FROM grip), g AS (SELECT *, (floor(ex * 4) / 4e0) + shift * 625e-4 AS candidate, abs((floor(ex * 4) / 4e0) + shift * 625e-4 - ex) AS gap FROM c),
w AS (SELECT *, CASE WHEN gap <= 625e-4 THEN 1 / greatest(gap, 1e-4) ELSE 0e0 END AS i, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY gap, shift) AS r FROM g),
v AS (SELECT *, CASE WHEN max(i) OVER (PARTITION BY episode_index, frame_index) > 0 THEN i WHEN r = 1 THEN 1e0 ELSE 0e0 END AS x FROM w)
SELECT episode_index, frame_index, CAST(shift AS INT) AS shift, candidate, round(x / sum(x) OVER (PARTITION BY episode_index, frame_index), 9) AS weight FROM v""")
def f10_distance_labels(spark, sf_dir):
    """weights of one over the distance; where no candidate is near enough, the nearest alone."""
    g = table(spark, sf_dir, "grip").select("episode_index", "frame_index", "ex", (F.floor(F.col("ex") * 4) / 4.0).alias("centre"))
    out = sampling.soft_labels(g, "ex", ["centre"], bins=4, size=0.0625, key=["episode_index", "frame_index"], weights="distance")
    return out.withColumn("weight", F.round("weight", 9))


@query("SELECT p_partkey AS id, NULLIF(CASE WHEN p_partkey % 3 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice END, 'NaN'::DOUBLE) AS price FROM part")
def s05_nan_to_null(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("price"))
    return nan_to_null(p)


@query("""SELECT p_partkey AS id, CASE WHEN p_type LIKE 'robot%' OR p_partkey % 11 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 4 WHEN p_partkey % 5 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS label FROM part""")
def f29_body_labels(spark, sf_dir):
    """robot before handle before door or drawer before target."""
    from demolake.functions.labels import body_label

    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "robot0_link").when(k % 7 == 0, "cab_handle").when(k % 5 == 0, "cab_door").when(k % 3 == 0, "apple_main").otherwise("wall")
    return table(spark, sf_dir, "part").select(k.alias("id"), body_label(name, targets=("apple",)).alias("label"))
