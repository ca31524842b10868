"""Queries over vector columns and rotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demolake.functions import rotation
from demolake.operators import quantiles, vectors
from demolake.plans.catalog import query
from demolake.plans.fixtures import table

_LONG = "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


@query(f"""WITH e AS ({_LONG})
SELECT dim, count(*) AS n, round(quantile_cont(v, 1e-2), 9) AS q01, round(quantile_cont(v, 5e-1), 9) AS q50, round(quantile_cont(v, 99e-2), 9) AS q99 FROM e GROUP BY dim""")
def a02_quantiles_by_rank(spark, sf_dir):
    """A2 without a task that holds a dimension's values."""
    out = vectors.quantiles_by_rank(table(spark, sf_dir, "embeddings"), "embedding", (0.01, 0.5, 0.99))
    return out.withColumns({c: F.round(c, 9) for c in ("q01", "q50", "q99")})


@query(f"""WITH e AS ({_LONG})
SELECT dim, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, quantile_cont(v, 1e-2) AS q01, quantile_cont(v, 1e-1) AS q10,
  quantile_cont(v, 5e-1) AS q50, quantile_cont(v, 9e-1) AS q90, quantile_cont(v, 99e-2) AS q99 FROM e GROUP BY dim""")
def a01_vector_stats(spark, sf_dir):
    """A1, A2: per dimension, without exploding."""
    out = vectors.vector_stats(table(spark, sf_dir, "embeddings"), "embedding", quantiles=(0.01, 0.1, 0.5, 0.9, 0.99), width=64)
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


_QS = (0.01, 0.1, 0.5, 0.9, 0.99)
_PART = "pmod(vec_id * 31 + floor(vec_id / 7), 8)"


@query(f"""WITH e AS ({_LONG})
SELECT dim, count(*) AS n, {", ".join(f"round(quantile_cont(v, {round(100 * q)}e-2), 9) AS q{round(100 * q):02d}" for q in _QS)} FROM e GROUP BY dim""")
def r04_merged_quantiles(spark, sf_dir):
    """Exact quantiles of eight parts, merged from the parts' counts of values."""
    rows = table(spark, sf_dir, "embeddings")
    states = [quantiles.value_counts(quantiles.vector_values(rows.filter(f"{_PART} = {k}"), "embedding"), "x", ["dim"]) for k in range(8)]
    out = quantiles.counted_quantiles(quantiles.merge_counts(reduce(DataFrame.unionByName, states), ["dim"]), _QS, ["dim"])
    return out.withColumns({quantiles.quantile_name(q): F.round(quantiles.quantile_name(q), 9) for q in _QS})


@query("""SELECT l_returnflag AS flag, count(*) AS n, quantile_cont(CAST(l_quantity AS DOUBLE), 1e-1) AS q10, quantile_cont(CAST(l_quantity AS DOUBLE), 5e-1) AS q50, quantile_cont(CAST(l_quantity AS DOUBLE), 99e-2) AS q99
FROM lineitem GROUP BY l_returnflag""")
def a02_quantiles_of_few_values(spark, sf_dir):
    """A2 where a few values hold all rows: quantiles by rank of counted values."""
    return quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_quantity", (0.1, 0.5, 0.99), ["l_returnflag"]).withColumnRenamed("l_returnflag", "flag")


@query(f"""WITH e AS ({_LONG})
SELECT dim, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, min(v) AS q00, max(v) AS q100 FROM e GROUP BY dim""")
def x02_accumulator(spark, sf_dir):
    """Eight parts in two accumulators, merged; the ends of its sketches are the least and the greatest value."""
    rows = table(spark, sf_dir, "embeddings")
    one, other = vectors.StatsAccumulator("embedding"), vectors.StatsAccumulator("embedding")
    for k in range(8):
        (one if k % 2 else other).update(rows.filter(f"{_PART} = {k}"))
    return one.merge(other).result((0.0, 1.0)).withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query(f"""WITH e AS ({_LONG})
SELECT dim, count(*) AS n, min(v) AS min, max(v) AS max, CASE WHEN dim BETWEEN 3 AND 6 THEN 0 ELSE round(avg(v), 9) END AS mean,
  CASE WHEN dim BETWEEN 3 AND 6 THEN 1 ELSE round(stddev_pop(v), 9) END AS std FROM e GROUP BY dim""")
def a04_masked_stats(spark, sf_dir):
    stats = vectors.vector_stats(table(spark, sf_dir, "embeddings"), "embedding")
    out = vectors.mask_rotation_stats(vectors.replace_zero_std(stats), 3, 7, "quat")
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query(f"WITH e AS ({_LONG}) SELECT dim, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std FROM e GROUP BY dim")
def r04_merged_partials(spark, sf_dir):
    """Partial rows of eight parts, merged: the batch form of the streaming statistics."""
    parts = vectors.partial_stats(table(spark, sf_dir, "embeddings").withColumn("part", F.col("vec_id") % 8), "embedding", by=["part"])
    return vectors.merge_partials(parts).withColumns({"mean": F.round("mean", 7), "std": F.round("std", 7)})


@query("""WITH r AS (SELECT vec_id, list_concat(list_concat(embedding[1:2], [CAST(1 AS FLOAT), CAST(2 AS FLOAT)]), embedding[5:64]) AS v, embedding[3] AS a FROM embeddings)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS dim, CAST(unnest(v) AS DOUBLE) AS value, CAST(a AS DOUBLE) AS first, CAST(0 AS DOUBLE) AS last, CAST(6 AS INT) AS width FROM r""")
def p04_slice_and_pad(spark, sf_dir):
    """A slice replaced, and another padded."""
    two = F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.pad_vector(vectors.vslice("embedding", 2, 6), 6).alias("p"), F.posexplode(vectors.vreplace("embedding", 2, 4, two)).alias("dim", "value"))
    return rows.select("vec_id", "dim", F.col("value").cast("double").alias("value"), F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"), F.size("p").alias("width"))


@query(f"""WITH e AS ({_LONG}), s AS (SELECT dim, quantile_cont(v, 1e-2) AS lo, quantile_cont(v, 99e-2) AS hi FROM e GROUP BY dim),
b AS (SELECT vec_id, dim, greatest(least((v - lo) / (hi - lo) * 2e0 - 1e0, 1e0), -1e0) AS y FROM e JOIN s USING (dim))
SELECT vec_id, dim, round(y, 9) AS y, CAST(greatest(least(floor((y + 1e0) * 128), 255), 0) AS INT) AS bin FROM b""")
def f12_bounds_and_bins(spark, sf_dir):
    """clipped quantile bounds, then 256 bins. The one-row statistics are broadcast."""
    e = table(spark, sf_dir, "embeddings")
    stats = vectors.vector_stats(e, "embedding", quantiles=(0.01, 0.99), width=64)
    arrays = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "q01", "q99"))).alias("s")).select(F.col("s.q01").alias("lo"), F.col("s.q99").alias("hi"))
    y = vectors.bounds_normalise(F.col("embedding").cast("array<double>"), F.col("lo"), F.col("hi"), clip=True)
    rows = e.crossJoin(F.broadcast(arrays)).select("vec_id", y.alias("y"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("y", vectors.discretise(F.col("y")).alias("bin"))).alias("dim", "z")).select("vec_id", "dim", F.round("z.y", 9).alias("y"), F.col("z.bin").alias("bin"))


@query(f"""WITH e AS ({_LONG}), s AS (SELECT dim, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS d FROM e GROUP BY dim)
SELECT vec_id, dim, round((v - m) / d, 6) AS z FROM e JOIN s USING (dim)""")
def f11_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    stats = vectors.vector_stats(e, "embedding", width=64)
    arrays = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s")).select(F.col("s.mean").alias("m"), F.col("s.std").alias("d"))
    z = vectors.normalise(F.col("embedding").cast("array<double>"), F.col("m"), F.col("d"), guard=1e-6)
    return e.crossJoin(F.broadcast(arrays)).select("vec_id", F.posexplode(z).alias("dim", "z")).withColumn("z", F.round("z", 6))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 40 = 0 OR vec_id % 40 = 20)
SELECT vec_id, query_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[])))), 9) AS cosine
FROM embeddings, q""")
def a32_cosine_to_queries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.cosine_to_queries(e, "embedding", e.filter("vec_id % 20 = 0"), key="vec_id", digits=9)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0)
SELECT vec_id, query_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[])))), 9) AS cosine
FROM embeddings, q""")
def a32_cosine_to_every_twentieth(spark, sf_dir):
    """A32 with every row whose id is divisible by 20 as a query."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.cosine_to_queries(e, "embedding", e.filter("vec_id % 20 = 0"), key="vec_id", digits=9)


@query("""WITH a AS (SELECT vec_id % 5 AS rep, vec_id AS id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings),
c AS (SELECT rep, avg(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) AS m FROM a GROUP BY rep)
SELECT round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std, count(*) AS repeats FROM c""")
def a33_paired_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("rep", F.col("vec_id") % 5)
    half = lambda s: e.select("vec_id", "rep", F.slice("embedding", s, 32).alias("v"))
    out = vectors.paired_cosine(half(1), half(33), "v", "vec_id", "rep")
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


_N = "sqrt(q1 * q1 + q2 * q2 + q3 * q3 + q4 * q4)"


@query(f"""WITH q AS (SELECT vec_id, q1 / {_N} AS w, q2 / {_N} AS x, q3 / {_N} AS y, q4 / {_N} AS z FROM poses)
SELECT vec_id, round(w*w + x*x - y*y - z*z, 9) AS m0, round(2*(x*y - w*z), 9) AS m1, round(2*(x*z + w*y), 9) AS m2, round(2*(x*y + w*z), 9) AS m3, round(w*w - x*x + y*y - z*z, 9) AS m4,
  round(2*(y*z - w*x), 9) AS m5, round(2*(x*z - w*y), 9) AS m6, round(2*(y*z + w*x), 9) AS m7, round(w*w - x*x - y*y + z*z, 9) AS m8 FROM q""")
def f03_quat_to_matrix(spark, sf_dir):
    m = rotation.quat_to_matrix(F.array("q1", "q2", "q3", "q4"))
    return table(spark, sf_dir, "poses").withColumn("m", m).select("vec_id", *(F.round(F.element_at("m", k + 1), 9).alias(f"m{k}") for k in range(9)))


@query(f"""WITH q AS (SELECT vec_id, CASE WHEN q1 < 0 THEN -1 ELSE 1 END / {_N} AS s, * EXCLUDE vec_id FROM poses)
SELECT vec_id, round(q1 * s, 8) AS w, round(q2 * s, 8) AS x, round(q3 * s, 8) AS y, round(q4 * s, 8) AS z FROM q""")
def f04_quat_round_trip(spark, sf_dir):
    """through the matrix and back gives the unit quaternion with w >= 0."""
    q = rotation.convert_rotation(F.array("q1", "q2", "q3", "q4"), "quat", "quat")
    return table(spark, sf_dir, "poses").withColumn("q", q).select("vec_id", *(F.round(F.element_at("q", k + 1), 8).alias(c) for k, c in enumerate("wxyz")))


@query("""SELECT vec_id, round(cos(q2) * cos(q3), 9) AS m0, round(-cos(q2) * sin(q3), 9) AS m1, round(sin(q2), 9) AS m2,
  round(sin(q1) * sin(q2) * cos(q3) + cos(q1) * sin(q3), 9) AS m3, round(cos(q1) * cos(q3) - sin(q1) * sin(q2) * sin(q3), 9) AS m4, round(-sin(q1) * cos(q2), 9) AS m5 FROM poses""")
def f01_euler_to_matrix(spark, sf_dir):
    m = rotation.euler_to_matrix(F.array("q1", "q2", "q3"))
    return table(spark, sf_dir, "poses").withColumn("m", m).select("vec_id", *(F.round(F.element_at("m", k + 1), 9).alias(f"m{k}") for k in range(6)))


@query("SELECT vec_id, round(q1, 8) AS a, round(q2, 8) AS b, round(q3, 8) AS c FROM poses")
def f02_euler_round_trip(spark, sf_dir):
    e = rotation.convert_rotation(F.array("q1", "q2", "q3"), "euler", "euler")
    return table(spark, sf_dir, "poses").withColumn("e", e).select("vec_id", *(F.round(F.element_at("e", k + 1), 8).alias(c) for k, c in enumerate("abc")))


@query(f"""WITH q AS (SELECT vec_id, q1 / {_N} AS w, q2 / {_N} AS x, q3 / {_N} AS y, q4 / {_N} AS z FROM poses)
SELECT vec_id, round(w*w + x*x - y*y - z*z, 8) AS r0, round(2*(x*y + w*z), 8) AS r1, round(2*(x*z - w*y), 8) AS r2, round(2*(x*y - w*z), 8) AS r3, round(w*w - x*x + y*y - z*z, 8) AS r4, round(2*(y*z + w*x), 8) AS r5 FROM q""")
def f05_rot6d_round_trip(spark, sf_dir):
    """six numbers to a matrix and back, from quaternions."""
    six = rotation.convert_rotation(F.array("q1", "q2", "q3", "q4"), "quat", "rot6d")
    again = rotation.convert_rotation(F.col("r"), "rot6d", "rot6d")
    return table(spark, sf_dir, "poses").withColumn("r", six).withColumn("r", again).select("vec_id", *(F.round(F.element_at("r", k + 1), 8).alias(f"r{k}") for k in range(6)))


@query("SELECT vec_id, round(q1, 7) AS a, round(q2, 7) AS b, round(q3, 7) AS c FROM poses")
def f06_axis_angle_round_trip(spark, sf_dir):
    v = rotation.convert_rotation(F.array("q1", "q2", "q3"), "axisangle", "axisangle")
    return table(spark, sf_dir, "poses").withColumn("v", v).select("vec_id", *(F.round(F.element_at("v", k + 1), 7).alias(c) for k, c in enumerate("abc")))


@query("""WITH a AS (SELECT *, (vec_id % 64) / 64e0 AS t FROM poses)
SELECT vec_id, round(q1 * cos(t / 2) - q2 * sin(t / 2), 9) AS x, round(q2 * cos(t / 2) + q1 * sin(t / 2), 9) AS y, round(q3 * cos(t / 2) + q4 * sin(t / 2), 9) AS z, round(q4 * cos(t / 2) - q3 * sin(t / 2), 9) AS w FROM a""")
def f08_rotate_about_z(spark, sf_dir):
    q = rotation.rotate_quat_about_z(F.array("q1", "q2", "q3", "q4"), F.col("vec_id") % 64 / 64.0)
    return table(spark, sf_dir, "poses").withColumn("q", q).select("vec_id", *(F.round(F.element_at("q", k + 1), 9).alias(c) for k, c in enumerate("xyzw")))


@query("""WITH b AS (SELECT vec_id, unnest([q1, q2, q3]) AS a, unnest([0, 1, 2]) AS axis FROM poses), k AS (SELECT vec_id, axis, CAST(round_even((degrees(a) + 180e0) / 5e0, 0) AS INT) AS bin FROM b)
SELECT vec_id, CAST(axis AS INT) AS axis, CASE WHEN bin = 72 THEN 0 ELSE bin END AS bin FROM k""")
def f09_euler_bins(spark, sf_dir):
    return table(spark, sf_dir, "poses").select("vec_id", F.posexplode(rotation.euler_to_bins(F.array("q1", "q2", "q3"), 5.0)).alias("axis", "bin"))


@query("SELECT vec_id, round(q2, 9) AS x, round(q3, 9) AS y, round(q4, 9) AS z, round(q1 * q1, 9) AS gripper, round(cos(sqrt(q1*q1 + q2*q2 + q3*q3) / 2), 8) AS qw FROM poses")
def f22_reorder_action(spark, sf_dir):
    """base 4, mode, xyz, axis-angle, gripper to xyz, quaternion, gripper, base, mode."""
    a = F.array(*(F.lit(0.0) for _ in range(5)), F.col("q2"), F.col("q3"), F.col("q4"), F.col("q1"), F.col("q2"), F.col("q3"), F.col("q1") * F.col("q1"))
    out = table(spark, sf_dir, "poses").withColumn("a", rotation.reorder_action(a))
    return out.select("vec_id", *(F.round(F.element_at("a", k), 8 if n == "qw" else 9).alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z"), (8, "gripper"), (7, "qw"))))
