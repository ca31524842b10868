import bisect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demolake.operators import quantiles, vectors
from demolake.streaming import monitors

SF = "/root/testdata/sf0.001"
QS = (0.01, 0.1, 0.5, 0.9, 0.99)


@pytest.fixture
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture
def by_dim(embeddings):
    return np.array([r.embedding for r in embeddings.collect()], dtype=float).T


def test_exact_quantiles_equal_numpy_whatever_the_split(spark, embeddings, by_dim, tmp_path):
    sink = monitors.counts_sink(str(tmp_path / "c"), "embedding")
    for k in range(8):
        sink(embeddings.filter(F.col("vec_id") % 8 == k), k)
    sink(embeddings.filter("vec_id % 8 = 3"), 3)  # a batch run again replaces itself
    for r in monitors.read_quantiles(spark, str(tmp_path / "c"), QS).collect():
        assert [r[quantiles.quantile_name(q)] for q in QS] == pytest.approx(np.quantile(by_dim[r.dim], QS).tolist()) and r.n == by_dim.shape[1]


def test_streamed_sketches_stay_within_their_rank_error(spark, tmp_path):
    big = spark.range(200_000).select(F.array(F.pmod(F.col("id") * 7919, F.lit(200_003)).cast("double"), F.pow(F.rand(3), F.lit(4)) * 1000).alias("v"), "id")
    big.write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    sink = monitors.stats_sink(str(tmp_path / "s"), "v", sketch=1024)
    for k in range(8):
        sink(source.filter(F.col("id") % 8 == k), k)
    sink(source.filter("id % 8 = 5"), 5)
    values = [sorted(x) for x in np.array([r.v for r in source.collect()]).T.tolist()]
    for r in monitors.read_stats(spark, str(tmp_path / "s"), QS).collect():
        own = values[r.dim]
        assert (r.n, r.min, r.max, r.mean) == (len(own), own[0], own[-1], pytest.approx(np.mean(own)))
        for q in QS:
            x = r[quantiles.quantile_name(q)]
            assert bisect.bisect_left(own, x) / len(own) - 0.005 <= q <= bisect.bisect_right(own, x) / len(own) + 0.005


def test_a_value_of_most_rows_and_missing_values(spark):
    rows = [(None if k % 10 == 9 else "ab"[k % 2], 5.0 if k % 3 else (None if k % 7 == 0 else math.nan if k % 5 == 0 else float(k))) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r for r in quantiles.exact_quantiles(df, "x", (0.0, 0.25, 0.5, 1.0), ["g"]).collect()}
    for g in ("a", "b", None):
        own = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        assert [got[g][c] for c in ("q00", "q25", "q50", "q100")] == pytest.approx(np.quantile(own, (0, 0.25, 0.5, 1)).tolist()) and got[g].n == len(own)
    whole = quantiles.exact_quantiles(df, "x", {"middle": 0.5}).first()
    assert whole.middle == 5.0
    assert [tuple(r) for r in quantiles.exact_quantiles(df.limit(0), "x", (0.5,)).collect()] == [(None, None)]
    assert quantiles.exact_quantiles(df.limit(0), "x", (0.5,), ["g"]).collect() == []


def test_no_task_holds_a_column(spark):
    """Exact quantiles of a whole table are ranks in ranges: no percentile aggregate is in the plan."""
    rows = spark.range(1000).select(F.array(F.col("id").cast("double")).alias("v"))
    plan = vectors.vector_stats(rows, "v", quantiles=QS, width=1)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_accumulators(spark, embeddings, by_dim):
    one = vectors.StatsAccumulator("embedding").update(embeddings.filter("vec_id < 100"))
    early = {r.dim: r.n for r in one.result().collect()}
    other = vectors.StatsAccumulator("embedding").update(embeddings.filter("vec_id >= 100"))
    got = {r.dim: r for r in one.merge(other).result((0.5,)).collect()}
    for dim, own in enumerate(by_dim):
        assert early[dim] == 100
        assert (got[dim].n, got[dim].mean, got[dim]["std"]) == (len(own), pytest.approx(own.mean()), pytest.approx(own.std()))
        assert abs((own <= got[dim].q50).mean() - 0.5) < 0.01
    with pytest.raises(ValueError, match="gathered"):
        vectors.StatsAccumulator("v").result()
    with pytest.raises(ValueError, match="don't merge"):
        one.merge(vectors.StatsAccumulator("v"))
