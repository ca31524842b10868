"""What must not grow faster than the input: files written, passes over a table, calls of Python, rows of a task."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from demolake.operators import curves, pooling, sampling, vectors, voxel
from demolake.sources import arrays, frame_store, shared, tables
from demolake.streaming import monitors


def plan(df):
    return df._jdf.queryExecution().toString()


def test_results_without_expiry_are_an_aggregate(spark, tmp_path):
    """A Python call for each key took hours; only state that expires needs one."""
    schema = "trial long, version long, is_final boolean"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    held = monitors.keep_results(stream, ["trial"], version="version")._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in held and "Aggregate" in held
    assert "TransformWithState" in monitors.keep_results(stream, ["trial"], version="version", ttl_ms=1000)._jdf.queryExecution().analyzed().toString()


def test_a_chunk_of_few_episodes_is_one_file(spark, tmp_path, request):
    """Ten episodes were up to ten files; files keep their episodes in order, and large chunks are several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    frames = spark.range(3000).select((F.col("id") % 100).alias("episode_index"), F.floor(F.col("id") / 100).alias("frame_index")).repartition(5)
    tables.write_frame_table(frames, str(tmp_path / "t"), chunk_size=10)
    files = sorted(Path(tmp_path / "t").rglob("*.parquet"))
    assert len(files) == 10
    held = [(r.episode_index, r.frame_index) for r in spark.read.parquet(str(files[3])).collect()]
    assert held == sorted(held) and len(held) == 300
    assert sorted(map(tuple, tables.read_frames(spark, str(tmp_path / "t"), frames.columns).collect())) == sorted(map(tuple, frames.collect()))
    tables.write_frame_table(frames, str(tmp_path / "u"), chunk_size=100, run=20)
    assert 1 < len(list(Path(tmp_path / "u").rglob("*.parquet"))) <= 5


def test_farthest_points_of_many_clouds_at_once(spark):
    """Equal to one cloud after another, with ties and clouds of unequal sizes; a cloud is a row, not a call of Python, and the table is read once."""
    import numpy as np

    rnd = np.random.default_rng(3)
    rows = [(c, p, *(float(v) for v in rnd.integers(0, 6, 3))) for c in range(60) for p in rnd.permutation(3 + c % 20).tolist()]
    points = spark.createDataFrame(rows, "cloud long, point_id long, x double, y double, z double").repartition(3)
    want = []
    for c in range(60):
        cloud = sorted(r for r in rows if r[0] == c)
        xyz, far, at = np.array([r[2:] for r in cloud]), np.full(len(cloud), np.inf), 0
        for turn in range(5 if len(cloud) >= 5 else 0):
            want.append((c, cloud[at][1], turn))
            far = np.minimum(far, ((xyz - xyz[at]) ** 2).sum(axis=1))
            at = int(far.argmax())
    got = sampling.farthest_points(points, 5, by=["cloud"], skip=True)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroups" not in plan(got) and plan(got.select("turn")).count("Aggregate [cloud") <= 3
    whole = points.filter("cloud % 20 > 1")
    large = sampling.farthest_points_of_large_clouds(whole, 5, by=["cloud"])
    assert sorted(map(tuple, large.collect())) == sorted(w for w in want if w[0] % 20 > 1)


def test_large_clouds_are_evaluated_once(spark):
    """Each round evaluated the whole plan of the points again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    points = spark.range(500).selectExpr("id % 2 AS cloud", "id AS point_id", "double(id * 7 % 32) AS x", "double(id * 31 % 32) AS y", "double(id * 113 % 32) AS z")
    sampling.farthest_points_of_large_clouds(points.mapInPandas(count, points.schema), 4, by=["cloud"]).collect()
    assert seen.value == 500


def test_hilbert_codes_are_computed_for_many_points_at_once(spark):
    """A fold of SQL expressions took about 60 microseconds a point; nulls stay null."""
    df = spark.createDataFrame([(1, 2, 3), (None, 0, 0), (5, 7, 0)], "ix long, iy long, iz long")
    coded = voxel.with_hilbert_order(df, 3, "code")
    back = curves.hilbert_cells(coded, "code", 3, ["jx", "jy", "jz"])
    assert "aggregate(" not in plan(back) and "ArrowEvalPython" in plan(back)
    assert [r.code is None for r in coded.collect()] == [False, True, False]
    assert [(r.jx, r.jy, r.jz) for r in back.collect()] == [(1, 2, 3), (None, None, None), (5, 7, 0)]


def test_many_array_files_are_few_partitions(spark, tmp_path):
    """A task for each of thousands of files took hours; every file is still read, and what episodes hold is kept."""
    frames = spark.range(1203).selectExpr("id AS episode_index", "0L AS frame_index", "cast(id * 20 AS short) AS v", "array(double(id), 0.5D) AS w")
    arrays.write_episode_arrays(frames, None, str(tmp_path / "c"))
    back = arrays.read_episode_arrays(spark, str(tmp_path / "c"), schema="episode_index long, frame_index long, v short, w array<double>")
    assert back.rdd.getNumPartitions() == 172
    assert sorted(map(str, back.collect())) == sorted(map(str, frames.collect()))


def test_chunks_of_a_store_widen_with_its_episodes(spark, tmp_path):
    """Files were chunks times buckets, without bound; the widened store opens again and knows what is pending."""
    rows = spark.range(3000).selectExpr("id AS episode_index", "0L AS frame_index", "id AS v")
    store = frame_store.FrameStore.create(spark, str(tmp_path / "s"), buckets=2, chunk_size=5)
    store.write("rows", rows)
    assert store.chunk_size == 95 and len(list((tmp_path / "s" / "rows").glob("episode_chunk=*"))) == 32
    again = frame_store.FrameStore.open(spark, store.path)
    assert again.chunk_size == 95 and again.read("rows").count() == 3000
    more = spark.range(2995, 3005).selectExpr("id AS episode_index", "0L AS frame_index")
    assert sorted(r.episode_index for r in again.pending(more, "rows").collect()) == list(range(3000, 3005))


def test_windows_of_many_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    """The sorts of a cloud's windows grew with the table, as the number of tasks didn't; results are the same."""
    points = spark.range(400).selectExpr("id % 20 AS episode_index", "0L AS frame_index", "id AS point_id", "double(id * 7 % 32) / 32 AS x", "double(id * 31 % 32) / 32 AS y", "double(id * 113 % 32) / 32 AS z")
    made = lambda: (pooling.pooling_ids(points, 0.25, [2]), curves.permutations(voxel.serialise(points, 0.25, depth=4)), voxel.voxel_downsample(points, 0.25, origin="min"))
    want = [sorted(map(tuple, df.collect())) for df in made()]
    monkeypatch.setattr(shared, "AT_ONCE", 25)
    for df, rows in zip(made(), want, strict=True):
        assert re.search(r"RepartitionByExpression \[episode_index#\d+L?, frame_index#\d+L?\], 16", plan(df)), plan(df)
        assert sorted(map(tuple, df.collect())) == rows


def test_products_of_rows_and_queries_are_dealt_over_tasks(spark, monkeypatch):
    """All pairs of one input file were one task; results are the same, and only the two sides are shuffled."""
    df = spark.range(600).selectExpr("id AS vec_id", "array(double(id % 7) - 3, double(id % 11), IF(id = 5, NULL, 1D)) AS embedding").coalesce(1)
    made = lambda: vectors.cosine_to_queries(df, "embedding", df.filter("vec_id % 2 = 0"), key="vec_id", block=40).withColumn("cosine", F.round("cosine", 9))
    want = sorted(map(str, made().collect()))
    monkeypatch.setattr(vectors, "RESULTS", 10_000, raising=False)
    got = made()
    assert sorted(map(str, got.collect())) == want and len(want) == 600 * 300
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 18 and max(r["count"] for r in tasks) <= 10_000
    planned = plan(made()).split("== Physical Plan ==")[1]
    assert "CartesianProduct" in planned and planned.count("Exchange RoundRobin") == 2
    monkeypatch.setattr(vectors, "MOST_TASKS", 6)
    assert made().rdd.getNumPartitions() == 6
