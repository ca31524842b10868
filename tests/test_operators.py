import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demolake.functions import labels, rotation
from demolake.operators import anchors, episodes, evaluation, sampling, vectors, voxel
from demolake.sources import tables


def values(df, column):
    return [list(r[column]) for r in df.collect()]


def test_rotations_round_trip_and_are_orthonormal(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.standard_normal(4)]) for i in range(50)] + [(50, [1.0, 0.0, 0.0, 0.0]), (51, [0.0, 1.0, 0.0, 0.0]), (52, [-0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "i int, q array<double>")
    q = F.col("q")
    m = np.array(values(df.select(rotation.quat_to_matrix(q).alias("m")), "m")).reshape(-1, 3, 3)
    assert np.allclose(m @ m.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(m), 1)
    for kind in ("euler", "rot6d", "quat"):
        back = rotation.convert_rotation(rotation.convert_rotation(q, "quat", kind), kind, "matrix")
        assert np.allclose(np.array(values(df.select(back.alias("m")), "m")).reshape(-1, 3, 3), m, atol=1e-7)
    small = df.filter("i < 50")  # half turns lose their axis
    back = rotation.convert_rotation(rotation.convert_rotation(q, "quat", "axisangle"), "axisangle", "matrix")
    assert np.allclose(np.array(values(small.select(back.alias("m")), "m")).reshape(-1, 3, 3), m[:50], atol=1e-6)


def test_gimbal_lock_sets_the_third_angle_to_zero(spark):
    df = spark.createDataFrame([([0.3, math.pi / 2, 0.4],)], "e array<double>")
    out = values(df.select(rotation.convert_rotation(F.col("e"), "euler", "euler").alias("e")), "e")[0]
    assert out[2] == pytest.approx(0) and out[1] == pytest.approx(math.pi / 2)


def test_extrinsic_is_intrinsic_reversed(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3],)], "e array<double>")
    a = values(df.select(rotation.extrinsic_to_matrix(F.col("e"), "xyz").alias("m")), "m")
    b = values(df.select(rotation.euler_to_matrix(F.reverse("e"), "zyx").alias("m")), "m")
    assert np.allclose(a, b)


def cloud(spark, rows):
    return spark.createDataFrame([(0, 0, i, *map(float, p), label) for i, (p, label) in enumerate(rows)], "episode_index long, frame_index long, point_id long, x double, y double, z double, label int")


def test_voxels(spark):
    points = cloud(spark, [((-0.01, 0, 0), 1), ((-0.02, 0, 0), 2), ((0.01, 0, 0), 3)])
    got = {r.ix: (r.n_points, r.label) for r in voxel.merge_with_labels(points, 0.125).collect()}
    assert got == {-1: (2, 2), 0: (1, 3)}  # floor on negatives; label ties go up
    assert voxel.voxel_downsample(points, 0).count() == 3
    assert voxel.key_params(0.01) == (128, 256)
    with pytest.raises(ValueError, match="radix"):
        voxel.key_params(0.0005)
    with pytest.raises(Exception, match="packable"):
        voxel.cells(cloud(spark, [((50.0, 0, 0), 0)]), 0.125).select(voxel.pack_key(0.125)).collect()


def test_unmatched_gate(spark):
    t = voxel.transfer_labels(cloud(spark, [((0, 0, 0), 1), ((0.5, 0, 0), 1)]).drop("label"), voxel.voxel_labels(cloud(spark, [((0, 0, 0), 1)]), 0.125), 0.125)
    assert voxel.unmatched_share(t).first().unmatched == 0.5
    with pytest.raises(Exception, match="unmatched"):
        voxel.unmatched_share(t, limit=0.001).collect()


def test_hilbert_neighbours(spark):
    rows = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    df = spark.createDataFrame(rows, "ix long, iy long, iz long")
    path = [(r.ix, r.iy, r.iz) for r in voxel.with_hilbert_order(df, 3, "code").orderBy("code").collect()]
    codes = {r.code for r in voxel.with_hilbert_order(df, 3, "code").collect()}
    assert codes == set(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_density_draw(spark):
    rnd = np.random.default_rng(0)
    d = np.linalg.norm(rnd.standard_normal((2000, 3)) * 0.3, axis=1)
    w = 0.05 + 0.95 * np.exp(-0.5 * (d / 0.25) ** 2)
    df = spark.createDataFrame([(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(d, w, strict=True))], "episode_index long, frame_index long, point_id long, d double, w double")
    got = sampling.weighted_draw(df, "w", 800).toPandas()
    assert len(got) == 800 and got.point_id.is_unique
    assert (got.d < 0.25).mean() > (d < 0.25).mean() + 0.05 and (got.d > 0.75).any()
    assert sampling.weighted_draw(df.filter("point_id < 300"), "w", 800).count() == 300
    assert sampling.weighted_draw(df.withColumn("w", F.lit(0.0)), "w", 800).count() == 800
    assert sampling.weighted_draw(df.withColumn("w", F.lit(float("nan"))), "w", 800).count() == 800
    less = sampling.finite_weighted_draw(df, "w", 100).toPandas()
    assert set(less.point_id) < set(got.point_id)  # a smaller budget is a subset


def test_farthest_points(spark):
    points = cloud(spark, [((0, 0, 0), 0), ((1, 0, 0), 0), ((5, 0, 0), 0), ((2, 0, 0), 0)])
    got = [r.point_id for r in sampling.farthest_points(points, 3).orderBy("turn").collect()]
    assert got == [0, 2, 3]
    with pytest.raises(Exception, match="asked for"):
        sampling.farthest_points(points, 9).collect()


def test_holds_differ_on_empty_key_frames(spark):
    frames = spark.createDataFrame([(0, f) for f in range(6)], "episode_index long, frame_index long")
    keyed = spark.createDataFrame([(0, 1, 1.0), (0, 3, None)], "episode_index long, frame_index long, x double")
    held = lambda **o: [r.x for r in episodes.hold(frames, keyed, ["x"], **o).orderBy("frame_index").collect()]
    assert held() == [None, 1.0, 1.0, None, None, None]
    assert held(keep_empty=False) == [None, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_label_anchor_falls_back(spark):
    first = cloud(spark, [((0, 0, 0), 4), ((2, 0, 0), 4), ((9, 0, 0), 3)])
    assert anchors.label_anchor(first).first().x == 1.0
    assert anchors.label_anchor(first.filter("label = 3")).first().x == 9.0
    assert anchors.label_anchor(first.withColumn("label", F.lit(0))).first().x is None


def test_merge_shards(spark):
    a = spark.createDataFrame([(1, 2)], "k long, v long")
    assert episodes.merge_shards([a, a.withColumn("k", F.lit(3).cast("long"))], ["k"]).count() == 2
    with pytest.raises(Exception, match="several shards"):
        episodes.merge_shards([a, a], ["k"]).collect()
    with pytest.raises(ValueError, match="columns"):
        episodes.merge_shards([a, a.drop("v")], ["k"])


def test_wilson_and_pooling(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k int, n int")
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0] == (0.0, 0.0) and got[1] == pytest.approx((0.2366, 0.7634), abs=1e-4) and got[2][1] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="task"):
        evaluation.pool_success(df, ["step"])


def test_vector_helpers(spark):
    df = spark.createDataFrame([([-1.0, -0.999, 0.0, 1.0],)], "v array<double>")
    assert values(df.select(vectors.discretise(F.col("v")).alias("b")), "b") == [[0, 0, 128, 255]]
    with pytest.raises(Exception, match="width"):
        vectors.check_width(df, "v", 3).collect()
    low, high = F.array(*[F.lit(-2.0)] * 4), F.array(*[F.lit(2.0)] * 4)
    y = vectors.bounds_normalise(F.col("v"), low, high, clip=False)
    assert np.allclose(values(df.select(vectors.bounds_denormalise(y, low, high).alias("v")), "v"), [[-1, -0.999, 0, 1]])


def test_features_and_frames(spark, tmp_path):
    meta = spark.createDataFrame([("observation.image", "video", [4, 5, 3], ["h", "w", "channels"]), ("observation.state", "float32", [8], ["x"]), ("action", "float32", [8], ["x"]), ("next.done", "bool", [1], None)], "key string, dtype string, shape array<int>, names array<string>")
    assert {r.key: (r.kind, r.shape) for r in tables.classify_features(meta).collect()} == {"observation.image": ("visual", [3, 4, 5]), "observation.state": ("state", [8]), "action": ("action", [8])}
    frames = spark.createDataFrame([(e, f, float(f)) for e in (1, 1500) for f in range(3)], "episode_index long, frame_index long, v double")
    tables.write_frame_table(frames, str(tmp_path / "t"))
    back = tables.read_frames(spark, str(tmp_path / "t"), ["episode_index", "v"], episodes=[1500], chunk_size=1000)
    assert sorted(map(tuple, back.collect())) == [(1500, 0.0), (1500, 1.0), (1500, 2.0)]
    assert "PartitionFilters: [isnotnull(episode_chunk" in back._jdf.queryExecution().toString() or "PartitionFilters: [(episode_chunk" in back._jdf.queryExecution().toString()


def test_trials_from_paths(spark, tmp_path):
    root = tmp_path / "od-eef-n2048-s1" / "checkpoint-5000"
    root.mkdir(parents=True)
    (root / "per_trial_seed1_n2.json").write_text('{"seed": 1, "trials": [{"trial": 0, "success": true, "task": "od"}, {"trial": 1, "success": false, "task": "od"}], "skipped": [7]}')
    (root / "per_trial_seed1_partial.json").write_text('{"seed": 1, "trials": [{"trial": 0, "success": true}]}')
    got = tables.read_trials(spark, str(tmp_path)).orderBy("trial").collect()
    assert [(r.run, r.step, r.trial, r.success, r.n_skipped) for r in got] == [("od-eef-n2048-s1", 5000, 0, True, 1), ("od-eef-n2048-s1", 5000, 1, False, 1)]
    assert got[0].asDict()["task"] == "od"


def test_pixel_labels_and_foreground(spark):
    lookup = spark.createDataFrame([(1, 4), (2, 2)], "geom_id int, label int")
    px = spark.createDataFrame([(1,), (2,), (3,), (-1,)], "geom_id int")
    assert sorted((r.geom_id, r.label) for r in labels.pixel_labels(px, lookup).collect()) == [(-1, 0), (1, 4), (2, 2), (3, 0)]
    points = spark.createDataFrame([(5,), (6,), (labels.UNDEFINED,)], "instance int")
    assert [r.instance for r in labels.foreground(points, points.filter("instance = 5")).collect()] == [6]


def test_dense_index(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    numbered, n = sampling.dense_index(df, ["k"], "i", bucket_rows=90)
    assert n == 1000 and sorted(r.i for r in numbered.collect()) == list(range(1000))
    assert sampling.resample(df, 0.3, ["k"]).count() == 300


def test_farthest_points_of_large_clouds(spark):
    """Equal to the grouped map on small clouds; one cloud of all points is searched by several tasks, and ties go to the smaller point."""
    points = spark.range(900).select((F.col("id") % 3).alias("cloud"), F.col("id").alias("point_id"), *((F.pmod(F.col("id") * k, F.lit(32)) / 32).alias(c) for c, k in (("x", 7), ("y", 31), ("z", 113)))).repartition(6)
    of = lambda df: sorted(map(tuple, df.select("cloud", "point_id", "turn").collect()))
    assert of(sampling.farthest_points_of_large_clouds(points, 12, by=["cloud"])) == of(sampling.farthest_points(points, 12, by=["cloud"]))
    whole = sampling.farthest_points_of_large_clouds(points, 7).orderBy("turn").collect()
    grouped = sampling.farthest_points(points.withColumn("cloud", F.lit(0)), 7, by=["cloud"]).orderBy("turn").collect()
    assert [r.point_id for r in whole] == [r.point_id for r in grouped]
    assert sampling.farthest_points_of_large_clouds(points.limit(0), 3).collect() == []
    assert sampling.farthest_points_of_large_clouds(points.limit(0), 3, by=["cloud"]).collect() == []
    with pytest.raises(ValueError, match="has 300 points, 301 are asked for"):
        sampling.farthest_points_of_large_clouds(points, 301, by=["cloud"])
    with pytest.raises(ValueError, match="too many"):
        sampling.farthest_points_of_large_clouds(points, 3, by=["cloud"], most_clouds=2)
