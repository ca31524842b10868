"""What readers, writers and the registry refuse."""

import pytest
from pyspark.sql import functions as F

from demolake.operators import anchors, registry
from demolake.sources import tables


def test_a_folder_without_frames_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="no Parquet files"):
        tables.read_frames(spark, str(tmp_path / "empty"))


def test_a_frame_without_points_is_an_error(spark):
    frames = spark.createDataFrame([(0, 0), (0, 1)], "episode_index long, frame_index long")
    points = spark.createDataFrame([(0, 0, 5)], "episode_index long, frame_index long, point_id long")
    assert tables.read_points(frames.limit(1), points).count() == 1
    with pytest.raises(Exception, match="no points of frame 0-1"):
        tables.read_points(frames, points).collect()
    assert tables.read_anchors(frames, points).filter("point_id IS NULL").count() == 1


def test_a_point_without_a_neighbour(spark):
    rows = [(0, 0, k, k / 8, 0.0, 0.0) for k in range(20)]
    cloud = spark.createDataFrame(rows, "episode_index long, frame_index long, point_id long, x double, y double, z double")
    moved = cloud.withColumn("x", F.col("x") + F.when(F.col("point_id") == 7, 0.01).otherwise(-0.001))
    got = {r.point_id: r.neighbour for r in anchors.nearest_within(moved, cloud, 0.002).collect()}
    assert got == {k: None if k == 7 else k for k in range(20)}
    with pytest.raises(Exception, match="no neighbour within 0.002 of point 7"):
        anchors.nearest_within(moved, cloud, 0.002, missing="error").collect()


def test_neighbours_across_cell_borders(spark):
    import random

    rnd = random.Random(3)
    rows = [(0, 0, k, *(rnd.choice([-1, 1]) * rnd.random() for _ in range(3))) for k in range(300)]
    schema = "episode_index long, frame_index long, point_id long, x double, y double, z double"
    asked = [(0, 0, 1000 + k, x + rnd.uniform(-0.2, 0.2), y, z) for k, (_, _, _, x, y, z) in enumerate(rows)]
    got = {r.point_id: r.neighbour for r in anchors.nearest_within(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), 0.15).collect()}
    for _, _, p, *a in asked:
        d, best = min((sum((x - y) ** 2 for x, y in zip(a, r[3:], strict=True)), r[2]) for r in rows)
        assert got[p] == (best if d <= 0.15**2 else None)


def test_registered_operators_have_names_of_their_own(spark):
    @registry.register_operator("first_half")
    def first_half(df):
        return df.filter("id < 5")

    assert spark.range(10).transform(registry.operator("first_half")).count() == 5
    with pytest.raises(ValueError, match="registered already"):
        registry.register_operator("first_half")(first_half)
    with pytest.raises(KeyError, match="first_half"):
        registry.operator("other")


def test_a_batch_sent_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "trial long, success boolean")
    for _ in range(2):
        tables.write_trials(df, str(tmp_path / "r"), final=False, batch="a")
    tables.write_trials(df.filter("trial = 1"), str(tmp_path / "r"), final=True, batch="a")
    got = tables.read_results(spark, str(tmp_path / "r"), df.schema, ["trial"]).collect()
    assert sorted((r.trial, r.is_final) for r in got) == [(1, True), (2, False)]


def test_sequences_with_common_first_values(spark):
    from demolake.operators import episodes

    source = [(s, f, [0.0] if f == 0 else [float(s), float(f)]) for s in range(40) for f in range(6)]
    mine = [(100 + s, f, v) for s, f, v in source if s < 5] + [(200, f, [0.0] if f == 0 else [-1.0]) for f in range(4)]
    schema = "episode_index long, frame_index long, action array<double>"
    got = {r.episode_index: (r.source_episode, r.matches) for r in episodes.match_sequences(spark.createDataFrame(mine, schema), spark.createDataFrame(source, schema)).collect()}
    assert got == {100: (0, 1), 101: (1, 1), 102: (2, 1), 103: (3, 1), 104: (4, 1), 200: (None, 0)}
