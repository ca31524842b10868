import numpy as np
import pytest
from pyspark.sql import functions as F

from demolake.sources import arrays


@pytest.fixture
def store(spark, tmp_path):
    frames = spark.createDataFrame([(e, f, [float(e), float(f)], f % 2 == 0, e * 10 + f) for e in (3, 4, 12) for f in range(e)], "episode_index int, frame_index int, state array<float>, done boolean, tick int")
    points = spark.createDataFrame([(e, f, p, e + f / 8 + p / 64, p % 5) for e in (3, 4, 12) for f in range(e) for p in range((e + f) % 4)], "episode_index int, frame_index int, point_id int, x double, label tinyint")
    path = str(tmp_path / "cache")
    arrays.write_episode_arrays(frames.repartition(5), points.repartition(5), path)
    return path, frames, points


def test_round_trip(spark, store):
    path, frames, points = store
    back = arrays.read_episode_arrays(spark, path)
    assert back.columns == ["episode_index", "frame_index", "done", "state", "tick"]
    assert sorted(map(tuple, back.select(*frames.columns).collect())) == sorted(map(tuple, frames.collect()))
    back = arrays.read_episode_arrays(spark, path, "points", "label tinyint, episode_index long, x double, frame_index long, point_id long")
    assert sorted(map(tuple, back.select(*points.columns).collect())) == sorted(map(tuple, points.collect()))


def test_a_partition_is_a_file_and_files_are_pruned(spark, store):
    path, *_ = store
    rows = arrays.read_episode_arrays(spark, path, schema="episode_index long, tick int")
    assert rows.rdd.getNumPartitions() == 3
    for kept, episodes in ((rows.filter("episode_index = 4"), {4}), (rows.filter("episode_index IN (3, 12, 99)"), {3, 12}), (rows.filter("episode_index > 3 AND episode_index <= 11 AND tick >= 0"), {4})):
        assert kept.rdd.getNumPartitions() == len(episodes)
        assert {r.episode_index for r in kept.collect()} == episodes
    assert {r.episode_index for r in arrays.read_episode_arrays(spark, path, episodes=[12, 5]).collect()} == {12}
    assert rows.filter("episode_index = 99").collect() == []


def test_only_asked_arrays_are_loaded(spark, store, tmp_path):
    """An array that can't be read harms no query that doesn't name it."""
    path, *_ = store
    odd = {n: a for n, a in np.load(f"{path}/episode_000003.npz").items()}
    np.savez(f"{path}/episode_000003.npz", **odd | {"tick": np.zeros(99)})
    assert arrays.read_episode_arrays(spark, path, schema="episode_index long, done boolean").count() == 19
    with pytest.raises(Exception, match="tick has 99 rows, not 3"):
        arrays.read_episode_arrays(spark, path, schema="episode_index long, tick int").collect()


@pytest.mark.parametrize(
    ("members", "options", "what"),
    [
        ({"offsets": [1, 2]}, {}, "begin at 0"),
        ({"offsets": [0, 3, 1]}, {}, "never fall"),
        ({"offsets": [0, 1, 5]}, {}, "x has 4 rows, not 5"),
        ({"offsets": [0, 1, 4], "n": [1, 2]}, {"counts": "n"}, "n and offsets disagree"),
        ({"ends": [0, 1, 4]}, {"offsets": "ends", "counts": "lost"}, "no array lost"),
    ],
)
def test_what_is_wrong_with_a_file_is_said(spark, tmp_path, members, options, what):
    np.savez(tmp_path / "e_7.npz", x=np.arange(4.0), **{k: np.array(v) for k, v in members.items()})
    with pytest.raises(Exception, match=what):
        arrays.read_episode_arrays(spark, str(tmp_path), "points", "episode_index long, x double", **options).collect()


def test_arrays_beside_the_file(spark, tmp_path):
    np.savez(tmp_path / "episode_000002.npz", ends=np.array([0, 1, 3]), n=np.array([1, 2]))
    np.save(tmp_path / "episode_000002_points.npy", np.arange(18, dtype=np.float32).reshape(3, 6))
    rows = arrays.read_episode_arrays(spark, str(tmp_path), "points", "frame_index long, point_id long, points array<float>", offsets="ends", counts="n").collect()
    assert [(r.frame_index, r.point_id, r.points[0]) for r in rows] == [(0, 0, 0.0), (1, 0, 6.0), (1, 1, 12.0)]


def test_writes_replace_and_refuse(spark, store):
    path, frames, _ = store
    arrays.write_episode_arrays(frames.filter("episode_index = 3"), None, path, overwrite=True)
    assert {r.episode_index for r in arrays.read_episode_arrays(spark, path).collect()} == {3}
    with pytest.raises(Exception, match="has frame 2 where 1 is due"):
        arrays.write_episode_arrays(frames.filter("episode_index = 4 AND frame_index <> 1"), None, path)
    with pytest.raises(Exception, match="table is frames or points"):
        arrays.read_episode_arrays(spark, path, "pixels")
    with pytest.raises(Exception, match="no episode files"):
        arrays.read_episode_arrays(spark, path.replace("cache", "")).count()


def test_an_episode_without_points(spark, tmp_path):
    frames = spark.range(2).select(F.lit(1).alias("episode_index"), F.col("id").alias("frame_index"), F.lit(1.5).cast("float").alias("v"))
    arrays.write_episode_arrays(frames, None, str(tmp_path / "c"))
    assert arrays.read_episode_arrays(spark, str(tmp_path / "c"), "points").collect() == []
