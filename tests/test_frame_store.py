import re

import pytest
from pyspark.sql import functions as F

from demolake.operators import episodes, voxel
from demolake.sources import tables
from demolake.sources.frame_store import KEYS, FrameStore


@pytest.fixture
def rows(spark):
    points = spark.range(4000).select((F.col("id") % 50).alias("episode_index"), (F.floor(F.col("id") / 50) % 8).alias("frame_index"), F.col("id").alias("point_id"), *((F.pmod(F.col("id") * k, F.lit(1024)) / 1024).alias(c) for c, k in (("x", 7919), ("y", 104729), ("z", 31))), (F.col("id") % 5).cast("int").alias("label"))
    return points.repartition(7)


@pytest.fixture
def store(spark, rows, tmp_path):
    store = FrameStore.create(spark, str(tmp_path / "store"), buckets=4, chunk_size=10)
    store.write("points", rows.drop("label"), order=["point_id"])
    store.write("labels", rows.filter("point_id % 3 > 0").select(*KEYS, "point_id", "label"))
    store.write("cells", voxel.voxel_labels(rows, 0.25))
    store.write("anchors", rows.filter("episode_index % 4 = 0").groupBy(*KEYS).agg(F.avg("x").alias("anchor_x")))
    return store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def assembled(store):
    frames = store.read("points").select(*KEYS).distinct()
    return episodes.assemble_by_frame(frames, store.read("points"), labels=store.read("labels"), anchors=store.read("anchors"))


def test_assembly_and_label_transfer_without_exchange(spark, store, rows, no_broadcast):
    by_cell = tables.read_anchors(voxel.transfer_labels_by_frame(store.read("points"), store.read("cells"), 0.25), store.read("anchors"))
    for df in (assembled(store), by_cell):
        assert "SortMergeJoin" in plan(df) and not re.search(r"\bExchange\b", plan(df))
    want = voxel.transfer_labels(rows.drop("label"), voxel.voxel_labels(rows, 0.25), 0.25)
    columns = [*KEYS, "point_id", "vkey", "label", "matched"]
    assert sorted(map(tuple, by_cell.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    got = assembled(store)
    want = episodes.assemble(rows.select(*KEYS).distinct(), rows.drop("label"), labels=rows.filter("point_id % 3 > 0").select(*KEYS, "point_id", "label"), anchors=store.read("anchors"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_another_session_opens_it(spark, store, no_broadcast):
    want = sorted(map(str, assembled(store).collect()))
    for name in ("points", "labels", "cells", "anchors"):
        spark.sql(f"DROP TABLE {store._name(name)}")
    again = FrameStore.open(spark, store.path)
    assert (again.buckets, again.chunk_size) == (4, 10)
    assert sorted(map(str, assembled(again).collect())) == want and not re.search(r"\bExchange\b", plan(assembled(again)))


def test_coverage(store):
    got = {r.table: tuple(r)[1:] for r in store.coverage("points", ["points", "anchors"]).collect()}
    n = store.read("points").select(*KEYS).distinct().count()
    anchored = store.read("anchors").count()
    assert got == {"points": (4000, n, 0, 0, 1.0), "anchors": (anchored, anchored, n - anchored, 0, anchored / n)}
    back = {r.table: tuple(r)[1:] for r in store.coverage("anchors", ["points"]).collect()}
    assert back == {"points": (4000, n, 0, n - anchored, 1.0)}


def test_only_chunks_with_pending_frames_are_read(spark, store, rows):
    todo = rows.select(*KEYS).distinct()
    assert store.pending(todo, "points").count() == 0
    more = todo.unionByName(spark.createDataFrame([(23, 99), (24, 99)], todo.schema))
    left = store.pending(more, "points")
    assert sorted(map(tuple, left.collect())) == [(23, 99), (24, 99)]
    assert re.search(r"PartitionFilters: \[[^\]]*episode_chunk#\d+ (= 2|IN \(2\))", plan(left)), plan(left)
    store.write("points", left.withColumn("point_id", F.lit(0).cast("long")).withColumns({c: F.lit(0.5) for c in "xyz"}), append=True)
    assert store.pending(more, "points").count() == 0 and store.read("points").count() == 4002


def test_a_lost_manifest_costs_reading_only(spark, store, rows):
    todo = rows.select(*KEYS).distinct()
    spark.createDataFrame([], "episode_chunk int, n long, total long, mixed long, write string").write.mode("overwrite").parquet(f"{store.path}/_manifests/points")
    assert store.pending(todo, "points").count() == 0


def test_an_empty_table(spark, store, rows):
    store.write("none", rows.limit(0))
    assert store.coverage("points", ["none"]).first().covered == 0.0
    assert store.pending(rows.select(*KEYS).distinct(), "none").count() == rows.select(*KEYS).distinct().count()
