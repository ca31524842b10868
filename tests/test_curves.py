import random

import pytest
from pyspark.sql import functions as F

from demolake.operators import curves, pooling, voxel


def all_cells(spark, depth):
    n = 1 << depth
    return spark.range(n**3).select((F.col("id") % n).alias("ix"), (F.floor(F.col("id") / n) % n).alias("iy"), F.floor(F.col("id") / (n * n)).alias("iz"))


@pytest.mark.parametrize("curve", ["z", "hilbert"])
def test_decoding_undoes_encoding_on_all_cells(spark, curve):
    df = all_cells(spark, 6)
    coded = df.withColumn("code", voxel.z_order(6)) if curve == "z" else voxel.with_hilbert_order(df, 6, "code")
    decode = curves.z_cells if curve == "z" else curves.hilbert_cells
    back = decode(coded, "code", 6, ["jx", "jy", "jz"])
    assert back.filter("ix != jx OR iy != jy OR iz != jz").count() == 0
    assert coded.agg(F.count_distinct("code"), F.min("code"), F.max("code")).first() == (64**3, 0, 64**3 - 1)


@pytest.mark.parametrize("depth", [1, 9, 16])
def test_other_depths(spark, depth):
    rnd = random.Random(depth)
    rows = [tuple(rnd.randrange(1 << depth) for _ in range(3)) for _ in range(50)] + [((1 << depth) - 1,) * 3, (0, 0, 0)]
    coded = voxel.with_hilbert_order(spark.createDataFrame(rows, "ix long, iy long, iz long"), depth, "code")
    back = curves.hilbert_cells(coded, "code", depth, ["jx", "jy", "jz"])
    assert back.filter("ix = jx AND iy = jy AND iz = jz").count() == len(rows)


def cloud(spark, n=300):
    rnd = random.Random(5)
    rows = [(e, f, p * 3 + 1, *(rnd.randrange(64) / 64 for _ in range(3)), rnd.randrange(5)) for e in range(2) for f in range(3) for p in range(n // (1 + f))]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, point_id long, x double, y double, z double, label int")


def test_an_order_and_its_inverse_are_the_identity(spark):
    points = voxel.serialise(cloud(spark), 0.25, depth=4, curve="hilbert")  # cells are crowded, so that codes tie
    found = curves.permutations(points).collect()
    by_cloud = {}
    for r in found:
        by_cloud.setdefault((r.episode_index, r.frame_index), {})[r.i] = r
    codes = {}
    for r in points.orderBy("point_id").collect():
        codes.setdefault((r.episode_index, r.frame_index), []).append((r.code, r.point_id))
    for key, rows in by_cloud.items():
        order, inverse = [rows[i].order for i in range(len(rows))], [rows[i].inverse for i in range(len(rows))]
        assert [order[inverse[i]] for i in range(len(rows))] == [inverse[order[i]] for i in range(len(rows))] == list(range(len(rows)))
        assert [codes[key][i] for i in order] == sorted(codes[key])


def test_batch_codes(spark):
    df = spark.createDataFrame([(0, 5), (3, 63), (7, 0)], "batch long, code long")
    both = curves.batch_code(F.col("code"), F.col("batch"), 2)
    rows = df.withColumn("both", both).select("batch", "code", "both", *(c.alias(n) for c, n in zip(curves.split_batch_code(F.col("both"), 2), ("b", "c"), strict=True))).collect()
    assert [r.both for r in rows] == [5, 3 * 64 + 63, 7 * 64] and all((r.b, r.c) == (r.batch, r.code) for r in rows)
    with pytest.raises(Exception, match="no code of depth 1"):
        df.select(curves.batch_code(F.col("code"), F.col("batch"), 1)).collect()
    for depth, batches in ((0, 1), (17, 1), (16, 1 << 16)):
        with pytest.raises(ValueError, match="depth"):
            curves.check_depth(depth, batches)


def test_a_cloud_that_is_too_wide_is_an_error(spark):
    with pytest.raises(Exception, match="outside of depth 2"):
        voxel.serialise(cloud(spark), 0.125, depth=2).collect()
    assert voxel.serialise(cloud(spark), 0.125, depth=3).filter("code >= 512").count() == 0


def test_ancestors_by_composed_maps_are_those_of_the_points(spark):
    shifted = cloud(spark).withColumns({c: F.col(c) - 0.4 for c in "xyz"})  # cells below zero go towards zero
    ids = pooling.pooling_ids(shifted, 0.0625, [2, 2, 3])
    found = {tuple(r) for r in pooling.compose([pooling.parent_map(ids, k) for k in range(3)]).collect()}
    want = {(r.episode_index, r.frame_index, k, r.id0, r[f"id{k}"]) for r in ids.collect() for k in range(4)}
    assert found == want
    pooled = voxel.propagate_labels(shifted, 0.0625, [2, 2, 3])
    assert ids.select("episode_index", "frame_index", "id3").distinct().count() == pooled.count()


def test_queries_are_carried(spark):
    ids = pooling.pooling_ids(cloud(spark), 0.125, [2, 2]).withColumn("query_id", F.when(F.col("label") > 2, F.col("label")))
    got = {(r.episode_index, r.frame_index, r.level, r.cell): r.query_ids for r in pooling.carry_ids(ids.select("episode_index", "frame_index", F.col("id0").alias("child"), "query_id"), pooling.compose([pooling.parent_map(ids, k) for k in range(2)])).collect()}
    want = {}
    for r in ids.filter("query_id IS NOT NULL").collect():
        for k in range(3):
            want.setdefault((r.episode_index, r.frame_index, k, r[f"id{k}"]), set()).add(r.query_id)
    assert got == {k: sorted(v) for k, v in want.items()}
