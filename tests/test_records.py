import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demolake.functions import geometry
from demolake.operators import records

ANCHOR = "struct<x:double,y:double,z:double,query_id:int,n_support:int,agree:boolean,left_u:double,left_v:double,right_u:double,right_v:double,wrist_u:double,wrist_v:double>"


def anchors(n):
    return [(0.5 * k, -0.25, float(k), k % 2, 3 * k, k % 3 == 0, None if k == 1 else 8.0 + k, 1.5, 2.5 + k, None if k == 2 else 4.0, 9.0, 10.0 + k) for k in range(n)]


@pytest.mark.parametrize(("slots", "views"), records.LAYOUTS.values())
def test_every_layout_round_trips(spark, slots, views):
    rows = [(n, anchors(n)) for n in (0, 1, 2, 5, 8)]
    df = spark.createDataFrame(rows, f"id int, a array<{ANCHOR}>").select("id", records.encode_anchors(F.col("a"), slots=slots, views=views).alias("r"))
    assert {r.n for r in df.select(F.size("r").alias("n")).collect()} == {records.record_length(slots, views)}
    for form in (df, df.select("id", "r").rdd.map(lambda r: (r.id, bytearray(np.array(r.r, "<f4").tobytes()))).toDF("id int, r binary")):
        got = {}
        for r in records.read_records(form, "r", ["id"]).orderBy("id", "slot").collect():
            got.setdefault(r.id, []).append(r)
        assert set(got) == {1, 2, 5, 8}
        for n, own in got.items():
            want = anchors(n)[:slots]
            assert [(r.x, r.y, r.z, r.query_id, r.n_support, r.agree) for r in own] == [a[:6] for a in want]
            pixels = [[r[f"{v}_{c}"] for v in records.VIEWS for c in "uv"] for r in own]
            assert pixels == [[*a[6 : 6 + 2 * views], *[None] * (6 - 2 * views)] for a in want]


def test_lengths_are_told_apart_and_others_refused(spark):
    assert len(records.LAYOUTS) == len(records.SLOTS) * len(records.VIEWS) == 6
    df = spark.createDataFrame([(1, [0.0] * 50)], "id int, r array<float>")
    with pytest.raises(Exception, match="no anchor record has 50 numbers"):
        records.read_records(df, "r", ["id"]).collect()
    with pytest.raises(ValueError, match="3 slots"):
        records.encode_anchors(F.col("a"), slots=3)


def test_unusable_anchors_and_missing_records(spark):
    record = [2.0, 1.0, math.nan, 1.0, 0.0, 4.0, math.nan, 2.0, 1.0, 1.0, 2.0, 3.0, 1.0, 5.0, 7.0, 8.0, 0.0]
    rows = [(1, record), (2, None), (3, [math.nan, *record[1:]]), (4, [99.0, *record[1:]])]
    decoded = records.read_records(spark.createDataFrame(rows, "id int, r array<float>"), "r", ["id"])
    assert sorted((r.id, r.slot, r.y, r.left_u) for r in decoded.collect()) == sorted([(1, 0, None, None), (1, 1, 2.0, 7.0), (4, 0, None, None), (4, 1, 2.0, 7.0)], key=str)
    assert records.usable_anchors(decoded).count() == 2 and records.usable_anchors(decoded, [0]).count() == 0
    assert records.read_records(spark.createDataFrame([], "id int, r array<float>"), "r", ["id"]).collect() == []


def test_cameras_that_are_too_many_are_refused(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "frame_index int, x double, y double, z double")
    cams = spark.range(20).selectExpr("int(id) AS frame_index", *(f"{v}D AS {n}" for n, v in (("fx", 8.0), ("fy", 8.0), ("cx", 4.0), ("cy", 4.0), ("tx", 0.0), ("ty", 0.0), ("tz", 0.0))))
    assert geometry.project_points(points, cams.drop("frame_index")).count() == 20
    with pytest.raises(ValueError, match="too many"):
        geometry.project_points(points, cams.drop("frame_index"), most=19)
    joined = geometry.project_points(points, cams, on=["frame_index"], most=1)
    assert joined.count() == 1 and "hint" not in joined._jdf.queryExecution().analyzed().toString().lower()
