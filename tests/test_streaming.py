import pytest
from pyspark.sql import functions as F

from demolake.operators import vectors
from demolake.streaming import monitors

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    """The events table as a file stream of four files."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), events


def drain(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_running_success_equals_the_batch(spark, stream, tmp_path):
    source, events = stream
    as_trials = lambda df: df.withColumn("success", F.when(F.col("event_id") % 10 != 0, F.col("value") > 50)).withColumnRenamed("event_type", "arm")
    got = drain(monitors.running_success(as_trials(source), arm=["arm"], keys=["event_id"], late="3650 days"), "complete", "running", tmp_path)
    want = as_trials(events).filter("success IS NOT NULL").groupBy("arm").agg(F.count_if("success").alias("s"), F.count("*").alias("n"))
    assert sorted((r.arm, r.successes, r.num_trials) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_coverage_alarm(spark, stream, tmp_path):
    source, events = stream
    out = monitors.coverage_alarm(source.withColumn("anchored", F.col("value") > 50), width="1 day", late="3650 days")
    got = drain(out, "complete", "coverage", tmp_path)
    want = events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    assert sorted((r.starts, r.n) for r in got.collect()) == sorted((r.window.start, r.n) for r in want.collect())


def test_held_anchors_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(e, f, f % 4 == 0, float(f) if f % 8 == 0 else None, 0.0, 0.0) for e in range(3) for f in range(12)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, is_key boolean, x double, y double, z double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(monitors.hold_anchors(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "append", "held", tmp_path)
    assert {(r.episode_index, r.frame_index): r.x for r in got.collect()} == {(e, f): (float(f // 4 * 4) if f // 4 * 4 % 8 == 0 else None) for e in range(3) for f in range(12)}


def test_partial_statistics_merge(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    sink = monitors.stats_sink(str(tmp_path / "s"), "embedding")
    for k in range(3):
        sink(e.filter(F.col("vec_id") % 3 == k), k)
    sink(e.filter("vec_id % 3 = 1"), 1)  # a batch run again replaces itself
    got = {r.dim: r for r in monitors.read_stats(spark, str(tmp_path / "s")).collect()}
    for r in vectors.vector_stats(e, "embedding").collect():
        assert (got[r.dim].n, got[r.dim].mean, got[r.dim]["std"]) == (r.n, pytest.approx(r.mean), pytest.approx(r["std"]))


def test_state_is_cleared_when_the_episode_ends(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "episode_index long, frame_index long, is_key boolean, is_last boolean, x double, y double, z double"
    place = str(tmp_path / "in")
    first = spark.createDataFrame([(0, 0, True, False, 1.0, 0.0, 0.0), (0, 1, False, True, None, None, None), (1, 0, True, False, 2.0, 0.0, 0.0)], schema)
    later = spark.createDataFrame([(e, 2, False, False, None, None, None) for e in (0, 1)], schema)
    for n, df in enumerate((first, spark.createDataFrame([(9, 0, False, False, None, None, None)], schema), later)):
        df.coalesce(1).write.mode("append").parquet(place)
        query = monitors.hold_anchors(spark.readStream.schema(schema).parquet(place)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r.episode_index, r.frame_index): r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, 2] == 2.0 and got[0, 1] == 1.0
    assert got[0, 2] is None  # nothing is held of an episode that had ended


def test_state_is_cleared_after_a_silence(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "episode_index long, frame_index long, is_key boolean, x double, y double, z double"
    place = str(tmp_path / "in")
    spark.createDataFrame([(0, 0, True, 1.0, 0.0, 0.0)], schema).coalesce(1).write.parquet(place)
    query = monitors.hold_anchors(spark.readStream.schema(schema).parquet(place), idle_ms=500).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()

    def seen(n):
        for _ in range(120):
            rows = spark.table("silent").collect()
            if len(rows) >= n:
                return {r.frame_index: r.x for r in rows}
            time.sleep(0.5)
        raise AssertionError(f"{n} rows were not seen")

    try:
        assert seen(1) == {0: 1.0}
        time.sleep(4)
        spark.createDataFrame([(0, 1, False, None, None, None)], schema).coalesce(1).write.mode("append").parquet(place)
        assert seen(2) == {0: 1.0, 1: None}
    finally:
        query.stop()


def test_merged_statistics_far_from_zero(spark):
    """Parts with exact means and squared deviations, so that only the merge can lose digits."""
    from fractions import Fraction

    values = [[Fraction(10**9) + Fraction((k * 7 + p) % 16, 8) for k in range(64)] for p in range(5)]
    parts = []
    for v in values:
        mean = sum(v) / len(v)
        parts.append((0, len(v), float(mean), float(sum((x - mean) ** 2 for x in v)), float(min(v)), float(max(v))))
    got = vectors.merge_partials(spark.createDataFrame(parts, "dim int, n long, mean double, m2 double, min double, max double")).first()
    flat = [x for v in values for x in v]
    mean = sum(flat) / len(flat)
    assert got["std"] == pytest.approx(float(sum((x - mean) ** 2 for x in flat) / len(flat)) ** 0.5, rel=1e-9) and got.n == 320
    assert got["mean"] == pytest.approx(float(mean), rel=1e-15)


def test_a_run_of_skipped_trials_is_an_error(spark):
    skipped = spark.createDataFrame([(1, None), (2, None)], "trial long, success boolean")
    gate = monitors.RunGate()
    gate(skipped, 0)
    gate(skipped, 0)
    with pytest.raises(RuntimeError, match="all 2 trials"):
        gate.check()
    gate(skipped.withColumn("success", F.lit(True)), 1)
    gate.check()
    monitors.RunGate().check()


def test_final_results_replace_partial_ones_in_any_order(spark, tmp_path):
    """The stream ends where the batch reader does, however records are dealt, and when some come again."""
    import random

    from demolake.plans.streams import streamed
    from demolake.sources import tables

    schema = "trial long, version long, is_final boolean, success boolean, note string"
    records = [(t, v, False, None, f"p{v}") for t in range(40) for v in range(1, 2 + t % 3)] + [(t, 1, True, t % 2 == 0, None) for t in range(40) if t % 4]
    df = spark.createDataFrame(records, schema)
    keys = ["trial"]
    newest = df.filter("NOT is_final").groupBy("trial").agg(F.max("version").alias("version"))
    tables.write_trials(df.filter("is_final").drop("is_final"), str(tmp_path / "r"), final=True, batch="a")
    tables.write_trials(df.filter("NOT is_final").join(newest, ["trial", "version"]).drop("is_final"), str(tmp_path / "r"), final=False, batch="b")
    batch = tables.read_results(spark, str(tmp_path / "r"), df.drop("is_final").schema, keys)
    want = sorted((r.trial, r.version, r.is_final, r.success, r.note) for r in batch.collect())
    for seed in (1, 2):
        rows = records + random.Random(seed).sample(records, 30)
        random.Random(seed).shuffle(rows)
        parts = [spark.createDataFrame(rows[k::3], schema).coalesce(1) for k in range(3)]
        out = streamed(parts, lambda s: monitors.keep_results(s, keys, version="version"), "update")
        got = monitors.read_changes(spark, out, keys, version="version").collect()
        assert sorted(tuple(r) for r in got) == want
        again = spark.read.parquet(out).filter("batch = 1").drop("batch")  # a batch run again replaces itself
        monitors.changes_sink(out)(spark.createDataFrame(again.collect(), again.schema), 1)
        assert sorted(tuple(r) for r in monitors.read_changes(spark, out, keys, version="version").collect()) == want
