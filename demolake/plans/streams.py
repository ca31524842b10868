"""Queries that run as streams: a table arrives in several parts, and the stream's outcome must equal the batch's."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.plans.catalog import query
from demolake.plans.fixtures import table
from demolake.sources.shared import new_folder
from demolake.streaming import monitors

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark: SparkSession):
    held = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, held)


def streamed(parts: Sequence[DataFrame], transform: Callable[[DataFrame], DataFrame], mode: str, sink: Callable[[str], Callable[[DataFrame, int], None]] = monitors.changes_sink) -> str:
    """Writes parts one after another into a folder, runs the stream after each until it has read all, and returns where its sink writes."""
    spark = parts[0].sparkSession
    source, out, checkpoint = (new_folder(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    with _rocksdb(spark):
        for part in parts:
            part.write.mode("append").parquet(source)
            stream = transform(spark.readStream.schema(part.schema).parquet(source))
            stream.writeStream.outputMode(mode).foreachBatch(sink(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out


def _last(spark: SparkSession, path: str) -> DataFrame:
    """What a stream in complete mode wrote last."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def _parts(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


@query("""SELECT task, sampling, count(*) FILTER (success) AS successes, count(*) AS num_trials, count(*) FILTER (success) / CAST(count(*) AS DOUBLE) AS rate FROM trials WHERE trial % 9 <> 0 GROUP BY task, sampling""")
def r01_running_success(spark, sf_dir):
    """Trials arrive in three parts, one of them twice; skipped ones count for nothing."""
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("trial"))
    rows = table(spark, sf_dir, "trials").withColumns({"success": F.when(F.col("trial") % 9 != 0, F.col("success")), "ts": ts})
    parts = _parts(rows, "trial", 3)
    out = streamed([*parts, parts[1]], lambda s: monitors.running_success(s, arm=["task", "sampling"], keys=["trial"], late="3650 days"), "complete")
    return _last(spark, out).select("task", "sampling", "successes", "num_trials", "rate")


@query("""WITH k AS (SELECT *, idx % 11 <> 0 AS hit, max(CASE WHEN frame_index % 8 = 0 THEN frame_index END) OVER (PARTITION BY episode_index ORDER BY frame_index) AS kf FROM frames)
SELECT a.episode_index, a.frame_index, CASE WHEN b.hit THEN CAST(b.idx AS DOUBLE) END AS x FROM k a LEFT JOIN k b ON b.episode_index = a.episode_index AND b.frame_index = a.kf""")
def r02_anchor_hold(spark, sf_dir):
    """R2: frames arrive in three parts in order; the last key frame's anchor is held, an empty one, too."""
    f = table(spark, sf_dir, "frames")
    x = F.when(F.col("idx") % 11 != 0, F.col("idx").cast("double"))
    key = F.col("frame_index") % 8 == 0
    rows = f.select("episode_index", F.col("frame_index").cast("long").alias("frame_index"), key.alias("is_key"), F.when(key, x).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    parts = [rows.filter("frame_index < 13"), rows.filter("frame_index BETWEEN 13 AND 40"), rows.filter("frame_index > 40")]
    out = streamed(parts, monitors.hold_anchors, "append")
    return spark.read.parquet(out).select("episode_index", "frame_index", "x")


@query("""SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS starts, count(*) AS n, avg(CAST(value > 50 AS INT)) AS coverage, avg(CAST(value > 50 AS INT)) < 5e-1 AS alarm FROM events GROUP BY 1""")
def r03_coverage_alarm(spark, sf_dir):
    """Share of rows with an anchor by day, as rows arrive."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("anchored"))
    out = streamed(_parts(events, "event_id", 3), lambda s: monitors.coverage_alarm(s, width="1 day", late="3650 days"), "complete")
    return _last(spark, out).select(F.unix_timestamp("starts").alias("starts"), "n", "coverage", "alarm")


@query("""SELECT trial, task, CASE WHEN trial % 5 = 0 THEN 2 ELSE 3 END AS version, trial % 5 <> 0 AS is_final, CASE WHEN trial % 5 = 0 THEN NOT success ELSE success END AS success FROM trials""")
def s12_final_replaces_partial(spark, sf_dir):
    """Partial and final records of each trial arrive mixed and partly twice; four in five end with their final one."""
    t = table(spark, sf_dir, "trials").select("trial", "task", "success")
    first = t.select("trial", "task", F.lit(1).alias("version"), F.lit(False).alias("is_final"), F.lit(None).cast("boolean").alias("success"))
    second = t.select("trial", "task", F.lit(2).alias("version"), F.lit(False).alias("is_final"), (~F.col("success")).alias("success"))
    final = t.filter("trial % 5 <> 0").select("trial", "task", F.lit(3).alias("version"), F.lit(True).alias("is_final"), "success")
    parts = _parts(first.unionByName(second).unionByName(final).withColumn("_k", F.xxhash64("trial", "version")), "_k", 3)
    parts = [p.drop("_k") for p in parts]
    out = streamed([parts[2], parts[0], parts[2], parts[1]], lambda s: monitors.keep_results(s, ["trial"], version="version"), "update")
    return monitors.read_changes(spark, out, ["trial"], version="version").select("trial", "task", "version", "is_final", "success")
