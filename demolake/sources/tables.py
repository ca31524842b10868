"""Reading and writing demonstration tables: frames, episode metadata, trials, statistics, frame-keyed stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISODES = T.StructType([T.StructField("episode_index", T.LongType()), T.StructField("length", T.LongType()), T.StructField("tasks", T.ArrayType(T.StringType()))])
TASKS = T.StructType([T.StructField("task_index", T.LongType()), T.StructField("task", T.StringType())])
TRIALS = T.StructType([
    T.StructField("seed", T.IntegerType()), T.StructField("seed_per_episode", T.BooleanType()), T.StructField("num_trials", T.LongType()), T.StructField("successes", T.LongType()),
    T.StructField("trials", T.ArrayType(T.StructType([T.StructField("trial", T.LongType()), T.StructField("success", T.BooleanType()), T.StructField("task", T.StringType())]))),
    T.StructField("skipped", T.ArrayType(T.LongType())),
])


def read_frames(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, episodes: Sequence[int] | None = None, chunk_size: int | None = None) -> DataFrame:
    """Frames under files or folders, only the columns asked for. With a chunk size, ``episode_chunk`` prunes the partitions of the given episodes.

    A folder without any Parquet file is an error.
    """
    reader = spark.read if chunk_size else spark.read.option("recursiveFileLookup", True)
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        df = reader.parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            raise FileNotFoundError(f"no Parquet files under {', '.join(paths)}") from e
        raise
    if episodes is not None:
        if chunk_size:
            df = df.filter(F.col("episode_chunk").isin(sorted({e // chunk_size for e in episodes})))
        df = df.filter(F.col("episode_index").isin(list(episodes)))
    return df if columns is None else df.select(*columns)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episode lengths and first tasks; no task reads as empty."""
    rows = spark.read.schema(EPISODES).json(path)
    return rows.select("episode_index", "length", F.coalesce(F.get("tasks", F.lit(0)), F.lit("")).alias("task"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASKS).json(path)


def read_trials(spark: SparkSession, root: str) -> DataFrame:
    """Final per-trial results with the identity that their paths carry: task-sampling-nP-sS / checkpoint-STEP."""
    rows = spark.read.schema(TRIALS).option("recursiveFileLookup", True).option("pathGlobFilter", "per_trial_seed*_n*.json").option("multiLine", True).json(root).withColumn("path", F.col("_metadata.file_path"))
    out = path_identity(rows).select("run", "step", "seed", "seed_per_episode", F.size(F.coalesce("skipped", F.array().cast("array<bigint>"))).alias("n_skipped"), F.explode("trials").alias("t"))
    return out.select("run", "step", "seed", "seed_per_episode", "n_skipped", "t.*")


def path_identity(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is that of a final result, with run and step; partial files and other folders are passed over."""
    run = F.regexp_extract(path, r"/([^/]+-n\d+-s\d+)/", 1)
    step = F.regexp_extract(path, r"/checkpoint-(\d+)/", 1)
    final = F.col(path).rlike(r"/per_trial_seed[^/]*_n[^/]*\.json$")
    return rows.filter(final & (step != "")).withColumns({"run": run, "step": step.cast("long")})


def write_trials(df: DataFrame, path: str, *, final: bool, batch: str) -> None:
    """JSON lines of one batch, in a folder of its own: a batch written again replaces itself. Partial and final results never share a folder."""
    df.write.mode("overwrite").json(f"{path}/{'final' if final else 'partial'}/batch={batch}")


def read_results(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Results as written by write_trials: final records, and the partial ones whose key has no final record yet (``is_final``)."""
    of = lambda kind: spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{path}/{kind}")
    final = of("final")
    return final.withColumn("is_final", F.lit(True)).unionByName(of("partial").join(final.select(*keys), list(keys), "left_anti").withColumn("is_final", F.lit(False)))


def read_points(frames: DataFrame, points: DataFrame, keys: Sequence[str] = ("episode_index", "frame_index")) -> DataFrame:
    """The points of every frame; a frame without points is an error."""
    rows = frames.join(points.withColumn("_there", F.lit(True)), list(keys), "left")
    lost = F.raise_error(F.concat(F.lit("no points of frame "), F.concat_ws("-", *(F.col(k).cast("string") for k in keys)))).cast("boolean")
    return rows.filter(F.coalesce(F.col("_there"), lost)).drop("_there")


def read_anchors(frames: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("episode_index", "frame_index")) -> DataFrame:
    """The anchors of every frame, null where there are none."""
    return frames.join(anchors, list(keys), "left")


def write_stats(stats: DataFrame, path: str, *, prefix: str, num_data: int) -> None:
    """One JSON object with prefixed vectors, dimensions in order."""
    names = [c for c in stats.columns if c not in ("dim", "n")]
    rows = stats.agg(F.array_sort(F.collect_list(F.struct("dim", *names))).alias("_r"))
    rows.select(*(F.col(f"_r.{c}").alias(f"{prefix}_{c}") for c in names), F.lit(num_data).alias("num_data")).coalesce(1).write.mode("overwrite").json(path)


def export_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as one file; reports are a few rows."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def write_frame_table(df: DataFrame, path: str, *, chunk_size: int = 1000, sort: Sequence[str] = ("episode_index", "frame_index"), run: int = 64) -> None:
    """A frame-keyed table, partitioned by episode chunk and sorted within files, so that readers prune both. A file has ``run`` consecutive episodes of a chunk."""
    rows = df.withColumn("episode_chunk", F.floor(F.col("episode_index") / chunk_size).cast("int"))
    dealt = rows.repartition("episode_chunk", F.floor(F.pmod("episode_index", F.lit(chunk_size)) / run))
    dealt.sortWithinPartitions("episode_chunk", *sort).write.mode("overwrite").partitionBy("episode_chunk").parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in all float columns: Spark ranks NaN above every number."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in df.schema if f.dataType.typeName() in ("float", "double")})


def features_of(df: DataFrame, prefix: str, keys: Sequence[str] | None = None) -> list[str]:
    """The feature columns with a prefix, or the given ones, which must exist; padding marks are no features."""
    if keys is not None:
        absent = [k for k in keys if k not in df.columns]
        if absent:
            raise KeyError(f"no such features: {absent}")
        return list(keys)
    return [c for c in df.columns if c.startswith(prefix) and not c.endswith("_is_pad")]


def classify_features(meta: DataFrame) -> DataFrame:
    """The kind of each feature (key, dtype, shape, names): visual, env, state or action, and its channel-first shape; others are dropped."""
    key, visual = F.col("key"), F.col("dtype").isin("image", "video")
    rank = F.when(visual & (F.size("shape") != 3), F.raise_error(F.concat(F.lit("rank of "), key, F.lit(" is not 3"))).cast("string"))
    kind = (
        F.when(visual, F.coalesce(rank, F.lit("visual")))
        .when(key == "observation.environment_state", "env")
        .when(key.startswith("observation.depths") | key.startswith("observation.camera"), "visual")
        .when(key.startswith("observation"), "state")
        .when(key.startswith("action"), "action")
    )
    last = visual & F.get("names", F.lit(2)).isin("channel", "channels")
    shape = F.when(last, F.array(*(F.get("shape", F.lit(k)) for k in (2, 0, 1)))).otherwise(F.col("shape"))
    return meta.select("key", kind.alias("kind"), shape.alias("shape")).filter("kind IS NOT NULL")
