"""Evaluation trials: pooled success with intervals, rollups, paired arms, rates, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.operators.quantiles import exact_quantiles

ARM = ("task", "sampling", "npoints", "step")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of k successes in n trials, clamped to [0, 1]; (0, 0) without trials."""
    p = k / n
    d = 1 + z * z / n
    middle, reach = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    low = F.when(n == 0, 0.0).otherwise(F.greatest(middle - reach, F.lit(0.0)))
    high = F.when(n == 0, 0.0).otherwise(F.least(middle + reach, F.lit(1.0)))
    return low, high


def pool_success(trials: DataFrame, by: Sequence[str] = ARM) -> DataFrame:
    """Successes and trials summed over seeds, the seeds, the rate and its interval; the task must be among the keys."""
    if "task" not in by:
        raise ValueError("pooling across tasks mixes arms: add task to the keys")
    out = trials.groupBy(*by).agg(F.count_if("success").alias("successes"), F.count("*").alias("num_trials"), F.count_distinct("seed").alias("n_seeds"))
    low, high = wilson(F.col("successes"), F.col("num_trials"))
    return out.withColumns({"rate": F.col("successes") / F.col("num_trials"), "low": low, "high": high})


def success_table(pooled: DataFrame, step: int, samplings: Sequence[str]) -> DataFrame:
    """Point counts by sampling at one step, in percent; a missing cell reads --."""
    cell = F.first(F.format_string("%.1f", 100.0 * F.col("successes") / F.col("num_trials")))
    wide = pooled.filter(F.col("step") == step).groupBy("task", "npoints").pivot("sampling", list(samplings)).agg(cell)
    return wide.fillna("--", list(samplings))


def first_records(records: DataFrame, order: str, keys: Sequence[str] = ("checkpoint", "task", "variation")) -> DataFrame:
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")


def checkpoint_step(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1).cast("long")


def sr_rollup(records: DataFrame, order: str, *, by_episodes: bool = False, tasks_first: bool = False) -> DataFrame:
    """Success rate per checkpoint. The first record of a (checkpoint, task, variation) counts.

    A task's rate is the mean over its variations, or weighted by episodes; a
    checkpoint's is the mean over all variations, or over tasks' rates.
    """
    rows = first_records(records, order)
    weighted = F.sum(F.col("sr") * F.col("num_episodes")) / F.sum("num_episodes")
    rate = weighted if by_episodes else F.avg("sr")
    if tasks_first:
        tasks = rows.groupBy("checkpoint", "task").agg(rate.alias("sr"), F.count("*").alias("n"))
        out = tasks.groupBy("checkpoint").agg(F.avg("sr").alias("sr"), F.sum("n").alias("n_records"), F.count("*").alias("n_tasks"))
    else:
        out = rows.groupBy("checkpoint").agg(rate.alias("sr"), F.count("*").alias("n_records"), F.count_distinct("task").alias("n_tasks"))
    return out.withColumn("step", checkpoint_step(F.col("checkpoint")))


def best_checkpoints(rollup: DataFrame) -> DataFrame:
    """All checkpoints that share the highest rate; a rollup has one row per checkpoint."""
    top = rollup.agg(F.max("sr").alias("_top"))
    return rollup.join(F.broadcast(top), F.col("sr") == F.col("_top")).drop("_top")


def paired_arms(trials: DataFrame, arm: str, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """The same scenes under two arms: both, only a, only b, neither, and the exact-conditional chi-square with continuity correction."""
    left = trials.filter(F.col(arm) == a).select(*keys, F.col("success").alias("_a"))
    right = trials.filter(F.col(arm) == b).select(*keys, F.col("success").alias("_b"))
    out = left.join(right, list(keys)).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"))
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return out.withColumn("mcnemar", F.when(F.col("only_a") + F.col("only_b") > 0, gap * gap / (F.col("only_a") + F.col("only_b"))))


def marginal_rate(runs: DataFrame, *, base: int) -> DataFrame:
    """Steps per second between a configuration's shortest and longest run, free of start-up time, and the speed-up over the base; null where time or steps don't grow."""
    ends = runs.groupBy("config").agg(*(f(F.struct("steps", "seconds")).alias(n) for n, f in (("lo", F.min), ("hi", F.max))))
    n, t = F.col("hi.steps") - F.col("lo.steps"), F.col("hi.seconds") - F.col("lo.seconds")
    rates = ends.select("config", F.when((n > 0) & (t > 0), n / t).alias("rate"))
    reference = rates.filter(F.col("config") == base).select(F.col("rate").alias("_base"))
    return rates.join(F.broadcast(reference)).select("config", "rate", (F.col("rate") / F.col("_base")).alias("speedup"))


def exposure(runs: DataFrame, frames: DataFrame, *, batch: int, gpus: int) -> DataFrame:
    """Epochs and GPU hours of runs (steps, seconds) over a dataset's frames."""
    n = frames.agg(F.count("*").alias("_n"))
    per_epoch = F.col("_n") / batch
    return runs.join(F.broadcast(n)).select(*runs.columns, per_epoch.alias("steps_per_epoch"), (F.col("steps") / per_epoch).alias("epochs"), (F.col("seconds") * gpus / 3600).alias("gpu_hours"))


def cloud_size_stats(points: DataFrame, by: Sequence[str]) -> DataFrame:
    n = points.groupBy(*by).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_frames"), F.min("n").alias("min_points"), F.max("n").alias("max_points"), F.avg("n").alias("mean_points"))


def grid_probe(clouds: DataFrame, *, radii: Sequence[float], target: int, budget: int, base: str) -> DataFrame:
    """For each grid: median points within each radius (``distance``), of the target label, and drawn under a budget; ratios to the base grid; saturation."""
    per = clouds.groupBy("grid", "episode_index", "frame_index").agg(F.count("*").alias("n"), F.count_if(F.col("label") == target).alias("target"), *(F.count_if(F.col("distance") <= r).alias(f"within_{k}") for k, r in enumerate(radii)))
    per = per.withColumn("drawn", F.least("n", F.lit(budget)))
    names = ["n", "target", "drawn", *(f"within_{k}" for k in range(len(radii)))]
    each = per.select("grid", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in names))).alias("e")).select("grid", "e.*")
    median = exact_quantiles(each, "x", {"median": 0.5}, ["grid", "name"]).groupBy("grid").pivot("name", names).agg(F.max("median"))
    out = per.groupBy("grid").agg(F.count("*").alias("n_frames")).join(median, "grid")
    ref = out.filter(F.col("grid") == base).select(F.col("n").alias("_n"))
    return out.join(F.broadcast(ref)).withColumns({"ratio": F.col("n") / F.col("_n"), "saturation": F.col("drawn") / F.col("n")}).drop("_n")


def completeness(runs: DataFrame, steps: DataFrame, seeds: DataFrame, results: DataFrame) -> DataFrame:
    """The grid of runs, steps and seeds with each cell's state: ok, partial or missing. The three axes are short lists."""
    grid = runs.crossJoin(F.broadcast(steps)).crossJoin(F.broadcast(seeds))
    keys = [*runs.columns, *steps.columns, *seeds.columns]
    done = results.groupBy(*keys).agg(F.max("final").alias("_final"))
    state = F.when(F.col("_final"), "ok").when(F.col("_final").isNotNull(), "partial").otherwise("missing")
    return grid.join(done, keys, "left").select(*keys, state.alias("state"))


def run_name(task: Column, sampling: Column, npoints: Column, seed: Column) -> Column:
    """task-sampling-nP-sS, without the parts that are null."""
    return F.concat_ws("-", task, sampling, F.concat(F.lit("n"), npoints.cast("string")), F.concat(F.lit("s"), seed.cast("string")))


def parse_run(name: Column, samplings: Sequence[str] = ("uniform", "eef", "oracle")) -> dict[str, Column]:
    """The parts of a run's name, longest sampling name first; null where the name has another form."""
    pattern = rf"^(.+)-({'|'.join(sorted(samplings, key=len, reverse=True))})-n(\d+)-s(\d+)$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return {"task": part(1), "sampling": part(2), "npoints": part(3).cast("int"), "seed": part(4).cast("int")}


def scene_seed(seed: Column, episode: Column) -> Column:
    """The seed of an episode's scene, from 0 to 2**31 - 1: a function of the run's seed and the episode alone, in whole numbers that any engine can repeat."""
    mixed = (seed.cast("long") * 73856093).bitwiseXOR(episode.cast("long") * 19349663)
    return F.pmod(F.pmod(mixed, F.lit(2**31)) * 48271, F.lit(2**31 - 1))
