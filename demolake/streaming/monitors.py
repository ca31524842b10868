"""Structured Streaming twins of the batch operators: running success, anchor hold, coverage, results, partial statistics, quality gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from demolake.operators.evaluation import wilson
from demolake.operators.quantiles import counted_quantiles, merge_counts, value_counts, vector_values
from demolake.operators.vectors import merge_partials, partial_stats


def running_success(trials: DataFrame, *, arm: Sequence[str], keys: Sequence[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Successes, trials, rate and interval per arm as trials arrive; a trial sent again counts once, a skipped one (null success) not at all."""
    once = trials.filter("success IS NOT NULL").withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    out = once.groupBy(*arm).agg(F.count_if("success").alias("successes"), F.count("*").alias("num_trials"))
    low, high = wilson(F.col("successes"), F.col("num_trials"))
    return out.withColumns({"rate": F.col("successes") / F.col("num_trials"), "low": low, "high": high})


def coverage_alarm(replans: DataFrame, *, width: str = "10 minutes", late: str = "10 minutes", least: float = 0.5, time: str = "ts") -> DataFrame:
    """Share of replans with an anchor per tumbling window, and whether it is below ``least``."""
    out = replans.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg(F.col("anchored").cast("int")).alias("coverage"))
    return out.select(F.col("window.start").alias("starts"), "n", "coverage", (F.col("coverage") < least).alias("alarm"))


class HoldAnchor(StatefulProcessor):
    """Holds an episode's last key-frame anchor; rows older than the held key frame are dropped and counted.

    The frame marked as the episode's last clears its state. With ``idle_ms`` a timer
    does so, too, for an episode that just stops: so long after its newest frame.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "frame long, x double, y double, z double")
        self.dropped = handle.getValueState("dropped", "n long")
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        at, x, y, z = self.held.get() if self.held.exists() else (-1, None, None, None)
        late, over = self.dropped.get()[0] if self.dropped.exists() else 0, False
        frames = sorted((r for part in rows for r in part[["frame_index", "is_key", "is_last", "x", "y", "z"]].itertuples(index=False)), key=lambda r: r.frame_index)
        out = []
        for r in frames:
            over |= bool(r.is_last)
            if r.frame_index < at:
                late += 1
                continue
            if r.is_key:
                at, x, y, z = (int(r.frame_index), *(None if pd.isna(v) else float(v) for v in (r.x, r.y, r.z)))
            out.append((key[0], int(r.frame_index), x, y, z, late))
        if self.idle_ms is not None and self.ends.exists():
            self.handle.deleteTimer(self.ends.get()[0])
        if over:
            self.clear()
        else:
            if at >= 0:
                self.held.update((at, x, y, z))
            self.dropped.update((late,))
            if self.idle_ms is not None:
                end = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(end)
                self.ends.update((end,))
        yield pd.DataFrame(out, columns=["episode_index", "frame_index", "x", "y", "z", "n_late"]).astype({"x": float, "y": float, "z": float})

    def clear(self) -> None:
        for state in (self.held, self.dropped, self.ends):
            state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        self.clear()
        yield pd.DataFrame({"episode_index": pd.Series(dtype="int64"), "frame_index": pd.Series(dtype="int64"), "x": pd.Series(dtype=float), "y": pd.Series(dtype=float), "z": pd.Series(dtype=float), "n_late": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def hold_anchors(frames: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """frames: episode_index, frame_index, is_key, x, y, z, and is_last if there is an end mark. Needs the RocksDB state store.

    Where episodes may stop without an end mark, give ``idle_ms``: the stream then runs batches without data, too, to look at its timers.
    """
    rows = frames if "is_last" in frames.columns else frames.withColumn("is_last", F.lit(False))
    return rows.groupBy("episode_index").transformWithStateInPandas(
        statefulProcessor=HoldAnchor(idle_ms), outputStructType="episode_index long, frame_index long, x double, y double, z double, n_late long", outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime"
    )


class KeepBest(StatefulProcessor):
    """Keeps the best record of a key: a final before a partial one, then the newest version; emits it when it changes."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "is_final boolean, version long, record string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        before = tuple(self.held.get()) if self.held.exists() else None
        best = before
        for part in rows:
            for r in part[["record_final", "record_version", "record_json"]].itertuples(index=False):
                new = (bool(r[0]), int(r[1]), r[2])
                best = new if best is None or new > best else best
        if best != before:
            self.held.update(best)
        out = [best] if best != before else []
        yield pd.DataFrame(out, columns=["is_final", "version", "record"]).astype({"is_final": bool, "version": "int64", "record": object})

    def close(self) -> None:
        pass


def keep_results(records: DataFrame, keys: Sequence[str], *, version: str, final: str = "is_final", ttl_ms: int | None = None) -> DataFrame:
    """A stream of partial and final records as each key's result, for every key that a batch brings (update mode); needs the RocksDB state store.

    Of a key's records the one that is greatest by (final, version, content) holds, so that neither the order in which records come nor
    records that come again make a difference, and a partial record that comes late never replaces a final one. State stays for every
    key. With ``ttl_ms`` it stays for so long after its last change, and only changes are sent on; a record that comes after that counts as
    new. That takes a Python call for each key of a batch; without it the result is a streaming aggregate. A null version is 0.
    """
    own = F.to_json(F.struct(*records.columns))
    rows = records.select(*keys, F.coalesce(final, F.lit(False)).alias("record_final"), F.coalesce(F.col(version).cast("long"), F.lit(0)).alias("record_version"), own.alias("record_json"))
    if ttl_ms is None:
        changes = rows.groupBy(*keys).agg(F.max(F.struct("record_final", "record_version", "record_json")).alias("best")).select(F.col("best.record_json").alias("record"))
    else:
        changes = rows.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=KeepBest(ttl_ms), outputStructType="is_final boolean, version long, record string", outputMode="Update", timeMode="ProcessingTime"
        )
    return changes.withColumn("r", F.from_json("record", records.schema)).select("r.*")


def changes_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's changes in a folder of its own, so that a batch run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_changes(spark, path: str, keys: Sequence[str], *, version: str, final: str = "is_final") -> DataFrame:
    """Each key's result after all changes that changes_sink wrote."""
    rows = spark.read.parquet(path).drop("batch")
    best = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce(final, F.lit(False)), F.coalesce(version, F.lit(0)), F.to_json(F.struct(*rows.columns))))
    return rows.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def stats_sink(path: str, vector: str, *, sketch: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch's partial statistics to a folder of its own, so that a batch run again replaces itself.

    With ``sketch``, its size, quantiles can be read within a rank error, from rows of bounded size.
    """

    def write(batch: DataFrame, number: int) -> None:
        partial_stats(batch, vector, sketch=sketch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_stats(spark, path: str, quantiles: Sequence[float] = ()) -> DataFrame:
    return merge_partials(spark.read.parquet(path), quantiles=quantiles)


def counts_sink(path: str, vector: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the exact quantile state of each batch, the counts of each dimension's values, in a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        value_counts(vector_values(batch, vector), "x", ["dim"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_quantiles(spark, path: str, quantiles: Sequence[float]) -> DataFrame:
    """Exact quantiles per dimension of all batches that counts_sink wrote."""
    counts = merge_counts(spark.read.parquet(path).drop("batch"), ["dim"])
    return counted_quantiles(counts, quantiles, ["dim"])


class RunGate:
    """For foreachBatch: a run whose trials were all skipped is a failure, not a rate of zero. ``check`` judges when the run ends.

    Counts are kept by batch, so that a batch sent again counts once.
    """

    def __init__(self) -> None:
        self.seen: dict[int, tuple[int, int]] = {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.seen[number] = tuple(batch.agg(F.count("*"), F.count_if(F.col("success").isNull())).first())

    def check(self) -> None:
        n, skipped = (sum(v) for v in zip(*self.seen.values(), strict=True)) if self.seen else (0, 0)
        if n and n == skipped:
            raise RuntimeError(f"all {n} trials of the run were skipped")
