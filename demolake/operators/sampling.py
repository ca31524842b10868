"""Drawing points and rows: weighted and uniform draws, budgets, probes, farthest points. Every random choice is a seeded hash."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.functions.colour import uniform
from demolake.operators.quantiles import with_quantiles
from demolake.sources.shared import materialize

FRAME = ("episode_index", "frame_index")


def weighted_draw(points: DataFrame, weight: str | Column, n: int, *, by: Sequence[str] = FRAME, point: str = "point_id", key: Column | None = None, seed: int = 0, cap: Column | None = None) -> DataFrame:
    """min(n, all) rows of each group without replacement, likelier by weight (exponential keys: as sequential weighted draws).

    Weights that aren't finite, or sum to nothing, make the group's draw uniform.
    The constant n prunes rows before the shuffle; ``cap`` is a smaller number per group.
    key: a number in (0, 1) per row in place of the seeded hash.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    fine = w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf"))
    group = Window.partitionBy(*by)
    rows = points.withColumn("_w", w).withColumn("_ok", F.min(fine.cast("int")).over(group)).withColumn("_t", F.sum(F.when(fine, w)).over(group))
    rows = rows.withColumn("_w", F.when((F.col("_ok") == 1) & (F.col("_t") > 0), F.col("_w")).otherwise(1.0))
    return _lowest(rows, n, by, point, key, seed, cap).drop("_w", "_ok", "_t")


def finite_weighted_draw(points: DataFrame, weight: str, n: int, *, by: Sequence[str] = FRAME, point: str = "point_id", key: Column | None = None, seed: int = 0, cap: Column | None = None) -> DataFrame:
    """As weighted_draw for weights known to be positive and finite: no pass over the group, so the draw is pruned before the shuffle."""
    return _lowest(points.withColumn("_w", F.col(weight)), n, by, point, key, seed, cap).drop("_w")


def _lowest(rows: DataFrame, n: int, by: Sequence[str], point: str, key: Column | None, seed: int, cap: Column | None) -> DataFrame:
    u = key if key is not None else (uniform(seed, *by, point) + 2.0**-54)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_k"), F.col(point)))
    out = rows.withColumn("_k", F.when(F.col("_w") > 0, -F.log(u) / F.col("_w")).otherwise(float("inf"))).withColumn("_r", rank).filter(F.col("_r") <= n)
    return (out if cap is None else out.filter(F.col("_r") <= cap)).drop("_k", "_r")


def uniform_draw(points: DataFrame, n: int, *, by: Sequence[str] = FRAME, point: str = "point_id", seed: int = 0) -> DataFrame:
    return finite_weighted_draw(points.withColumn("_one", F.lit(1.0)), "_one", n, by=by, point=point, seed=seed).drop("_one")


def nearest_draw(points: DataFrame, distance: str, n: int, *, by: Sequence[str] = FRAME, point: str = "point_id") -> DataFrame:
    """The n points of each group at the least distance, ties to the smaller point."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(distance, point))
    return points.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")


def draw_count(n: Column, cap: int, *, by: Sequence[str] = FRAME, seed: int = 0, u: Column | None = None) -> Column:
    """How many of n points to draw: all up to the cap; else some share between 0.8 and 1 of them, the cap at most. u: a number in [0, 1) in place of the seeded hash."""
    share = 0.8 + 0.2 * (uniform(seed, *by) if u is None else u)
    return F.when(n <= cap, n).otherwise(F.least(F.floor(n * share), F.lit(cap)))


def oversampling(points: DataFrame, weight: str, *, by: Sequence[str] = FRAME) -> DataFrame:
    """N w / sum(w) within a group; 1 where the sum is not positive."""
    group = Window.partitionBy(*by)
    total = F.sum(weight).over(group)
    return points.withColumn("oversampling", F.when(total > 0, F.count("*").over(group) * F.col(weight) / total).otherwise(1.0))


def choose_anchor(oracle: Column, gripper: Column, detector: Column, arm: str, *, fallback: str = "uniform") -> Column:
    """The anchors of the active arm as an array; a detector's miss falls back to the gripper, or to none for a uniform draw."""
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    if arm == "oracle":
        return one(oracle)
    if arm == "eef":
        return one(gripper)
    miss = one(gripper) if fallback == "eef" else none
    return F.when(detector.isNotNull() & (F.size(detector) > 0), detector).otherwise(miss)


def _picks(starts: np.ndarray, xyz: np.ndarray, k: int) -> np.ndarray:
    """Rows of k picks for each cloud (clouds by picks); clouds lie one after another, from ``starts`` on, and have k points at least."""
    sizes = np.diff(np.append(starts, len(xyz)))
    cloud = np.repeat(np.arange(len(starts)), sizes)
    far, at, chosen = np.full(len(xyz), np.inf), starts, []
    for _ in range(k):
        chosen.append(at)
        far = np.minimum(far, ((xyz - xyz[at][cloud]) ** 2).sum(axis=1))
        far = np.where(np.isnan(far), np.inf, far)
        best = np.flatnonzero(far == np.maximum.reduceat(far, starts)[cloud])  # in order of clouds, then of rows
        at = best[np.searchsorted(cloud[best], np.arange(len(starts)))]
    return np.stack(chosen, axis=1)


def farthest_points(points: DataFrame, k: int, *, by: Sequence[str] = FRAME, point: str = "point_id", skip: bool = False) -> DataFrame:
    """k points of each cloud, each the farthest from those before it, from the smallest point id on; ties to the smaller id. Fewer than k points are an error, or with ``skip`` give none.

    The order within a cloud is sequential by nature. Clouds run in parallel: each is one row of arrays, and a task searches many at a time. A cloud must fit a task.
    """
    keys = list(by)
    rows = points.select(*keys, point, *(F.col(c).cast("double").alias(c) for c in "xyz"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, point).schema), "turn int"])
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(point).alias("p"), "x", "y", "z"))).alias("_c"))
    enough = F.size("_c") >= k
    if skip:
        held = held.filter(enough)
    else:
        said = F.raise_error(F.concat(F.lit("a cloud has "), F.size("_c").cast("string"), F.lit(f" points, {k} are asked for")))
        held = held.withColumn("_c", F.when(enough, F.col("_c")).otherwise(said.cast(held.schema["_c"].dataType)))

    def pick(batches):
        for whole in batches:
            sizes = pc.list_value_length(whole.column(len(keys))).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 1_000_000, prepend=-1)) if len(sizes) else []
            for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):  # about a million points at a time
                batch = whole.slice(a, b - a)
                lists = batch.column(len(keys))
                flat = lists.flatten()
                xyz = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
                n = sizes[a:b]
                chosen = _picks(np.cumsum(n) - n, xyz, k)
                own = pa.array(np.repeat(np.arange(b - a), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(len(keys))), flat.field("p").take(pa.array(chosen.ravel())), pa.array(np.tile(np.arange(k, dtype=np.int32), b - a))], names=[*keys, point, "turn"])

    return held.mapInArrow(pick, schema)


def farthest_points_of_large_clouds(points: DataFrame, k: int, *, by: Sequence[str] = (), point: str = "point_id", most_clouds: int = 100_000) -> DataFrame:
    """As farthest_points, for clouds that no task holds (or one cloud, without ``by``): each round every task proposes its farthest point of each cloud, and the best proposal is the next pick.

    Points are written once and stay where they are; what travels is a proposal for each task and cloud, and the picks so far, k for each of at most
    ``most_clouds`` clouds. A round measures each point against all picks so far, so that k should be tens; many small clouds are better grouped.
    """
    rows = materialize(points.select(*by, point, *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "xyz")), "clouds")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    least = sizes.agg(F.min("n"), F.count("*")).first()
    if least[1] > most_clouds:
        raise ValueError(f"{least[1]} clouds are too many; group them")
    if not by and least[0] == 0:
        return rows.select(point).limit(0).withColumn("turn", F.lit(0))
    if least[0] is not None and least[0] < k:
        raise ValueError(f"a cloud has {least[0]} points, {k} are asked for")
    with_ = lambda df, held: df.join(F.broadcast(held), list(by)) if by else df.crossJoin(F.broadcast(held))  # noqa: E731  no more rows than clouds
    lowest = lambda df, best: materialize(with_(df, df.groupBy(*by).agg(best)).filter("_d <=> _best").groupBy(*by).agg(F.min_by(F.struct(F.col(point).alias("point"), "x", "y", "z"), F.col(point)).alias("_next"), F.first("picks").alias("picks")), "picks").select(*by, F.concat("picks", F.array("_next")).alias("picks"))
    none = F.array().cast(f"array<struct<point:{rows.schema[point].dataType.simpleString()},x:double,y:double,z:double>>")
    picks = lowest(rows.withColumns({"_d": F.col(point), "picks": none}), F.min("_d").alias("_best"))
    for n in range(1, k):
        apart = lambda q: reduce(lambda a, b: a + b, [(F.col(c) - q[c]) * (F.col(c) - q[c]) for c in "xyz"])
        d2 = F.array_min(F.array(*(apart(F.col("picks")[i]) for i in range(n))))
        picks = lowest(with_(rows, picks).withColumn("_d", d2), F.max("_d").alias("_best"))  # numbers alone, so that both passes aggregate by hashing
    out = picks.select(*by, F.posexplode("picks").alias("turn", "p"))
    return out.select(*by, F.col("p.point").alias(point), "turn")


def take_strategy(df: DataFrame, strategy: str, order: Sequence[str], *, seed: int = 0) -> DataFrame:
    """first:N, end:N or random:N, N being a number or a percentage (rounded up); anything else keeps all."""
    kind, _, amount = strategy.partition(":")
    if kind not in ("first", "end", "random"):
        return df
    n = math.ceil(df.count() * float(amount[:-1]) / 100) if amount.endswith("%") else int(amount)
    keys = [F.col(c) for c in order] if kind == "first" else [F.col(c).desc() for c in order] if kind == "end" else [F.xxhash64(F.lit(seed), *order), *(F.col(c) for c in order)]
    return ranged_rows(df, keys).filter(F.col("_i") < n).select(*df.columns)


def ranged_rows(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows with ``_i``, their place from 0 in the order of keys: numbered within ranges, a range's first number being the sum of the sizes before it."""
    ranged = materialize(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_o"))  # one row for each range
    rows = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1).join(F.broadcast(before), "_p")
    return rows.withColumn("_i", F.col("_o") + F.col("_r")).drop("_p", "_o", "_r")


def dense_index(df: DataFrame, key: Sequence[str], out: str, *, bucket_rows: int = 100_000) -> tuple[DataFrame, int]:
    """Numbers rows from 0 without gaps, in no particular order, and counts them.

    Rows are numbered within buckets of a hash; a bucket's first number is the sum of the sizes before it.
    """
    n = df.count()
    buckets = max(1, n // bucket_rows)
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_o", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).select("_b", "_o")
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*key)) - 1
    return rows.withColumn("_p", place).join(before, "_b").withColumn(out, F.col("_o") + F.col("_p")).drop("_b", "_p", "_o"), n


def resample(df: DataFrame, weight: float, key: Sequence[str], *, seed: int = 0, choice: Callable[[Column], Column] | None = None, ordered: bool = False) -> DataFrame:
    """int(rows * weight) rows drawn uniformly with replacement: the slot, then the row's columns.

    choice: a whole number for a slot in place of the seeded hash; ``ordered`` numbers the rows in the order of key.
    """
    n = df.count()
    numbered = ranged_rows(df, [F.col(c) for c in key]) if ordered else dense_index(df, key, "_i")[0]
    pick = F.xxhash64(F.lit(seed), "id") if choice is None else choice(F.col("id"))
    slots = df.sparkSession.range(int(n * weight)).select(F.col("id").alias("slot"), F.pmod(pick, F.lit(max(n, 1))).alias("_i"))
    return slots.join(numbered, "_i").drop("_i")


def spread_probes(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """Every max(1, n // k)-th row, the first k of them. Rows are numbered within ranges of ``order``; a range's first number is the sum of the sizes before it."""
    step = max(1, df.count() // k)
    rows = ranged_rows(df, [F.col(c) for c in order])
    return rows.filter((F.col("_i") % step == 0) & (F.col("_i") < step * k)).select(*df.columns)


def random_frames(frames: DataFrame, k: int, *, seed: int = 0, key: Column | None = None) -> DataFrame:
    """k frames of each episode, those of the smallest key (a seeded hash by default)."""
    w = Window.partitionBy("episode_index").orderBy(F.xxhash64(F.lit(seed), "episode_index", "frame_index") if key is None else key, "frame_index")
    return frames.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def pick_rollouts(trials: DataFrame, by: Sequence[str], *, order: str = "trial") -> DataFrame:
    """A success and a failure of each group, the first of each; where all ended alike, the first two."""
    each = Window.partitionBy(*by, "success").orderBy(order)
    kinds = F.size(F.collect_set("success").over(Window.partitionBy(*by)))
    return trials.withColumns({"_r": F.row_number().over(each), "_k": kinds}).filter(F.col("_r") <= F.when(F.col("_k") == 2, 1).otherwise(2)).drop("_r", "_k")


def bin_argmax(candidates: DataFrame, by: Sequence[str], position: str, probability: str, order: str) -> DataFrame:
    """The likeliest candidate position of each group, ties to the first."""
    return candidates.groupBy(*by).agg(F.max_by(position, F.struct(F.col(probability), (-F.col(order)).alias("_o"))).alias(position), F.max(probability).alias(probability))


def soft_labels(frames: DataFrame, position: str, centres: Sequence[str], *, bins: int, size: float, key: Sequence[str], weights: str = "plain") -> DataFrame:
    """Weights over candidate positions along an axis, normalised per row of ``key``: candidates are centre + shift * size, for ``bins`` shifts from -bins / 2 on.

    plain: weight 1 within less than one bin of the true position. distance: 1 / distance (of at least 1e-4) within one bin. Where none is, the nearest candidate alone, ties to the first.
    """
    if weights not in ("plain", "distance"):
        raise ValueError(f"weights are plain or distance, not {weights}")
    shifts = F.explode(F.array(*(F.lit(k) for k in range(-(bins // 2), bins - bins // 2)))).alias("shift")
    rows = frames.select(*key, position, *centres, shifts)
    rows = rows.select(*key, "shift", *((F.col(c) + F.col("shift") * size).alias("candidate") for c in centres), F.col(position).alias("_p"))
    w = Window.partitionBy(*key)
    gap = F.abs(F.col("candidate") - F.col("_p"))
    inside = (F.col("_g") < size).cast("double") if weights == "plain" else F.when(F.col("_g") <= size, 1.0 / F.greatest("_g", F.lit(1e-4))).otherwise(0.0)
    rows = rows.withColumn("_g", gap).withColumns({"_in": inside, "_first": F.row_number().over(w.orderBy("_g", "shift"))})
    rows = rows.withColumn("_any", F.max("_in").over(w)).withColumn("_w", F.when(F.col("_any") > 0, F.col("_in")).otherwise((F.col("_first") == 1).cast("double")))
    return rows.select(*key, "shift", "candidate", (F.col("_w") / F.sum("_w").over(w)).alias("weight"))


def audit_sampling(drawn: DataFrame, points: DataFrame, *, sigma: float, budget: int, by: Sequence[str] = FRAME) -> DataFrame:
    """Per group: points, drawn, concentration (share of the draw within sigma over that of the points) and the problems found. Needs ``distance``."""
    near = F.count_if(F.col("distance") <= sigma)
    a = points.groupBy(*by).agg(F.count("*").alias("n_points"), near.alias("near_points"), F.count("distance").alias("with_anchor"))
    d = drawn.groupBy(*by).agg(F.count("*").alias("n_drawn"), near.alias("near_drawn"))
    out = a.join(d, list(by), "left").fillna(0, ["n_drawn", "near_drawn"])
    share = (F.col("near_drawn") / F.greatest("n_drawn", F.lit(1))) / (F.col("near_points") / F.col("n_points"))
    out = out.withColumn("concentration", F.when(F.col("near_points") > 0, share))
    problems = F.array(F.when(F.col("with_anchor") == 0, "no anchor"), F.when(F.col("concentration") < 1.5, "not concentrated"), F.when(F.col("n_drawn") < F.least("n_points", F.lit(budget)), "budget unmet"))
    return out.withColumn("problems", F.filter(problems, lambda p: p.isNotNull()))


def audit_summary(audit: DataFrame, centres: DataFrame, *, budget: int, by: Sequence[str] = FRAME) -> DataFrame:
    """Over all frames of an audit: how many have centres (rows of ``centres``) and how many fall back, centres per anchored frame, the median drawn and its share of the budget, and frames with problems."""
    per = centres.groupBy(*by).agg(F.count("*").alias("_c"))
    rows = audit.join(per, list(by), "left")
    out = rows.agg(F.count("*").alias("n_frames"), F.count("_c").alias("n_anchored"), F.count_if(F.col("_c").isNull()).alias("n_fallback"), F.avg("_c").alias("centres_per_frame"), F.count_if(F.size("problems") > 0).alias("n_with_problems"))
    return with_quantiles(out, rows, "n_drawn", {"median_drawn": 0.5}).withColumn("drawn_share", F.col("median_drawn") / budget)
