"""Voxel grids over point tables: merge, majority labels, label transfer, pooling, space-filling order."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.sources.shared import spread

FRAME = ("episode_index", "frame_index")
AXES = ("x", "y", "z")
CELL = ("ix", "iy", "iz")
#: Fixed values of the key format: workspace reach in metres, and the largest radix that 32-bit keys allow.
REACH, MAX_RADIX = 1.0, 1024


def key_params(size: float) -> tuple[int, int]:
    """Offset and radix of packed keys, from the voxel size alone."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    span = 2 * (math.ceil(REACH / size) + 1) + 1
    radix = 2 ** math.ceil(math.log2(span))
    if radix > MAX_RADIX:
        raise ValueError(f"voxel size {size} needs radix {radix}, over {MAX_RADIX}")
    return radix // 2, radix


def cells(points: DataFrame, size: float, *, origin: str | None = None, by: Sequence[str] = FRAME) -> DataFrame:
    """Adds ix, iy, iz. origin None: absolute grid; ``min``: anchored half a voxel below each cloud's least corner."""
    if origin is None:
        index = {c: F.floor(F.col(a) / size) for c, a in zip(CELL, AXES, strict=True)}
    else:
        points, corner = spread(points, by), Window.partitionBy(*by)
        index = {c: F.floor((F.col(a) - (F.min(a).over(corner) - size / 2)) / size) for c, a in zip(CELL, AXES, strict=True)}
    return points.withColumns(index)


def pack_key(size: float, index: Sequence[str] = CELL) -> Column:
    """One order-preserving number per cell; a cell outside the packable range raises an error."""
    offset, radix = key_params(size)
    shifted = [F.col(c).cast("long") + offset for c in index]
    inside = reduce(lambda a, b: a & b, [(s >= 0) & (s < radix) for s in shifted])
    return F.when(inside, (shifted[0] * radix + shifted[1]) * radix + shifted[2]).otherwise(F.raise_error(F.lit("voxel index outside the packable range")).cast("long"))


def voxel_downsample(points: DataFrame, size: float, *, columns: Sequence[str] = AXES, by: Sequence[str] = FRAME, origin: str | None = None) -> DataFrame:
    """Mean of ``columns`` per cell. A size of zero or less passes the points through.

    On the absolute grid partial sums are made before the one shuffle, so a crowded cell costs no more than any other.
    """
    if size <= 0:
        return points
    return cells(points, size, origin=origin, by=by).groupBy(*by, *CELL).agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n_points"))


def voxel_labels(points: DataFrame, size: float, *, by: Sequence[str] = FRAME) -> DataFrame:
    """The most frequent label of each cell, ties to the higher one."""
    counts = cells(points, size).groupBy(*by, *CELL, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(*by, *CELL).agg(F.max_by("label", F.struct("n", "label")).alias("label"))


def merge_with_labels(points: DataFrame, size: float, *, by: Sequence[str] = FRAME) -> DataFrame:
    """voxel_downsample and voxel_labels in one pass: label counts carry the sums."""
    per_label = cells(points, size).groupBy(*by, *CELL, "label").agg(F.count("*").alias("n"), *(F.sum(a).alias(a) for a in AXES))
    return per_label.groupBy(*by, *CELL).agg(*((F.sum(a) / F.sum("n")).alias(a) for a in AXES), F.sum("n").alias("n_points"), F.max_by("label", F.struct("n", "label")).alias("label"))


def voxel_ordered(points: DataFrame, size: float, *, by: Sequence[str] = FRAME) -> DataFrame:
    """Rows with their packed cell key (vkey), dealt by frame and sorted by it within each task, as a writer stores them."""
    keyed = cells(points, size).withColumn("vkey", pack_key(size)).drop(*CELL)
    return keyed.repartition(*by).sortWithinPartitions(*by, "vkey")


def fuse_views(views: Sequence[DataFrame]) -> DataFrame:
    """One cloud of all cameras' points: the union of their tables, columns by name."""
    return reduce(lambda a, b: a.unionByName(b), views)


def transfer_labels(points: DataFrame, labels: DataFrame, size: float, *, by: Sequence[str] = FRAME) -> DataFrame:
    """Labels of one cloud onto another by cell: label 0 where no cell matches; ``matched`` tells which."""
    keyed = cells(points, size).withColumn("vkey", pack_key(size)).drop(*CELL)
    known = labels.withColumn("vkey", pack_key(size)).select(*by, "vkey", F.col("label").alias("_label"))
    return keyed.join(known, [*by, "vkey"], "left").withColumns({"label": F.coalesce("_label", F.lit(0)), "matched": F.col("_label").isNotNull()}).drop("_label")


def transfer_labels_by_frame(points: DataFrame, labels: DataFrame, size: float, *, by: Sequence[str] = FRAME) -> DataFrame:
    """As transfer_labels, but the labels of a frame travel as one map: a join by the frame alone, which tables that are bucketed by it need no shuffle for."""
    known = labels.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(pack_key(size).alias("k"), F.col("label").alias("v")))).alias("_labels"))
    out = cells(points, size).withColumn("vkey", pack_key(size)).drop(*CELL).join(known, list(by), "left")
    found = F.try_element_at("_labels", F.col("vkey"))
    return out.withColumns({"label": F.coalesce(found, F.lit(0)), "matched": found.isNotNull()}).drop("_labels")


def unmatched_share(transferred: DataFrame, *, by: Sequence[str] = FRAME, limit: float | None = None) -> DataFrame:
    """Overall and worst-frame share of points without a label; with ``limit``, an error above it."""
    frames = transferred.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("matched")).alias("missing"))
    out = frames.agg((F.sum("missing") / F.sum("n")).alias("unmatched"), F.max(F.col("missing") / F.col("n")).alias("worst_frame"))
    if limit is None:
        return out
    fine = F.when(F.col("unmatched") <= limit, F.col("unmatched")).otherwise(F.raise_error(F.lit(f"unmatched share over {limit}")).cast("double"))
    return out.withColumn("unmatched", fine)


def label_histogram(points: DataFrame, *, classes: int = 5, target: Sequence[int] = (3, 4), budget: int | None = None) -> DataFrame:
    """Count and share of each label, absent ones with 0; with a budget, the points of it that ``target`` labels would get."""
    counts = points.agg(F.count("*").alias("total"), *(F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(classes)))
    share = sum(F.col(f"n{k}") for k in target) / F.greatest("total", F.lit(1))
    rows = counts.select("total", share.alias("target_share"), F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"n{k}").alias("n")) for k in range(classes)))).alias("e"))
    out = rows.select("e.label", "e.n", (F.col("e.n") / F.greatest("total", F.lit(1))).alias("share"), "target_share")
    return out if budget is None else out.withColumn("target_points", F.col("target_share") * budget)


def grid_pool(points: DataFrame, size: float, stride: int, *, features: Sequence[str] = (), reduce_by: str = "max", by: Sequence[str] = FRAME) -> tuple[DataFrame, DataFrame]:
    """Pools grid coordinates by ``stride`` (towards zero): the coarse points, and each point's parent cell."""
    fine = cells(points, size, by=by)
    parent = {c: F.when(F.col(c) < 0, -F.floor(-F.col(c) / stride)).otherwise(F.floor(F.col(c) / stride)) for c in CELL}
    children = fine.withColumns(parent)
    how = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}[reduce_by]
    pooled = children.groupBy(*by, *CELL).agg(*(F.avg(a).alias(a) for a in AXES), *(how(f).alias(f) for f in features), F.count("*").alias("n_children"))
    return pooled, children


def propagate_labels(points: DataFrame, size: float, strides: Sequence[int], *, classes: int = 5, by: Sequence[str] = FRAME) -> DataFrame:
    """Label counts of the cells after a chain of poolings, their majority (first largest), and whether any target label is inside."""
    rows = cells(points, size, by=by).groupBy(*by, *CELL).agg(*(F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(classes)))
    for stride in strides:
        parent = {c: F.when(F.col(c) < 0, -F.floor(-F.col(c) / stride)).otherwise(F.floor(F.col(c) / stride)) for c in CELL}
        rows = rows.withColumns(parent).groupBy(*by, *CELL).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(classes)))
    counts = F.array(*(F.col(f"n{k}") for k in range(classes)))
    return rows.withColumns({"majority": (F.array_position(counts, F.array_max(counts)) - 1).cast("int"), "has_target": F.col(f"n{classes - 1}") > 0})


def z_order(depth: int, order: Sequence[str] = CELL) -> Column:
    """Interleaves the low ``depth`` bits of three non-negative cell numbers, the last axis lowest."""
    parts = []
    for bit in range(depth):
        for place, c in enumerate(reversed(order)):
            parts.append(F.shiftleft(F.shiftright(F.col(c).cast("long"), bit).bitwiseAND(F.lit(1)), 3 * bit + place))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def skilling_steps(x: list[np.ndarray], steps: Sequence[tuple[int, int]]) -> None:
    """Steps (level of bits, axis) of Skilling's transform over three arrays of numbers, in place.

    Where the axis has the level's bit, the lower bits of the first axis turn over; else both axes exchange theirs.
    """
    for level, axis in steps:
        low = (1 << level) - 1
        has = (x[axis] >> level & 1).astype(bool)
        swap = np.where(has, 0, (x[0] ^ x[axis]) & low)
        x[axis] = x[axis] ^ swap  # no change where the axis is the first
        x[0] = x[0] ^ np.where(has, low, swap)


def hilbert_codes(a: np.ndarray, b: np.ndarray, c: np.ndarray, depth: int) -> np.ndarray:
    """The Hilbert codes of cells: Skilling's transform, a level of bits at a time, over many points at once."""
    x = [a, b, c]
    skilling_steps(x, [(level, axis) for level in range(depth - 1, 0, -1) for axis in range(3)])
    x[1] = x[0] ^ x[1]
    x[2] = x[1] ^ x[2]
    turn = np.zeros_like(x[2])
    for level in range(depth - 1, 0, -1):
        turn ^= (x[2] >> level & 1) * ((1 << level) - 1)
    code = np.zeros_like(turn)
    for k in range(3):
        for level in range(depth):
            code |= ((x[k] ^ turn) >> level & 1) << (3 * level + 2 - k)
    return code


def numbers(*columns: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of whole numbers as arrays of 64 bits (nulls: 0), and which rows have a null."""
    lost = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        lost |= c.is_null().to_numpy(zero_copy_only=False)
    return [c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).copy() for c in columns], lost


def with_hilbert_order(df: DataFrame, depth: int, out: str, order: Sequence[str] = CELL) -> DataFrame:
    """Adds the Hilbert code of three cell numbers (null where one is null)."""

    @F.arrow_udf("long")
    def code(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        x, lost = numbers(a, b, c)
        return pa.array(hilbert_codes(*x, depth), mask=lost)

    return df.withColumn(out, code(*(F.col(c).cast("long") for c in order)))


def serialise(points: DataFrame, size: float, *, depth: int = 10, curve: str = "z", by: Sequence[str] = FRAME) -> DataFrame:
    """Each point's code on a space-filling curve, and its place along the curve within its cloud (ties to the smaller point_id).

    curve: z, z-trans, hilbert or hilbert-trans (first two axes exchanged). A cloud that is wider than ``depth`` levels is an error.
    """
    from demolake.operators.curves import check_depth, inside

    check_depth(depth)
    corner = Window.partitionBy(*by)
    grid = spread(points, by).withColumns({c: ((F.col(a) - F.min(a).over(corner)) / size).cast("long") for c, a in zip(CELL, AXES, strict=True)})
    grid = inside(grid, depth)
    order = (CELL[1], CELL[0], CELL[2]) if curve.endswith("-trans") else CELL
    coded = grid.withColumn("code", z_order(depth, order)) if curve.startswith("z") else with_hilbert_order(grid, depth, "code", order)
    return coded.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("code", "point_id")) - 1)
