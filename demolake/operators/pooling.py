"""Pooling chains with their parent maps: which cell of every level a point falls into, and what ids the cells carry.

Cells of a level are numbered from 0 within their cloud, in order of (ix, iy, iz). Coarser cells are cells divided by
the stride, towards zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.operators.voxel import CELL, FRAME, cells
from demolake.sources.shared import spread


def pooling_ids(points: DataFrame, size: float, strides: Sequence[int], *, by: Sequence[str] = FRAME) -> DataFrame:
    """The points with the number of their cell at each level: id0 (cells of ``size``), id1, ... after each pooling."""
    rows = cells(spread(points, by), size, by=by)
    at = list(CELL)
    for level in range(len(strides) + 1):
        order = Window.partitionBy(*by).orderBy(*at)
        rows = rows.withColumn(f"id{level}", F.dense_rank().over(order) - 1)
        if level < len(strides):
            up = [f"_{c}{level}" for c in CELL]
            rows = rows.withColumns({u: F.when(F.col(c) < 0, -F.floor(-F.col(c) / strides[level])).otherwise(F.floor(F.col(c) / strides[level])) for u, c in zip(up, at, strict=True)})
            at = up
    return rows.drop(*CELL, *(f"_{c}{level}" for c in CELL for level in range(len(strides))))


def parent_map(ids: DataFrame, level: int, *, by: Sequence[str] = FRAME) -> DataFrame:
    """Child and parent of each cell of a level: by, child, parent."""
    return ids.select(*by, F.col(f"id{level}").alias("child"), F.col(f"id{level + 1}").alias("parent")).distinct()


def compose(maps: Sequence[DataFrame], *, by: Sequence[str] = FRAME) -> DataFrame:
    """From the parent maps of successive levels, each cell of the first and its ancestor at every level: by, level, child, ancestor (level 0: itself).

    A child without parent in a later map has no ancestors from there on.
    """
    now = maps[0].select(*by, "child", F.col("parent").alias("ancestor"))
    out = [maps[0].select(*by, F.lit(0).alias("level"), "child", F.col("child").alias("ancestor")), now.select(*by, F.lit(1).alias("level"), "child", "ancestor")]
    for level, step in enumerate(maps[1:], 2):
        now = now.join(step.select(*by, F.col("child").alias("ancestor"), "parent"), [*by, "ancestor"]).select(*by, "child", F.col("parent").alias("ancestor"))
        out.append(now.select(*by, F.lit(level).alias("level"), "child", "ancestor"))
    return reduce(DataFrame.unionByName, out)


def carry_ids(carried: DataFrame, ancestors: DataFrame, *, by: Sequence[str] = FRAME, id: str = "query_id") -> DataFrame:
    """The ids that cells of the first level carry (by, child, id), at every level: by, level, cell, and the sorted distinct ids inside. Cells without any aren't listed."""
    rows = ancestors.join(carried.select(*by, "child", F.col(id).alias("_id")).filter("_id IS NOT NULL").distinct(), [*by, "child"])
    return rows.groupBy(*by, "level", F.col("ancestor").alias("cell")).agg(F.array_sort(F.collect_set("_id")).alias(f"{id}s"))
