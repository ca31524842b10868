"""Space-filling curves the other way round: cells of codes, batch codes, orders and their inverses.

``voxel.serialise`` gives points their codes; here codes become cells again, codes of several clouds become one
number, and the order along a curve becomes a pair of permutations, one the inverse of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.operators.voxel import CELL, FRAME, numbers, skilling_steps

#: Codes of three axes at this depth still fit 48 bits beside a batch number.
DEEPEST = 16


def check_depth(depth: int, batches: int = 1) -> None:
    """Fails if codes of so many levels and batches don't fit a long number."""
    if not 0 < depth <= DEEPEST:
        raise ValueError(f"depth must be 1 to {DEEPEST}, not {depth}")
    if 3 * depth + batches.bit_length() > 63:
        raise ValueError(f"codes of depth {depth} leave no room for {batches} batches")


def inside(df: DataFrame, depth: int, cells: Sequence[str] = CELL) -> DataFrame:
    """The same rows; a cell outside of the 2**depth cells of an axis is an error when it is read."""
    fine = lambda c: (F.col(c) >= 0) & (F.col(c) < (1 << depth))
    said = lambda c: F.raise_error(F.concat(F.lit(f"{c} lies outside of depth {depth}: "), F.col(c).cast("string")))
    return df.withColumns({c: F.when(fine(c) | F.col(c).isNull(), F.col(c)).otherwise(said(c).cast(df.schema[c].dataType)) for c in cells})


def _taken(code: Column, depth: int, place: int) -> Column:
    """Every third bit of a code, from ``place`` on."""
    out = F.lit(0).cast("long")
    for level in range(depth):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 3 * level + place).bitwiseAND(F.lit(1).cast("long")), level))
    return out


def z_cells(df: DataFrame, code: str, depth: int, cells: Sequence[str] = CELL) -> DataFrame:
    """Adds the cells of codes in z order."""
    check_depth(depth)
    return df.withColumns({c: _taken(F.col(code), depth, 2 - k) for k, c in enumerate(cells)})


def hilbert_cells(df: DataFrame, code: str, depth: int, cells: Sequence[str] = CELL) -> DataFrame:
    """Adds the cells of Hilbert codes: Skilling's transform undone, the lowest level of bits first, over many codes at once."""
    check_depth(depth)

    @F.arrow_udf("struct<a:long,b:long,c:long>")
    def back(codes: pa.Array) -> pa.Array:
        (code,), lost = numbers(codes)
        x = []
        for k in range(3):
            taken = np.zeros_like(code)
            for level in range(depth):
                taken |= (code >> (3 * level + 2 - k) & 1) << level
            x.append(taken)
        x = [x[0] ^ (x[2] >> 1), x[1] ^ x[0], x[2] ^ x[1]]
        skilling_steps(x, [(level, axis) for level in range(1, depth) for axis in (2, 1, 0)])
        return pa.StructArray.from_arrays([pa.array(v, mask=lost) for v in x], names=["a", "b", "c"])

    return df.withColumn("_cells", back(F.col(code).cast("long"))).withColumns({c: F.col(f"_cells.{n}") for c, n in zip(cells, "abc", strict=True)}).drop("_cells")


def batch_code(code: Column, batch: Column, depth: int) -> Column:
    """Codes of several clouds as one number, the batch in front. A code or batch that doesn't fit is an error."""
    check_depth(depth)
    fits = (code >= 0) & (code < F.lit(1 << 3 * depth)) & (batch >= 0) & (batch < F.lit(1 << (62 - 3 * depth)))
    said = F.raise_error(F.concat(F.lit(f"no code of depth {depth}: batch "), batch.cast("string"), F.lit(", code "), code.cast("string"))).cast("long")
    return F.when(fits, F.shiftleft(batch.cast("long"), 3 * depth).bitwiseOR(code)).otherwise(said)


def split_batch_code(code: Column, depth: int) -> tuple[Column, Column]:
    """Batch and code."""
    return F.shiftright(code, 3 * depth), code.bitwiseAND(F.lit((1 << 3 * depth) - 1).cast("long"))


def permutations(points: DataFrame, code: str = "code", *, by: Sequence[str] = FRAME, point: str = "point_id") -> DataFrame:
    """For every cloud and i from 0: ``order`` is which of its points (counted by ``point``) comes i-th along the curve, ``inverse`` which place point i has. Ties go to the smaller point."""
    cloud = Window.partitionBy(*by)
    rows = points.select(*by, (F.row_number().over(cloud.orderBy(point)) - 1).alias("_n"), (F.row_number().over(cloud.orderBy(code, point)) - 1).alias("_p"))
    # the i-th row by number tells the inverse, the i-th by place the order: both lists come from one pass over the cloud
    by_number, by_place = F.array_sort(F.collect_list(F.struct("_n", "_p"))), F.array_sort(F.collect_list(F.struct("_p", "_n")))
    lists = rows.groupBy(*by).agg(by_place.alias("_o"), by_number.alias("_i"))
    zipped = lists.select(*by, F.posexplode(F.arrays_zip(F.col("_o._n").alias("order"), F.col("_i._p").alias("inverse"))).alias("i", "_z"))
    return zipped.select(*by, "i", "_z.order", "_z.inverse")
