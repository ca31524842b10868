"""Point-cloud colours: scaling, brightness, contrast, saturation, gamma, jitter, stretch. All randomness is a seeded hash."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RGB = ("r", "g", "b")


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    h = F.xxhash64(F.lit(seed), *(F.col(k) if isinstance(k, str) else k for k in keys))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def normal(seed: int, *keys: str | Column) -> Column:
    u, v = uniform(seed, *keys), uniform(seed + 1, *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * math.pi * v)


def jitter_colours(
    points: DataFrame, *, by: Sequence[str], point: str = "point_id", seed: int = 0, brightness: float = 0.0, contrast: float = 0.0,
    saturation: float = 0.0, jitter_std: float = 0.0, gamma: float = 0.0, auto_contrast: bool = False,
) -> DataFrame:
    """Each frame has factors of its own; jitter is per point and channel. Colours over 1 count as bytes. The result is clipped to [0, 1]."""
    frame = Window.partitionBy(*by)
    factor = lambda k, width: 1.0 + (uniform(seed + k, *by) * 2 - 1) * width
    top = F.max(F.greatest(*RGB)).over(frame)
    df = points.withColumns({c: F.when(top > 1, F.col(c) / 255.0).otherwise(F.col(c)) for c in RGB})
    if brightness > 0:
        df = df.withColumns({c: F.col(c) * factor(10, brightness) for c in RGB})
    if contrast > 0:
        df = df.withColumns({c: (F.col(c) - F.avg(c).over(frame)) * factor(20, contrast) + F.avg(c).over(frame) for c in RGB})
    if saturation > 0:
        grey = (F.col("r") + F.col("g") + F.col("b")) / 3
        df = df.withColumn("_grey", grey).withColumns({c: F.col("_grey") + (F.col(c) - F.col("_grey")) * factor(30, saturation) for c in RGB}).drop("_grey")
    if jitter_std > 0:
        df = df.withColumns({c: F.col(c) + jitter_std * normal(seed + 40 + 2 * k, *by, point) for k, c in enumerate(RGB)})
    if gamma > 0:
        df = df.withColumns({c: F.pow(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)), factor(50, gamma)) for c in RGB})
    if auto_contrast:
        df = df.withColumns({c: (F.col(c) - F.min(c).over(frame)) / (F.max(c).over(frame) - F.min(c).over(frame) + 1e-6) for c in RGB})
    return df.withColumns({c: F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) for c in RGB})


def adjust_colours(points: DataFrame, *, by: Sequence[str], brightness: Column | float = 1.0, contrast: Column | float = 1.0, saturation: Column | float = 1.0, gamma: Column | float = 1.0) -> DataFrame:
    """Given factors in order: brightness, contrast about the cloud's mean, saturation about the point's grey, gamma of the colour clipped to [0, 1]; the result is clipped, too."""
    frame = Window.partitionBy(*by)
    clipped = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    df = points.withColumns({c: F.col(c) * brightness for c in RGB}).withColumns({f"_mean_{c}": F.avg(c).over(frame) for c in RGB})
    df = df.withColumns({c: (F.col(c) - F.col(f"_mean_{c}")) * contrast + F.col(f"_mean_{c}") for c in RGB})
    df = df.withColumn("_grey", (F.col("r") + F.col("g") + F.col("b")) / 3)
    df = df.withColumns({c: F.pow(clipped(F.col("_grey") + (F.col(c) - F.col("_grey")) * saturation), gamma if isinstance(gamma, Column) else F.lit(gamma)) for c in RGB})
    return df.drop("_grey", *(f"_mean_{c}" for c in RGB))


def to_signed(c: Column) -> Column:
    return c * 2.0 - 1.0
