"""Class labels of bodies and masks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label numbers.
BACKGROUND, ROBOT, TARGET, DOOR, HANDLE = 0, 1, 2, 3, 4
UNDEFINED = 65535


def body_label(name: Column, *, targets: Sequence[str] = (), robots: Sequence[str] = ("robot", "gripper", "mobilebase")) -> Column:
    """The label of a body by its name: robot, then handle, then door or drawer, then target."""
    n = F.lower(name)
    target = reduce(lambda a, b: a | b, [n.contains(t.lower()) for t in targets], F.lit(False))
    robot = reduce(lambda a, b: a | b, [n.startswith(r) for r in robots])
    return F.when(robot, ROBOT).when(n.contains("handle"), HANDLE).when(n.contains("door") | n.contains("drawer"), DOOR).when(target, TARGET).otherwise(BACKGROUND)


def pixel_labels(pixels: DataFrame, lookup: DataFrame, geom: str = "geom_id") -> DataFrame:
    """Labels of pixels by the geometry drawn there; nothing drawn (-1) or unknown is background. The lookup is one row per geometry of a scene."""
    return pixels.join(lookup.select(geom, F.col("label").alias("_l")), geom, "left").withColumn("label", F.when(F.col(geom) == -1, BACKGROUND).otherwise(F.coalesce("_l", F.lit(BACKGROUND)))).drop("_l")


def foreground(points: DataFrame, background: DataFrame, instance: str = "instance") -> DataFrame:
    """Points whose instance is no background id; the undefined id never stays."""
    return points.filter(F.col(instance) != UNDEFINED).join(background.select(instance).distinct(), instance, "left_anti")


def valid_depth(df: DataFrame, depth: str, image: Sequence[str]) -> DataFrame:
    """Depths with negative ones and NaN as 0, and whether the image is normalised (its largest depth is 1 at most)."""
    from pyspark.sql.window import Window

    d = F.col(depth)
    clean = F.when(d.isNull() | F.isnan(d) | (d < 0), 0.0).otherwise(d)
    top = F.max(clean).over(Window.partitionBy(*image))
    return df.withColumn(depth, clean).withColumn("normalised", top <= 1)
