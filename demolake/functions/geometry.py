"""Cameras, depth codes, frames of reference, densities and boxes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demolake.functions.rotation import _at, apply, transpose


def depth_from_rgb(r: Column, g: Column, b: Column, scale: float = 256000.0) -> Column:
    return (65536.0 * r + 256.0 * g + b) / scale


def depth_to_rgb(depth: Column, scale: float = 256000.0, drop_blue: bool = False) -> Column:
    """A struct of r, g, b: the depth as a 24-bit number, rounded half up and clipped."""
    code = F.greatest(F.least(F.floor(depth * scale + 0.5), F.lit(2**24 - 1)), F.lit(0)).cast("long")
    part = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(16).alias("r"), part(8).alias("g"), (F.lit(0) if drop_blue else part(0)).alias("b"))


#: Units of stored grey depth by pixel type.
GREY_SCALE = {"uint8": 100.0, "uint16": 1000.0, "int32": 256000.0}


def depth_from_grey(v: Column, kind: str) -> Column:
    return v / GREY_SCALE[kind]


def metric_depth(d: Column, near: Column, far: Column) -> Column:
    return F.greatest(d * (far - near) + near, F.lit(0.0))


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """A pixel at a depth, in camera coordinates."""
    return F.array((u - cx) * depth / fx, (v - cy) * depth / fy, depth)


def rigid_apply(rotation: Column, translation: Column, p: Column) -> Column:
    return F.zip_with(apply(rotation, p), translation, lambda a, b: a + b)


def rigid_inverse(rotation: Column, translation: Column) -> tuple[Column, Column]:
    """Of a rotation and a shift; no solver is needed."""
    back = transpose(rotation)
    return back, F.transform(apply(back, translation), lambda x: -x)


def rigid_compose(r1: Column, t1: Column, r2: Column, t2: Column) -> tuple[Column, Column]:
    """First the second motion, then the first one."""
    from demolake.functions.rotation import matmul

    return matmul(r1, r2), rigid_apply(r1, t1, t2)


def flip_camera_axes(p: Column) -> Column:
    """Between cameras that look along -z and those that look along +z."""
    return F.array(_at(p, 0), -_at(p, 1), -_at(p, 2))


def project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column, eps: float = 1e-6) -> Column:
    """Camera coordinates to a struct u, v, z, in_front; u and v are null behind the camera."""
    z = _at(p, 2)
    front = z > eps
    return F.struct(F.when(front, fx * _at(p, 0) / z + cx).alias("u"), F.when(front, fy * _at(p, 1) / z + cy).alias("v"), z.alias("z"), front.alias("in_front"))


def project_rounded(p: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Whole pixels, rounded half to even; (0, 0) behind the camera."""
    z = _at(p, 2)
    behind = z <= 1e-8
    pixel = lambda f, k, c: F.when(behind, 0).otherwise(F.rint(f * _at(p, k) / z + c)).cast("int")
    return F.struct(pixel(fx, 0, cx).alias("u"), pixel(fy, 1, cy).alias("v"))


def project_points(points: DataFrame, cams: DataFrame, *, on: Sequence[str] = (), most: int = 10_000) -> DataFrame:
    """Points seen by cameras (view_id, fx, fy, cx, cy, tx, ty, tz), looking along +z from (tx, ty, -tz): every point by each of at most ``most`` cameras, or by the cameras of its key."""
    both = points.join(cams, list(on)) if on else points.crossJoin(F.broadcast(few(cams, most)))
    p = F.array(F.col("x") + F.col("tx"), F.col("y") + F.col("ty"), F.col("z") + F.col("tz"))
    return _seen_at(both, p)


def project_posed(points: DataFrame, cams: DataFrame, *, on: Sequence[str], rotation: str = "cam_rotation", shift: str = "cam_shift") -> DataFrame:
    """Points seen by the cameras of their key, such as a frame: cams has fx, fy, cx, cy, a rotation (nine numbers by rows) and a shift, from the points' coordinates to the camera's.

    An equi join: Spark broadcasts the cameras only if they are small, as they grow with the frames.
    """
    both = points.join(cams, list(on))
    x = F.array("x", "y", "z")
    row = lambda k: sum((_at(F.col(rotation), 3 * k + j) * _at(x, j) for j in range(3)), _at(F.col(shift), k))
    return _seen_at(both, F.array(*(row(k) for k in range(3))))


def _seen_at(both: DataFrame, p: Column) -> DataFrame:
    return both.withColumn("_p", project(p, F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))).select("*", "_p.u", "_p.v", F.col("_p.z").alias("depth"), "_p.in_front").drop("_p")


def few(df: DataFrame, most: int) -> DataFrame:
    """The same rows, if they are few enough to be broadcast."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows are too many to meet every row; join them by a key")
    return df


def visible(width: int, height: int) -> Column:
    return F.col("in_front") & (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)


def in_image_box(width: int, height: int, box: tuple[float, float, float, float]) -> Column:
    """Whether a projected point lies in front of the camera, inside the image (half open) and inside a box (left, top, right, bottom; closed)."""
    left, top, right, bottom = box
    return visible(width, height) & F.col("u").between(left, right) & F.col("v").between(top, bottom)


def in_workspace(box: Sequence[tuple[float, float]], *, closed: bool = False, axes: Sequence[str] = ("x", "y", "z")) -> Column:
    """Strictly inside a box, or with its faces when closed."""
    out = F.lit(True)
    for a, (low, high) in zip(axes, box, strict=True):
        out = out & (F.col(a).between(low, high) if closed else (F.col(a) > low) & (F.col(a) < high))
    return out


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    x, y, z = (p - q for p, q in zip(a, b, strict=True))
    return x * x + y * y + z * z


def density_weight(xyz: Sequence[Column], anchors: Column, sigma: float, floor: float) -> Column:
    """floor + (1 - floor) times the highest Gaussian bump over an array of anchor structs (x, y, z); the floor where there is none."""
    s = max(sigma, 1e-6)
    bump = F.array_max(F.transform(anchors, lambda a: F.exp(-squared_distance(xyz, (a["x"], a["y"], a["z"])) / (2 * s * s))))
    return floor + (1 - floor) * F.coalesce(bump, F.lit(0.0))


def box_from_bounds(low: Column, high: Column, rotation: Column, position: Column) -> Column:
    """An oriented box (centre, rotation, extent) from a link's bounds and pose."""
    middle = F.zip_with(low, high, lambda a, b: (a + b) / 2)
    return F.struct(rigid_apply(rotation, position, middle).alias("centre"), rotation.alias("rotation"), F.zip_with(high, low, lambda a, b: a - b).alias("extent"))


def box_from_vector(v: Column) -> Column:
    """From fifteen numbers: centre, rotation, size."""
    return F.struct(F.slice(v, 1, 3).alias("centre"), F.slice(v, 4, 9).alias("rotation"), F.slice(v, 13, 3).alias("extent"))


def in_box(xyz: Sequence[Column], box: Column) -> Column:
    """Whether a point lies in an oriented box, faces included."""
    shift = F.array(*(p - _at(box["centre"], k) for k, p in enumerate(xyz)))
    local = apply(transpose(box["rotation"]), shift)
    out = F.lit(True)
    for k in range(3):
        out = out & (F.abs(_at(local, k)) <= _at(box["extent"], k) / 2)
    return out


def remove_in_boxes(points: DataFrame, boxes: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Points outside all boxes of their frame: the boxes come as one array per frame, so that points are neither multiplied nor dropped."""
    per_frame = boxes.groupBy(*by).agg(F.collect_list("box").alias("_boxes"))
    hit = F.exists("_boxes", lambda b: in_box((F.col("x"), F.col("y"), F.col("z")), b))
    return points.join(per_frame, list(by), "left").filter(~F.coalesce(hit, F.lit(False))).drop("_boxes")


def instance_id(r: Column, g: Column, b: Column) -> Column:
    return r + 256 * g + 65536 * b


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    byte = lambda c: F.lpad(F.lower(F.hex(F.rint(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) * 255).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Points inside any box of their frame, each once."""
    per_frame = boxes.groupBy(*by).agg(F.collect_list("box").alias("_boxes"))
    return points.join(per_frame, list(by)).filter(F.exists("_boxes", lambda b: in_box((F.col("x"), F.col("y"), F.col("z")), b))).drop("_boxes")
