"""Rotations as column expressions: vectors are arrays of doubles, a matrix is nine numbers, row by row."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(v: Column, k: int) -> Column:
    return F.element_at(v, k + 1).cast("double")


def let(f):
    """Evaluates the first argument once, however often ``f`` uses it: without this, nested rotations would multiply their expressions."""

    @functools.wraps(f)
    def bound(v: Column, *args, **options) -> Column:
        return F.element_at(F.transform(F.array(v), lambda x: f(x, *args, **options)), 1)

    return bound


@let
def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


@let
def unit(v: Column, eps: float = 1e-12) -> Column:
    return _scaled(F.greatest(norm(v), F.lit(eps)), v)


@let
def _scaled(n: Column, v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / n)


@let
def matmul(a: Column, b: Column) -> Column:
    return _product(b, a)


@let
def _product(b: Column, a: Column) -> Column:
    return F.array(*(sum((_at(a, 3 * i + k) * _at(b, 3 * k + j) for k in range(1, 3)), _at(a, 3 * i) * _at(b, j)) for i in range(3) for j in range(3)))


@let
def apply(m: Column, v: Column) -> Column:
    return _applied(v, m)


@let
def _applied(v: Column, m: Column) -> Column:
    return F.array(*(_at(m, 3 * i) * _at(v, 0) + _at(m, 3 * i + 1) * _at(v, 1) + _at(m, 3 * i + 2) * _at(v, 2) for i in range(3)))


@let
def transpose(m: Column) -> Column:
    return F.array(*(_at(m, 3 * j + i) for i in range(3) for j in range(3)))


@let
def wrap_angle(x: Column) -> Column:
    """Into [-pi, pi), as the remainder of a positive modulus gives it."""
    y = x + math.pi
    return y - F.floor(y / (2 * math.pi)) * (2 * math.pi) - math.pi


def _about(axis: str, angle: Column) -> Column:
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return F.array(*{"x": (o, z, z, z, c, -s, z, s, c), "y": (c, z, s, z, o, z, -s, z, c), "z": (c, -s, z, s, c, z, z, z, o)}[axis])


@let
def euler_to_matrix(e: Column, order: str = "xyz") -> Column:
    """Intrinsic rotations about the axes of ``order`` (xyz or zyx)."""
    _known(order)
    first, second, third = (_about(a, _at(e, k)) for k, a in enumerate(order))
    return matmul(matmul(first, second), third)


@let
def extrinsic_to_matrix(e: Column, order: str = "xyz") -> Column:
    """Rotations about fixed axes, the first of ``order`` applied first."""
    first, second, third = (_about(a, _at(e, k)) for k, a in enumerate(order))
    return matmul(matmul(third, second), first)


def _known(order: str) -> None:
    if order not in ("xyz", "zyx"):
        raise ValueError("order must be xyz or zyx")


@let
def matrix_to_euler(m: Column, order: str = "xyz", eps: float = 1e-7, wrap: bool = True) -> Column:
    """Intrinsic angles; near the gimbal lock the third is 0."""
    _known(order)
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
    if order == "xyz":
        middle = F.asin(clip(_at(m, 2)))
        free = F.atan2(-_at(m, 5), _at(m, 8)), F.atan2(-_at(m, 1), _at(m, 0))
        locked = F.atan2(-_at(m, 3), _at(m, 4))
    else:
        middle = F.asin(clip(-_at(m, 6)))
        free = F.atan2(_at(m, 3), _at(m, 0)), F.atan2(_at(m, 7), _at(m, 8))
        locked = F.atan2(-_at(m, 1), _at(m, 4))
    lock = F.abs(F.cos(middle)) < eps
    out = F.array(F.when(lock, locked).otherwise(free[0]), middle, F.when(lock, 0.0).otherwise(free[1]))
    return F.transform(out, wrap_angle) if wrap else out


@let
def quat_to_matrix(q: Column, order: str = "wxyz", normalise: bool = True) -> Column:
    return _quat_matrix(unit(q) if normalise else q, order)


@let
def _quat_matrix(q: Column, order: str) -> Column:
    w, x, y, z = (_at(q, k) for k in ((0, 1, 2, 3) if order == "wxyz" else (3, 0, 1, 2)))
    return F.array(
        w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z,
    )


@let
def matrix_to_quat(m: Column, order: str = "wxyz") -> Column:
    """Unit quaternion with w >= 0, from whichever component is safely large."""
    d = [_at(m, 0), _at(m, 4), _at(m, 8)]
    trace = d[0] + d[1] + d[2]
    skew = [_at(m, 7) - _at(m, 5), _at(m, 2) - _at(m, 6), _at(m, 3) - _at(m, 1)]
    mixed = {(0, 1): _at(m, 1) + _at(m, 3), (0, 2): _at(m, 2) + _at(m, 6), (1, 2): _at(m, 5) + _at(m, 7)}

    def by_trace() -> Column:
        s = F.lit(0.5) / F.sqrt(trace + 1.0)
        return F.array(F.lit(0.25) / s, *(k * s for k in skew))

    def by_axis(i: int) -> Column:
        s = F.lit(0.5) / F.sqrt(F.greatest(2.0 * d[i] - trace + 1.0, F.lit(1e-12)))
        rest = [F.lit(0.25) / s if j == i else mixed[min(i, j), max(i, j)] * s for j in range(3)]
        return F.array(skew[i] * s, *rest)

    q = F.when(trace > 0, by_trace()).when((d[0] >= d[1]) & (d[0] >= d[2]), by_axis(0)).when(d[1] > d[2], by_axis(1)).otherwise(by_axis(2))
    return _canonical(unit(q), order)


@let
def _canonical(q: Column, order: str) -> Column:
    sign = F.when(_at(q, 0) < 0, -1.0).otherwise(1.0)
    return F.array(*(_at(q, k) * sign for k in ((0, 1, 2, 3) if order == "wxyz" else (1, 2, 3, 0))))


@let
def rot6d_to_matrix(r: Column) -> Column:
    """Two columns, made orthonormal, and their cross product."""
    return _second_column(unit(F.slice(r, 1, 3)), F.slice(r, 4, 3))


@let
def _second_column(a: Column, rest: Column) -> Column:
    along = F.aggregate(F.zip_with(a, rest, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return _columns(unit(F.zip_with(rest, a, lambda y, x: y.cast("double") - along * x)), a)


@let
def _columns(b: Column, a: Column) -> Column:
    (a0, a1, a2), (b0, b1, b2) = ([_at(v, k) for k in range(3)] for v in (a, b))
    return F.array(a0, b0, a1 * b2 - a2 * b1, a1, b1, a2 * b0 - a0 * b2, a2, b2, a0 * b1 - a1 * b0)


@let
def matrix_to_rot6d(m: Column) -> Column:
    return F.array(*(_at(m, k) for k in (0, 3, 6, 1, 4, 7)))


@let
def axis_angle_to_matrix(v: Column, eps: float = 1e-12) -> Column:
    """Rotation vector to matrix; a vanishing one is no rotation."""
    return _about_vector(norm(v), v, eps)


@let
def _about_vector(angle: Column, v: Column, eps: float) -> Column:
    return _rodrigues(F.array(*(F.when(angle > eps, _at(v, k) / angle).otherwise(F.lit(1.0 if k == 0 else 0.0)) for k in range(3))), angle)


@let
def _rodrigues(axis: Column, angle: Column) -> Column:
    x, y, z = (_at(axis, k) for k in range(3))
    c, s = F.cos(angle), F.sin(angle)
    t = 1.0 - c
    return F.array(t * x * x + c, t * x * y - s * z, t * x * z + s * y, t * x * y + s * z, t * y * y + c, t * y * z - s * x, t * x * z - s * y, t * y * z + s * x, t * z * z + c)


@let
def matrix_to_axis_angle(m: Column, eps: float = 1e-7) -> Column:
    """Matrix to rotation vector. Near pi the skew part vanishes and the axis falls back to x."""
    theta = F.acos(F.greatest(F.least((_at(m, 0) + _at(m, 4) + _at(m, 8) - 1.0) * 0.5, F.lit(1.0)), F.lit(-1.0)))
    return _turned(F.array(_at(m, 7) - _at(m, 5), _at(m, 2) - _at(m, 6), _at(m, 3) - _at(m, 1)), theta, eps)


@let
def _turned(w: Column, theta: Column, eps: float) -> Column:
    n = norm(w)
    return F.array(*(F.when(n > eps, _at(w, k) / n).otherwise(F.lit(1.0 if k == 0 else 0.0)) * theta for k in range(3)))


_TO = {"matrix": lambda x, e, q: x, "euler": lambda x, e, q: euler_to_matrix(x, e), "quat": lambda x, e, q: quat_to_matrix(x, q), "rot6d": lambda x, e, q: rot6d_to_matrix(x), "axisangle": lambda x, e, q: axis_angle_to_matrix(x)}
_FROM = {"matrix": lambda m, e, q: m, "euler": lambda m, e, q: matrix_to_euler(m, e), "quat": lambda m, e, q: matrix_to_quat(m, q), "rot6d": lambda m, e, q: matrix_to_rot6d(m), "axisangle": lambda m, e, q: matrix_to_axis_angle(m)}


def convert_rotation(x: Column, source: str, target: str, *, euler_order: str = "xyz", quat_order: str = "wxyz") -> Column:
    """Between matrix, euler, quat, rot6d and axisangle, through the matrix."""
    return _FROM[target](_TO[source](x, euler_order, quat_order), euler_order, quat_order)


@let
def quat_multiply(a: Column, b: Column) -> Column:
    """Product of quaternions in xyzw order."""
    return _hamilton(b, a)


@let
def _hamilton(b: Column, a: Column) -> Column:
    ax, ay, az, aw = (_at(a, k) for k in range(4))
    bx, by, bz, bw = (_at(b, k) for k in range(4))
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def about_z(angle: Column) -> Column:
    """The quaternion (xyzw) of a turn about z."""
    return F.array(F.lit(0.0), F.lit(0.0), F.sin(angle / 2), F.cos(angle / 2))


@let
def rotate_quat_about_z(q: Column, angle: Column) -> Column:
    return quat_multiply(about_z(angle), q)


@let
def rotate_delta_quat_about_z(q: Column, angle: Column) -> Column:
    """Conjugation, for a relative rotation seen from the turned frame."""
    return quat_multiply(quat_multiply(about_z(angle), q), about_z(-angle))


def euler_to_bins(e: Column, resolution: float) -> Column:
    """Angles in radians to bins: degrees from -180, rounded half to even, the top bin being bin 0."""
    bins = int(360 // resolution)
    return F.transform(e, lambda a: (lambda k: F.when(k == bins, 0).otherwise(k).cast("int"))(F.rint((F.degrees(a) + 180.0) / resolution)))


def bins_to_euler(b: Column, resolution: float) -> Column:
    return F.transform(b, lambda k: F.radians(k * resolution - 180.0))


@let
def reorder_action(a: Column) -> Column:
    """Twelve numbers (base 4, mode 1, hand xyz 3, axis-angle 3, gripper 1) to thirteen (xyz, quaternion xyzw, gripper, base, mode)."""
    quat = matrix_to_quat(axis_angle_to_matrix(F.slice(a, 9, 3)), "xyzw")
    return F.concat(F.slice(a, 6, 3), quat, F.slice(a, 12, 1), F.slice(a, 1, 4), F.slice(a, 5, 1)).cast("array<double>")


def sign_threshold(x: Column, at: float = 0.5) -> Column:
    return F.when(x < at, -1.0).otherwise(1.0)
