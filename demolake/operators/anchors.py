"""From detections to anchors: lifting, fusing views, ground truth, scoring, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.operators.quantiles import exact_quantiles, with_quantiles

FRAME = ("episode_index", "frame_index")
XYZ = ("x", "y", "z")
VIEWS = ("left", "right", "wrist")


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def label_anchor(points: DataFrame, *, primary: Sequence[int] = (4,), fallback: Sequence[int] = (3,), by: Sequence[str] = FRAME) -> DataFrame:
    """Mean position of the primary labels; of the fallback labels where there are none; else null."""
    first, second = F.col("label").isin(list(primary)), F.col("label").isin(list(fallback))
    return points.groupBy(*by).agg(*(F.coalesce(F.avg(F.when(first, F.col(c))), F.avg(F.when(second, F.col(c)))).alias(c) for c in XYZ))


def first_detection(detections: DataFrame, order: str, *, keys: Sequence[str] = (*FRAME, "query_id", "view_id")) -> DataFrame:
    return detections.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")


def valid_detections(detections: DataFrame, n_views: int) -> DataFrame:
    return detections.filter((F.col("view_id") >= 0) & (F.col("view_id") < n_views))


def dropped_detections(detections: DataFrame, n_views: int) -> DataFrame:
    """How many detections name one of the views, and how many are dropped: n_kept, n_dropped."""
    fine = F.coalesce((F.col("view_id") >= 0) & (F.col("view_id") < n_views), F.lit(False))
    return detections.agg(F.count_if(fine).alias("n_kept"), F.count_if(~fine).alias("n_dropped"))


def finite(columns: Sequence[str] = XYZ) -> Column:
    """Whether all components are numbers, none null, NaN or infinite."""
    return reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False)) for c in columns])


def finite_anchors(anchors: DataFrame, queries: Sequence[int] | None = None) -> DataFrame:
    """Anchors whose position is finite, of the given queries only (all if None)."""
    rows = anchors.filter(finite())
    return rows if queries is None else rows.filter(F.col("query_id").isin(list(queries)))


def lift_from_cloud(detections: DataFrame, seen: DataFrame, *, window: float = 2, least: int = 1, keys: Sequence[str] = (*FRAME, "view_id")) -> DataFrame:
    """Per-axis median of the projected points within ``window`` pixels of a detection (u, v), and how many there are.

    seen: points with pixel columns pu, pv (see project_points). The box test rides on an equi join by frame and view.
    """
    both = detections.join(seen, list(keys)).filter((F.abs(F.col("pu") - F.col("u")) <= window) & (F.abs(F.col("pv") - F.col("v")) <= window))
    return both.groupBy(*detections.columns).agg(*(F.median(c).alias(c) for c in XYZ), F.count("*").alias("n_support")).filter(F.col("n_support") >= least)


def lift_from_pixels(detections: DataFrame, pixels: DataFrame, *, window: int = 1, nearest: float | None = None, keys: Sequence[str] = (*FRAME, "view_id")) -> DataFrame:
    """Median over the pixels around a detection, rounded half to even; void pixels are left out. ``nearest`` keeps those within so much of the closest range."""
    zero = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in XYZ])
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in XYZ]) & ~zero
    both = detections.join(pixels.filter(fine), list(keys)).filter((F.abs(F.col("pu") - F.rint("u")) <= window) & (F.abs(F.col("pv") - F.rint("v")) <= window))
    if nearest is not None:
        both = both.withColumn("_m", F.min("z").over(Window.partitionBy(*detections.columns))).filter(F.col("z") <= F.col("_m") + nearest)
    return both.groupBy(*detections.columns).agg(*(F.median(c).alias(c) for c in XYZ), F.count("*").alias("n_support"))


def by_view(lifts: DataFrame, *, keys: Sequence[str] = (*FRAME, "query_id")) -> DataFrame:
    """One row per query with a struct column (x, y, z, n) for each view, null where the view didn't lift."""
    one = lambda v: F.max(F.when(F.col("view_name") == v, F.struct(*XYZ, F.col("n_support").alias("n")))).alias(v)
    return lifts.groupBy(*keys).agg(*(one(v) for v in VIEWS))


def _xyz(s: Column) -> Column:
    return F.struct(*(s[c].alias(c) for c in XYZ))


def _gap(a: Column, b: Column) -> Column:
    return distance([a[c] for c in XYZ], [b[c] for c in XYZ])


def fuse_views(lifts: DataFrame, rule: str, *, agree: float = 0.10, accept: float = 0.15, require_static: bool = True, keys: Sequence[str] = (*FRAME, "query_id")) -> DataFrame:
    """One anchor per query from its views' lifts.

    mean: of all views. gated: static views within ``agree`` are averaged, else the
    better supported one counts (ties to the first); the wrist is adopted within
    ``accept`` of that. per_view: no fusion, a row per view.
    """
    if rule == "per_view":
        return lifts.select(*keys, "view_name", *XYZ)
    if rule == "mean":
        return lifts.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in XYZ), F.count("*").alias("n_views"))
    wide = by_view(lifts, keys=keys)
    left, right, wrist = (F.col(v) for v in VIEWS)
    agreed = F.coalesce(_gap(left, right) <= agree, F.lit(False))
    middle = F.struct(*(((left[c] + right[c]) / 2).alias(c) for c in XYZ))
    static = F.when(agreed, middle).when(left.isNotNull() & (right.isNull() | (left["n"] >= right["n"])), _xyz(left)).when(right.isNotNull(), _xyz(right))
    wide = wide.withColumns({"_s": static, "agree": agreed})
    close = F.coalesce(_gap(wrist, F.col("_s")) <= accept, F.lit(False))
    used = close if require_static else close | (F.col("_s").isNull() & wrist.isNotNull())
    return wide.withColumn("used_wrist", used).withColumn("_a", F.when(F.col("used_wrist"), _xyz(wrist)).otherwise(F.col("_s"))).filter("_a IS NOT NULL").select(*keys, *(F.col(f"_a.{c}").alias(c) for c in XYZ), "agree", "used_wrist")


def select_closest(lifts: DataFrame, truth: DataFrame, asked: DataFrame, *, keys: Sequence[str] = (*FRAME, "query_id")) -> DataFrame:
    """The view whose lift is nearest the truth, ties to the first view; asked queries without a lift or a truth keep a row of nulls.

    Also the number of lifts, and the error of their mean for comparison. truth: the keys and tx, ty, tz.
    """
    order = F.array_position(F.array(*(F.lit(v) for v in VIEWS)), F.col("view_name"))
    known = truth.filter("tx IS NOT NULL")
    err = distance([F.col(c) for c in XYZ], [F.col(f"t{c}") for c in XYZ])
    scored = lifts.join(known, list(keys)).withColumn("error", err).withColumn("_o", order)
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("view_name", *XYZ, "error"), F.struct("error", "_o")).alias("b"), F.count("*").alias("n_lifts"), *(F.avg(c).alias(f"_m{c}") for c in XYZ), *(F.first(f"t{c}").alias(f"_t{c}") for c in XYZ))
    mean_error = distance([F.col(f"_m{c}") for c in XYZ], [F.col(f"_t{c}") for c in XYZ])
    return asked.select(*keys).join(best.select(*keys, "b.*", "n_lifts", mean_error.alias("mean_error")), list(keys), "left").withColumn("n_lifts", F.coalesce("n_lifts", F.lit(0)))


def pointing_outcomes(asked: DataFrame, *, pointed: Column, lifted: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """Over asked key frames with a truth: anchored, pointed without a lift, pointed nowhere, and the rates; those without a truth are counted apart."""
    known = asked.withColumns({"_t": truth, "_l": lifted, "_p": pointed})
    out = known.groupBy(*by).agg(
        F.count_if("_t").alias("n_truth"),
        F.count_if(~F.col("_t")).alias("n_no_truth"),
        F.count_if(F.col("_t") & F.col("_l")).alias("n_anchored"),
        F.count_if(F.col("_t") & F.col("_p") & ~F.col("_l")).alias("n_no_lift"),
        F.count_if(F.col("_t") & ~F.col("_p") & ~F.col("_l")).alias("n_nowhere"),
    )
    return out.withColumns({f"rate_{k}": F.col(f"n_{k}") / F.greatest("n_truth", F.lit(1)) for k in ("anchored", "no_lift", "nowhere")})


def describe_errors(df: DataFrame, error: str, *, unit: str = "m", scale: float = 1.0, thresholds: Sequence[float] = (0.02, 0.04, 0.08, 0.16, 0.32), by: Sequence[str] = ()) -> DataFrame:
    """n, median, mean, p25, p75, p90 in a unit, and the share strictly within each threshold; without rows only n."""
    e = F.col(error) * scale
    rows = df.filter(F.col(error).isNotNull())
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias(f"mean_{unit}"), *(F.avg((e < t).cast("int")).alias(f"within_{t:g}".replace(".", "_")) for t in thresholds))
    return with_quantiles(out, rows, e, {f"median_{unit}": 0.5, **{f"p{p}_{unit}": p / 100 for p in (25, 75, 90)}}, by)


def errors_by_phase(df: DataFrame, error: str, phase: str = "phase", **options) -> DataFrame:
    """describe_errors by quarter of the episode; the very last frame (phase 1) belongs to none."""
    rows = df.withColumn("quarter", F.floor(F.col(phase) * 4).cast("int")).filter("quarter BETWEEN 0 AND 3")
    return describe_errors(rows, error, by=["quarter"], **options)


def errors_by_side(df: DataFrame, error: str, task: str = "task", **options) -> DataFrame:
    """describe_errors by the side that a task's text names, left before right; texts without a side are left out."""
    return describe_errors(df.withColumn("side", side_of(F.col(task))).filter("side IS NOT NULL"), error, by=["side"], **options)


def errors_by_agreement(df: DataFrame, error: str, agree: str = "agree", **options) -> DataFrame:
    """describe_errors of anchors on which the views agreed, and of the others."""
    return describe_errors(df, error, by=[agree], **options)


def side_of(task: Column) -> Column:
    return F.when(F.lower(task).contains("left"), "left").when(F.lower(task).contains("right"), "right")


def distractor_margin(rows: DataFrame, error: str, distractor: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of anchors nearer to the distractor than to the target, and the median distance to it."""
    both = rows.filter(F.col(error).isNotNull() & F.col(distractor).isNotNull())
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(distractor) < F.col(error)).cast("int")).alias("nearer_distractor"))
    return with_quantiles(out, both, distractor, {"median_distance": 0.5}, by)


def pixel_errors(detections: DataFrame, truth: DataFrame, *, keys: Sequence[str] = (*FRAME, "view_id"), thresholds: Sequence[float] = (4, 16), by: Sequence[str] = ("view_id",)) -> DataFrame:
    """How often the truth is visible, how often it was also pointed at, and the pixel error, per view or other groups. truth: keys, tu, tv, visible."""
    rows = truth.join(detections.select(*keys, "u", "v"), list(keys), "left")
    e = F.when(F.col("visible") & F.col("u").isNotNull(), F.sqrt((F.col("u") - F.col("tu")) * (F.col("u") - F.col("tu")) + (F.col("v") - F.col("tv")) * (F.col("v") - F.col("tv"))))
    rows = rows.withColumn("_e", e)
    out = rows.groupBy(*by).agg(F.count_if("visible").alias("n_visible"), F.count("_e").alias("n_pointed"), F.avg("_e").alias("mean_px"), *(F.avg((F.col("_e") < t).cast("int")).alias(f"within_{t}px") for t in thresholds))
    return with_quantiles(out, rows, "_e", {"median_px": 0.5}, by)


def lift_outcome(pointed: Column, lifted: Column) -> Column:
    """What became of a view's pointing: lifted to a position, pointed without a lift, or pointed nowhere."""
    return F.when(lifted, "lifted").when(pointed, "no_lift").otherwise("nowhere")


def anchor_coverage(frames: DataFrame, *, hit: Column, agree: Column, both: Column, wrist: Column, truth: Column) -> DataFrame:
    """Coverage counters of a build; denominators are at least 1, rates have four digits."""
    c = frames.agg(F.count("*").alias("n_frames"), F.count_if(hit).alias("n_hit"), F.count_if(both).alias("n_both"), F.count_if(agree).alias("n_agree"), F.count_if(wrist).alias("n_wrist"), F.count_if(~truth).alias("n_no_truth"))
    rate = lambda a, b: F.round(F.col(a) / F.greatest(b, F.lit(1)), 4)
    return c.withColumns({"hit_rate": rate("n_hit", "n_frames"), "agree_rate": rate("n_agree", "n_both"), "wrist_rate": rate("n_wrist", "n_hit")})


def target_motion(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distance between the sets target and distractor (median, min, max), and travel per set: each episode's largest displacement, then median and max."""
    from demolake.operators.episodes import displacement

    a = targets.filter("set_name = 'target'").drop("set_name")
    b = targets.filter("set_name = 'distractor'").select("source_episode", "frame_index", *(F.col(c).alias(f"_{c}") for c in XYZ))
    gap = a.join(b, ["source_episode", "frame_index"]).select(distance([F.col(c) for c in XYZ], [F.col(f"_{c}") for c in XYZ]).alias("d"))
    apart = with_quantiles(gap.agg(F.count("*").alias("n"), F.min("d").alias("min"), F.max("d").alias("max")), gap, "d", {"median": 0.5})
    most = displacement(targets, ["source_episode", "set_name"]).groupBy("set_name", "source_episode").agg(F.max("displacement").alias("m"))
    travel = most.groupBy("set_name").agg(F.count("*").alias("episodes"), F.max("m").alias("max_travel"))
    return apart, with_quantiles(travel, most, "m", {"median_travel": 0.5}, ["set_name"])


def calibration_report(calib: DataFrame, elements: Sequence[str], *, fine: float = 1e-3, poor: float = 1e-2) -> DataFrame:
    """Per view: the largest population std over a matrix's elements, a verdict, and the element-wise median."""
    out = calib.groupBy("view_name").agg(F.count("*").alias("n"), F.greatest(*(F.stddev_pop(c) for c in elements)).alias("max_std"))
    each = calib.select("view_name", F.explode(F.array(*(F.struct(F.lit(c).alias("element"), F.col(c).cast("double").alias("x")) for c in elements))).alias("e")).select("view_name", "e.*")
    median = exact_quantiles(each, "x", {"median": 0.5}, ["view_name", "element"]).groupBy("view_name").pivot("element", list(elements)).agg(F.max("median"))
    out = out.join(median, "view_name", "left")
    return out.withColumn("verdict", F.when(F.col("max_std") < fine, "constant").when(F.col("max_std") < poor, "nearly constant").otherwise("varies"))


def bbox(points: DataFrame, by: Sequence[str], *, columns: Sequence[str] = XYZ) -> DataFrame:
    """Extent and mean of a cloud (or of a mask's rows and columns); no row for an empty one."""
    return points.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def nearest_point(points: DataFrame, queries: DataFrame, *, by: Sequence[str] = FRAME, point: str = "point_id") -> DataFrame:
    """The point of each frame nearest to the frame's query (qx, qy, qz), ties to the smaller id: one aggregate, nothing is multiplied."""
    d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in XYZ])
    both = points.join(queries, list(by)).withColumn("d2", d2)
    return both.groupBy(*by).agg(F.min_by(point, F.struct("d2", point)).alias(point), F.sqrt(F.min("d2")).alias("distance"))


def nearest_within(points: DataFrame, cloud: DataFrame, tolerance: float, *, by: Sequence[str] = FRAME, point: str = "point_id", found: str = "neighbour", missing: str = "null") -> DataFrame:
    """Each point's nearest neighbour in another cloud of its frame, within a tolerance; no neighbour: null, or with ``missing="error"`` a failure.

    Cells are twice the tolerance wide: a point's neighbours lie in its own cell or in the nearer
    one along each axis, so that 8 probes and an equi join find them.
    """
    if missing not in ("null", "error"):
        raise ValueError(f"missing is null or error, not {missing}")
    width = 2 * tolerance
    asked = points.select(*by, point, *XYZ)
    probes = asked
    for c in XYZ:
        at = F.col(c) / width
        nearer = F.floor(at) + F.when(at - F.floor(at) < 0.5, -1).otherwise(1)
        probes = probes.withColumn(f"_c{c}", F.explode(F.array(F.floor(at), nearer)))
    grid = cloud.select(*by, F.col(point).alias(found), *(F.col(c).alias(f"_{c}") for c in XYZ)).withColumns({f"_c{c}": F.floor(F.col(f"_{c}") / width) for c in XYZ})
    d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in XYZ])
    hits = probes.join(grid, [*by, *(f"_c{c}" for c in XYZ)]).withColumn("d2", d2).filter(F.col("d2") <= tolerance * tolerance)
    best = hits.groupBy(*by, point).agg(F.min_by(found, F.struct("d2", found)).alias(found), F.sqrt(F.min("d2")).alias("distance"))
    out = asked.select(*by, point).join(best, [*by, point], "left")
    if missing == "null":
        return out
    lost = F.raise_error(F.concat(F.lit(f"no neighbour within {tolerance} of point "), F.col(point).cast("string"))).cast(out.schema[found].dataType)
    return out.withColumn(found, F.when(F.col("distance").isNull(), lost).otherwise(F.col(found)))


def encode_record(anchors: Column, slots: int) -> Column:
    """A flat array: the number of anchors, then x, y, z, query, support for each, at most ``slots``."""
    kept = F.slice(anchors, 1, slots)
    flat = F.flatten(F.transform(kept, lambda a: F.array(a["x"], a["y"], a["z"], a["query_id"].cast("double"), a["n_support"].cast("double"))))
    return F.concat(F.array(F.size(kept).cast("double")), flat)


def decode_record(flat: Column) -> Column:
    at = lambda i, k: F.element_at(flat, (i * 5 + 2 + k).cast("int"))
    n = F.element_at(flat, 1).cast("int")
    empty = F.array().cast("array<struct<x:double,y:double,z:double,query_id:int,n_support:int>>")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z"), at(i, 3).cast("int").alias("query_id"), at(i, 4).cast("int").alias("n_support")))
    return F.when(n > 0, rows).otherwise(empty)
