"""Queries over cameras, pixels and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from demolake.functions import geometry
from demolake.operators import anchors, episodes
from demolake.plans.catalog import query
from demolake.plans.fixtures import table

_K = ["episode_index", "frame_index"]
_SEEN = """seen AS (SELECT p.episode_index, p.frame_index, p.point_id, c.view_id, 64e0 * (p.x + c.tx) / (p.z + c.tz) + 32e0 AS u, 64e0 * (p.y + c.ty) / (p.z + c.tz) + 24e0 AS v, p.z + c.tz AS depth, p.x, p.y, p.z FROM points p, cams c)"""


def _seen(spark, sf_dir):
    return geometry.project_points(table(spark, sf_dir, "points"), table(spark, sf_dir, "cams"))


@query(f"WITH {_SEEN} SELECT view_id, episode_index, count(*) AS n, count(*) FILTER (u >= 0 AND u < 64 AND v >= 0 AND v < 48) AS n_visible, round(avg(u), 6) AS mean_u, round(max(depth), 9) AS max_depth FROM seen GROUP BY ALL")
def j11_projection(spark, sf_dir):
    """Every point in three cameras, and how many are visible."""
    rows = _seen(spark, sf_dir).withColumn("seen", geometry.visible(64, 48))
    return rows.groupBy("view_id", "episode_index").agg(F.count("*").alias("n"), F.count_if("seen").alias("n_visible"), F.round(F.avg("u"), 6).alias("mean_u"), F.round(F.max("depth"), 9).alias("max_depth"))


@query("""WITH g AS (SELECT episode_index, frame_index, ex, ey, ez, ((episode_index * 37 + frame_index * 101) % 64 + 1) / 16e0 AS t FROM grip),
c AS (SELECT p.episode_index, p.frame_index, cos(t) * x + sin(t) * y - (cos(t) * ex + sin(t) * ey) + 25e-2 AS a, -sin(t) * x + cos(t) * y + sin(t) * ex - cos(t) * ey AS b, z - ez + 5e-1 AS c FROM points p JOIN g USING (episode_index, frame_index)),
s AS (SELECT *, 64e0 * a / c + 32e0 AS u, 64e0 * b / c + 24e0 AS v FROM c)
SELECT episode_index, frame_index, count(*) AS n, count(*) FILTER (c > 1e-6) AS n_front, count(*) FILTER (c > 1e-6 AND u >= 0 AND u < 64 AND v >= 0 AND v < 48) AS n_visible, round(avg(CASE WHEN c > 25e-2 THEN u END), 6) AS mean_u FROM s GROUP BY ALL""")
def j11_wrist_projection(spark, sf_dir):
    """Every point in the wrist camera of its own frame, by a join on the frame."""
    t = (F.pmod(F.col("episode_index") * 37 + F.col("frame_index") * 101, F.lit(64)) + 1) / 16.0
    hands = table(spark, sf_dir, "grip").select(*_K, F.array("ex", "ey", "ez").alias("hand"), F.array(F.lit(0.0), F.lit(0.0), F.sin(t / 2), F.cos(t / 2)).alias("quat"))
    cams = episodes.wrist_camera(hands, xyz="hand", quat="quat", hand_to_camera=((1, 0, 0, 0, 1, 0, 0, 0, 1), (0.25, 0, 0.5)))
    cams = cams.select(*_K, "cam_rotation", "cam_shift", *(F.lit(v).alias(n) for n, v in (("fx", 64.0), ("fy", 64.0), ("cx", 32.0), ("cy", 24.0))))
    seen = geometry.project_posed(table(spark, sf_dir, "points"), cams, on=_K)
    mean = F.round(F.avg(F.when(F.col("depth") > 0.25, F.col("u"))), 6)
    return seen.groupBy(*_K).agg(F.count("*").alias("n"), F.count_if("in_front").alias("n_front"), F.count_if(geometry.visible(64, 48)).alias("n_visible"), mean.alias("mean_u"))


_DETS = "dets AS (SELECT episode_index, frame_index, view_id, 8e0 + (episode_index * 7 + frame_index * 13 + view_id * 5) % 48 AS u, 4e0 + (episode_index * 11 + frame_index * 3 + view_id) % 40 AS v FROM (SELECT DISTINCT episode_index, frame_index FROM points), (SELECT DISTINCT view_id FROM cams))"


def _dets(spark, sf_dir):
    k = table(spark, sf_dir, "points").select(*_K).distinct().crossJoin(F.broadcast(table(spark, sf_dir, "cams").select("view_id").distinct()))
    return k.select(*_K, "view_id", (8.0 + (F.col("episode_index") * 7 + F.col("frame_index") * 13 + F.col("view_id") * 5) % 48).alias("u"), (4.0 + (F.col("episode_index") * 11 + F.col("frame_index") * 3 + F.col("view_id")) % 40).alias("v"))


@query(f"""WITH {_SEEN}, {_DETS}
SELECT d.episode_index, d.frame_index, d.view_id, d.u, d.v, median(s.x) AS x, median(s.y) AS y, median(s.z) AS z, count(*) AS n_support
FROM dets d JOIN seen s ON s.episode_index = d.episode_index AND s.frame_index = d.frame_index AND s.view_id = d.view_id AND abs(s.u - d.u) <= 6 AND abs(s.v - d.v) <= 6 GROUP BY ALL HAVING count(*) >= 2""")
def a11_window_lift(spark, sf_dir):
    """The box test rides on an equi join by frame and view."""
    seen = _seen(spark, sf_dir).select(*_K, "view_id", F.col("u").alias("pu"), F.col("v").alias("pv"), "x", "y", "z")
    return anchors.lift_from_cloud(_dets(spark, sf_dir), seen, window=6, least=2)


@query("""WITH g AS (SELECT DISTINCT episode_index, frame_index, view_id, u AS pu, v AS pv, (u - 32) / 64e0 AS x, (v - 24) / 64e0 AS y, (r + 1) / 256e0 AS z FROM pixels),
d AS (SELECT DISTINCT episode_index, frame_index, view_id, 8e0 + (episode_index * 7 + frame_index * 13 + view_id * 5) % 48 AS u, 4e0 + (episode_index * 11 + frame_index * 3 + view_id) % 40 AS v FROM pixels)
SELECT d.*, median(x) AS x, median(y) AS y, median(z) AS z, count(*) AS n_support FROM d JOIN g ON g.episode_index = d.episode_index AND g.frame_index = d.frame_index AND g.view_id = d.view_id AND abs(pu - u) <= 4 AND abs(pv - v) <= 4 GROUP BY ALL""")
def a12_pixel_lift(spark, sf_dir):
    p = table(spark, sf_dir, "pixels")
    grid = p.select(*_K, "view_id", F.col("u").alias("pu"), F.col("v").alias("pv"), ((F.col("u") - 32) / 64.0).alias("x"), ((F.col("v") - 24) / 64.0).alias("y"), ((F.col("r") + 1) / 256.0).alias("z")).distinct()
    d = p.select(*_K, "view_id", (8.0 + (F.col("episode_index") * 7 + F.col("frame_index") * 13 + F.col("view_id") * 5) % 48).alias("u"), (4.0 + (F.col("episode_index") * 11 + F.col("frame_index") * 3 + F.col("view_id")) % 40).alias("v")).distinct()
    return anchors.lift_from_pixels(d, grid, window=4)


@query("""SELECT ok, ln, (65536e0 * r + 256e0 * g + b) / 256000e0 AS depth, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b, CAST(r + 256 * g + 65536 * b AS INT) AS instance FROM pixels""")
def s16_depth_codes(spark, sf_dir):
    """Decoded, encoded again, and the instance number."""
    d = geometry.depth_from_rgb(F.col("r"), F.col("g"), F.col("b"))
    rows = table(spark, sf_dir, "pixels").withColumn("depth", d).withColumn("c", geometry.depth_to_rgb(F.col("depth")))
    return rows.select("ok", "ln", "depth", "c.r", "c.g", "c.b", geometry.instance_id(F.col("r"), F.col("g"), F.col("b")).alias("instance"))


@query("SELECT ok, ln, (u - 32e0) * greatest(r / 256e0 * 2e0 + 5e-1, 0) / 64e0 AS x, (v - 24e0) * greatest(r / 256e0 * 2e0 + 5e-1, 0) / 64e0 AS y, greatest(r / 256e0 * 2e0 + 5e-1, 0) AS z FROM pixels")
def f14_unproject(spark, sf_dir):
    """F14, F15."""
    depth = geometry.metric_depth(F.col("r") / 256.0, F.lit(0.5), F.lit(2.5))
    f, cx, cy = F.lit(64.0), F.lit(32.0), F.lit(24.0)
    rows = table(spark, sf_dir, "pixels").withColumn("d", depth).withColumn("p", geometry.unproject(F.col("u"), F.col("v"), F.col("d"), f, f, cx, cy))
    return rows.select("ok", "ln", *(F.element_at("p", k + 1).alias(c) for k, c in enumerate("xyz")))


@query("""SELECT episode_index, frame_index, point_id, CASE WHEN z - 5e-1 <= 1e-8 THEN 0 ELSE CAST(round_even(64e0 * x / (z - 5e-1) + 32e0, 0) AS INT) END AS u,
  CASE WHEN z - 5e-1 <= 1e-8 THEN 0 ELSE CAST(round_even(64e0 * y / (z - 5e-1) + 24e0, 0) AS INT) END AS v FROM points""")
def f17_rounded_pixels(spark, sf_dir):
    p = geometry.project_rounded(F.array("x", "y", F.col("z") - 0.5), F.lit(64.0), F.lit(64.0), F.lit(32.0), F.lit(24.0))
    return table(spark, sf_dir, "points").select(*_K, "point_id", p.alias("p")).select(*_K, "point_id", "p.u", "p.v")


@query("""WITH b AS (SELECT DISTINCT episode_index, frame_index, (episode_index % 8) / 8e0 - 5e-1 AS cx FROM points WHERE frame_index % 2 = 0)
SELECT p.episode_index, p.frame_index, p.point_id FROM points p LEFT JOIN b USING (episode_index, frame_index)
WHERE NOT coalesce((abs(y) <= 25e-2 AND abs(x - cx) <= 125e-3 AND abs(z - 5e-1) <= 25e-2) OR (cx IS NOT NULL AND abs(x) <= 625e-4 AND abs(y) <= 625e-4 AND abs(z - 25e-2) <= 125e-3), FALSE)""")
def p15_remove_in_boxes(spark, sf_dir):
    """Two oriented boxes per even frame, the first turned by a quarter about z."""
    p = table(spark, sf_dir, "points")
    turned = F.array(*(F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)))
    plain = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    lit = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    first = geometry.box_from_bounds(lit(-0.25, -0.125, -0.25), lit(0.25, 0.125, 0.25), turned, F.array((F.col("episode_index") % 8) / 8.0 - 0.5, F.lit(0.0), F.lit(0.5)))
    second = geometry.box_from_vector(F.concat(lit(0, 0, 0.25), plain, lit(0.125, 0.125, 0.25)))
    frames = p.filter("frame_index % 2 = 0").select(*_K).distinct()
    boxes = frames.select(*_K, F.explode(F.array(first, second)).alias("box"))
    return geometry.remove_in_boxes(p, boxes, by=_K).select(*_K, "point_id")


@query("SELECT ok, ln, '#' || lower(lpad(to_hex(CAST(r AS INT)), 2, '0')) || lower(lpad(to_hex(CAST(g AS INT)), 2, '0')) || lower(lpad(to_hex(CAST(b AS INT)), 2, '0')) AS colour FROM pixels")
def f21_hex_colours(spark, sf_dir):
    return table(spark, sf_dir, "pixels").select("ok", "ln", geometry.hex_colour(*(F.col(c) / 255.0 for c in "rgb")).alias("colour"))
