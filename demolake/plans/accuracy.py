"""Queries over lifts, anchors and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from demolake.operators import anchors, episodes, records
from demolake.plans.catalog import query
from demolake.plans.fixtures import table

_K = ["episode_index", "frame_index"]
_Q = [*_K, "query_id"]
_GAP = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


@query("SELECT episode_index, frame_index, query_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_views FROM lifts GROUP BY ALL")
def a13_fuse_mean(spark, sf_dir):
    return anchors.fuse_views(table(spark, sf_dir, "lifts"), "mean")


@query(f"""WITH k AS (SELECT DISTINCT episode_index, frame_index, query_id FROM lifts),
j AS (SELECT k.*, l.x AS lx, l.y AS ly, l.z AS lz, l.n_support AS ln, r.x AS rx, r.y AS ry, r.z AS rz, r.n_support AS rn, w.x AS wx, w.y AS wy, w.z AS wz,
  coalesce({_GAP.format(a="l", b="r")} <= 10e-2, FALSE) AS agree FROM k
  LEFT JOIN lifts l ON l.episode_index = k.episode_index AND l.frame_index = k.frame_index AND l.query_id = k.query_id AND l.view_name = 'left'
  LEFT JOIN lifts r ON r.episode_index = k.episode_index AND r.frame_index = k.frame_index AND r.query_id = k.query_id AND r.view_name = 'right'
  LEFT JOIN lifts w ON w.episode_index = k.episode_index AND w.frame_index = k.frame_index AND w.query_id = k.query_id AND w.view_name = 'wrist'),
s AS (SELECT *, CASE WHEN agree THEN (lx + rx) / 2 WHEN lx IS NOT NULL AND (rx IS NULL OR ln >= rn) THEN lx ELSE rx END AS sx,
  CASE WHEN agree THEN (ly + ry) / 2 WHEN lx IS NOT NULL AND (rx IS NULL OR ln >= rn) THEN ly ELSE ry END AS sy,
  CASE WHEN agree THEN (lz + rz) / 2 WHEN lx IS NOT NULL AND (rx IS NULL OR ln >= rn) THEN lz ELSE rz END AS sz FROM j),
u AS (SELECT *, coalesce(sqrt((wx - sx) * (wx - sx) + (wy - sy) * (wy - sy) + (wz - sz) * (wz - sz)) <= 15e-2, FALSE) AS used_wrist FROM s WHERE sx IS NOT NULL)
SELECT episode_index, frame_index, query_id, CASE WHEN used_wrist THEN wx ELSE sx END AS x, CASE WHEN used_wrist THEN wy ELSE sy END AS y, CASE WHEN used_wrist THEN wz ELSE sz END AS z, agree, used_wrist FROM u""")
def a13_fuse_gated(spark, sf_dir):
    return anchors.fuse_views(table(spark, sf_dir, "lifts"), "gated")


_TRUTH = """truth AS (SELECT k.episode_index, k.frame_index, q.query_id, CASE WHEN k.episode_index % 5 = 0 THEN NULL ELSE ((k.episode_index * 37 + k.frame_index * 101) % 128) / 1024e0 END AS tx,
  ((k.episode_index * 53 + k.frame_index * 211) % 128) / 1024e0 AS ty, ((k.episode_index * 71 + k.frame_index * 307) % 128) / 1024e0 AS tz
  FROM (SELECT episode_index, frame_index FROM frames WHERE frame_index % 8 = 0) k CROSS JOIN (SELECT 0 AS query_id UNION ALL SELECT 1) q)"""


def _truth(spark, sf_dir):
    k = table(spark, sf_dir, "frames").filter("frame_index % 8 = 0").select(*_K, F.explode(F.array(F.lit(0), F.lit(1))).alias("query_id"))
    at = lambda a, b: ((F.col("episode_index") * a + F.col("frame_index") * b) % 128) / 1024.0
    return k.select(*_Q, F.when(F.col("episode_index") % 5 != 0, at(37, 101)).alias("tx"), at(53, 211).alias("ty"), at(71, 307).alias("tz"))


_SCORED = f"""{_TRUTH}, e AS (SELECT l.*, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz)) AS error, tx, ty, tz, list_position(['left', 'right', 'wrist'], view_name) AS o FROM lifts l JOIN truth USING (episode_index, frame_index, query_id) WHERE tx IS NOT NULL)"""


@query(f"""WITH {_SCORED}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index, query_id ORDER BY error, o) AS k FROM e) WHERE k = 1),
m AS (SELECT episode_index, frame_index, query_id, count(*) AS n_lifts, sqrt((avg(x) - any_value(tx)) ** 2 + (avg(y) - any_value(ty)) ** 2 + (avg(z) - any_value(tz)) ** 2) AS mean_error FROM e GROUP BY ALL)
SELECT t.episode_index, t.frame_index, t.query_id, b.view_name, b.x, b.y, b.z, round(b.error, 9) AS error, coalesce(m.n_lifts, 0) AS n_lifts, round(m.mean_error, 9) AS mean_error
FROM truth t LEFT JOIN b USING (episode_index, frame_index, query_id) LEFT JOIN m USING (episode_index, frame_index, query_id)""")
def a14_select_closest(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    out = anchors.select_closest(table(spark, sf_dir, "lifts"), truth, truth)
    return out.withColumns({"error": F.round("error", 9), "mean_error": F.round("mean_error", 9)})


@query("""WITH d AS (SELECT d.episode_index, d.frame_index, d.x, d.x IS NOT NULL AS lifted, d.view_id < 2 AS pointed, m.source_episode IS NOT NULL AS known FROM detections d LEFT JOIN epmap m USING (episode_index))
SELECT count(*) FILTER (known) AS n_truth, count(*) FILTER (NOT known) AS n_no_truth, count(*) FILTER (known AND lifted) AS n_anchored, count(*) FILTER (known AND pointed AND NOT lifted) AS n_no_lift,
  count(*) FILTER (known AND NOT pointed AND NOT lifted) AS n_nowhere, count(*) FILTER (known AND lifted) / CAST(greatest(count(*) FILTER (known), 1) AS DOUBLE) AS rate_anchored,
  count(*) FILTER (known AND pointed AND NOT lifted) / CAST(greatest(count(*) FILTER (known), 1) AS DOUBLE) AS rate_no_lift,
  count(*) FILTER (known AND NOT pointed AND NOT lifted) / CAST(greatest(count(*) FILTER (known), 1) AS DOUBLE) AS rate_nowhere FROM d""")
def a15_outcomes(spark, sf_dir):
    d = table(spark, sf_dir, "detections").join(table(spark, sf_dir, "epmap"), "episode_index", "left")
    return anchors.pointing_outcomes(d, pointed=F.col("view_id") < 2, lifted=F.col("x").isNotNull(), truth=F.col("source_episode").isNotNull())


def _errors(spark, sf_dir):
    frames = episodes.with_bounds(table(spark, sf_dir, "frames").select(*_K)).select(*_K, "phase")
    t = episodes.join_targets(frames, table(spark, sf_dir, "epmap"), table(spark, sf_dir, "targets")).select(*_K, "phase", "set_name", *(F.col(c).alias(f"t{c}") for c in "xyz"))
    d = table(spark, sf_dir, "detections").join(t, _K)
    return d.withColumn("error", anchors.distance([F.col(c) for c in "xyz"], [F.col(f"t{c}") for c in "xyz"]))


_ERRORS = """n AS (SELECT source_episode, set_name, count(*) AS n FROM targets GROUP BY ALL), p AS (SELECT episode_index, frame_index, frame_index / CAST(greatest(max(frame_index) OVER (PARTITION BY episode_index), 1) AS DOUBLE) AS phase FROM frames),
e AS (SELECT d.episode_index, d.frame_index, d.view_id, p.phase, n.set_name, sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y) + (d.z - t.z) * (d.z - t.z)) AS error
  FROM detections d JOIN p USING (episode_index, frame_index) LEFT JOIN epmap m USING (episode_index) LEFT JOIN n USING (source_episode)
  LEFT JOIN targets t ON t.source_episode = m.source_episode AND t.set_name = n.set_name AND t.frame_index = CASE WHEN n.n = 1 THEN 0 ELSE d.frame_index END)"""
_STATS = "count(*) AS n, round(quantile_cont(error * 1e2, 5e-1), 6) AS median_cm, round(avg(error * 1e2), 6) AS mean_cm, round(quantile_cont(error * 1e2, 25e-2), 6) AS p25_cm, round(quantile_cont(error * 1e2, 75e-2), 6) AS p75_cm, round(quantile_cont(error * 1e2, 9e-1), 6) AS p90_cm, avg(CAST(error * 1e2 < 32 AS INT)) AS within_32, avg(CAST(error * 1e2 < 64 AS INT)) AS within_64"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_cm")})


@query(f"WITH {_ERRORS} SELECT view_id, {_STATS} FROM e WHERE set_name = 'target' AND error IS NOT NULL GROUP BY view_id")
def a16_describe_errors(spark, sf_dir):
    e = _errors(spark, sf_dir).filter("set_name = 'target'")
    return _rounded(anchors.describe_errors(e, "error", unit="cm", scale=100.0, thresholds=(32, 64), by=["view_id"]))


@query(f"WITH {_ERRORS} SELECT CAST(floor(phase * 4) AS INT) AS quarter, {_STATS} FROM e WHERE set_name = 'target' AND error IS NOT NULL AND phase < 1 GROUP BY 1")
def a17_errors_by_phase(spark, sf_dir):
    e = _errors(spark, sf_dir).filter("set_name = 'target'")
    return _rounded(anchors.errors_by_phase(e, "error", unit="cm", scale=100.0, thresholds=(32, 64)))


@query(f"""WITH {_ERRORS} SELECT count(*) AS n, avg(CAST(b.error < a.error AS INT)) AS nearer_distractor, round(median(b.error), 9) AS median_distance
FROM e a JOIN e b USING (episode_index, frame_index) WHERE a.set_name = 'target' AND b.set_name = 'distractor' AND a.error IS NOT NULL AND b.error IS NOT NULL""")
def a18_distractor_margin(spark, sf_dir):
    e = _errors(spark, sf_dir)
    a = e.filter("set_name = 'target'").select(*_K, "error")
    b = e.filter("set_name = 'distractor'").select(*_K, F.col("error").alias("distractor"))
    return anchors.distractor_margin(a.join(b, _K), "error", "distractor").withColumn("median_distance", F.round("median_distance", 9))


@query("""WITH t AS (SELECT episode_index, frame_index, view_id, (frame_index * 3 + episode_index) % 64 AS tu, (frame_index * 5 + episode_index) % 48 AS tv, episode_index % 4 <> 0 AS visible FROM detections),
d AS (SELECT episode_index, frame_index, view_id, (frame_index * 7 + episode_index) % 64 AS u, (frame_index * 2 + episode_index) % 48 AS v FROM detections WHERE x IS NOT NULL),
j AS (SELECT t.*, CASE WHEN visible AND u IS NOT NULL THEN sqrt((u - tu) * (u - tu) + (v - tv) * (v - tv)) END AS e FROM t LEFT JOIN d USING (episode_index, frame_index, view_id))
SELECT view_id, count(*) FILTER (visible) AS n_visible, count(e) AS n_pointed, round(median(e), 9) AS median_px, round(avg(e), 9) AS mean_px, avg(CAST(e < 4 AS INT)) AS within_4px, avg(CAST(e < 16 AS INT)) AS within_16px FROM j GROUP BY view_id""")
def a19_pixel_errors(spark, sf_dir):
    d = table(spark, sf_dir, "detections")
    e, f = F.col("episode_index"), F.col("frame_index")
    truth = d.select(*_K, "view_id", ((f * 3 + e) % 64).alias("tu"), ((f * 5 + e) % 48).alias("tv"), (e % 4 != 0).alias("visible"))
    found = d.filter("x IS NOT NULL").select(*_K, "view_id", ((f * 7 + e) % 64).alias("u"), ((f * 2 + e) % 48).alias("v"))
    out = anchors.pixel_errors(found, truth)
    return out.withColumns({"median_px": F.round("median_px", 9), "mean_px": F.round("mean_px", 9)})


@query("""WITH t AS (SELECT episode_index, frame_index, view_id, (frame_index * 3 + episode_index) % 64 AS tu, (frame_index * 5 + episode_index) % 48 AS tv, episode_index % 4 <> 0 AS visible FROM detections),
d AS (SELECT episode_index, frame_index, view_id, (frame_index * 7 + episode_index) % 64 AS u, (frame_index * 2 + episode_index) % 48 AS v, x IS NOT NULL AS lifted FROM detections WHERE (episode_index + frame_index) % 5 <> 0),
j AS (SELECT t.*, CASE WHEN visible AND u IS NOT NULL THEN sqrt((u - tu) * (u - tu) + (v - tv) * (v - tv)) END AS e, CASE WHEN lifted THEN 'lifted' WHEN u IS NOT NULL THEN 'no_lift' ELSE 'nowhere' END AS outcome FROM t LEFT JOIN d USING (episode_index, frame_index, view_id))
SELECT view_id, outcome, count(*) FILTER (visible) AS n_visible, count(e) AS n_pointed, round(median(e), 9) AS median_px, round(avg(e), 9) AS mean_px, avg(CAST(e < 4 AS INT)) AS within_4px, avg(CAST(e < 16 AS INT)) AS within_16px FROM j GROUP BY view_id, outcome""")
def a19_pixel_errors_by_outcome(spark, sf_dir):
    """Pixel errors of pointings that were lifted, of those that weren't, and what was visible without one."""
    d = table(spark, sf_dir, "detections")
    e, f = F.col("episode_index"), F.col("frame_index")
    found = d.filter((e + f) % 5 != 0).select(*_K, "view_id", ((f * 7 + e) % 64).alias("u"), ((f * 2 + e) % 48).alias("v"), F.col("x").isNotNull().alias("lifted"))
    truth = d.select(*_K, "view_id", ((f * 3 + e) % 64).alias("tu"), ((f * 5 + e) % 48).alias("tv"), (e % 4 != 0).alias("visible"))
    of = found.select(*_K, "view_id", "lifted")
    truth = truth.join(of, [*_K, "view_id"], "left").withColumn("outcome", anchors.lift_outcome(F.col("lifted").isNotNull(), F.coalesce("lifted", F.lit(False)))).drop("lifted")
    out = anchors.pixel_errors(found, truth, by=["view_id", "outcome"])
    return out.withColumns({"median_px": F.round("median_px", 9), "mean_px": F.round("mean_px", 9)})


@query("""WITH w AS (SELECT episode_index, frame_index, query_id, max(CASE view_name WHEN 'left' THEN 1 ELSE 0 END) AS l, max(CASE view_name WHEN 'right' THEN 1 ELSE 0 END) AS r, max(CASE view_name WHEN 'wrist' THEN 1 ELSE 0 END) AS k FROM lifts GROUP BY ALL),
c AS (SELECT count(*) AS n_frames, count(*) FILTER (l + r > 0) AS n_hit, count(*) FILTER (l + r = 2) AS n_both, count(*) FILTER (l + r = 2 AND (episode_index + frame_index) % 2 = 0) AS n_agree, count(*) FILTER (k = 1) AS n_wrist, count(*) FILTER (episode_index % 5 = 0) AS n_no_truth FROM w)
SELECT *, round(n_hit / CAST(greatest(n_frames, 1) AS DOUBLE), 4) AS hit_rate, round(n_agree / CAST(greatest(n_both, 1) AS DOUBLE), 4) AS agree_rate, round(n_wrist / CAST(greatest(n_hit, 1) AS DOUBLE), 4) AS wrist_rate FROM c""")
def a29_coverage(spark, sf_dir):
    w = anchors.by_view(table(spark, sf_dir, "lifts"))
    left, right = F.col("left").isNotNull(), F.col("right").isNotNull()
    agree = left & right & ((F.col("episode_index") + F.col("frame_index")) % 2 == 0)
    return anchors.anchor_coverage(w, hit=left | right, agree=agree, both=left & right, wrist=F.col("wrist").isNotNull(), truth=F.col("episode_index") % 5 != 0)


@query("""SELECT view_name, count(*) AS n, round(greatest(stddev_pop(m1), stddev_pop(m2), stddev_pop(m3)), 12) AS max_std, median(m1) AS m1, median(m2) AS m2, median(m3) AS m3,
  CASE WHEN greatest(stddev_pop(m1), stddev_pop(m2), stddev_pop(m3)) < 1e-3 THEN 'constant' WHEN greatest(stddev_pop(m1), stddev_pop(m2), stddev_pop(m3)) < 1e-2 THEN 'nearly constant' ELSE 'varies' END AS verdict FROM calib GROUP BY view_name""")
def a26_calibration(spark, sf_dir):
    return anchors.calibration_report(table(spark, sf_dir, "calib"), ["m1", "m2", "m3"]).withColumn("max_std", F.round("max_std", 12))


@query("""SELECT episode_index, frame_index, query_id, view_name, x, y, z, n_support FROM lifts WHERE n_support > 0""")
def f27_record_round_trip(spark, sf_dir):
    """anchors packed as flat arrays and unpacked again."""
    rows = table(spark, sf_dir, "lifts").filter("n_support > 0")
    packed = rows.groupBy(*_K, "view_name").agg(F.array_sort(F.collect_list(F.struct("x", "y", "z", "query_id", "n_support"))).alias("a"))
    flat = packed.select(*_K, "view_name", anchors.encode_record(F.col("a"), 6).alias("f"))
    return flat.select(*_K, "view_name", F.inline(anchors.decode_record(F.col("f")))).withColumn("n_support", F.col("n_support").cast("long"))


_LAYOUT = "CAST((episode_index + frame_index) % 3 + 1 AS INT) AS views, CASE WHEN (episode_index + frame_index) % 2 = 0 THEN 6 ELSE 2 END AS slots"
_PIXEL = "CASE WHEN (frame_index + query_id) % 4 <> {k} AND views > {k} THEN (query_id * 8 + frame_index % 16) / 2e0 + {k} END"


@query(f"""WITH l AS (SELECT episode_index, frame_index, query_id, view_name, x, y, z, CAST(n_support AS INT) AS n_support, {_LAYOUT} FROM lifts),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY query_id, view_name) - 1 AS INT) AS slot FROM l)
SELECT episode_index, frame_index, slot, query_id, n_support, n_support > 2 AS agree, x, y, z, {", ".join(f"{_PIXEL.format(k=k)} AS {v}_u, {_PIXEL.format(k=k)} + 1 AS {v}_v" for k, v in enumerate(("left", "right", "wrist")))}
FROM r WHERE slot < slots""")
def f27_records_by_layout(spark, sf_dir):
    """Anchors and pixels in records of six layouts, decoded by their length."""
    rows = table(spark, sf_dir, "lifts").selectExpr("*", *(e.strip() for e in (_LAYOUT.split(" AS views, ")[0] + " AS views", _LAYOUT.split(" AS views, ")[1])))
    pixels = [F.expr(f"{_PIXEL.format(k=k)} + {j}").alias(f"{v}_{c}") for k, v in enumerate(records.VIEWS) for j, c in enumerate("uv")]
    anchor = F.struct("query_id", "view_name", "x", "y", "z", "n_support", (F.col("n_support") > 2).alias("agree"), *pixels)
    packed = rows.groupBy(*_K, "views", "slots").agg(F.array_sort(F.collect_list(anchor)).alias("a"))
    each = [F.when((F.col("views") == v) & (F.col("slots") == s), records.encode_anchors(F.col("a"), slots=s, views=v)) for s, v in records.LAYOUTS.values()]
    back = records.usable_anchors(records.read_records(packed.select(*_K, F.coalesce(*each).alias("record")), "record", _K))
    return back.select(*_K, "slot", "query_id", "n_support", "agree", "x", "y", "z", *(f"{v}_{c}" for v in records.VIEWS for c in "uv"))
