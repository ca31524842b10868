"""Queries over point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.functions.colour import jitter_colours
from demolake.functions.geometry import density_weight, in_workspace, squared_distance
from demolake.operators import anchors, curves, pooling, sampling, voxel
from demolake.plans.catalog import query
from demolake.plans.fixtures import table
from demolake.sources.shared import materialize

#: The workspace in metres.
BOX = ((-0.75, 0.75), (-0.75, 0.75), (0.0, 0.9375))
_INSIDE = "x > -0.75 AND x < 0.75 AND y > -0.75 AND y < 0.75 AND z > 0.0 AND z < 0.9375"
_CELLS = "CAST(floor(x / 125e-3) AS BIGINT) AS ix, CAST(floor(y / 125e-3) AS BIGINT) AS iy, CAST(floor(z / 125e-3) AS BIGINT) AS iz"
_K = "episode_index, frame_index"


@query(f"SELECT {_K}, point_id, x, y, z, label FROM points WHERE {_INSIDE}")
def p06_crop_workspace(spark, sf_dir):
    return table(spark, sf_dir, "points").filter(in_workspace(BOX)).select("episode_index", "frame_index", "point_id", "x", "y", "z", "label")


@query(f"""WITH c AS (SELECT *, {_CELLS} FROM points WHERE {_INSIDE}),
n AS (SELECT {_K}, ix, iy, iz, label, count(*) AS n FROM c GROUP BY ALL),
l AS (SELECT {_K}, ix, iy, iz, label FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, ix, iy, iz ORDER BY n DESC, label DESC) AS k FROM n) WHERE k = 1)
SELECT {_K}, ix, iy, iz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_points, any_value(l.label) AS label
FROM c JOIN l USING ({_K}, ix, iy, iz) GROUP BY {_K}, ix, iy, iz""")
def a06_voxel_downsample(spark, sf_dir):
    """Cropped clouds merged by voxel, with majority labels."""
    points = table(spark, sf_dir, "points").filter(in_workspace(BOX))
    return voxel.merge_with_labels(points, 0.125).select("episode_index", "frame_index", "ix", "iy", "iz", "x", "y", "z", "n_points", "label")


@query(f"""WITH c AS (SELECT *, min(x) OVER w - 625e-4 AS ox, min(y) OVER w - 625e-4 AS oy, min(z) OVER w - 625e-4 AS oz FROM points WINDOW w AS (PARTITION BY {_K}))
SELECT {_K}, CAST(floor((x - ox) / 125e-3) AS BIGINT) AS ix, CAST(floor((y - oy) / 125e-3) AS BIGINT) AS iy, CAST(floor((z - oz) / 125e-3) AS BIGINT) AS iz,
  avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_points FROM c GROUP BY ALL""")
def a07_voxel_relative(spark, sf_dir):
    return voxel.voxel_downsample(table(spark, sf_dir, "points"), 0.125, origin="min")


@query(f"""WITH p AS (SELECT *, {_CELLS} FROM points), s AS (SELECT * FROM p WHERE pk % 4 <> 0),
n AS (SELECT {_K}, ix, iy, iz, label, count(*) AS n FROM s GROUP BY ALL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, ix, iy, iz ORDER BY n DESC, label DESC) AS k FROM n) WHERE k = 1)
SELECT {_K}, point_id, CAST(((ix + 16) * 32 + iy + 16) * 32 + iz + 16 AS BIGINT) AS vkey, coalesce(l.label, 0) AS label, l.label IS NOT NULL AS matched
FROM p LEFT JOIN l USING ({_K}, ix, iy, iz)""")
def j02_transfer_labels(spark, sf_dir):
    points = table(spark, sf_dir, "points")
    known = voxel.voxel_labels(points.filter("pk % 4 <> 0"), 0.125)
    return voxel.transfer_labels(points.drop("label"), known, 0.125).select("episode_index", "frame_index", "point_id", "vkey", "label", "matched")


@query("""WITH t AS (SELECT count(*) AS total, count(*) FILTER (label IN (3, 4)) AS hits FROM points)
SELECT CAST(k AS INT) AS label, (SELECT count(*) FROM points WHERE label = k) AS n, (SELECT count(*) FROM points WHERE label = k) / CAST(total AS DOUBLE) AS share,
  hits / CAST(total AS DOUBLE) AS target_share, 4096 * (hits / CAST(total AS DOUBLE)) AS target_points FROM t, range(5) r(k)""")
def a09_label_histogram(spark, sf_dir):
    return voxel.label_histogram(table(spark, sf_dir, "points"), budget=4096)


@query(f"""SELECT {_K}, coalesce(avg(x) FILTER (label = 4), avg(x) FILTER (label = 3)) AS x, coalesce(avg(y) FILTER (label = 4), avg(y) FILTER (label = 3)) AS y,
  coalesce(avg(z) FILTER (label = 4), avg(z) FILTER (label = 3)) AS z FROM points GROUP BY ALL""")
def a10_label_anchor(spark, sf_dir):
    return anchors.label_anchor(table(spark, sf_dir, "points"))


@query(f"""SELECT {_K}, point_id, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM points WINDOW w AS (PARTITION BY {_K})""")
def a05_centre_cloud(spark, sf_dir):
    points = table(spark, sf_dir, "points")
    centres = points.groupBy("episode_index", "frame_index").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return points.join(centres, ["episode_index", "frame_index"]).select("episode_index", "frame_index", "point_id", *((F.col(c) - F.col(f"m{c}")).alias(f"c{c}") for c in "xyz"))


@query("""WITH n AS (SELECT episode_index, frame_index, count(*) AS n FROM points GROUP BY ALL)
SELECT count(*) AS n_frames, min(n) AS min_points, max(n) AS max_points, avg(n) AS mean_points FROM n""")
def a24_cloud_sizes(spark, sf_dir):
    from demolake.operators.evaluation import cloud_size_stats

    return cloud_size_stats(table(spark, sf_dir, "points"), ["episode_index", "frame_index"])


@query("""SELECT episode_index, label, min(x) AS min_x, max(x) AS max_x, avg(x) AS mean_x, min(y) AS min_y, max(y) AS max_y, avg(y) AS mean_y,
  min(z) AS min_z, max(z) AS max_z, avg(z) AS mean_z FROM points GROUP BY ALL""")
def a27_bounding_boxes(spark, sf_dir):
    return anchors.bbox(table(spark, sf_dir, "points"), ["episode_index", "label"])


@query("""WITH f AS (SELECT *, CAST(floor(x / 625e-4) AS BIGINT) AS fx, CAST(floor(y / 625e-4) AS BIGINT) AS fy, CAST(floor(z / 625e-4) AS BIGINT) AS fz FROM points)
SELECT episode_index, frame_index, CAST(trunc(fx / 2e0) AS BIGINT) AS ix, CAST(trunc(fy / 2e0) AS BIGINT) AS iy, CAST(trunc(fz / 2e0) AS BIGINT) AS iz,
  avg(x) AS x, avg(y) AS y, avg(z) AS z, max(r) AS r, count(*) AS n_children FROM f GROUP BY ALL""")
def a30_grid_pool(spark, sf_dir):
    return voxel.grid_pool(table(spark, sf_dir, "points"), 0.0625, 2, features=["r"])[0]


@query("""WITH f AS (SELECT *, CAST(trunc(trunc(floor(x / 625e-4) / 2e0) / 2e0) AS BIGINT) AS ix, CAST(trunc(trunc(floor(y / 625e-4) / 2e0) / 2e0) AS BIGINT) AS iy,
  CAST(trunc(trunc(floor(z / 625e-4) / 2e0) / 2e0) AS BIGINT) AS iz FROM points),
c AS (SELECT episode_index, frame_index, ix, iy, iz, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2,
  count(*) FILTER (label = 3) AS n3, count(*) FILTER (label = 4) AS n4 FROM f GROUP BY ALL)
SELECT *, CAST(CASE WHEN n0 >= greatest(n1, n2, n3, n4) THEN 0 WHEN n1 >= greatest(n2, n3, n4) THEN 1 WHEN n2 >= greatest(n3, n4) THEN 2 WHEN n3 >= n4 THEN 3 ELSE 4 END AS INT) AS majority,
  n4 > 0 AS has_target FROM c""")
def a31_propagate_labels(spark, sf_dir):
    return voxel.propagate_labels(table(spark, sf_dir, "points"), 0.0625, [2, 2])


_BITS = " | ".join(f"(((g{a} >> {k}) & 1) << {3 * k + p})" for k in range(6) for p, a in enumerate("zyx"))


@query(f"""WITH g AS (SELECT episode_index, frame_index, point_id, CAST(trunc((x - min(x) OVER w) / 3125e-5) AS BIGINT) AS gx, CAST(trunc((y - min(y) OVER w) / 3125e-5) AS BIGINT) AS gy,
  CAST(trunc((z - min(z) OVER w) / 3125e-5) AS BIGINT) AS gz FROM points WINDOW w AS (PARTITION BY episode_index, frame_index)),
c AS (SELECT *, {_BITS} AS code FROM g)
SELECT episode_index, frame_index, point_id, code, CAST(row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY code, point_id) - 1 AS INT) AS place FROM c""")
def t06_z_order(spark, sf_dir):
    return voxel.serialise(table(spark, sf_dir, "points"), 0.03125, depth=6).select("episode_index", "frame_index", "point_id", "code", "place")


def _hilbert_sql(depth, axes="xyz"):
    """Steps of Skilling's transform as a chain of subqueries over g (a, b, c from the cells gx, gy, gz), then the code."""
    steps, last = [f"h0 AS (SELECT *, {', '.join(f'g{x} AS {n}' for x, n in zip(axes, 'abc', strict=True))} FROM g)"], 0
    for level in range(depth - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for n in "abc":
            turned = f"CASE WHEN {n} & {q} <> 0 THEN xor(a, {p}) ELSE xor(a, xor(a, {n}) & {p}) END"
            other = "" if n == "a" else f", CASE WHEN {n} & {q} <> 0 THEN {n} ELSE xor({n}, xor(a, {n}) & {p}) END AS {n}"
            steps.append(f"h{last + 1} AS (SELECT * REPLACE ({turned} AS a{other}) FROM h{last})")
            last += 1
    steps.append(f"k1 AS (SELECT * REPLACE (xor(b, a) AS b) FROM h{last}), k2 AS (SELECT * REPLACE (xor(c, b) AS c) FROM k1)")
    turn = "0"
    for level in range(depth - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN c & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    code = " | ".join(f"(((xor({n}, t) >> {k}) & 1) << {3 * k + 2 - i})" for k in range(depth) for i, n in enumerate("abc"))
    return ", ".join(steps) + f", k3 AS (SELECT *, {turn} AS t FROM k2), c AS (SELECT *, {code} AS code FROM k3)"


_GRID = """g AS (SELECT episode_index, frame_index, point_id, CAST(trunc((x - min(x) OVER w) / 3125e-5) AS BIGINT) AS gx, CAST(trunc((y - min(y) OVER w) / 3125e-5) AS BIGINT) AS gy,
  CAST(trunc((z - min(z) OVER w) / 3125e-5) AS BIGINT) AS gz FROM points WINDOW w AS (PARTITION BY episode_index, frame_index))"""
_PLACED = "SELECT episode_index, frame_index, point_id, code, CAST(row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY code, point_id) - 1 AS INT) AS place FROM c"
_CODE = ["episode_index", "frame_index", "point_id", "code", "place"]


@query(f"WITH {_GRID}, {_hilbert_sql(6)} {_PLACED}")
def t06_hilbert_order(spark, sf_dir):
    return voxel.serialise(table(spark, sf_dir, "points"), 0.03125, depth=6, curve="hilbert").select(*_CODE)


@query(f"WITH {_GRID}, {_hilbert_sql(6, 'yxz')} {_PLACED}")
def t06_hilbert_trans_order(spark, sf_dir):
    """With the first two axes exchanged."""
    return voxel.serialise(table(spark, sf_dir, "points"), 0.03125, depth=6, curve="hilbert-trans").select(*_CODE)


@query(f"WITH {_GRID} SELECT episode_index, frame_index, point_id, gx AS ix, gy AS iy, gz AS iz FROM g")
def t06_cells_of_codes(spark, sf_dir):
    """Hilbert codes decoded are the cells that they came from."""
    coded = voxel.serialise(table(spark, sf_dir, "points"), 0.03125, depth=6, curve="hilbert").select(*_CODE)
    return curves.hilbert_cells(coded, "code", 6).select("episode_index", "frame_index", "point_id", "ix", "iy", "iz")


@query(f"""WITH {_GRID}, c AS (SELECT *, {_BITS} AS code FROM g), p AS (SELECT episode_index, frame_index, row_number() OVER w1 - 1 AS n, row_number() OVER w2 - 1 AS p FROM c
  WINDOW w1 AS (PARTITION BY episode_index, frame_index ORDER BY point_id), w2 AS (PARTITION BY episode_index, frame_index ORDER BY code, point_id))
SELECT a.episode_index, a.frame_index, CAST(a.n AS INT) AS i, CAST(b.n AS INT) AS "order", CAST(a.p AS INT) AS inverse FROM p a JOIN p b ON a.episode_index = b.episode_index AND a.frame_index = b.frame_index AND a.n = b.p""")
def t06_permutations(spark, sf_dir):
    """The order of each cloud along the curve, and its inverse."""
    return curves.permutations(voxel.serialise(table(spark, sf_dir, "points"), 0.03125, depth=6))


@query(f"""WITH {_GRID}, c AS (SELECT *, {_BITS} AS code FROM g), b AS (SELECT *, dense_rank() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS batch FROM c)
SELECT episode_index, frame_index, point_id, (batch << 18) | code AS code, CAST(row_number() OVER (PARTITION BY episode_index ORDER BY batch, code, point_id) - 1 AS INT) AS place FROM b""")
def t06_batch_codes(spark, sf_dir):
    """An episode's clouds in one order, by a code with the cloud's number in front."""
    coded = voxel.serialise(table(spark, sf_dir, "points"), 0.03125, depth=6)
    batch = F.dense_rank().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1
    rows = coded.withColumn("code", curves.batch_code(F.col("code"), batch, 6))
    return rows.select("episode_index", "frame_index", "point_id", "code", (F.row_number().over(Window.partitionBy("episode_index").orderBy("code", "point_id")) - 1).alias("place"))


_LEVELS = """f AS (SELECT episode_index, frame_index, point_id, label, CAST(floor(x / 625e-4) AS BIGINT) AS x0, CAST(floor(y / 625e-4) AS BIGINT) AS y0, CAST(floor(z / 625e-4) AS BIGINT) AS z0 FROM points),
g AS (SELECT *, CAST(trunc(x0 / 2e0) AS BIGINT) AS x1, CAST(trunc(y0 / 2e0) AS BIGINT) AS y1, CAST(trunc(z0 / 2e0) AS BIGINT) AS z1 FROM f),
h AS (SELECT *, CAST(trunc(x1 / 3e0) AS BIGINT) AS x2, CAST(trunc(y1 / 3e0) AS BIGINT) AS y2, CAST(trunc(z1 / 3e0) AS BIGINT) AS z2 FROM g),
i AS (SELECT episode_index, frame_index, point_id, label, """ + ", ".join(f"CAST(dense_rank() OVER (PARTITION BY episode_index, frame_index ORDER BY x{k}, y{k}, z{k}) - 1 AS INT) AS id{k}" for k in range(3)) + " FROM h)"


@query(f"WITH {_LEVELS} SELECT episode_index, frame_index, point_id, id0, id1, id2 FROM i")
def a31_pooling_ids(spark, sf_dir):
    """Each point's cell at every level of a pooling chain."""
    ids = pooling.pooling_ids(table(spark, sf_dir, "points"), 0.0625, [2, 3])
    return ids.select("episode_index", "frame_index", "point_id", "id0", "id1", "id2")


@query(f"""WITH {_LEVELS}, q AS (SELECT *, CASE WHEN label > 2 THEN label - 3 END AS query_id FROM i),
l AS (SELECT episode_index, frame_index, 0 AS level, id0 AS cell, query_id FROM q UNION ALL SELECT episode_index, frame_index, 1, id1, query_id FROM q UNION ALL SELECT episode_index, frame_index, 2, id2, query_id FROM q)
SELECT episode_index, frame_index, level, cell, string_agg(DISTINCT CAST(query_id AS VARCHAR), ',' ORDER BY CAST(query_id AS VARCHAR)) AS query_ids FROM l WHERE query_id IS NOT NULL GROUP BY ALL""")
def a31_query_ids(spark, sf_dir):
    """The queries that points answer, carried by composed parent maps to the cells of every level."""
    ids = pooling.pooling_ids(table(spark, sf_dir, "points"), 0.0625, [2, 3])
    ids = materialize(ids.select("episode_index", "frame_index", "label", "id0", "id1", "id2"), "pooling-ids")  # read for each map
    ancestors = pooling.compose([pooling.parent_map(ids, k) for k in range(2)])
    carried = ids.filter("label > 2").select("episode_index", "frame_index", F.col("id0").alias("child"), (F.col("label") - 3).alias("query_id"))
    return pooling.carry_ids(carried, ancestors).withColumn("query_ids", F.concat_ws(",", F.col("query_ids").cast("array<string>")))


#: A number in (0, 1) from integer arithmetic that both engines share.
_KEY = "((ok * 7919 + pk * 104729 + point_id * 31) % 65537 + 1) / 65539e0"
_D2 = "((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez))"


def _with_grip(spark, sf_dir):
    keys = ["episode_index", "frame_index"]
    return table(spark, sf_dir, "points").join(table(spark, sf_dir, "grip"), keys)


@query(f"""WITH w AS (SELECT p.episode_index, p.frame_index, point_id, 5e-2 + 95e-2 * exp(-{_D2} / 125e-3) AS w, {_KEY} AS u FROM points p JOIN grip USING (episode_index, frame_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY -ln(u) / w, point_id) AS k FROM w)
SELECT episode_index, frame_index, point_id, round(w, 9) AS weight FROM r WHERE k <= 16""")
def t01_density_draw(spark, sf_dir):
    """A density-weighted draw without replacement around the gripper, pruned before the shuffle."""
    rows = _with_grip(spark, sf_dir)
    anchor = F.array(F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z")))
    rows = rows.withColumn("weight", density_weight([F.col(c) for c in "xyz"], anchor, 0.25, 0.05))
    drawn = sampling.finite_weighted_draw(rows, "weight", 16, key=F.expr(_KEY))
    return drawn.select("episode_index", "frame_index", "point_id", F.round("weight", 9).alias("weight"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY -ln({_KEY}) / 1e0, point_id) AS k FROM points)
SELECT episode_index, frame_index, point_id FROM r WHERE k <= 32""")
def t03_uniform_draw(spark, sf_dir):
    rows = table(spark, sf_dir, "points").withColumn("one", F.lit(1.0))
    return sampling.finite_weighted_draw(rows, "one", 32, key=F.expr(_KEY)).select("episode_index", "frame_index", "point_id")


@query("""WITH r AS (SELECT *, x + 1e0 AS w FROM points)
SELECT episode_index, frame_index, point_id, round(count(*) OVER k * w / sum(w) OVER k, 9) AS oversampling FROM r WINDOW k AS (PARTITION BY episode_index, frame_index)""")
def f20_oversampling(spark, sf_dir):
    rows = sampling.oversampling(table(spark, sf_dir, "points").withColumn("w", F.col("x") + 1.0), "w")
    return rows.select("episode_index", "frame_index", "point_id", F.round("oversampling", 9).alias("oversampling"))


@query()
def t05_farthest_points(spark, sf_dir):
    return sampling.farthest_points(table(spark, sf_dir, "points"), 16)


@query(f"""WITH d AS (SELECT episode_index, frame_index, point_id, {_D2} AS d2 FROM points JOIN grip USING (episode_index, frame_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY d2, point_id) AS k FROM d)
SELECT episode_index, frame_index, point_id, sqrt(d2) AS distance FROM r WHERE k = 1""")
def j08_nearest_point(spark, sf_dir):
    grip = table(spark, sf_dir, "grip").select("episode_index", "frame_index", *(F.col(f"e{c}").alias(f"q{c}") for c in "xyz"))
    return anchors.nearest_point(table(spark, sf_dir, "points"), grip)


@query("""WITH a AS (SELECT * FROM points WHERE pk % 2 = 0), b AS (SELECT * FROM points WHERE pk % 2 = 1),
h AS (SELECT a.episode_index, a.frame_index, a.point_id, b.point_id AS neighbour,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM a JOIN b USING (episode_index, frame_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index, point_id ORDER BY d2, neighbour) AS k FROM h WHERE d2 <= 125e-3 * 125e-3)
SELECT a.episode_index, a.frame_index, a.point_id, r.neighbour, sqrt(r.d2) AS distance FROM a LEFT JOIN r ON r.k = 1 AND r.episode_index = a.episode_index AND r.frame_index = a.frame_index AND r.point_id = a.point_id""")
def j07_nearest_within(spark, sf_dir):
    points = table(spark, sf_dir, "points")
    return anchors.nearest_within(points.filter("pk % 2 = 0"), points.filter("pk % 2 = 1"), 0.125)


@query(f"""WITH d AS (SELECT p.*, sqrt({_D2}) AS distance FROM points p JOIN grip USING (episode_index, frame_index)),
g AS (SELECT 'fine' AS grid, * FROM d UNION ALL SELECT 'coarse', * FROM d WHERE pk % 3 = 0),
f AS (SELECT grid, episode_index, frame_index, count(*) AS n, count(*) FILTER (label = 4) AS target, count(*) FILTER (distance <= 25e-2) AS within_0,
  count(*) FILTER (distance <= 5e-1) AS within_1, least(count(*), 64) AS drawn FROM g GROUP BY ALL),
o AS (SELECT grid, count(*) AS n_frames, median(n) AS n, median(target) AS target, median(drawn) AS drawn, median(within_0) AS within_0, median(within_1) AS within_1 FROM f GROUP BY grid)
SELECT o.*, o.n / b.n AS ratio, o.drawn / o.n AS saturation FROM o, o b WHERE b.grid = 'fine'""")
def a28_grid_probe(spark, sf_dir):
    from demolake.operators.evaluation import grid_probe

    d = F.sqrt(squared_distance([F.col(c) for c in "xyz"], [F.col(f"e{c}") for c in "xyz"]))
    rows = _with_grip(spark, sf_dir).withColumn("distance", d)
    both = rows.withColumn("grid", F.lit("fine")).unionByName(rows.filter("pk % 3 = 0").withColumn("grid", F.lit("coarse")))
    return grid_probe(both, radii=(0.25, 0.5), target=4, budget=64, base="fine")


@query(f"""WITH d AS (SELECT p.*, sqrt({_D2}) AS distance FROM points p JOIN grip USING (episode_index, frame_index)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY distance, point_id) AS k FROM d) WHERE k <= 32),
a AS (SELECT episode_index, frame_index, count(*) AS n_points, count(*) FILTER (distance <= 5e-1) AS near_points, count(distance) AS with_anchor FROM d GROUP BY ALL),
b AS (SELECT episode_index, frame_index, count(*) AS n_drawn, count(*) FILTER (distance <= 5e-1) AS near_drawn FROM s GROUP BY ALL),
c AS (SELECT *, CASE WHEN near_points > 0 THEN (near_drawn / CAST(greatest(n_drawn, 1) AS DOUBLE)) / (near_points / CAST(n_points AS DOUBLE)) END AS c FROM a JOIN b USING (episode_index, frame_index))
SELECT episode_index, frame_index, n_points, near_points, with_anchor, n_drawn, near_drawn, round(c, 9) AS concentration,
  concat_ws(';', CASE WHEN with_anchor = 0 THEN 'no anchor' END, CASE WHEN c < 15e-1 THEN 'not concentrated' END, CASE WHEN n_drawn < least(n_points, 32) THEN 'budget unmet' END) AS problems FROM c""")
def a35_audit_sampling(spark, sf_dir):
    d = F.sqrt(squared_distance([F.col(c) for c in "xyz"], [F.col(f"e{c}") for c in "xyz"]))
    rows = _with_grip(spark, sf_dir).withColumn("distance", d)
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("episode_index", "frame_index").orderBy("distance", "point_id"))
    drawn = rows.withColumn("k", rank).filter("k <= 32")
    out = sampling.audit_sampling(drawn, rows, sigma=0.5, budget=32)
    return out.withColumns({"concentration": F.round("concentration", 9), "problems": F.array_join("problems", ";")})


@query("""WITH c AS (SELECT *, avg(r) OVER k AS mr, avg(g) OVER k AS mg, avg(b) OVER k AS mb FROM points WINDOW k AS (PARTITION BY episode_index, frame_index)),
s AS (SELECT episode_index, frame_index, point_id, r, g, b, min(r) OVER k AS lr, max(r) OVER k AS hr, min(g) OVER k AS lg, max(g) OVER k AS hg, min(b) OVER k AS lb, max(b) OVER k AS hb FROM c WINDOW k AS (PARTITION BY episode_index, frame_index))
SELECT episode_index, frame_index, point_id, round((r - lr) / (hr - lr + 1e-6), 9) AS r, round((g - lg) / (hg - lg + 1e-6), 9) AS g, round((b - lb) / (hb - lb + 1e-6), 9) AS b FROM s""")
def f21_stretch_colours(spark, sf_dir):
    out = jitter_colours(table(spark, sf_dir, "points"), by=["episode_index", "frame_index"], auto_contrast=True)
    return out.select("episode_index", "frame_index", "point_id", *(F.round(c, 9).alias(c) for c in "rgb"))
