"""Queries that write and read stores, select features and rows, and split reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.functions import geometry
from demolake.operators import anchors, conversation, evaluation, sampling, vectors, voxel
from demolake.plans.catalog import query
from demolake.plans.fixtures import table
from demolake.sources import arrays, frame_store, tables
from demolake.sources.shared import new_folder

_K = ["episode_index", "frame_index"]


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "frames").select(*_K, "task", "value")


@query("SELECT episode_index, frame_index, value FROM frames")
def s01_frame_scan(spark, sf_dir):
    """A frame-keyed table written and read back, with the columns asked for."""
    path = new_folder(spark, "frames")
    tables.write_frame_table(_frames(spark, sf_dir), path, chunk_size=10)
    return tables.read_frames(spark, path, [*_K, "value"])


@query("SELECT episode_index, frame_index, CAST(episode_index // 10 AS INT) AS episode_chunk FROM frames WHERE episode_index IN (2, 3, 5, 8, 13, 21, 34, 55)")
def s02_episode_scan(spark, sf_dir):
    """Only the files of the episodes asked for."""
    path = new_folder(spark, "frames")
    tables.write_frame_table(_frames(spark, sf_dir), path, chunk_size=10)
    return tables.read_frames(spark, path, [*_K, "episode_chunk"], episodes=[2, 3, 5, 8, 13, 21, 34, 55], chunk_size=10)


@query("SELECT episode_index, count(*) AS length, CASE WHEN episode_index % 5 = 0 THEN '' ELSE min(task) END AS task FROM frames GROUP BY episode_index")
def s03_episode_lines(spark, sf_dir):
    """S3: episode metadata as JSON lines; an episode without tasks reads as an empty one."""
    path = new_folder(spark, "episodes")
    tasks = F.array_sort(F.collect_set("task"))
    rows = _frames(spark, sf_dir).groupBy("episode_index").agg(F.count("*").alias("length"), tasks.alias("tasks"))
    rows.withColumn("tasks", F.when(F.col("episode_index") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("tasks"))).write.json(path)
    return tables.read_episodes(spark, path)


@query("""SELECT g.episode_index, g.frame_index, count(*) AS n_points, max(a.ax) AS anchor_x FROM grip g JOIN points p USING (episode_index, frame_index)
LEFT JOIN (SELECT episode_index, frame_index, avg(x) AS ax FROM points WHERE label = 4 GROUP BY ALL) a USING (episode_index, frame_index) GROUP BY ALL""")
def s05_keyed_read(spark, sf_dir):
    """Points by frame key, where a missing frame is an error, and anchors, where it is not."""
    p, frames = table(spark, sf_dir, "points"), table(spark, sf_dir, "grip").select(*_K)
    held = anchors.label_anchor(p, fallback=()).filter("x IS NOT NULL").select(*_K, F.col("x").alias("anchor_x"))
    n = tables.read_points(frames, p.select(*_K, "point_id")).groupBy(*_K).agg(F.count("*").alias("n_points"))
    return tables.read_anchors(n, held)


def _array_cache(spark, sf_dir):
    """The points of every supplier as an episode's arrays; frames are numbered from 0, and ``line`` has their own number."""
    path = new_folder(spark, "arrays")
    p = table(spark, sf_dir, "points")
    mean = p.groupBy(*_K).agg(F.array(*(F.avg(c) for c in "xyz")).alias("centre"))
    keys = mean.withColumn("at", F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1)
    frames = keys.select("episode_index", F.col("at").alias("frame_index"), F.col("frame_index").alias("line"), "centre")
    points = p.join(keys.select(*_K, "at"), _K).select("episode_index", F.col("at").alias("frame_index"), "point_id", "x", "y", "z", "label")
    arrays.write_episode_arrays(frames, points, path)
    return path


@query("SELECT episode_index, frame_index AS line, point_id, x, y, z, label FROM points")
def s07_array_caches(spark, sf_dir):
    """Per-episode arrays with offsets, written and read back as frames and points."""
    path = _array_cache(spark, sf_dir)
    points = arrays.read_episode_arrays(spark, path, "points", "episode_index long, frame_index long, point_id long, x double, y double, z double, label int")
    lines = arrays.read_episode_arrays(spark, path, "frames", "episode_index long, frame_index long, line long")
    return points.join(lines, _K).select("episode_index", "line", (F.col("point_id") + 1).alias("point_id"), "x", "y", "z", "label")


@query("SELECT episode_index, frame_index AS line, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points WHERE episode_index % 7 = 3 AND episode_index > 5 GROUP BY 1, 2")
def s07_array_caches_of_episodes(spark, sf_dir):
    """Of array caches only the files of the episodes asked for."""
    path = _array_cache(spark, sf_dir)
    asked = [r[0] for r in table(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 3").select("s_suppkey").collect()]
    rows = arrays.read_episode_arrays(spark, path, "frames", "episode_index long, line long, centre array<double>", episodes=asked).filter("episode_index > 5")
    return rows.select("episode_index", "line", *(F.col("centre")[k].alias(f"c{c}") for k, c in enumerate("xyz")))


def _frame_store(spark, sf_dir):
    """Points, labels of three quarters of them by cell, and anchors where a frame has a label 4."""
    store = frame_store.FrameStore.create(spark, new_folder(spark, "frame-store"), buckets=16, chunk_size=20)
    p = table(spark, sf_dir, "points")
    store.write("points", p.select(*_K, "point_id", "x", "y", "z"), order=["point_id"])
    store.write("labels", voxel.voxel_labels(p.filter("pk % 4 <> 0"), 0.125).select(*_K, *voxel.CELL, "label"))
    store.write("anchors", p.filter("label = 4 AND ok % 3 = 0").groupBy(*_K).agg(F.avg("x").alias("anchor_x")))
    return store


@query(f"""WITH p AS (SELECT *, CAST(floor(x / 125e-3) AS INT) AS ix, CAST(floor(y / 125e-3) AS INT) AS iy, CAST(floor(z / 125e-3) AS INT) AS iz FROM points),
n AS (SELECT {", ".join(_K)}, ix, iy, iz, label, count(*) AS n FROM p WHERE pk % 4 <> 0 GROUP BY ALL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(_K)}, ix, iy, iz ORDER BY n DESC, label DESC) AS k FROM n) WHERE k = 1),
a AS (SELECT {", ".join(_K)}, avg(x) AS anchor_x FROM points WHERE label = 4 AND ok % 3 = 0 GROUP BY ALL)
SELECT {", ".join(f"p.{k}" for k in _K)}, p.point_id, coalesce(l.label, 0) AS label, l.label IS NOT NULL AS matched, a.anchor_x
FROM p LEFT JOIN l USING ({", ".join(_K)}, ix, iy, iz) LEFT JOIN a USING ({", ".join(_K)})""")
def j01_stored_assembly(spark, sf_dir):
    """Samples from a store of bucketed tables, labels by cell and anchors by frame, without a shuffle."""
    store = _frame_store(spark, sf_dir)
    labelled = voxel.transfer_labels_by_frame(store.read("points"), store.read("labels"), 0.125)
    return tables.read_anchors(labelled, store.read("anchors")).select(*_K, "point_id", "label", "matched", "anchor_x")


@query(f"""WITH f AS (SELECT DISTINCT {", ".join(_K)} FROM points), a AS (SELECT DISTINCT {", ".join(_K)} FROM points WHERE label = 4 AND ok % 3 = 0),
l AS (SELECT {", ".join(_K)}, count(DISTINCT (floor(x / 125e-3), floor(y / 125e-3), floor(z / 125e-3))) AS n FROM points WHERE pk % 4 <> 0 GROUP BY ALL),
c AS (SELECT 'points' AS "table", (SELECT count(*) FROM points) AS n_rows, count(*) AS n_frames FROM f UNION ALL SELECT 'labels', sum(n), count(*) FROM l UNION ALL SELECT 'anchors', count(*), count(*) FROM a)
SELECT "table", CAST(n_rows AS BIGINT) AS n_rows, n_frames, (SELECT count(*) FROM f) - n_frames AS n_missing, CAST(0 AS BIGINT) AS n_extra, n_frames / CAST((SELECT count(*) FROM f) AS DOUBLE) AS covered FROM c""")
def s17_coverage(spark, sf_dir):
    """Rows and frames of every table of a store, and what it covers of the frames with points."""
    return _frame_store(spark, sf_dir).coverage("points", ["points", "labels", "anchors"])


@query(f"""SELECT DISTINCT {", ".join(_K)} FROM points WHERE episode_index % 40 < 3 AND frame_index > 4""")
def s13_pending_chunks(spark, sf_dir):
    """Frames not in the store yet; chunks whose manifest agrees aren't read."""
    store = frame_store.FrameStore.create(spark, new_folder(spark, "frame-store"), buckets=4, chunk_size=20)
    rows = table(spark, sf_dir, "points").groupBy(*_K).agg(F.count("*").alias("n"))
    late = "episode_index % 40 < 3 AND frame_index > 2"
    store.write("done", rows.filter(f"NOT ({late})"))
    store.write("done", rows.filter(f"{late} AND frame_index <= 4"), append=True)
    return store.pending(rows.select(*_K), "done")


@query("""WITH p AS (SELECT trial, task || '-' || sampling || '-n' || npoints || '-s' || seed AS run, CASE WHEN trial % 7 = 0 THEN NULL ELSE step END AS step, trial % 11 = 0 AS part FROM trials)
SELECT trial, run, CAST(step AS BIGINT) AS step FROM p WHERE step IS NOT NULL AND NOT part""")
def s11_path_identity(spark, sf_dir):
    """What paths say of their results; partial files and folders beside the checkpoints are passed over."""
    name = evaluation.run_name(F.col("task"), F.col("sampling"), F.col("npoints"), F.col("seed"))
    folder = F.concat(F.lit("checkpoint-"), F.col("step").cast("string"), F.when(F.col("trial") % 7 == 0, "-viz").otherwise(""))
    file = F.when(F.col("trial") % 11 == 0, "partial_seed0_n5.json").otherwise("per_trial_seed0_n5.json")
    paths = table(spark, sf_dir, "trials").select("trial", F.concat_ws("/", F.lit("/results"), name, folder, file).alias("path"))
    return tables.path_identity(paths).select("trial", "run", "step")


@query("SELECT trial, trial % 2 = 0 AS is_final, CASE WHEN trial % 2 = 0 THEN success ELSE NULL END AS success FROM trials")
def s12_results(spark, sf_dir):
    """Partial records of all trials, final ones of every other; a batch sent again replaces itself."""
    path, schema = new_folder(spark, "results"), table(spark, sf_dir, "trials").select("trial", "success").schema
    t = table(spark, sf_dir, "trials").select("trial", "success")
    partial = t.select("trial", F.lit(None).cast("boolean").alias("success"))
    for _ in range(2):
        tables.write_trials(partial, path, final=False, batch="0")
        tables.write_trials(t.filter("trial % 2 = 0"), path, final=True, batch="0")
    return tables.read_results(spark, path, schema, ["trial"]).select("trial", "is_final", "success")


@query("""WITH e AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT dim, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std, (SELECT count(*) FROM embeddings) AS num_data FROM e GROUP BY dim""")
def s14_stats_file(spark, sf_dir):
    """Statistics as one JSON object with prefixed names, read back."""
    path, e = new_folder(spark, "stats"), table(spark, sf_dir, "embeddings")
    tables.write_stats(vectors.vector_stats(e, "embedding", width=64).select("dim", "mean", "std"), path, prefix="state", num_data=e.count())
    rows = spark.read.schema("state_mean array<double>, state_std array<double>, num_data long").json(path)
    both = rows.select("num_data", F.posexplode(F.arrays_zip("state_mean", "state_std")).alias("dim", "s"))
    return both.select("dim", F.round("s.state_mean", 7).alias("mean"), F.round("s.state_std", 7).alias("std"), "num_data")


@query("SELECT task, sampling, count(*) FILTER (success) AS successes, count(*) AS num_trials FROM trials GROUP BY ALL")
def s15_export(spark, sf_dir):
    """A report as a CSV file, read back."""
    path = new_folder(spark, "report")
    report = table(spark, sf_dir, "trials").groupBy("task", "sampling").agg(F.count_if("success").alias("successes"), F.count("*").alias("num_trials"))
    tables.export_table(report, path)
    return spark.read.schema(report.schema).csv(path, header=True)


_FEATURES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'observation.images.left' WHEN 1 THEN 'observation.environment_state' WHEN 2 THEN 'observation.state' WHEN 3 THEN 'action' WHEN 4 THEN 'action_is_pad' ELSE 'timestamp' END AS key FROM part"""


@query(f"""WITH f AS ({_FEATURES}) SELECT id, key, CASE WHEN key LIKE 'observation.images%' THEN 'visual' WHEN key = 'observation.environment_state' THEN 'env' WHEN key LIKE 'observation%' THEN 'state' ELSE 'action' END AS kind,
CASE WHEN key LIKE 'observation.images%' THEN '3x240x320' ELSE '7' END AS shape FROM f WHERE key <> 'timestamp'""")
def p02_classify_features(spark, sf_dir):
    """Kinds and channel-first shapes of features."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "observation.images.left").when(k == 1, "observation.environment_state").when(k == 2, "observation.state").when(k == 3, "action").when(k == 4, "action_is_pad").otherwise("timestamp")
    video = F.when(k == 0, F.array(F.lit(240), F.lit(320), F.lit(3))).otherwise(F.array(F.lit(7)))
    meta = table(spark, sf_dir, "part").select("p_partkey", name.alias("key"), F.when(k == 0, "video").otherwise("float32").alias("dtype"), video.alias("shape"), F.when(k == 0, F.array(F.lit("height"), F.lit("width"), F.lit("channels"))).alias("names"))
    kinds = tables.classify_features(meta.select("key", "dtype", "shape", "names").distinct())
    shape = F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape")
    return meta.select(F.col("p_partkey").alias("id"), "key").join(F.broadcast(kinds), "key").select("id", "key", "kind", shape)


@query("SELECT vec_id, CAST(len(embedding) + 2 AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(vec_id AS DOUBLE) AS last FROM embeddings")
def p03_concat_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.array(F.lit(1.0), F.col("vec_id").cast("double")).alias("b"))
    return vectors.concat_vectors(e, ["a", "b"], "v").select("vec_id", F.size("v").alias("n"), F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"))


_BOX = ((-0.5, 0.5), (-0.25, 0.75), (0.0, 0.5))
_CLOSED = "x BETWEEN -5e-1 AND 5e-1 AND y BETWEEN -25e-2 AND 75e-2 AND z BETWEEN 0 AND 5e-1"
_OPEN = "x > -5e-1 AND x < 5e-1 AND y > -25e-2 AND y < 75e-2 AND z > 0 AND z < 5e-1"


@query(f"SELECT episode_index, frame_index, point_id FROM points WHERE {_CLOSED}")
def p07_closed_crop(spark, sf_dir):
    """The workspace with its faces."""
    return table(spark, sf_dir, "points").filter(geometry.in_workspace(_BOX, closed=True)).select(*_K, "point_id")


@query(f"SELECT episode_index, frame_index, view_id, coalesce({_OPEN}, false) AS inside FROM detections")
def p08_anchor_gate(spark, sf_dir):
    """Whether an anchor lies strictly inside the workspace; one without a position doesn't."""
    return table(spark, sf_dir, "detections").select(*_K, "view_id", F.coalesce(geometry.in_workspace(_BOX), F.lit(False)).alias("inside"))


@query("""WITH p AS (SELECT q.*, c.view_id AS view_id, x + tx AS px, y + ty AS py, z - 25e-2 AS pz, fx, fy, cx, cy FROM points q, cams c),
s AS (SELECT *, CASE WHEN pz > 1e-6 THEN fx * px / pz + cx END AS u, CASE WHEN pz > 1e-6 THEN fy * py / pz + cy END AS v FROM p)
SELECT episode_index, frame_index, point_id, view_id FROM s WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48 AND u BETWEEN 16 AND 48 AND v BETWEEN 12 AND 36""")
def p09_in_image_box(spark, sf_dir):
    """In front of the camera, inside the image (half open) and inside a box (closed)."""
    cams = table(spark, sf_dir, "cams").withColumn("tz", F.lit(-0.25))
    seen = geometry.project_points(table(spark, sf_dir, "points"), cams)
    return seen.filter(geometry.in_image_box(64, 48, (16, 12, 48, 36))).select(*_K, "point_id", "view_id")


@query("SELECT episode_index, frame_index, view_id AS query_id FROM detections WHERE x IS NOT NULL AND frame_index % 16 <> 0 AND view_id IN (0, 2)")
def p12_finite_anchors(spark, sf_dir):
    """Anchors with finite positions, of some queries."""
    d = table(spark, sf_dir, "detections").withColumnRenamed("view_id", "query_id")
    d = d.withColumn("z", F.when(F.col("frame_index") % 16 == 0, F.lit(float("nan"))).otherwise(F.col("z")))
    return anchors.finite_anchors(d, [0, 2]).select(*_K, "query_id")


@query("SELECT count(*) FILTER (view_id < 2) AS n_kept, count(*) FILTER (view_id >= 2) AS n_dropped, count(*) FILTER (view_id < 2) AS n_rows FROM detections")
def p18_valid_detections(spark, sf_dir):
    """Detections of the views asked for, and how many were dropped."""
    d = table(spark, sf_dir, "detections")
    return anchors.dropped_detections(d, 2).crossJoin(anchors.valid_detections(d, 2).agg(F.count("*").alias("n_rows")))


_ERRORS = """SELECT CASE task WHEN 'click' THEN 'open the Left door' WHEN 'view' THEN 'open the right door' ELSE task END AS task, idx % 3 = 0 AS agree, (idx % 128) / 1024e0 AS e FROM frames"""


def _errors(spark, sf_dir):
    task = F.when(F.col("task") == "click", "open the Left door").when(F.col("task") == "view", "open the right door").otherwise(F.col("task"))
    return table(spark, sf_dir, "frames").select(task.alias("task"), (F.col("idx") % 3 == 0).alias("agree"), (F.col("idx") % 128 / 1024.0).alias("e"))


@query(f"""WITH r AS ({_ERRORS}), s AS (SELECT *, CASE WHEN contains(lower(task), 'left') THEN 'left' WHEN contains(lower(task), 'right') THEN 'right' END AS side FROM r)
SELECT side, count(*) AS n, round(median(e), 6) AS median, round(avg(e), 6) AS mean FROM s WHERE side IS NOT NULL GROUP BY side""")
def a17_errors_by_side(spark, sf_dir):
    out = anchors.errors_by_side(_errors(spark, sf_dir), "e")
    return out.select("side", "n", F.round("median_m", 6).alias("median"), F.round("mean_m", 6).alias("mean"))


@query(f"WITH r AS ({_ERRORS}) SELECT agree, count(*) AS n, round(median(e), 6) AS median, round(avg(e), 6) AS mean FROM r GROUP BY agree")
def a17_errors_by_agreement(spark, sf_dir):
    out = anchors.errors_by_agreement(_errors(spark, sf_dir), "e")
    return out.select("agree", "n", F.round("median_m", 6).alias("median"), F.round("mean_m", 6).alias("mean"))


@query("""WITH c AS (SELECT episode_index, frame_index, point_id, CAST(floor(x * 32) AS BIGINT) AS ix, CAST(floor(y * 32) AS BIGINT) AS iy, CAST(floor(z * 32) AS BIGINT) AS iz FROM points)
SELECT episode_index, frame_index, point_id, dense_rank() OVER (PARTITION BY episode_index, frame_index ORDER BY ix, iy, iz) AS place FROM c""")
def t13_voxel_order(spark, sf_dir):
    """Rows in the order of their packed cells; the key orders as the cell's coordinates do."""
    from pyspark.sql.window import Window

    rows = voxel.voxel_ordered(table(spark, sf_dir, "points").select(*_K, "point_id", "x", "y", "z"), 0.03125)
    place = F.dense_rank().over(Window.partitionBy(*_K).orderBy("vkey"))
    return rows.select(*_K, "point_id", place.cast("long").alias("place"))


@query("SELECT episode_index, frame_index, count(*) AS n_points, count(DISTINCT view_id) AS n_views, CAST(sum(u) AS BIGINT) AS sum_u FROM pixels GROUP BY ALL")
def u02_fuse_views(spark, sf_dir):
    """The clouds of three cameras as one."""
    px = table(spark, sf_dir, "pixels").select(*_K, "view_id", "u", "v")
    fused = voxel.fuse_views([px.filter(F.col("view_id") == k).select("v", "u", "view_id", *_K) for k in range(3)])
    return fused.groupBy(*_K).agg(F.count("*").alias("n_points"), F.count_distinct("view_id").alias("n_views"), F.sum("u").cast("long").alias("sum_u"))


_CLOUD = ("SELECT episode_index % 2 AS cloud, (episode_index * 16 + frame_index) * 100000 + point_id AS point_id, x, y, z FROM points")


def _farther(n, by):
    """The n-th round of SQL: distances to the pick before, and the farthest point."""
    d = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"
    before = f"least(p.d, {d})" if n > 1 else d
    return f"""d{n} AS (SELECT p.cloud, p.point_id, p.x, p.y, p.z, {before} AS d FROM {f"d{n - 1}" if n > 1 else "p"} p JOIN c{n - 1} q ON {by}),
c{n} AS (SELECT cloud, point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY d DESC, point_id) AS r FROM d{n}) WHERE r = 1)"""


@query(f"""WITH p AS ({_CLOUD}), c0 AS (SELECT cloud, point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY point_id) AS r FROM p) WHERE r = 1), {", ".join(_farther(n, "p.cloud = q.cloud") for n in range(1, 6))}
{" UNION ALL ".join(f"SELECT cloud, point_id, CAST({n} AS INT) AS turn FROM c{n}" for n in range(6))}""")
def t05_farthest_of_large_clouds(spark, sf_dir):
    """T5: six points of two clouds that hold all points."""
    clouds = table(spark, sf_dir, "points").selectExpr("episode_index % 2 AS cloud", "(episode_index * 16 + frame_index) * 100000 + point_id AS point_id", "x", "y", "z")
    return sampling.farthest_points_of_large_clouds(clouds, 6, by=["cloud"])


@query("SELECT seed, trial, (((xor(CAST(seed AS BIGINT) * 73856093, CAST(trial AS BIGINT) * 19349663) % 2147483648) + 2147483648) % 2147483648 * 48271) % 2147483647 AS scene FROM trials")
def f31_scene_seed(spark, sf_dir):
    """the scene of every trial, from its seed and number alone."""
    return table(spark, sf_dir, "trials").select("seed", "trial", evaluation.scene_seed(F.col("seed"), F.col("trial")).alias("scene"))


@query("""WITH d AS (SELECT episode_index, frame_index, view_id, 0 AS query_id, u, v, ok, ln, row_number() OVER (PARTITION BY episode_index, frame_index, view_id ORDER BY ok, ln) AS r FROM pixels)
SELECT episode_index, frame_index, view_id, ok, ln FROM d WHERE r = 1""")
def w09_first_detection(spark, sf_dir):
    px = table(spark, sf_dir, "pixels").select(*_K, "view_id", F.lit(0).alias("query_id"), "ok", "ln", F.struct("ok", "ln").alias("o"))
    return anchors.first_detection(px, "o").select(*_K, "view_id", "ok", "ln")


@query("""WITH n AS (SELECT count(*) AS n FROM frames), r AS (SELECT episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS i FROM frames),
s AS (SELECT unnest(range(CAST(floor(n * 5e-1) AS BIGINT))) AS slot FROM n)
SELECT slot, episode_index, frame_index FROM s, n JOIN r ON r.i = (slot * 7919 + 13) % n""")
def t08_resampled_rows(spark, sf_dir):
    """Half as many rows as there are, with replacement; the slots' choices come from their numbers."""
    return sampling.resample(_frames(spark, sf_dir).select(*_K), 0.5, _K, choice=lambda i: i * 7919 + 13, ordered=True)


@query("""WITH a AS (SELECT conv_id, turn, [trim(x) FOR x IN string_split(role || '<br> <br>' || text, '<br>') IF trim(x) <> ''] AS a FROM conversations)
SELECT conv_id, turn, len(a) AS n, a[(conv_id * 31 + turn) % len(a) + 1] AS chosen FROM a""")
def f24_chosen_alternative(spark, sf_dir):
    """one of an instruction's readings."""
    text = F.concat("role", F.lit("<br> <br>"), "text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"))
    return c.select("conv_id", "turn", F.size(conversation.alternatives(F.col("t"))).cast("long").alias("n"), conversation.choose_alternative(F.col("t"), choice=F.col("conv_id") * 31 + F.col("turn")).alias("chosen"))


@query("""WITH r AS (SELECT doc_id, 'events' AS repo, doc_id * 7 AS idx FROM documents UNION ALL SELECT doc_id, 'other', doc_id FROM documents)
SELECT r.doc_id, r.repo, r.idx, f.episode_index, f.frame_index FROM r LEFT JOIN frames f ON r.repo = 'events' AND f.idx = r.idx""")
def j16_resolved_references(spark, sf_dir):
    """References resolve to the frames they name; others to nulls."""
    refs = F.array(F.concat_ws(" ", F.lit("events"), F.col("doc_id") * 7, F.lit(1)), F.concat_ws(" ", F.lit("other"), F.col("doc_id"), F.lit(1)))
    d = conversation.record_references(table(spark, sf_dir, "documents").select("doc_id", refs.alias("refs")), "refs", "doc_id")
    frames = table(spark, sf_dir, "frames").select(F.lit("events").alias("repo"), "idx", *_K)
    return conversation.resolve_references(d, frames).select("doc_id", "repo", "idx", *_K)


_FAR = """WITH p AS (SELECT episode_index, frame_index, point_id, x, y, z FROM points), c0 AS (SELECT episode_index, frame_index, min(point_id) AS pick FROM p GROUP BY ALL HAVING count(*) >= 3),
d0 AS (SELECT p.*, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d FROM p JOIN c0 USING (episode_index, frame_index) JOIN p q ON q.episode_index = p.episode_index AND q.frame_index = p.frame_index AND q.point_id = c0.pick),
c1 AS (SELECT episode_index, frame_index, point_id AS pick FROM (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY d DESC, point_id) AS r FROM d0) WHERE r = 1),
d1 AS (SELECT d0.* EXCLUDE d, least(d, (d0.x - q.x) * (d0.x - q.x) + (d0.y - q.y) * (d0.y - q.y) + (d0.z - q.z) * (d0.z - q.z)) AS d FROM d0 JOIN c1 USING (episode_index, frame_index) JOIN p q ON q.episode_index = d0.episode_index AND q.frame_index = d0.frame_index AND q.point_id = c1.pick),
c2 AS (SELECT episode_index, frame_index, point_id AS pick FROM (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY d DESC, point_id) AS r FROM d1) WHERE r = 1)
SELECT episode_index, frame_index, pick AS point_id, CAST(0 AS INT) AS turn FROM c0 UNION ALL SELECT episode_index, frame_index, pick, 1 FROM c1 UNION ALL SELECT episode_index, frame_index, pick, 2 FROM c2"""


@query(_FAR)
def t05_three_farthest(spark, sf_dir):
    """T5: three points of each cloud that has as many, each the farthest from those before."""
    p = table(spark, sf_dir, "points").select(*_K, "point_id", "x", "y", "z")
    return sampling.farthest_points(p, 3, skip=True).select(*_K, "point_id", "turn")
