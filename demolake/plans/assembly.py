"""Queries that assemble samples and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from demolake.functions import geometry, labels
from demolake.operators import anchors, conversation, episodes, sampling
from demolake.plans.catalog import query
from demolake.plans.fixtures import table

_K = ["episode_index", "frame_index"]


@query("""WITH g AS (SELECT episode_index, frame_index, ex, ey, ez FROM grip), c AS (SELECT episode_index, frame_index, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY ALL),
l AS (SELECT 0 AS dim, ex - mx AS v FROM g JOIN c USING (episode_index, frame_index) UNION ALL SELECT 1, ey - my FROM g JOIN c USING (episode_index, frame_index) UNION ALL SELECT 2, ez - mz FROM g JOIN c USING (episode_index, frame_index) UNION ALL SELECT 3, ex * 2 FROM g)
SELECT CAST(dim AS INT) AS dim, count(*) AS n, round(min(v), 9) AS min, round(max(v), 9) AS max, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(quantile_cont(v, 5e-1), 9) AS q50 FROM l GROUP BY dim""")
def a03_state_stats(spark, sf_dir):
    """A3: the hand's position centred on each frame's cloud, then statistics and a quantile."""
    centres = table(spark, sf_dir, "points").groupBy(*_K).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    grip = table(spark, sf_dir, "grip").select(*_K, F.array("ex", "ey", "ez", F.col("ex") * 2).alias("state"))
    out = episodes.state_action_stats(grip, "state", width=4, centres=centres, xyz=(0, 3), quantiles=(0.5,))
    return out.withColumns({c: F.round(c, 9) for c in ("min", "max", "mean", "std", "q50")})


@query("""WITH a AS (SELECT vec_id, q1 AS x, q2 AS y, q3 AS z, (vec_id % 64 + 1) / 16e0 AS t FROM poses)
SELECT vec_id, round(cos(t), 9) AS r0, round(sin(t), 9) AS r1, round(-sin(t), 9) AS r3, round(cos(t), 9) AS r4, round(-(cos(t) * x + sin(t) * y) + 25e-2, 9) AS t0, round(sin(t) * x - cos(t) * y, 9) AS t1, round(-z + 5e-1, 9) AS t2 FROM a""")
def j12_wrist_camera(spark, sf_dir):
    """Hands turned about z; the camera sits a fixed shift away."""
    t = (F.col("vec_id") % 64 + 1) / 16.0
    p = table(spark, sf_dir, "poses").select("vec_id", F.array("q1", "q2", "q3").alias("xyz"), F.array(F.lit(0.0), F.lit(0.0), F.sin(t / 2), F.cos(t / 2)).alias("quat"))
    out = episodes.wrist_camera(p, xyz="xyz", quat="quat", hand_to_camera=((1, 0, 0, 0, 1, 0, 0, 0, 1), (0.25, 0, 0.5)))
    r, s = (lambda k: F.round(F.element_at("cam_rotation", k + 1), 9)), (lambda k: F.round(F.element_at("cam_shift", k + 1), 9))
    return out.select("vec_id", r(0).alias("r0"), r(1).alias("r1"), r(3).alias("r3"), r(4).alias("r4"), s(0).alias("t0"), s(1).alias("t1"), s(2).alias("t2"))


@query("""SELECT g.episode_index, g.frame_index, count(*) AS n_points, count(l.label) AS n_labelled, max(a.x) AS anchor_x FROM grip g JOIN points p USING (episode_index, frame_index)
LEFT JOIN (SELECT episode_index, frame_index, point_id, label FROM points WHERE label > 1) l USING (episode_index, frame_index, point_id)
LEFT JOIN (SELECT episode_index, frame_index, avg(x) AS x FROM points WHERE label = 4 GROUP BY ALL) a USING (episode_index, frame_index) GROUP BY ALL""")
def j01_assemble(spark, sf_dir):
    p = table(spark, sf_dir, "points")
    anchor = p.filter("label = 4").groupBy(*_K).agg(F.avg("x").alias("anchor_x"))
    out = episodes.assemble(table(spark, sf_dir, "grip"), p.drop("label"), labels=p.filter("label > 1").select(*_K, "point_id", "label"), anchors=anchor)
    return out.groupBy(*_K).agg(F.count("*").alias("n_points"), F.count("label").alias("n_labelled"), F.max("anchor_x").alias("anchor_x"))


@query("SELECT ok, ln, CASE WHEN u % 7 = 0 THEN 0 WHEN u % 5 IN (1, 2) THEN u % 5 + 2 ELSE 0 END AS label FROM pixels")
def p17_pixel_labels(spark, sf_dir):
    px = table(spark, sf_dir, "pixels").select("ok", "ln", F.when(F.col("u") % 7 == 0, -1).otherwise(F.col("u") % 5).alias("geom_id"))
    lookup = spark.range(1, 3).select(F.col("id").cast("int").alias("geom_id"), (F.col("id") + 2).cast("int").alias("label"))
    return labels.pixel_labels(px, lookup).select("ok", "ln", "label")


@query("SELECT ok, ln, CAST(r + 256 * g AS INT) AS instance FROM pixels WHERE r > 31 AND CAST(r + 256 * g AS INT) <> 65535")
def p14_foreground(spark, sf_dir):
    px = table(spark, sf_dir, "pixels").select("ok", "ln", geometry.instance_id(F.col("r"), F.col("g"), F.lit(0)).alias("instance"))
    background = spark.range(65536).filter("id % 256 < 32").select(F.col("id").cast("int").alias("instance"))
    return labels.foreground(px, background).select("ok", "ln", "instance")


@query("""WITH d AS (SELECT ok, ln, episode_index, frame_index, CASE WHEN r % 16 = 0 THEN -1e0 WHEN r % 16 = 1 THEN NULL ELSE r / CASE WHEN episode_index % 2 = 0 THEN 256e0 ELSE 64e0 END END AS depth FROM pixels), c AS (SELECT *, CASE WHEN depth IS NULL OR depth < 0 THEN 0 ELSE depth END AS v FROM d)
SELECT ok, ln, v AS depth, max(v) OVER (PARTITION BY episode_index, frame_index) <= 1 AS normalised FROM c""")
def p16_valid_depth(spark, sf_dir):
    scale = F.when(F.col("episode_index") % 2 == 0, 256.0).otherwise(64.0)
    d = F.when(F.col("r") % 16 == 0, -1.0).when(F.col("r") % 16 == 1, float("nan")).otherwise(F.col("r") / scale)
    return labels.valid_depth(table(spark, sf_dir, "pixels").withColumn("depth", d), "depth", _K).select("ok", "ln", "depth", "normalised")


@query("SELECT episode_index, frame_index FROM frames WHERE episode_index % 2 = 0 AND frame_index < 20")
def p13_successful(spark, sf_dir):
    frames = table(spark, sf_dir, "frames").select(*_K)
    meta = frames.select("episode_index").distinct().select("episode_index", (F.col("episode_index") % 2 == 0).alias("success"), F.lit(20).alias("length"))
    return episodes.successful(meta, frames).select(*_K)


@query("SELECT episode_index, frame_index, value FROM frames")
def s10_merge_shards(spark, sf_dir):
    f = table(spark, sf_dir, "frames").select(*_K, "value")
    return episodes.merge_shards([f.filter(F.col("episode_index") % 3 == k) for k in range(3)], _K)


@query("SELECT episode_index, CAST(count(*) AS BIGINT) AS n FROM (SELECT episode_index, frame_index FROM frames UNION ALL SELECT episode_index, frame_index FROM frames WHERE episode_index % 5 = 0 AND frame_index = 0) GROUP BY episode_index, frame_index HAVING count(*) > 1")
def j20_shard_conflicts(spark, sf_dir):
    f = table(spark, sf_dir, "frames").select(*_K)
    return episodes.shard_conflicts(f.unionByName(f.filter("episode_index % 5 = 0 AND frame_index = 0")), _K).select("episode_index", "n")


@query("SELECT episode_index, frame_index FROM frames f ANTI JOIN detections d USING (episode_index, frame_index)")
def u04_missing_keys(spark, sf_dir):
    return episodes.missing_keys(table(spark, sf_dir, "frames"), table(spark, sf_dir, "detections"))


@query("SELECT p.episode_index, p.frame_index, p.point_id FROM points p WHERE p.frame_index % 2 = 0 AND abs(x) <= 25e-2 AND abs(y) <= 125e-3 AND abs(z - 5e-1) <= 25e-2")
def u03_points_in_boxes(spark, sf_dir):
    """The union over two overlapping boxes, each point once."""
    p = table(spark, sf_dir, "points")
    plain = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    box = lambda *v: geometry.box_from_vector(F.array(*(F.lit(float(x)) for x in v)))
    frames = p.filter("frame_index % 2 = 0").select(*_K).distinct()
    boxes = frames.select(*_K, F.explode(F.array(box(-0.0625, 0, 0.5, *plain, 0.375, 0.25, 0.5), box(0.0625, 0, 0.5, *plain, 0.375, 0.25, 0.5))).alias("box"))
    return geometry.points_in_boxes(p, boxes, by=_K).select(*_K, "point_id")


@query("""SELECT vec_id, 'position (' || printf('%.2f, %.2f, %.2f', q1, q2, q3) || '), rotation (' || printf('%.0f, %.0f, %.0f', q1 * 100, q2 * 100, q3 * 100) || '), gripper ' || CASE WHEN q4 > 5e-1 THEN 'open' ELSE 'closed' END AS plan FROM poses""")
def f32_plan_text(spark, sf_dir):
    xyz = [F.col(f"q{k}") for k in (1, 2, 3)]
    return table(spark, sf_dir, "poses").select("vec_id", conversation.plan_text(xyz, [c * 100 for c in xyz], F.col("q4")).alias("plan"))


@query("""WITH a AS (SELECT g.*, d.x AS dx FROM grip g LEFT JOIN (SELECT episode_index, frame_index, avg(x) AS x FROM points WHERE label = 4 GROUP BY ALL) d USING (episode_index, frame_index))
SELECT episode_index, frame_index, coalesce(dx, ex) AS centre_x, CAST(1 AS INT) AS n_anchors FROM a""")
def t04_choose_anchor(spark, sf_dir):
    """T4: the detector's anchors, the gripper where it found none."""
    xyz = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in "xyz"))
    found = anchors.label_anchor(table(spark, sf_dir, "points"), fallback=()).select(*_K, *(F.col(c).alias(f"d{c}") for c in "xyz"))
    g = table(spark, sf_dir, "grip").join(found, _K, "left")
    detector = F.when(F.col("dx").isNotNull(), F.array(xyz("d")))
    chosen = sampling.choose_anchor(F.lit(None).cast("struct<x:double,y:double,z:double>"), xyz("e"), detector, "detector", fallback="eef")
    return g.select(*_K, chosen.alias("a")).select(*_K, F.col("a")[0]["x"].alias("centre_x"), F.size("a").alias("n_anchors"))


@query("""WITH c AS (SELECT episode_index, frame_index, count(*) AS n FROM points GROUP BY ALL),
k AS (SELECT episode_index, frame_index, CAST(CASE WHEN n <= 64 THEN n ELSE least(floor(n * (8e-1 + 2e-1 * (((episode_index * 7919 + frame_index * 104729) % 1024) / 1024e0))), 64) END AS BIGINT) AS cap FROM c),
r AS (SELECT p.episode_index, p.frame_index, p.point_id, cap, row_number() OVER (PARTITION BY p.episode_index, p.frame_index ORDER BY (p.point_id * 7919 + p.ok * 31) % 1009 DESC, p.point_id) AS r FROM points p JOIN k USING (episode_index, frame_index))
SELECT episode_index, frame_index, point_id, cap FROM r WHERE r <= cap""")
def t02_capped_draw(spark, sf_dir):
    """A share of each cloud between 0.8 and 1, 64 points at most, drawn uniformly; shares and keys from the ids."""
    p = table(spark, sf_dir, "points")
    share = F.pmod(F.col("episode_index") * 7919 + F.col("frame_index") * 104729, F.lit(1024)) / 1024.0
    caps = p.groupBy(*_K).agg(F.count("*").alias("n")).select(*_K, sampling.draw_count(F.col("n"), 64, u=share).cast("long").alias("cap"))
    key = (F.pmod(F.col("point_id") * 7919 + F.col("ok") * 31, F.lit(1009)) + 1) / 1024.0
    drawn = sampling.finite_weighted_draw(p.join(caps, _K).withColumn("one", F.lit(1.0)), "one", 64, key=key, cap=F.col("cap"))
    return drawn.select(*_K, "point_id", "cap")


@query(f"""WITH a AS (SELECT *, role = 'user' AND contains(text, 'the') AS act FROM conversations), e AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (act) AS ends FROM a GROUP BY conv_id),
c AS (SELECT conv_id, ends[(conv_id * 7919) % (coalesce(len(ends), 0) + 1) + 1] AS cut FROM e),
r AS (SELECT a.conv_id, turn, role, text, cut, coalesce(lag(act) OVER (PARTITION BY a.conv_id ORDER BY turn), false) AS before FROM a JOIN c USING (conv_id))
SELECT conv_id, turn, role, CASE WHEN before AND role = 'assistant' AND (cut IS NULL OR turn <= cut) THEN '{conversation.PASS * 2}' ELSE text END AS text FROM r WHERE cut IS NULL OR turn <= cut + 1""")
def f26_truncated_conversations(spark, sf_dir):
    """cut at one of the user's turns with a marker, earlier replies passed over."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation.truncate_at_action(turns, "the", chunk=2, choice=F.col("conv_id") * 7919)


@query("""WITH r AS (SELECT episode_index, frame_index, row_number() OVER (PARTITION BY episode_index ORDER BY (episode_index * 31 + frame_index * 7919) % 1009, frame_index) AS r FROM frames) SELECT episode_index, frame_index FROM r WHERE r <= 3""")
def t10_random_frames(spark, sf_dir):
    key = F.pmod(F.col("episode_index") * 31 + F.col("frame_index") * 7919, F.lit(1009))
    return sampling.random_frames(table(spark, sf_dir, "frames").select(*_K), 3, key=key)


_CENTS = ", ".join(f"round(quantile_cont(c, {p}e-2), 7) AS p{p:02d}" for p in (1, 5, 25, 50, 75, 95, 99))


@query(f"""WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY (vec_id * 7919) % 10007, vec_id LIMIT 2000), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM s),
p AS (SELECT list_dot_product(a.v, b.v) / (a.n * b.n) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id)
SELECT count(*) AS pairs, {_CENTS} FROM p""")
def a32_pairwise_percentiles(spark, sf_dir):
    from demolake.operators.vectors import pairwise_cosine_percentiles

    out = pairwise_cosine_percentiles(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", order=F.pmod(F.col("vec_id") * 7919, F.lit(10007)))
    return out.select("pairs", *(F.round(c, 7).alias(c) for c in out.columns if c != "pairs"))


@query()
def f21_jittered_colours(spark, sf_dir):
    from demolake.functions.colour import jitter_colours

    p = table(spark, sf_dir, "points").select(*_K, "point_id", "r", "g", "b")
    return jitter_colours(p, by=_K, brightness=0.2, contrast=0.2, saturation=0.2, jitter_std=0.02, gamma=0.1)
