"""Queries over sample prompts, training texts, selected features, colours and the audit of draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from demolake.functions import colour, geometry
from demolake.operators import anchors, conversation, episodes, sampling, vectors
from demolake.plans.catalog import query
from demolake.plans.fixtures import table
from demolake.sources import tables

_K = ["episode_index", "frame_index"]
_IMAGE = "<|vision_start|><|image_pad|><|vision_end|>"


@query(f"""SELECT idx, 0 AS turn, 'user' AS role, repeat('{_IMAGE}', CAST(idx % 4 AS INT)) || CASE WHEN idx % 3 = 0 THEN '<|point_start|><|point_pad|><|point_end|>' ELSE '' END
  || CASE WHEN idx % 2 = 0 THEN '<|state_start|><|state_pad|><|state_end|>' ELSE '' END || task || '<|vla|>' AS content FROM frames UNION ALL SELECT idx, 1, 'assistant', '<|action_start|><|action_pad|><|action_end|>' FROM frames""")
def f25_monolithic_prompts(spark, sf_dir):
    """robot samples as two turns, the reply holding the action."""
    idx = F.col("idx")
    turns = conversation.monolithic_prompt(F.col("task"), idx % 4, points=idx % 3 == 0, state=idx % 2 == 0)
    return table(spark, sf_dir, "frames").select("idx", F.posexplode(turns).alias("turn", "t")).select("idx", "turn", "t.*")


@query(f"SELECT idx, 'user' AS role, repeat('{_IMAGE}', CAST(idx % 4 AS INT)) || task AS content FROM frames")
def f25_dual_prompts(spark, sf_dir):
    """robot samples as one turn, the actions apart."""
    return table(spark, sf_dir, "frames").select("idx", F.inline(conversation.dual_prompt(F.col("task"), F.col("idx") % 4)))


@query("""SELECT vec_id, 'Task: open the ' || CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END || ' drawer, State: ' || array_to_string([CAST(greatest(least(CAST(floor((CAST(embedding[k] AS DOUBLE) + 1) * 128) AS INT), 255), 0) AS VARCHAR) FOR k IN [1, 2, 3]], ' ') || chr(59) || chr(10) || 'Action: ' AS prompt FROM embeddings""")
def f25_state_prompts(spark, sf_dir):
    """an instruction and a discretised state as prompt text."""
    task = F.concat(F.lit(" open_the_"), F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right"), F.lit("\ndrawer "))
    bins = vectors.discretise(F.slice("embedding", 1, 3).cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", conversation.state_prompt(task, bins).alias("prompt"))


_SPELLED = "CASE CAST(idx % 7 AS INT) WHEN 0 THEN ' Positive' WHEN 1 THEN '1.0' WHEN 2 THEN 'TRUE ' WHEN 3 THEN 'bad' WHEN 4 THEN '0' WHEN 5 THEN 'unknown' END"


@query("SELECT idx, CASE WHEN idx % 7 < 3 THEN 'Advantage: positive' WHEN idx % 7 < 5 THEN 'Advantage: negative' END AS advantage FROM frames")
def f25_advantage_text(spark, sf_dir):
    """advantage labels of several spellings."""
    return table(spark, sf_dir, "frames").select("idx", conversation.advantage_text(F.expr(_SPELLED)).alias("advantage"))


@query("""WITH s AS (SELECT *, CASE WHEN frame_index < 10 THEN 'reach' WHEN frame_index < 30 THEN 'grasp' ELSE 'place' END AS own FROM frames)
SELECT episode_index, frame_index, CASE WHEN episode_index % 5 = 0 THEN task ELSE own END AS subtask, CASE WHEN episode_index % 5 = 0 THEN task ELSE 'reach grasp place' END AS whole,
  CASE WHEN episode_index % 5 <> 0 AND (idx * 7919) % 1000 < 250 THEN own ELSE task END AS mixed FROM s""")
def j18_training_texts(spark, sf_dir):
    """A frame's subtask, all of its episode's, or a mixture with the task; an episode without subtasks has its task."""
    none = F.col("episode_index") % 5 == 0
    ends = F.when(~none, F.array(F.lit(10), F.lit(30), F.lit(50)))
    texts = F.when(~none, F.array(F.lit("reach"), F.lit("grasp"), F.lit("place")))
    text = lambda mode, u=None: episodes.training_text(F.col("frame_index"), ends, texts, F.col("task"), mode, u=u)
    return table(spark, sf_dir, "frames").select(*_K, text("subtask").alias("subtask"), text("cumulate").alias("whole"), text("mix:0.25", (F.col("idx") * 7919) % 1000 / 1000.0).alias("mixed"))


@query("SELECT episode_index, frame_index, x + y * 2 AS state, label AS action FROM points WHERE point_id = 1")
def p01_features_by_prefix(spark, sf_dir):
    """The columns of a prefix, without marks of padding; and those of a list."""
    rows = table(spark, sf_dir, "points").filter("point_id = 1").selectExpr(*_K, "x AS `observation.state.a`", "y AS `observation.state.b`", "z AS `observation.state.a_is_pad`", "label AS `action.grip`", "z AS `action.grip_is_pad`")
    state, action = tables.features_of(rows, "observation.state"), tables.features_of(rows, "action", ["action.grip"])
    total = sum(((k + 1) * F.col(f"`{c}`") for k, c in enumerate(state)), F.lit(0.0))
    return rows.select(*_K, total.alias("state"), F.col(f"`{action[0]}`").alias("action"))


@query("SELECT ok, ln, r / 100e0 AS byte, (r + 256 * g) / 1000e0 AS short, (r + 256 * g + 65536 * b) / 256000e0 AS whole FROM pixels")
def s16_grey_depth(spark, sf_dir):
    """Grey depth of the three pixel types."""
    r, g, b = (F.col(c) for c in "rgb")
    of = lambda v, kind: geometry.depth_from_grey(v.cast("double"), kind)
    return table(spark, sf_dir, "pixels").select("ok", "ln", of(r, "uint8").alias("byte"), of(r + 256 * g, "uint16").alias("short"), of(r + 256 * g + 65536 * b, "int32").alias("whole"))


@query("""WITH g AS (SELECT DISTINCT episode_index, frame_index, view_id, u AS pu, v AS pv, (u - 32) / 64e0 AS x, (v - 24) / 64e0 AS y, (r + 1) / 256e0 AS z FROM pixels),
d AS (SELECT DISTINCT episode_index, frame_index, view_id, 8e0 + (episode_index * 7 + frame_index * 13 + view_id * 5) % 48 AS u, 4e0 + (episode_index * 11 + frame_index * 3 + view_id) % 40 AS v FROM pixels),
j AS (SELECT d.*, x, y, z, min(z) OVER (PARTITION BY d.episode_index, d.frame_index, d.view_id, d.u, d.v) AS m FROM d JOIN g ON g.episode_index = d.episode_index AND g.frame_index = d.frame_index AND g.view_id = d.view_id AND abs(pu - u) <= 6 AND abs(pv - v) <= 6)
SELECT episode_index, frame_index, view_id, u, v, median(x) AS x, median(y) AS y, median(z) AS z, count(*) AS n_support FROM j WHERE z <= m + 125e-3 GROUP BY ALL""")
def a12_nearest_surface(spark, sf_dir):
    """The median of the surface nearest to the camera, within an eighth of a metre."""
    p = table(spark, sf_dir, "pixels")
    e, f, w = F.col("episode_index"), F.col("frame_index"), F.col("view_id")
    grid = p.select(*_K, "view_id", F.col("u").alias("pu"), F.col("v").alias("pv"), ((F.col("u") - 32) / 64.0).alias("x"), ((F.col("v") - 24) / 64.0).alias("y"), ((F.col("r") + 1) / 256.0).alias("z")).distinct()
    d = p.select(*_K, "view_id", (8.0 + (e * 7 + f * 13 + w * 5) % 48).alias("u"), (4.0 + (e * 11 + f * 3 + w) % 40).alias("v")).distinct()
    return anchors.lift_from_pixels(d, grid, window=6, nearest=0.125)


_D2 = "((p.x - {x}) * (p.x - {x}) + (p.y - {y}) * (p.y - {y}) + (p.z - {z}) * (p.z - {z}))"
_BUMP = "exp(-" + _D2 + " / 125e-3)"


@query(f"""SELECT p.episode_index, p.frame_index, p.point_id, round(5e-2 + 95e-2 * CASE CAST(p.frame_index % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN {_BUMP.format(x="g.ex", y="g.ey", z="g.ez")}
  ELSE greatest({_BUMP.format(x="g.ex", y="g.ey", z="g.ez")}, {_BUMP.format(x="g.ey", y="g.ex", z="0")}, {_BUMP.format(x="5e-1", y="-25e-2", z="g.ez")}) END, 9) AS weight FROM points p JOIN grip g USING (episode_index, frame_index)""")
def j14_several_anchors(spark, sf_dir):
    """Weights by the nearest of three anchors, of one, or of none."""
    anchor = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    ex, ey, ez = (F.col(c) for c in ("ex", "ey", "ez"))
    three = F.array(anchor(ex, ey, ez), anchor(ey, ex, F.lit(0.0)), anchor(F.lit(0.5), F.lit(-0.25), ez))
    of_frame = table(spark, sf_dir, "grip").select(*_K, F.slice(three, F.lit(1), F.when(F.col("frame_index") % 3 == 0, 0).when(F.col("frame_index") % 3 == 1, 1).otherwise(3)).alias("anchors"))
    rows = table(spark, sf_dir, "points").join(of_frame, _K)
    return rows.select(*_K, "point_id", F.round(geometry.density_weight([F.col(c) for c in "xyz"], F.col("anchors"), 0.25, 0.05), 9).alias("weight"))


@query("SELECT vec_id, q1 AS x, -q2 AS y, -q3 AS z FROM poses")
def f16_camera_flip(spark, sf_dir):
    """F16: from a camera that looks along -z to one that looks along +z."""
    p = table(spark, sf_dir, "poses").select("vec_id", geometry.flip_camera_axes(F.array("q1", "q2", "q3")).alias("p"))
    return p.select("vec_id", *(F.element_at("p", k + 1).alias(c) for k, c in enumerate("xyz")))


_MEANS = ", ".join(f"{c} * 125e-2 AS {c}1, avg({c} * 125e-2) OVER (PARTITION BY episode_index, frame_index) AS {c}m" for c in "rgb")
_CONTRAST = ", ".join(f"({c}1 - {c}m) * (5e-1 + frame_index / 8e0) + {c}m AS {c}2" for c in "rgb")
_FINAL = ", ".join(f"round(pow(greatest(least((r2 + g2 + b2) / 3 + ({c}2 - (r2 + g2 + b2) / 3) * 75e-2, 1), 0), 15e-1), 9) AS {c}" for c in "rgb")


@query(f"WITH m AS (SELECT episode_index, frame_index, point_id, {_MEANS} FROM points), c AS (SELECT *, {_CONTRAST} FROM m) SELECT episode_index, frame_index, point_id, {_FINAL} FROM c")
def f21_adjusted_colours(spark, sf_dir):
    """Brightness, contrast about the cloud's mean, saturation and gamma, by given factors."""
    out = colour.adjust_colours(table(spark, sf_dir, "points"), by=_K, brightness=1.25, contrast=0.5 + F.col("frame_index") / 8.0, saturation=0.75, gamma=1.5)
    return out.select(*_K, "point_id", *(F.round(c, 9).alias(c) for c in "rgb"))


@query("""WITH d AS (SELECT p.*, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez)) AS distance FROM points p JOIN grip USING (episode_index, frame_index)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY distance, point_id) AS k FROM d) WHERE k <= 32),
a AS (SELECT episode_index, frame_index, count(*) AS n_points, count(*) FILTER (distance <= 5e-1) AS near_points FROM d GROUP BY ALL),
b AS (SELECT episode_index, frame_index, count(*) AS n_drawn, count(*) FILTER (distance <= 5e-1) AS near_drawn FROM s GROUP BY ALL),
q AS (SELECT episode_index, frame_index, count(*) AS centres FROM points WHERE label = 4 AND ok % 5 = 0 GROUP BY ALL),
c AS (SELECT *, (near_points > 0 AND (near_drawn / CAST(n_drawn AS DOUBLE)) / (near_points / CAST(n_points AS DOUBLE)) < 15e-1) OR n_drawn < least(n_points, 32) AS bad FROM a JOIN b USING (episode_index, frame_index) LEFT JOIN q USING (episode_index, frame_index))
SELECT count(*) AS n_frames, count(centres) AS n_anchored, count(*) - count(centres) AS n_fallback, round(avg(centres), 9) AS centres_per_frame, count(*) FILTER (bad) AS n_with_problems, median(n_drawn) AS median_drawn, median(n_drawn) / 32 AS drawn_share FROM c""")
def a35_audit_summary(spark, sf_dir):
    """Anchored and fallback frames, centres per frame, and the median drawn against the budget."""
    p = table(spark, sf_dir, "points")
    d = F.sqrt(geometry.squared_distance([F.col(c) for c in "xyz"], [F.col(f"e{c}") for c in "xyz"]))
    rows = p.join(table(spark, sf_dir, "grip"), _K).withColumn("distance", d)
    drawn = sampling.nearest_draw(rows, "distance", 32)
    out = sampling.audit_summary(sampling.audit_sampling(drawn, rows, sigma=0.5, budget=32), p.filter("label = 4 AND ok % 5 = 0"), budget=32)
    return out.withColumn("centres_per_frame", F.round("centres_per_frame", 9))
