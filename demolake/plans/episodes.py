"""Queries over episodes, frames and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from demolake.operators import conversation, episodes, sampling
from demolake.plans.catalog import query
from demolake.plans.fixtures import table

_K = ["episode_index", "frame_index"]


@query("""SELECT episode_index, frame_index, min(frame_index) OVER w AS first_frame, max(frame_index) OVER w AS last_frame, max(frame_index) OVER w - min(frame_index) OVER w + 1 AS length,
  frame_index / CAST(greatest(max(frame_index) OVER w, 1) AS DOUBLE) AS phase FROM frames WINDOW w AS (PARTITION BY episode_index)""")
def w01_bounds_and_phase(spark, sf_dir):
    """W1, W6."""
    return episodes.with_bounds(table(spark, sf_dir, "frames").select(*_K))


@query("""WITH a AS (SELECT episode_index, frame_index, value, coalesce(lead(value) OVER w, value) AS action, max(frame_index) OVER (PARTITION BY episode_index) AS last FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, frame_index, value, action FROM a WHERE frame_index < last""")
def w02_next_action(spark, sf_dir):
    return episodes.next_action(table(spark, sf_dir, "frames").select(*_K, "value"), "value")


@query("""WITH l AS (SELECT episode_index, max(frame_index) AS last FROM frames GROUP BY 1)
SELECT f.episode_index, f.frame_index, CAST(s.k AS INT) AS step, g.value, f.frame_index + s.k > l.last AS is_pad
FROM frames f JOIN l USING (episode_index) CROSS JOIN (SELECT unnest(range(4)) AS k) s
JOIN frames g ON g.episode_index = f.episode_index AND g.frame_index = least(f.frame_index + s.k, l.last)""")
def j03_action_chunk(spark, sf_dir):
    """By leads over one window, not by a self join."""
    return episodes.action_chunk(table(spark, sf_dir, "frames"), "value", 4)


@query("""SELECT f.episode_index, f.frame_index, d.x, d.y, d.z FROM frames f LEFT JOIN detections d ON d.episode_index = f.episode_index AND d.frame_index = f.frame_index - f.frame_index % 8""")
def j06_anchor_hold(spark, sf_dir):
    """An empty key frame overrides the one before."""
    d = table(spark, sf_dir, "detections").select(*_K, "x", "y", "z")
    return episodes.hold(table(spark, sf_dir, "frames").select(*_K), d, ["x", "y", "z"], stride=8)


@query("""WITH d AS (SELECT * FROM detections WHERE x IS NOT NULL)
SELECT f.episode_index, f.frame_index, d.x, d.y, d.z FROM frames f ASOF LEFT JOIN d ON d.episode_index = f.episode_index AND d.frame_index <= f.frame_index""")
def j06_anchor_hold_last_found(spark, sf_dir):
    """The other mode: empty key frames are passed over."""
    d = table(spark, sf_dir, "detections").filter("x IS NOT NULL").select(*_K, "x", "y", "z")
    return episodes.hold(table(spark, sf_dir, "frames").select(*_K), d, ["x", "y", "z"], keep_empty=False)


@query("""WITH d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM detections WHERE x IS NOT NULL WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, frame_index, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS jitter FROM d""")
def w05_replan_jitter(spark, sf_dir):
    d = table(spark, sf_dir, "detections").filter("x IS NOT NULL").select(*_K, "x", "y", "z")
    return episodes.replan_jitter(d).select(*_K, "jitter")


@query("""WITH n AS (SELECT source_episode, set_name, count(*) AS n FROM targets GROUP BY ALL)
SELECT f.episode_index, f.frame_index, m.source_episode, n.set_name, t.x, t.y, t.z FROM frames f LEFT JOIN epmap m USING (episode_index) LEFT JOIN n USING (source_episode)
LEFT JOIN targets t ON t.source_episode = m.source_episode AND t.set_name = n.set_name AND t.frame_index = CASE WHEN n.n = 1 THEN 0 ELSE f.frame_index END""")
def j05_truth_join(spark, sf_dir):
    """Through the episode map; episodes with one row answer for every frame."""
    out = episodes.join_targets(table(spark, sf_dir, "frames").select(*_K), table(spark, sf_dir, "epmap"), table(spark, sf_dir, "targets"))
    return out.select(*_K, "source_episode", "set_name", "x", "y", "z")


@query("""WITH s AS (SELECT source_episode, set_name, frame_index, x, y, z FROM targets), f AS (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(z) OVER w AS fz FROM s WINDOW w AS (PARTITION BY source_episode, set_name ORDER BY frame_index)),
m AS (SELECT set_name, source_episode, max(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy) + (z - fz) * (z - fz))) AS m FROM f GROUP BY ALL)
SELECT set_name, count(*) AS episodes, median(m) AS median_travel, max(m) AS max_travel FROM m GROUP BY set_name""")
def a25_target_travel(spark, sf_dir):
    from demolake.operators.anchors import target_motion

    return target_motion(table(spark, sf_dir, "targets"))[1]


@query("""SELECT count(*) AS n, median(d) AS median, min(d) AS min, max(d) AS max FROM (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
FROM targets a JOIN targets b USING (source_episode, frame_index) WHERE a.set_name = 'target' AND b.set_name = 'distractor')""")
def a25_target_separation(spark, sf_dir):
    from demolake.operators.anchors import target_motion

    return target_motion(table(spark, sf_dir, "targets"))[0]


@query("""WITH n AS (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT episode_index + 100000 AS source_episode, frame_index, value FROM frames),
a AS (SELECT f.*, greatest(n.n - 1, 1) AS k FROM frames f JOIN n USING (episode_index)),
h AS (SELECT a.episode_index, s.source_episode, any_value(a.k) AS k, count(*) AS hits FROM a JOIN s ON s.frame_index = a.frame_index AND s.value = a.value WHERE a.frame_index < a.k GROUP BY ALL),
m AS (SELECT episode_index, min(source_episode) AS source_episode, count(*) AS matches FROM h WHERE hits = k GROUP BY 1)
SELECT n.episode_index, CASE WHEN matches = 1 THEN source_episode END AS source_episode, coalesce(matches, 0) AS matches FROM n LEFT JOIN m USING (episode_index)""")
def j09_match_sequences(spark, sf_dir):
    mine = table(spark, sf_dir, "frames").select(*_K, "value")
    return episodes.match_sequences(mine, mine.withColumn("episode_index", F.col("episode_index") + 100000), "value")


@query("""WITH l AS (SELECT episode_index, count(*) AS length FROM frames GROUP BY 1)
SELECT count(*) FILTER (a.length = b.length) AS n_ok, count(*) AS n_total FROM epmap LEFT JOIN l a USING (episode_index) LEFT JOIN l b ON b.episode_index = source_episode""")
def j10_verify_map(spark, sf_dir):
    lengths = table(spark, sf_dir, "frames").groupBy("episode_index").agg(F.count("*").alias("length"))
    return episodes.verify_map(table(spark, sf_dir, "epmap"), lengths, lengths)


@query("""SELECT episode_index, frame_index, CASE WHEN frame_index < 10 THEN 'reach' WHEN frame_index < 30 THEN 'grasp' ELSE 'place' END AS subtask,
  CASE WHEN frame_index < 10 THEN 'reach' WHEN frame_index < 30 THEN 'reach grasp' ELSE 'reach grasp place' END AS so_far FROM frames""")
def j18_subtasks(spark, sf_dir):
    ends, texts = F.array(F.lit(10), F.lit(30), F.lit(50)), F.array(F.lit("reach"), F.lit("grasp"), F.lit("place"))
    frame = F.col("frame_index")
    return table(spark, sf_dir, "frames").select(*_K, episodes.subtask_text(frame, ends, texts).alias("subtask"), episodes.subtask_text(frame, ends, texts, cumulate=True).alias("so_far"))


@query("""WITH s AS (SELECT event_type AS dataset, count(*) AS n, row_number() OVER (ORDER BY event_type) AS position FROM events GROUP BY 1), u AS (SELECT dataset, sum(n) OVER (ORDER BY position) - n AS lo, sum(n) OVER (ORDER BY position) AS hi FROM s)
SELECT event_id AS idx, dataset, CAST(event_id - lo AS BIGINT) AS local_index FROM events JOIN u ON event_id >= lo AND event_id < hi""")
def j19_locate_global(spark, sf_dir):
    from pyspark.sql.window import Window

    events = table(spark, sf_dir, "events")
    sizes = events.groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n")).withColumn("position", F.row_number().over(Window.orderBy("dataset")))
    return episodes.locate_global(events.select(F.col("event_id").alias("idx")), sizes)


@query("SELECT episode_index, frame_index FROM frames WHERE frame_index % 8 = 0 AND frame_index >= 8 AND frame_index < 64")
def p10_key_frames(spark, sf_dir):
    return episodes.key_frames(table(spark, sf_dir, "frames").select(*_K), 8, low=8, high=64)


@query("SELECT episode_index, frame_index FROM frames f ANTI JOIN (SELECT * FROM detections WHERE x IS NOT NULL) d USING (episode_index, frame_index)")
def s13_pending(spark, sf_dir):
    """S13, U4."""
    return episodes.pending(table(spark, sf_dir, "frames").select(*_K), table(spark, sf_dir, "detections").filter("x IS NOT NULL"), _K)


@query("SELECT episode_index, CAST(row_number() OVER (ORDER BY episode_index) - 1 AS INT) AS new_index FROM (SELECT DISTINCT episode_index FROM frames WHERE episode_index % 7 <> 0)")
def s08_renumber(spark, sf_dir):
    out = episodes.renumber(table(spark, sf_dir, "frames").select("episode_index").distinct(), F.col("episode_index") % 7 != 0)
    return out.withColumn("new_index", F.col("new_index").cast("int"))


@query("""WITH n AS (SELECT l_suppkey AS episode_index, CAST(l_linenumber AS BIGINT) AS frame_index, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, CAST(sum(n) OVER w - n AS BIGINT) AS begins, CAST(sum(n) OVER w AS BIGINT) AS ends FROM n WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""")
def w08_point_offsets(spark, sf_dir):
    counts = table(spark, sf_dir, "points").groupBy(*_K).agg(F.count("*").alias("n"))
    return episodes.offsets_of(counts)


@query("SELECT l_suppkey AS episode_index, CAST(l_linenumber AS BIGINT) AS frame_index, l_orderkey AS ok FROM lineitem")
def s07_ragged_to_rows(spark, sf_dir):
    """Points gathered per episode with offsets, and back to rows."""
    p = table(spark, sf_dir, "points").select(*_K, "ok")
    per_frame = p.groupBy(*_K).agg(F.collect_list("ok").alias("p"))
    per_episode = per_frame.groupBy("episode_index").agg(F.array_sort(F.collect_list(F.struct("frame_index", "p"))).alias("f"))
    sizes = F.transform("f", lambda s: F.size(s["p"]))
    packed = per_episode.select(
        "episode_index",
        F.transform("f", lambda s: s["frame_index"]).alias("names"),
        F.transform(F.flatten(F.col("f.p")), lambda k: F.struct(k.alias("ok"))).alias("points"),
        F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(1), F.size("f")), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b))).alias("offsets"),
    )
    frames, points = episodes.frame_rows(packed, ["names"], points="points", offsets="offsets")
    return frames.join(points, _K).select("episode_index", F.col("names").alias("frame_index"), "ok")


@query("""WITH n AS (SELECT episode_index, frame_index, frame_index % 5 AS n FROM frames WHERE frame_index % 3 <> 0), j AS (SELECT f.episode_index, f.frame_index, f.task = 'purchase' AS s, coalesce(n, 0) AS n FROM frames f LEFT JOIN n USING (episode_index, frame_index))
SELECT episode_index, bool_or(s) AS success, coalesce(min(frame_index) FILTER (s), -1) AS first_success, count(*) AS length, min(n) AS min_points, max(n) AS max_points, avg(n) AS mean_points FROM j GROUP BY 1""")
def a36_episode_summary(spark, sf_dir):
    frames = table(spark, sf_dir, "frames")
    counts = frames.filter("frame_index % 3 <> 0").select(*_K, (F.col("frame_index") % 5).alias("n"))
    return episodes.episode_summary(frames.select(*_K, "task"), counts, F.col("task") == "purchase")


@query("SELECT episode_index, min(frame_index) AS grasp_frame, arg_min(value, frame_index) AS value FROM frames WHERE value > 5e1 GROUP BY 1")
def w13_grasp_anchor(spark, sf_dir):
    return episodes.grasp_anchor(table(spark, sf_dir, "frames"), F.col("value") > 50.0, ["value"])


@query("SELECT episode_index, CAST(max(frame_index) + 1 AS BIGINT) AS length FROM frames GROUP BY 1")
def s06_frame_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "frames").select(episodes.frame_key().alias("key"))
    e, f = episodes.parse_frame_key("key")
    return episodes.episode_lengths(keys.select(e.alias("episode_index"), f.alias("frame_index")))


@query("SELECT episode_index, frame_index, 'a' AS dataset, value, NULL::VARCHAR AS task FROM frames WHERE episode_index % 2 = 0 UNION ALL SELECT episode_index, frame_index, 'b', NULL, task FROM frames WHERE episode_index % 2 = 1")
def u01_concat_datasets(spark, sf_dir):
    f = table(spark, sf_dir, "frames")
    return episodes.concat_datasets({"a": f.filter("episode_index % 2 = 0").select(*_K, "value"), "b": f.filter("episode_index % 2 = 1").select(*_K, "task")})


@query("WITH t AS (SELECT role AS task, min(turn) AS position FROM conversations WHERE trim(role) <> '' GROUP BY 1) SELECT task, position FROM t")
def s04_instructions(spark, sf_dir):
    return conversation.instructions(table(spark, sf_dir, "conversations"), "role", "turn").select(F.col("role").alias("task"), "position")


@query("""SELECT conv_id, turn, CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END AS role, replace('look <|vision_start|><|image_pad|><|vision_end|>then ' || text, ' <', '<') AS text
FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role, text FROM conversations)""")
def f25_tokens_and_roles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    source = c.select("conv_id", "turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("role"), F.concat(F.lit("look <image>\nthen "), "text").alias("text"))
    return source.select("conv_id", "turn", conversation.map_role(F.col("role")).alias("role"), conversation.replace_tokens(F.col("text")).alias("text"))


@query("""WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'OpenDrawer' ELSE 'PickPlaceCounterToStove' END AS task, CASE WHEN turn % 2 = 0 THEN 'Open the ' || CASE WHEN conv_id % 2 = 0 THEN 'Left' ELSE 'right' END || ' drawer.' ELSE 'Pick the ' || role || ' from the plate' END AS i, role FROM conversations)
SELECT conv_id, turn, CAST(0 AS INT) AS query_id, CASE WHEN turn % 2 = 0 THEN 'Point to the handle of the ' || CASE WHEN conv_id % 2 = 0 THEN 'left' ELSE 'right' END || ' drawer.' ELSE 'Point to the ' || role || '.' END AS query FROM q
UNION ALL SELECT conv_id, turn, 1, 'Point to the pan.' FROM q WHERE turn % 2 = 1""")
def f23_pointing_queries(spark, sf_dir):
    even = F.col("turn") % 2 == 0
    side = F.when(F.col("conv_id") % 2 == 0, "Left").otherwise("right")
    instruction = F.when(even, F.concat(F.lit("Open the "), side, F.lit(" drawer."))).otherwise(F.concat(F.lit("Pick the "), "role", F.lit(" from the plate")))
    q = conversation.pointing_queries(F.when(even, "OpenDrawer").otherwise("PickPlaceCounterToStove"), instruction)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(q).alias("query_id", "query"))


@query("""WITH f AS (SELECT conv_id, min(turn) AS cut FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_alternatives FROM (SELECT conv_id, unnest(string_split(role || '<br> ' || '<br>' || text, '<br>')) AS a FROM conversations) WHERE trim(a) <> '' GROUP BY conv_id""")
def f24_alternatives(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", conversation.alternatives(F.concat("role", F.lit("<br> <br>"), "text")).alias("a"))
    return c.groupBy("conv_id").agg(F.sum(F.size("a")).alias("n_alternatives"))


@query("""WITH d AS (SELECT doc_id, source || ' ' || doc_id || ' ' || (doc_id % 7) AS a, lang || ' ' || n_chars || ' 1' AS b FROM documents)
SELECT doc_id, CAST(0 AS INT) AS position, string_split(a, ' ')[1] AS repo, CAST(string_split(a, ' ')[2] AS BIGINT) AS idx, CAST(string_split(a, ' ')[3] AS INT) AS chunk FROM d
UNION ALL SELECT doc_id, 1, string_split(b, ' ')[1], CAST(string_split(b, ' ')[2] AS BIGINT), CAST(string_split(b, ' ')[3] AS INT) FROM d""")
def j16_record_references(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.concat_ws(" ", "source", "doc_id", F.col("doc_id") % 7), F.concat_ws(" ", "lang", "n_chars", F.lit(1))).alias("refs"))
    return conversation.record_references(d, "refs", "doc_id")


@query("SELECT lang AS instruction FROM documents EXCEPT SELECT 'en'")
def j15_missing_contexts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("instruction"))
    return conversation.missing_contexts(d, d.filter("instruction = 'en'"), "instruction")


@query("SELECT doc_id, n_chars FROM documents WHERE coalesce(n_chars, 0) <= 1000")
def p11_cap_length(spark, sf_dir):
    return conversation.cap_length(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 1000, "n_chars")


@query("""WITH r AS (SELECT episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS i, count(*) OVER () AS n FROM frames)
SELECT episode_index, frame_index FROM r WHERE i % greatest(floor(n / 50e0), 1) = 0 AND i < greatest(floor(n / 50e0), 1) * 50""")
def t09_spread_probes(spark, sf_dir):
    return sampling.spread_probes(table(spark, sf_dir, "frames").select(*_K), 50, _K)


@query("SELECT episode_index, frame_index FROM frames ORDER BY episode_index DESC, frame_index DESC LIMIT CAST(ceil((SELECT count(*) FROM frames) * 5 / 100e0) AS BIGINT)")
def t07_take_strategy(spark, sf_dir):
    return sampling.take_strategy(table(spark, sf_dir, "frames").select(*_K), "end:5%", _K)


@query("SELECT CAST((SELECT count(*) FROM frames) * 5e-1 AS BIGINT) AS n_slots")
def t08_resample(spark, sf_dir):
    return sampling.resample(table(spark, sf_dir, "frames").select(*_K), 0.5, _K).agg(F.count_distinct("slot").alias("n_slots"))
