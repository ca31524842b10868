"""Episode and frame tables: chunks, holds, phases, identity of sequences, maps, subtasks, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = ("episode_index", "frame_index")


def _episode(order: str = "frame_index", episode: str = "episode_index"):
    return Window.partitionBy(episode).orderBy(order)


def with_bounds(frames: DataFrame) -> DataFrame:
    """First and last frame of the episode, its length, and the phase in [0, 1]."""
    whole = Window.partitionBy("episode_index")
    first, last = F.min("frame_index").over(whole), F.max("frame_index").over(whole)
    return frames.withColumns({"first_frame": first, "last_frame": last, "length": last - first + 1, "phase": F.col("frame_index") / F.greatest(last, F.lit(1))})


def next_action(frames: DataFrame, pose: str, *, keep_stop: bool = False) -> DataFrame:
    """Key steps to frames: the action is the next pose, the last one repeats itself; the stop row goes unless kept."""
    out = frames.withColumn("action", F.coalesce(F.lead(pose).over(_episode()), F.col(pose)))
    if keep_stop:
        return out
    last = F.max("frame_index").over(Window.partitionBy("episode_index"))
    return out.withColumn("_last", last).filter(F.col("frame_index") < F.col("_last")).drop("_last")


def action_chunk(frames: DataFrame, value: str, size: int, *, keys: Sequence[str] = ("episode_index", "frame_index")) -> DataFrame:
    """One row per frame and step: the value ``step`` frames on, clamped to the episode's last, and whether it lies past the end."""
    w = _episode()
    last = F.last(value).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    left = F.count("*").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)) - 1
    steps = [F.struct(F.lit(k).alias("step"), F.when(left >= k, F.lead(value, k).over(w)).otherwise(last).alias("value"), (left < k).alias("is_pad")) for k in range(size)]
    wide = frames.select(*keys, *(s.alias(f"_{k}") for k, s in enumerate(steps)))
    return wide.select(*keys, F.inline(F.array(*(F.col(f"_{k}") for k in range(size)))))


def hold(frames: DataFrame, keyed: DataFrame, columns: Sequence[str], *, stride: int | None = None, keep_empty: bool = True) -> DataFrame:
    """Values of key frames held until the next one; nothing before the first.

    keep_empty: a key frame whose value is null overrides the one before it
    (``stride`` then tells which frames are key frames, if keyed lacks some).
    Otherwise it is passed over.
    """
    has = F.lit(True) if keep_empty else F.coalesce(*(F.col(c) for c in columns)).isNotNull()
    rows = keyed.filter(has).select(*FRAME, F.struct(*columns).alias("_v"))
    joined = frames.join(rows, list(FRAME), "left")
    key = F.col("_v").isNotNull()
    if stride and keep_empty:
        key = key | (F.col("frame_index") % stride == 0)
    held = F.last(F.when(key, F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(_episode().rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("_h", held).select(*frames.columns, *(F.col(f"_h.v.{c}").alias(c) for c in columns))


def replan_jitter(anchored: DataFrame, xyz: Sequence[str] = ("x", "y", "z"), out: str = "jitter") -> DataFrame:
    """Distance to the previous anchored key frame of the episode."""
    w = _episode()
    d = reduce(lambda a, b: a + b, [(F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in xyz])
    return anchored.withColumn(out, F.sqrt(d))


def displacement(rows: DataFrame, episode: Sequence[str], xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Distance from the position at the first frame."""
    w = Window.partitionBy(*episode).orderBy("frame_index")
    d = reduce(lambda a, b: a + b, [(F.col(c) - F.first(c).over(w)) * (F.col(c) - F.first(c).over(w)) for c in xyz])
    return rows.withColumn("displacement", F.sqrt(d))


def join_targets(frames: DataFrame, episode_map: DataFrame, targets: DataFrame) -> DataFrame:
    """Ground truth of each frame and target set through the episode map.

    An episode with one row per set answers for every frame, others for their own frames only; no map row
    or no such frame gives null.
    """
    static = F.count("*").over(Window.partitionBy("source_episode", "set_name")) == 1
    known = targets.withColumn("is_static", static)
    mapped = frames.join(episode_map, "episode_index", "left")
    one = known.filter("is_static").drop("frame_index", "is_static")
    many = known.filter("NOT is_static").drop("is_static")
    sets = known.select("source_episode", "set_name", "is_static").distinct()
    asked = mapped.join(sets, "source_episode", "left")
    still = asked.filter("is_static").join(one, ["source_episode", "set_name"], "left")
    moving = asked.filter("NOT is_static OR is_static IS NULL").join(many, ["source_episode", "set_name", "frame_index"], "left")
    return still.unionByName(moving.select(*still.columns)).drop("is_static")


def frame_rows(episodes: DataFrame, arrays: Sequence[str], *, points: str | None = None, offsets: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Episode rows with per-frame arrays (and points with offsets of length T + 1) to frame rows and point rows."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("frame_index", "_z")
    frames = episodes.select("episode_index", zipped).select("episode_index", "frame_index", *(F.col(f"_z.{a}").alias(a) for a in arrays))
    if points is None:
        return frames, None
    pieces = F.transform(F.sequence(F.lit(0), F.size(offsets) - 2), lambda i: F.slice(F.col(points), F.element_at(offsets, i + 1) + 1, F.element_at(offsets, i + 2) - F.element_at(offsets, i + 1)))
    each = episodes.select("episode_index", F.posexplode(pieces).alias("frame_index", "_p"))
    return frames, each.select("episode_index", "frame_index", F.posexplode("_p").alias("point_id", "_q")).select("episode_index", "frame_index", "point_id", "_q.*")


def check_offsets(episodes: DataFrame, arrays: Sequence[str], points: str, offsets: str) -> DataFrame:
    """Episodes whose arrays differ in length, or whose offsets don't start at 0, rise, and end at the number of points."""
    size = F.size(arrays[0])
    equal = reduce(lambda a, b: a & b, [F.size(a) == size for a in arrays], F.size(offsets) == size + 1)
    rising = F.forall(F.sequence(F.lit(1), F.size(offsets) - 1), lambda i: F.element_at(offsets, i) <= F.element_at(offsets, i + 1))
    fine = equal & (F.element_at(offsets, 1) == 0) & (F.element_at(offsets, -1) == F.size(points)) & rising
    return episodes.filter(~fine).select("episode_index")


def offsets_of(counts: DataFrame) -> DataFrame:
    """Where each frame's points begin and end within its episode; counts: episode_index, frame_index, n."""
    upto = F.sum("n").over(_episode().rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"begins": upto - F.col("n"), "ends": upto})


def renumber(episodes: DataFrame, kept: Column | None = None) -> DataFrame:
    """A dense index of the retained episodes in source order, numbered within sorted ranges."""
    from demolake.operators.sampling import ranged_rows

    rows = episodes if kept is None else episodes.filter(kept)
    return ranged_rows(rows, [F.col("episode_index")]).withColumnRenamed("_i", "new_index")


def match_sequences(mine: DataFrame, source: DataFrame, value: str = "action") -> DataFrame:
    """The one source episode whose first max(1, n - 1) values equal an episode's own: episode_index, source_episode, matches.

    An episode is asked as one hash of its first values and their number; a source
    offers the hash of each of its beginnings whose length is asked for. Only pairs
    of equal hash and length are compared value by value, so that common first
    values pair nothing. Not exactly one match: source_episode is null.
    """
    n = F.count("*").over(Window.partitionBy("episode_index"))
    asked = mine.withColumn("_n", F.greatest(n - 1, F.lit(1))).filter(F.col("frame_index") < F.col("_n")).select("episode_index", "frame_index", F.col(value).alias("_v"), "_n")
    known = source.select(F.col("episode_index").alias("source_episode"), F.col("frame_index").alias("_f"), F.col(value).alias("_w"))
    one = lambda frame, v: F.xxhash64(frame, v.isNull(), v).cast("decimal(38,0)")
    heads = asked.groupBy("episode_index", "_n").agg(F.sum(one(F.col("frame_index"), F.col("_v"))).alias("_h"))
    upto = Window.partitionBy("source_episode").orderBy("_f").rowsBetween(Window.unboundedPreceding, 0)
    begins = known.select("source_episode", (F.col("_f") + 1).alias("_n"), F.sum(one(F.col("_f"), F.col("_w"))).over(upto).alias("_h"))
    start = heads.join(begins, ["_n", "_h"]).select("episode_index", "source_episode")
    pairs = asked.join(start, "episode_index").join(known.withColumnRenamed("source_episode", "_s"), (F.col("source_episode") == F.col("_s")) & (F.col("frame_index") == F.col("_f")) & F.col("_v").eqNullSafe(F.col("_w")))
    whole = pairs.groupBy("episode_index", "source_episode", "_n").agg(F.count("*").alias("_hits")).filter("_hits = _n")
    found = whole.groupBy("episode_index").agg(F.count("*").alias("matches"), F.min("source_episode").alias("source_episode"))
    return mine.select("episode_index").distinct().join(found, "episode_index", "left").select("episode_index", F.when(F.col("matches") == 1, F.col("source_episode")).alias("source_episode"), F.coalesce("matches", F.lit(0)).alias("matches"))


def verify_map(episode_map: DataFrame, lengths: DataFrame, source_lengths: DataFrame) -> DataFrame:
    """How many map rows lead to a source of the same length: n_ok, n_total."""
    rows = episode_map.join(lengths.select("episode_index", "length"), "episode_index", "left").join(source_lengths.select(F.col("episode_index").alias("source_episode"), F.col("length").alias("_l")), "source_episode", "left")
    return rows.agg(F.count_if(F.col("length") == F.col("_l")).alias("n_ok"), F.count("*").alias("n_total"))


def subtask_text(frame: Column, ends: Column, texts: Column, *, cumulate: bool = False) -> Column:
    """The subtask whose interval ends after the frame, the last one past the end; or all texts so far, joined."""
    i = F.least(F.size(F.filter(ends, lambda e: e <= frame)) + 1, F.size(texts))
    return F.array_join(F.slice(texts, 1, i), " ") if cumulate else F.element_at(texts, i)


def training_text(frame: Column, ends: Column, texts: Column, task: Column, mode: str, *, u: Column | None = None) -> Column:
    """The text that a frame is trained with: its ``subtask``, all subtasks of the episode (``cumulate``), or for ``mix:w`` its subtask with probability w and else the task. Without subtasks the task; ``u`` in [0, 1) decides mixtures."""
    kind, _, share = mode.partition(":")
    if kind not in ("subtask", "cumulate", "mix") or (kind == "mix") != bool(share):
        raise ValueError(f"mode is subtask, cumulate or mix:w, not {mode}")
    if kind == "mix" and u is None:
        raise ValueError("a mixture needs u")
    own = F.array_join(texts, " ") if kind == "cumulate" else subtask_text(frame, ends, texts)
    chosen = own if kind != "mix" else F.when(u < float(share), own).otherwise(task)
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, chosen).otherwise(task)


def locate_global(indices: DataFrame, sizes: DataFrame, index: str = "idx") -> DataFrame:
    """The dataset of a global row index over concatenated datasets (dataset, position, n), and the local index. The few datasets are broadcast."""
    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    upto = sizes.withColumn("_hi", F.sum("n").over(w)).withColumn("_lo", F.col("_hi") - F.col("n"))
    return indices.join(F.broadcast(upto), (F.col(index) >= F.col("_lo")) & (F.col(index) < F.col("_hi"))).withColumn("local_index", F.col(index) - F.col("_lo")).drop("_lo", "_hi", "position", "n")


def assemble(frames: DataFrame, points: DataFrame, *, labels: DataFrame | None = None, anchors: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Samples: frames with their points (required), and labels, anchors and targets where there are any. All joins share the frame key."""
    out = frames.join(points, list(FRAME))
    for other, extra in ((labels, ["point_id"]), (anchors, []), (targets, [])):
        if other is not None:
            out = out.join(other, [*FRAME, *extra], "left")
    return out


def assemble_by_frame(frames: DataFrame, points: DataFrame, *, labels: DataFrame | None = None, anchors: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """As assemble, but the labels (point_id, label) of a frame travel as one map: all joins are by the frame alone, which tables that are bucketed by it need no shuffle for. A point that is labelled twice is an error."""
    out = frames.join(points, list(FRAME))
    if labels is not None:
        packed = labels.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("point_id", "label"))).alias("_labels"))
        out = out.join(packed, list(FRAME), "left").withColumn("label", F.try_element_at("_labels", F.col("point_id"))).drop("_labels")
    for other in (anchors, targets):
        if other is not None:
            out = out.join(other, list(FRAME), "left")
    return out


def missing_keys(asked: DataFrame, known: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    return asked.select(*keys).distinct().join(known.select(*keys).distinct(), list(keys), "left_anti")


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't in the output yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows of shards with the same columns; a key found twice raises an error when read."""
    if len({tuple(sorted(s.columns)) for s in shards}) > 1:
        raise ValueError("shards differ in their columns")
    rows = reduce(DataFrame.unionByName, shards)
    first = rows.columns[0]
    seen = F.count("*").over(Window.partitionBy(*keys))
    fine = F.when(F.col("_n") == 1, F.col(first)).otherwise(F.raise_error(F.lit("a key stands in several shards")).cast(rows.schema[first].dataType))
    return rows.withColumn("_n", seen).withColumn(first, fine).drop("_n")


def shard_conflicts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def concat_datasets(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of all datasets by column name, absent columns null, with the dataset's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("dataset", F.lit(name)) for name, df in parts.items()])


def key_frames(frames: DataFrame, stride: int, *, low: int = 0, high: int | None = None) -> DataFrame:
    out = frames.filter((F.col("frame_index") % stride == 0) & (F.col("frame_index") >= low))
    return out if high is None else out.filter(F.col("frame_index") < high)


def parse_frame_key(key: str | Column) -> tuple[Column, Column]:
    parts = F.split(F.col(key) if isinstance(key, str) else key, "-")
    return F.element_at(parts, 1).cast("long"), F.element_at(parts, 2).cast("long")


def frame_key() -> Column:
    return F.concat_ws("-", "episode_index", "frame_index")


def episode_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("episode_index").agg((F.max("frame_index") + 1).alias("length"))


def episode_summary(frames: DataFrame, counts: DataFrame, success: Column) -> DataFrame:
    """Success, its first frame (-1: none), length, and point counts per frame (0 when empty)."""
    joined = frames.withColumn("_s", success).join(counts, list(FRAME), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.groupBy("episode_index").agg(
        F.max("_s").alias("success"),
        F.coalesce(F.min(F.when(F.col("_s"), F.col("frame_index"))), F.lit(-1)).alias("first_success"),
        F.count("*").alias("length"),
        F.min(n).alias("min_points"),
        F.max(n).alias("max_points"),
        F.avg(n).alias("mean_points"),
    )


def grasp_anchor(frames: DataFrame, closed: Column, xyz: Sequence[str]) -> DataFrame:
    """The position at each episode's first frame with a closed gripper."""
    return frames.filter(closed).groupBy("episode_index").agg(F.min("frame_index").alias("grasp_frame"), *(F.min_by(c, "frame_index").alias(c) for c in xyz))


def successful(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of successful episodes, up to the length that the episode table gives. episodes: episode_index, success, length."""
    kept = episodes.filter("success").select("episode_index", F.col("length").alias("_n"))
    return frames.join(kept, "episode_index").filter(F.col("frame_index") < F.col("_n")).drop("_n")


def wrist_camera(frames: DataFrame, *, xyz: str, quat: str, hand_to_camera: tuple[Sequence[float], Sequence[float]], rotation: str = "cam_rotation", shift: str = "cam_shift") -> DataFrame:
    """The base-to-camera motion of each frame: the fixed hand-to-camera motion after the inverse of the hand's pose (quaternion xyzw)."""
    from demolake.functions.geometry import rigid_compose, rigid_inverse
    from demolake.functions.rotation import quat_to_matrix

    rows = frames.withColumn("_r", quat_to_matrix(F.col(quat), "xyzw"))
    back_r, back_t = rigid_inverse(F.col("_r"), F.col(xyz))
    rows = rows.withColumn("_br", back_r).withColumn("_bt", back_t)
    fixed = [F.array(*(F.lit(float(x)) for x in part)) for part in hand_to_camera]
    r, t = rigid_compose(fixed[0], fixed[1], F.col("_br"), F.col("_bt"))
    return rows.withColumn(rotation, r).withColumn(shift, t).drop("_r", "_br", "_bt")


def state_action_stats(frames: DataFrame, vector: str, *, width: int, centres: DataFrame | None = None, xyz: tuple[int, int] | None = None, rotation: tuple[int, int, str, str] | None = None, quantiles: Sequence[float] = (0.01, 0.1, 0.5, 0.9, 0.99), exact: bool = True) -> DataFrame:
    """Statistics of a frame vector after its xyz slice is centred on the frame's cloud and its rotation slice is converted.

    centres: frame keys and mx, my, mz. rotation: start, end, and the kinds from and to. Masked rotation dimensions get mean 0 and std 1.
    """
    from demolake.functions.rotation import convert_rotation
    from demolake.operators import vectors

    rows, v = frames, F.col(vector).cast("array<double>")
    if centres is not None and xyz is not None:
        if xyz[1] - xyz[0] != 3:
            raise ValueError("an xyz slice has three components")
        rows = rows.join(centres.select(*FRAME, "mx", "my", "mz"), list(FRAME))
        moved = F.zip_with(vectors.vslice(v, *xyz), F.array("mx", "my", "mz"), lambda a, b: a - b)
        v = vectors.vreplace(v, *xyz, moved)
    rows = rows.withColumn("_v", v)
    masked = None
    if rotation is not None:
        start, end, source, target = rotation
        turned = convert_rotation(vectors.vslice("_v", start, end), source, target, quat_order="xyzw")
        size = {"quat": 4, "euler": 3, "rot6d": 6, "matrix": 9, "axisangle": 3}[target]
        rows, width, masked = rows.withColumn("_v", vectors.vreplace("_v", start, end, turned)), width + size - (end - start), (start, start + size, target)
    stats = vectors.vector_stats(rows, "_v", quantiles=quantiles, exact=exact, width=width)
    return stats if masked is None else vectors.mask_rotation_stats(stats, *masked)
