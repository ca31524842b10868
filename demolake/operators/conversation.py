"""Instructions, prompts and conversations as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Placeholders in source conversations and the tokens that replace them.
TOKENS = {
    "<image>": "<|vision_start|><|image_pad|><|vision_end|>",
    "<video>": "<|vision_start|><|video_pad|><|vision_end|>",
    "<action>": "<|action_start|><|action_pad|><|action_end|>",
    "<state>": "<|state_start|><|state_pad|><|state_end|>",
}
ROLES = {"human": "user", "gpt": "assistant"}
PASS = "<|action_pass|>"
POINTS = "<|point_start|><|point_pad|><|point_end|>"
VLA = "<|vla|>"


def instructions(tasks: DataFrame, text: str = "task", position: str = "task_index") -> DataFrame:
    """Distinct instructions in the order first seen, blank ones dropped."""
    return tasks.filter(F.trim(text) != "").groupBy(text).agg(F.min(position).alias("position")).orderBy("position")


def alternatives(text: Column) -> Column:
    """The readings of an instruction, separated by <br>, without empty ones."""
    return F.filter(F.transform(F.split(text, "<br>"), lambda s: F.trim(s)), lambda s: s != "")


def choose_alternative(text: Column, *keys: str, seed: int = 0, choice: Column | None = None) -> Column:
    """One of the readings, by a seeded hash of the keys or by a whole number."""
    options = alternatives(text)
    return F.element_at(options, (F.pmod(F.xxhash64(F.lit(seed), *keys) if choice is None else choice, F.greatest(F.size(options), F.lit(1))) + 1).cast("int"))


def replace_tokens(text: Column) -> Column:
    """Placeholders with the space before them and one line end after, replaced by their tokens."""
    for name, token in TOKENS.items():
        text = F.regexp_replace(text, rf"\s*{name}\n?", token.replace("$", r"\$"))
    return text


def map_role(role: Column) -> Column:
    out = role
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def pointing_queries(task: Column, instruction: Column) -> Column:
    """The questions to a pointing model for a task's instruction, as an array. Task names and question texts are fixed values."""
    side = F.lower(F.regexp_extract(instruction, r"(?i)\b(left|right)\b", 1))
    thing = lambda default: (lambda m: F.when(m == "", default).otherwise(m))(F.trim(F.regexp_extract(instruction, r"(?i)pick the (.+?) from the", 1)))
    point = lambda *parts: F.concat(F.lit("Point to the "), *parts, F.lit("."))
    return (
        F.when(task == "OpenDrawer", F.array(point(F.lit("handle of the "), F.when(side == "", "").otherwise(F.concat(side, F.lit(" "))), F.lit("drawer"))))
        .when(task == "PickPlaceCounterToStove", F.array(point(thing("object")), point(F.lit("pan"))))
        .when(task == "TurnOnMicrowave", F.array(point(F.lit("start button on the microwave"))))
        .when(task == "CoffeeSetupMug", F.array(point(thing("mug"))))
        .when(task == "CloseBlenderLid", F.array(point(F.lit("blender lid"))))
    )


def truncate_at_action(turns: DataFrame, marker: str, *, seed: int = 0, chunk: int = 1, choice: Column | None = None) -> DataFrame:
    """Conversations cut at one of the turns that hold ``marker``, or not at all, chosen by a hash: the cut turn and its reply end it.

    Replies to earlier action turns become ``chunk`` pass tokens. turns: conv_id, turn, role, text.
    choice: a whole number for a conversation in place of the seeded hash.
    """
    whole = Window.partitionBy("conv_id")
    is_action = F.col("text").contains(marker) & (F.col("role") == "user")
    ends = F.array_sort(F.collect_list(F.when(is_action, F.col("turn"))).over(whole))
    pick = F.pmod(F.xxhash64(F.lit(seed), "conv_id") if choice is None else choice, F.size("_ends") + 1).cast("int")
    rows = turns.withColumn("_ends", ends).withColumn("_pick", pick)
    rows = rows.withColumn("_cut", F.when(F.col("_pick") < F.size("_ends"), F.get("_ends", F.col("_pick"))))
    rows = rows.filter(F.col("_cut").isNull() | (F.col("turn") <= F.col("_cut") + 1))
    before = F.lag(is_action).over(whole.orderBy("turn"))
    early = F.coalesce(before, F.lit(False)) & (F.col("role") == "assistant") & (F.col("_cut").isNull() | (F.col("turn") <= F.col("_cut")))
    return rows.withColumn("text", F.when(early, PASS * chunk).otherwise(F.col("text"))).drop("_ends", "_pick", "_cut")


def record_references(rows: DataFrame, references: str, key: str) -> DataFrame:
    """References of the form ``repo idx chunk``, one row each: key, position, repo, idx, chunk."""
    parts = F.split("_r", r"\s+")
    return rows.select(key, F.posexplode(references).alias("position", "_r")).select(key, "position", F.element_at(parts, 1).alias("repo"), F.element_at(parts, 2).cast("long").alias("idx"), F.element_at(parts, 3).cast("int").alias("chunk"))


def resolve_references(references: DataFrame, frames: DataFrame, *, repo: str = "repo", idx: str = "idx") -> DataFrame:
    """References (repo, idx) with the frame that they name, found by the global index within its repository; a reference to nothing has nulls."""
    return references.join(frames, [repo, idx], "left")


def cap_length(df: DataFrame, most: int, length: str = "seq_length") -> DataFrame:
    return df.filter(F.coalesce(F.col(length), F.lit(0)) <= most)


def missing_contexts(instructions_: DataFrame, contexts: DataFrame, text: str = "instruction") -> DataFrame:
    return instructions_.select(text).distinct().join(contexts.select(text).distinct(), text, "left_anti")


def state_prompt(task: Column, bins: Column) -> Column:
    """An instruction and a discretised state as prompt text."""
    clean = F.regexp_replace(F.replace(F.trim(task), F.lit("_"), F.lit(" ")), "\n", " ")
    return F.concat(F.lit("Task: "), clean, F.lit(", State: "), F.array_join(F.transform(bins, lambda b: b.cast("string")), " "), F.lit(";\nAction: "))


def _turns(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def monolithic_prompt(task: Column, n_images: Column, *, points: Column, state: Column) -> Column:
    """A robot sample whose reply holds the action, as turns (role, content): images, then points and state where there are any, the task, and the action."""
    there = lambda has, token: F.when(has, token).otherwise("")
    asked = F.concat(F.repeat(F.lit(TOKENS["<image>"]), n_images.cast("int")), there(points, POINTS), there(state, TOKENS["<state>"]), task, F.lit(VLA))
    return _turns(("user", asked), ("assistant", F.lit(TOKENS["<action>"])))


def dual_prompt(task: Column, n_images: Column) -> Column:
    """A robot sample whose actions stay out of the conversation: images and the task, in one turn."""
    return _turns(("user", F.concat(F.repeat(F.lit(TOKENS["<image>"]), n_images.cast("int")), task)))


def plan_text(position: Sequence[Column], rotation: Sequence[Column], open_: Column) -> Column:
    """A state in words: position to two decimals, rotation in whole degrees, gripper open or closed."""
    return F.concat(
        F.format_string("position (%.2f, %.2f, %.2f), ", *position),
        F.format_string("rotation (%.0f, %.0f, %.0f), gripper ", *rotation),
        F.when(open_ > 0.5, "open").otherwise("closed"),
    )


def advantage_text(value: Column) -> Column:
    """A label of any spelling as one of two words; null for none."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("1", "1.0", "true", "positive", "good"), "Advantage: positive").when(v.isin("0", "0.0", "false", "negative", "bad"), "Advantage: negative")
