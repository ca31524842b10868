"""Mixing sources to target weights by temperature (operator 6).

A source's weight is its share of all words raised to an exponent, normalised.
The exponent is bisected: the largest one in [0, 1] whose weights reach a target
entropy (as a share of the most that so many sources allow), unless a source
would then be read more often than a repetition limit allows; then the smallest
one that keeps to the limit.

Weights become budgets of words. A source's documents are dealt to blocks of
about ``block_words`` words by a hash (of more where the corpus would have over
``most_blocks``: the table of blocks is broadcast). Each epoch of a source reads
its blocks in a permutation of its own, the last, partial epoch until the budget
ends: whole blocks, then documents of the next block. ``mix_places`` has a place in
its epoch's permutation for each time a document is read, ``mix_epochs`` their
number; epoch, place and a hash of the document order all that is read.

A null source is a source of its own. Nulls and texts without words cost
nothing; a source without any word is read once. Rows that repeat a doc_id lie
side by side in a block and are drawn each for itself. Extra columns stay; the
added columns replace any of the same name. An empty table gives none. A budget
that would read all words over ``max_repeats`` times is refused.

Per source one row reaches the driver, ``max_sources`` at most; more are refused.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.llm.scratch import materialize

ADDED = ("mix_words", "mix_weight", "mix_block", "mix_epochs", "mix_places")
_WORDS = r"[^\x20\x09-\x0D]+"


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def tempered(shares: np.ndarray, exponent: float) -> np.ndarray:
    q = np.where(shares > 0, np.power(np.maximum(shares, 1e-300), exponent), 0.0)
    return q / max(q.sum(), 1e-300)


def _bisect(fails, rounds: int = 60) -> float:
    """The end in [0, 1] of a condition that holds at 0 or at 1 only from some point on: fails(x) is false below it."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if fails(mid) else (mid, high)
    return low


def choose_exponent(words: np.ndarray, *, target_entropy: float, max_repeats: float, budget: float | None) -> float:
    """See above; budget None: as many words as every source needs to be read once whole."""
    shares = words / max(words.sum(), 1)
    n = int((words > 0).sum())
    if budget is not None and budget > max_repeats * words.sum() > 0:
        raise ValueError(f"a budget of {budget:.0f} words reads {words.sum():.0f} words over {max_repeats} times")
    if n < 2:
        return 1.0
    target = target_entropy * math.log(n)

    def repeats(x: float) -> float:
        q = tempered(shares, x)
        total = budget if budget is not None else (words[words > 0] / q[words > 0]).max()
        return float((q[words > 0] * total / words[words > 0]).max())

    x = 1.0 if entropy(shares) >= target else _bisect(lambda e: entropy(tempered(shares, e)) < target)
    if repeats(x) > max_repeats and repeats(1.0) <= max_repeats:
        x = 1.0 - _bisect(lambda e: repeats(1.0 - e) > max_repeats)
    return x


def mix_sources(docs: DataFrame, *, target_entropy: float = 0.97, max_repeats: float = 4.0, budget: float | None = None, block_words: int = 1 << 20, most_blocks: int = 100_000, seed: int = 1, max_sources: int = 100_000) -> DataFrame:
    """Docs with mix_words, mix_weight (of the source), mix_block, mix_epochs (how often the document is read; 0: not drawn) and mix_places.

    budget: words to read in all; by default just enough to read every document once.
    """
    spark = docs.sparkSession
    plain = docs.drop(*ADDED)
    kept = plain.columns
    counted = plain.withColumn("mix_words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORDS)).cast("long"))
    lite = materialize(counted.select("doc_id", "source", "mix_words"), "sizes")
    sources = lite.groupBy("source").agg(F.sum("mix_words").alias("words")).orderBy(F.col("source").asc_nulls_first()).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    words = np.array([r["words"] for r in sources], dtype=float)
    block_words = max(block_words, math.ceil(words.sum() / most_blocks))
    exponent = choose_exponent(words, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget)
    q = tempered(words / max(words.sum(), 1), exponent)
    total = budget if budget is not None else float((words[words > 0] / q[words > 0]).max()) if words.any() else 0.0
    plan = []
    for r, w, share in zip(sources, words, q, strict=True):
        epochs, rest = (divmod(share * total, w)) if w else (1.0, 0.0)
        if w - rest < 1e-6 * w:
            epochs, rest = epochs + 1, 0.0
        plan.append((r["source"], float(share), int(epochs), float(rest), max(1, math.ceil(w / block_words))))
    plan = spark.createDataFrame(plan, "_source string, mix_weight double, _epochs long, _rest double, _blocks long")
    same = F.col("source").eqNullSafe(F.col("_source"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_blocks")).alias("mix_block")

    # One row per source, block and epoch: the block's place, and the words read before it.
    sizes = lite.join(F.broadcast(plan), same).select("_source", "_epochs", "_rest", block, "mix_words").groupBy("_source", "mix_block").agg(F.sum("mix_words").alias("n"), F.first("_epochs").alias("_epochs"), F.first("_rest").alias("_rest"))
    begun = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs"))))
    order = Window.partitionBy("_source", "epoch").orderBy(F.xxhash64("_source", "mix_block", "epoch", F.lit(seed)), "mix_block")
    placed = begun.withColumns({"place": (F.row_number().over(order) - 1).cast("long"), "before": F.sum("n").over(order) - F.col("n")})
    whole = (F.col("epoch") < F.col("_epochs")) | (F.col("before") + F.col("n") <= F.col("_rest"))
    cut = ~whole & (F.col("before") < F.col("_rest"))
    read = F.sort_array(F.collect_list(F.when(whole, F.struct("epoch", "place"))))
    blocks = placed.groupBy("_source", "mix_block").agg(F.transform(read, lambda x: x.place).alias("_places"), F.max(F.when(cut, F.struct("place", (F.col("_rest") - F.col("before")).alias("left")))).alias("_end"))
    full = materialize(plan.join(blocks.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), "plan")

    # At most most_blocks and one for each source are broadcast.
    rows = counted.join(F.broadcast(plan.select("_source", "_blocks")), same).select(*kept, "mix_words", block)
    held = full.select("_source", "mix_weight", F.col("mix_block").alias("_block"), "_epochs", "_places", "_end")
    rows = rows.join(F.broadcast(held), same & (F.col("mix_block") == F.col("_block")))
    within = Window.partitionBy("_source").orderBy(F.xxhash64("doc_id", "_epochs", F.lit(seed)), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # one block of each source
    last = rows.filter("_end IS NOT NULL").withColumn("_more", F.sum("mix_words").over(within) <= F.col("_end.left"))
    out = rows.filter("_end IS NULL").withColumn("_more", F.lit(False)).unionByName(last)
    places = F.when(F.col("_more"), F.concat("_places", F.array("_end.place"))).otherwise(F.col("_places")).alias("mix_places")
    return out.select(*kept, "mix_words", "mix_weight", "mix_block", places).withColumn("mix_epochs", F.size("mix_places").cast("long"))


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).drop("text")
