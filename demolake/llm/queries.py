"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demolake.llm import alignment, chat, decontaminate, exact, hnsw, langid, mixing, quality, simhash, substring, toxicity, variants, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [decontaminate.op1_suffix_automaton, simhash.op2_pigeonhole_simhash, langid.op3_segmentation_unigrams, hnsw.op4_sharded_hnsw, substring.op5_prefix_suffix_trees, mixing.op6_temperature_mix, warc.op7_content_addressed, chat.op8_prefix_targets, toxicity.op9_noisy_channel, quality.op10_neighbour_votes, alignment.op11_merge_path, exact.op12_digest_tree, variants.op13_prefix_suffix_tiles]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_automaton": decontaminate.OP1_SQL, "op5_prefix_suffix_trees": substring.OP5_SQL, "op7_content_addressed": warc.OP7_SQL, "op8_prefix_targets": chat.OP8_SQL, "op12_digest_tree": exact.OP12_SQL}
