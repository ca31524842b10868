"""The corpus pipeline: toxicity, near copies, repeated passages, benchmark passages, mixture.

Each stage reads the documents that its predecessor kept. All but the last
return the columns of ``documents``; the last adds how often a document is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm import decontaminate, mixing, simhash, substring, toxicity
from demolake.llm.langid import held_out
from demolake.llm.scratch import delete, new_folder, temporary_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 9 scores below 0.7; it learns from the labels of the documents at hand."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out("doc_id", 3, 1))
    return toxicity.score(docs, toxicity.train(docs, labels)).filter("score < 0.7").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (similarity 0.8 and more in runs of five words), the row smallest by (doc_id, nulls last, xxhash64(text)); of equal rows, one."""
    return simhash.near_copies(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that stand anywhere else; others stay as they are."""
    found = substring.remove_repeats(docs.select(*COLUMNS), keep_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words under one in twenty lie in benchmark windows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), items)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and how often the mixture reads it."""
    return mixing.mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_each_group),
    ("substring", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The toxicity model, XXH64 fingerprints and hash orders have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables, and its input, are deleted once its output is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before, path = path, new_folder(spark, f"pipeline-{name}")
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
    return docs
