"""Rows of portions stay small in JVMs: few to a file, and positions compressed."""

import pyarrow as pa
import pyarrow.parquet as pq

from demolake.llm import alignment
from tests.llm.test_alignment import PATHS, brute, results


def test_few_portions_to_a_file(spark, tmp_path, monkeypatch):
    """A task of many portions writes several files, so that no reader holds them all at once."""
    docs = [(i, f"text {i % 7} of naïve words, {i}") for i in range(30)]
    monkeypatch.setattr(alignment, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        assert results(alignment.align(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), portion=1)) == brute(docs)
    finally:
        spark.conf.set(name, now)
    rows = [pq.ParquetFile(f).metadata.num_rows for f in tmp_path.glob("portions/*.parquet")]
    assert sum(rows) == len(docs) and max(rows) <= 8


def test_positions_are_compressed(spark):
    words = [f"w{k * k % 997}" for k in range(3000)]
    docs = [(i, " ".join(words[i % 50 :])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = alignment.portions(df, id="doc_id", text="text", a=PATHS[0], b=PATHS[1], size=1 << 30).collect()
    assert len(found) == 1
    pairs = found[0].first[-1]
    assert pairs > 100_000 and len(found[0].place) + len(found[0].times) < pairs  # of 12 bytes each

    memory, portion = alignment.Memory(*alignment.tokenizers(*PATHS)), alignment._Portion()
    portion.add(pa.array(range(400)), [t for _, t in docs], memory)
    row = portion.row(0, [f.strip().split(" ")[0] for f in ("portion, pairs, docs, ids, " + alignment._ENTRIES).split(", ")])
    for name in ("place", "times"):
        assert alignment._numbers(getattr(found[0], name)).tolist() == row.column(name)[0].as_py()


def test_portions_without_pairs(spark):
    docs = [(1, None), (2, ""), (3, None)]
    assert results(alignment.align(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
