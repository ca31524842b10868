import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from demolake.llm import exact
from tests.test_queries import SF

ROWS = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (6, "b"), (6, "b"), (6, "c"), (None, "a"), (None, "d"), (None, "d"), (-(2**63), "e"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "A")]


def brute(rows, largest=True, normalise=lambda t: t):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalise(t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS digest", "2 AS kept", "3 AS text_sha256_").repartition(3)


@pytest.mark.parametrize("largest", [True, False])
def test_groups(docs, largest):
    assert results(exact.exact_groups(docs, largest=largest)) == brute(ROWS, largest)


def test_any_depth_and_either_join(docs):
    for depth, bits, share in ((1, 4, 10_000), (64, 1, 2), (1 << 9, 3, 1)):
        assert results(exact.exact_groups(docs, least_runs=depth, bits=bits, hot_share=share)) == brute(ROWS)


def test_normalised(docs):
    assert results(exact.exact_groups(docs, normalise=F.lower)) == brute(ROWS, normalise=str.lower)


def test_one_row_of_each_text_stays(docs):
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted({(k, t or "") for (i, t) in ROWS for (j, k, _, kept_, d) in brute(ROWS) if kept_ and d == hashlib.sha256((t or "").encode()).hexdigest()}, key=str)


def test_empty(docs):
    assert exact.exact_groups(docs.limit(0)).collect() == [] and exact.keep_one(docs.limit(0)).collect() == []


def test_a_text_of_half_the_rows(spark):
    df = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('t', id % 3000) END AS text").repartition(5)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert results(exact.exact_groups(df)) == brute(rows)


def entries(rows):
    e = np.zeros(len(rows), exact._ENTRY)
    for k, (words, id, row) in enumerate(rows):
        e[k] = (words, id or 0, id is None, row, 1)
    return e


def test_merge_verifies_whole_digests():
    """Digests that agree in 64 bits, or in all bits but not in length, are different texts."""
    one, other, longer = (7, 1, 2, 3, 4), (7, 1, 2, 9, 4), (7, 1, 2, 3, 5)
    got = exact.merge(entries([(one, 3, 0), (other, 9, 1), (one, 5, 2), (longer, 1, 3), (one, None, 4), (other, 9, 5)]), largest=True)
    assert [(tuple(e["key"]), int(e["id"]), int(e["row"]), int(e["n"])) for e in got] == [(one, 5, 2, 3), (longer, 1, 3, 1), (other, 9, 1, 2)]
    assert [int(e["id"]) for e in exact.merge(got[:1].repeat(2), largest=False)] == [5]
    assert len(exact.merge(got[:0], largest=True)) == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert results(exact.op12_digest_tree(spark, SF)) == brute(rows)
