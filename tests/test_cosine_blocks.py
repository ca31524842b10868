"""Similarity by blocks against numpy, with more queries than a block holds."""

import math

import duckdb
import numpy as np
import pytest

from demolake.operators import vectors
from demolake.plans import catalog


def test_blocks(spark):
    x = np.random.default_rng(0).standard_normal((303, 5))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.cosine_to_queries(df, "embedding", df, key="vec_id", block=40).toPandas()
    assert len(got) == len(rows) ** 2 and not got.duplicated(["vec_id", "query_id"]).any()
    odd = (got.vec_id >= 5000) | (got.query_id >= 5000)
    assert got.cosine.isna().equals(odd)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = got[~odd]
    assert np.allclose(some.cosine, (u[some.vec_id.to_numpy()] * u[some.query_id.to_numpy()]).sum(axis=1))
    assert vectors.cosine_to_queries(df, "embedding", df.limit(0), key="vec_id").count() == 0


def squares(total, n):
    """``n`` whole numbers whose squares add up to ``total``."""
    top = math.isqrt(total)
    if n == 1:
        return [top] if top * top == total else None
    return next(([a, *more] for a in range(top, -1, -1) if (more := squares(total - a * a, n - 1))), None)


@pytest.mark.parametrize("name", ["a32_cosine_to_queries", "a32_cosine_to_every_twentieth"])
def test_rounds_as_its_sql(spark, tmp_path, name):
    """Cosines that are an odd number of 1024ths end in a half at nine digits: a sum in another order fell on its other side."""
    rows = [(20, [6, 6, 7, 0, 0, 0, 0]), (40, [-12, -12, -14, 0, 0, 0, 0]), (21, [0] * 7), (60, None)]
    for k in range(1, 80, 2):
        a, b = 11 * k % 61, 5 * k % 47
        first = next([a, b, c] for c in range(22) if (6 * a + 6 * b + 7 * c) % 22 == 11)  # along the first row, of length 11, it is an odd number long, of 1024 in all
        rows.append((1000 + k, [*first, *squares(1024**2 - sum(c * c for c in first), 4)]))
    rows = [(i, v and [float(c) for c in v]) for i, v in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(catalog.oracle_sql()[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    whole = lambda rows: {(i, q): None if c is None or c != c else c for i, q, c in rows}
    assert len(got) == len(want) == 3 * len(rows) and whole(got) == whole(want)
