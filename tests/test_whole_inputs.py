"""Queries over whole tables rather than a few rows of them."""

import os

import pytest

from demolake.operators import vectors
from demolake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_every_configuration_has_a_rate(spark):
    rows = catalog.queries()["a34_marginal_rate_all"](spark, SF).collect()
    assert len(rows) == 6 and all(r.rate > 0 and r.speedup > 0 for r in rows)
    assert len({r.rate for r in rows}) > 1


def test_every_run_has_an_exposure(spark):
    assert catalog.queries()["a24_exposure_all"](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_a_twentieth_of_the_vectors_are_queries(spark):
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    got = catalog.queries()["a32_cosine_to_every_twentieth"](spark, SF)
    assert {r.query_id for r in got.select("query_id").distinct().collect()} == {i for i in ids if i % 20 == 0}
    assert got.count() == len(ids) * sum(i % 20 == 0 for i in ids)


def test_percentiles_over_all_pairs_of_the_sample(spark):
    n = min(2000, spark.read.parquet(f"{SF}/embeddings.parquet").count())
    assert catalog.queries()["a32_pairwise_percentiles"](spark, SF).first().pairs == n * (n - 1) // 2


@pytest.mark.parametrize("name", ["a32_cosine_to_queries", "a32_cosine_to_every_twentieth"])
def test_one_file_of_vectors_is_many_tasks(spark, monkeypatch, name):
    want = sorted(map(tuple, catalog.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(vectors, "RESULTS", len(want) // 5, raising=False)
    got = catalog.queries()[name](spark, SF)
    assert got.rdd.getNumPartitions() >= 5 and sorted(map(tuple, got.collect())) == want
