"""Queries of several threads of one driver don't touch each other's tables."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

import __spark_entry__
from demolake.sources.shared import shared_dir, temporary_tables
from demolake.llm.scratch import materialize
from tests.test_queries import SF


def of(name):
    return next(q for n, q in __spark_entry__.queries().items() if n.split("_")[0] == name)


def folders(spark):
    return {p.name.rpartition("-")[0] for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_three_at_once(spark):
    names = ("op2", "op5", "pipeline")
    rows = lambda name: sorted(map(str, of(name)(spark, SF).collect()))
    alone = [rows(n) for n in names]
    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(rows, names)) == alone


def test_tables_go_when_their_block_ends(spark):
    with temporary_tables(spark):
        outer = materialize(spark.range(3), "scope-outer")
        with pytest.raises(ZeroDivisionError), temporary_tables(spark):
            materialize(spark.range(3), "scope-inner")
            with ThreadPoolExecutor(1) as pool:
                other = pool.submit(lambda: materialize(spark.range(4), "scope-thread")).result()
            1 / 0
        assert "scope-inner" not in folders(spark) and "scope-outer" in folders(spark)
        assert outer.count() == 3
    assert "scope-outer" not in folders(spark)
    assert other.count() == 4
