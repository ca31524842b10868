"""The registered queries on the driver's smallest tables: against their SQL, brute force, or what their contract fixes."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tests.llm.test_hnsw_mixing import exact, plain_mix
from tests.llm.test_simhash import brute
from tests.test_queries import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
LARGER = SF.replace("sf0.001", "sf0.01")  # enough labels to learn from
QUERIES = {n: q for n, q in __spark_entry__.queries().items() if n.startswith("op")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def of(prefix):
    return next(q for n, q in QUERIES.items() if n.startswith(f"{prefix}_"))


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("prefix", ["op1", "op5", "op7", "op8", "op12"])
def test_sql_twin(spark, duck, prefix):
    name = next(n for n in QUERIES if n.startswith(f"{prefix}_"))
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())


def test_op2_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in of("op2")(spark, SF).collect())
    assert got == brute(docs) and all(len(r.fingerprint) == 16 for r in of("op2")(spark, SF).limit(5).collect())


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_op3_columns(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = of("op3")(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    learned = {d.lang for d in docs.values() if d.lang and not held(d.doc_id, 5, 0)}
    for r in got:
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1
        lettered = any(map(str.isalpha, docs[r.doc_id].text or ""))
        assert (r.lang_pred in learned) == lettered and (lettered or r.lang_pred == "und")
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean(right) > 0.9


def test_op4_against_all_vectors(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = exact(vectors, [i for i, _ in vectors if i % 50 == 0], 5)
    found = {}
    for r in sorted(of("op4")(spark, SF).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(found) == set(want)
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in found[q]}) / len(want[q]) for q in want]) >= 0.9
    assert all(f == sorted(f) for f in found.values())


def test_op6_against_a_plain_reading(spark):
    out = of("op6")(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for doc, got, want in plain_mix(spark, out, 1 << 20):
        assert got == want, doc


@pytest.mark.parametrize(("prefix", "label", "modulus", "rest", "least"), [("op9", "toxic", 3, 1, 0.7), ("op10", "quality", 5, 0, 0.3)])
def test_scores(spark, prefix, label, modulus, rest, least):
    got = of(prefix)(spark, LARGER).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) and r.held_out == held(r.doc_id, modulus, rest) for r in got)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if r[label] is not None}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.8
