"""The simhash stage of the pipeline on rows with null and repeated ids."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=80):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def staged(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(parts)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)


def test_rows_without_id_are_documents_of_their_own(spark):
    rows = [(None, text(k)) for k in range(6)]
    assert staged(spark, rows) == sorted(rows, key=str)
    assert staged(spark, [*rows, *rows]) == sorted(rows, key=str)


def test_one_id_with_two_texts_keeps_both(spark):
    rows = [(1, text(1)), (1, text(2)), (2, text(2)), (3, text(3)), (None, text(3))]
    want = [(1, text(1)), (1, text(2)), (3, text(3))]
    assert staged(spark, rows) == staged(spark, rows[::-1], 1) == sorted(want, key=str)
