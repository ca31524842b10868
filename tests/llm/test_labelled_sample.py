from demolake.llm.toxicity import labelled_sample


def test_a_repeated_id_gives_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "two"), (3, None), (4, "four")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.text, r.label) for r in labelled_sample(docs, labels, "toxic", per_class=5).collect())
    assert [(i, y) for i, _, y in got] == [(1, 1), (2, 0), (3, 0)] and got[1:] == [(2, "two", 0), (3, None, 0)]
    again = labelled_sample(docs.orderBy("text").repartition(7), labels, "toxic", per_class=5).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in again) == got
