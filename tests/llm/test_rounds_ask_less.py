import random

from demolake.llm import simhash


def test_keys_are_dealt_once_and_done_with(spark, monkeypatch):
    """Near copies that one component holds ask once: what a round deals is one row for each key of a member, and the next round has only keys of several components."""
    dealt, write = [], simhash.materialize

    def counted(df, name):
        table = write(df, name)
        if name in ("rooted", "open"):
            dealt.append((name, table.count(), table.select("key", "fp").distinct().count()))
        return table

    monkeypatch.setattr(simhash, "materialize", counted)
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(80):
        own = list(words)
        for at in rnd.sample(range(300), 1 + k % 3):
            own[at] = f"x{k}-{at}"
        texts.append((k, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert len(simhash.near_copies(docs).collect()) < 20
    (one, first, keys), (_, left, _), (two, again, _), _ = dealt
    assert one == two == "rooted" and first == keys > 80
    assert again == left < first
