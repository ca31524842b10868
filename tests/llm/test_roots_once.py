import random

from pyspark.sql.classic.dataframe import DataFrame

from demolake.llm import simhash


def test_a_member_looks_its_root_up_once(spark, monkeypatch):
    """Members stand under many keys; the join that gives them their roots has a row for each member, not for each key of it."""
    seen, join = [], DataFrame.join

    def counted(self, other, on=None, how=None):
        if isinstance(on, str) and (on, how) == ("fp", "left"):
            seen.append((self.count(), self.select("fp").distinct().count()))
        return join(self, other, on, how)

    monkeypatch.setattr(DataFrame, "join", counted)
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(60):
        own = list(words)
        for at in rnd.sample(range(300), 1 + k % 5):
            own[at] = f"x{k}-{at}"
        texts.append((k, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    simhash.near_copies(docs).collect()
    assert len(seen) >= 2 and max(n for n, _ in seen) > 10 and all(n == m for n, m in seen)
