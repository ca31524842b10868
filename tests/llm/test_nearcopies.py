"""The simhash stage of the pipeline against all pairs of texts at similarity 0.8."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from demolake.llm import simhash
from tests.llm.test_stage_rows import staged


def runs(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_against_all_pairs(spark):
    rnd, rows = random.Random(3), []
    for _ in range(12):
        base = [f"w{rnd.randrange(10**5)}" for _ in range(rnd.choice([40, 100, 300]))]
        for _ in range(5):
            w = list(base)
            for _ in range(rnd.randrange(1 + len(w) // 20)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**5)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), "a b c"), (len(rows) + 1, "A b  c"), (len(rows) + 2, "a b d"), (len(rows) + 3, None), (len(rows) + 4, "")]
    sets, group = [runs(t) for _, t in rows], list(range(len(rows)))
    linked = apart = 0
    for j in range(len(rows)):
        for i in range(j):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            linked, apart = linked + (0.8 <= alike < 1), apart + (0.5 < alike < 0.8)
            if alike >= 0.8 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert linked > 10 and apart > 10
    assert [i for i, _ in sorted(staged(spark, rows))] == sorted(set(group))


def test_crowded_groups_against_all_pairs(spark):
    """Large groups of copies about as far apart as the bound: each member is first compared with few others."""
    rnd, rows = random.Random(9), []
    for size, edits in ((150, (1, 2)), (60, (2,)), (40, (3,))):
        base = [f"w{rnd.randrange(10**5)}" for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.choice(edits)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**5)}"
            rows.append((len(rows), " ".join(w)))
    sets, group = [runs(t) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert 20 < len(set(group)) < 160
    assert [i for i, _ in sorted(staged(spark, rows))] == sorted(set(group))


def chains(groups=100):
    """Groups whose texts are about as far apart as the bound: chains, and edits of one text."""
    rnd, rows, group = random.Random(11), [], []
    for g in range(groups):
        base = [f"w{rnd.randrange(10**5)}" for _ in range(rnd.choice([60, 120, 300]))]
        now = base
        for _ in range(rnd.choice([8, 14])):
            w = list(base if g % 3 else now)
            for _ in range(max(1, round(len(w) * (rnd.choice([0.01, 0.012, 0.02, 0.025]) if g % 3 else 0.02)))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**5)}"
            now = w
            rows.append((len(rows), " ".join(w)))
            group.append(g)
    return rows, group


@pytest.mark.parametrize("bucket", [2048, 8])
def test_no_link_of_a_chain_is_lost(spark, monkeypatch, bucket):
    """Many pairs fall short by little, so that forests of nearest fingerprints break; a bucket of 8 crowds nearly every key."""
    rows, group = chains()
    sets, root = [runs(t) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if group[i] == group[j] and root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if g == old else g for g in root]
    monkeypatch.setattr(simhash, "link_texts", functools.partial(simhash.link_texts, bucket=bucket))
    assert [i for i, _ in sorted(staged(spark, rows))] == sorted(set(root))


def test_a_crowded_key_costs_rows_in_proportion(spark):
    """20,000 members of one key: chunks, leaders, and what one stray component meets."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("fp"), F.array(F.col("id")).alias("bits"))
    crowded = spark.createDataFrame([(1, 20_000)], "key long, n long")
    met = simhash._with_leaders(rows, crowded, 2048)
    assert met.count() < 1.2 * 20_000 and met.groupBy("key").count().agg(F.max("count")).first()[0] < 2048
    leaders = met.groupBy("fp").count().filter("count > 1").count()
    assert 20 < leaders < 200
    rooted = rows.withColumn("root", F.when(F.col("fp") < 30, F.col("fp")).otherwise(F.lit(99)))
    again = simhash._minor_meet_all(rooted, 2048)
    assert again.count() < 1.2 * 20_000
    met = {tuple(r) for r in again.alias("a").join(again.alias("b"), "key").filter("a.root != b.root AND a.fp < 30").select("a.fp", "b.fp").distinct().collect()}
    assert len(met) == 30 * 19_999
    assert simhash._minor_meet_all(rooted.withColumn("root", F.lit(1)), 2048).count() == 0


def test_empty_table(spark):
    assert staged(spark, [(1, "a b c")])[:0] == [] and simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
