import random

import pytest

from demolake.llm import substring


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def make(seed, n=60):
    rnd = random.Random(seed)
    passage = [[f"p{rnd.randrange(40)}" for _ in range(rnd.choice([8, 12, 30, 70]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passage)
            a = rnd.randrange(len(p))
            w[rnd.randrange(len(w) + 1) : 0] = p[a : a + rnd.choice([5, 12, 60])]
        if rnd.random() < 0.1:
            w += ["same"] * rnd.randrange(60)
        rows.append((i, "  ".join(w)))
    rows += [(n + i, rows[3][1]) for i in range(5)]
    return rows


@pytest.mark.parametrize(("seed", "group_rows", "filter_bits"), [(1, 15000, 1 << 12), (2, 3, 1 << 12), (3, 40, 64)])
def test_matches_brute_force(spark, seed, group_rows, filter_bits):
    """With groups of three rows nearly every repeated prefix is lengthened to the window; a filter of 64 bits lets everything through."""
    rows = [*make(seed), (900, None), (901, ""), (901, ""), (None, rows_text := "é " * 30), (None, rows_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS at", "'m' AS mask", "2 AS akey")
    got = substring.remove_repeats(df.select("doc_id", "text"), window=12, prefixes=(4, 7, 12), group_rows=group_rows, filter_bits=filter_bits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, 12)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a " * 40, 5, 6, "x"), (2, "b", 7, 8, "y")], "doc_id long, text string, at long, mask long, akey string")
    out = substring.remove_repeats(df, window=12, prefixes=(4, 7, 12)).orderBy("doc_id").collect()
    assert [(r.at, r["mask"], r.akey, r.n_removed) for r in out] == [(5, 6, "x", 40), (7, 8, "y", 0)]
    assert substring.remove_repeats(df.limit(0)).collect() == []
