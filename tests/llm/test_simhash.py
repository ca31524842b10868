import math
import random

import numpy as np
import pytest
import xxhash

from demolake.llm import pigeonhole, simhash


def brute(rows, shingle=4, radius=4):
    fps = []
    for _, text in rows:
        words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[root(i)] = min(doc, names.get(root(i), doc))
    return sorted((doc if doc is not None else -1, fps[i], names.get(root(i), -1)) for i, (doc, _) in enumerate(rows))


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "'x' AS part")
    out = simhash.near_duplicates(df, **options).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id if r.component_id is not None else -1) for r in out)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice("ab cd ef gh ij kl mn".split()) for _ in range(rnd.choice([0, 1, 3, 4, 9, 60]))) for _ in range(n // 3)]
    for _ in range(n - len(texts)):
        words = rnd.choice(texts).split()
        if words and rnd.random() < 0.8:
            words[rnd.randrange(len(words))] = rnd.choice(["zz", "AB", "é"])
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("radius", [0, 4])
def test_components_match_brute_force(spark, radius):
    rows = [*corpus(radius), (500, None), (501, ""), (501, ""), (None, "ab cd"), (502, "word " * 20000)]
    assert got(spark, rows, radius=radius) == brute(rows, radius=radius)


def test_dense_group_of_near_copies(spark):
    rnd, base = random.Random(5), [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rnd.randrange(400)] = f"x{i % 40}"
        rows.append((i, " ".join(words)))
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_plan_covers_every_pair_within_the_radius():
    rnd = np.random.default_rng(1)
    bits = (rnd.random((500, 64)) < 0.5).astype(float)
    bits[:, 10] = bits[:, 40]
    for n in (500, 10**6, 10**9):
        plan = pigeonhole.plan_parts(bits.T @ bits * (n / 500), n, 4)
        assert sorted(b for _, group, _ in plan for b in group) == list(range(64))
        assert sum(t for _, _, t in plan) >= 4 - len(plan) + 1


def test_bands_keep_to_the_share_that_may_escape():
    both = np.full((16, 64, 64), 250.0)
    both[:, range(64), range(64)] = 500
    for n in (1000, 10**6, 10**9):
        plan = pigeonhole.plan_bands(both * (n / 1000), n, 0.16, 0.002)
        escape = 1.0
        for _, group, t in plan:
            escape *= 1 - sum(math.comb(len(group), d) * 0.16**d * 0.84 ** (len(group) - d) for d in range(t + 1))
        assert escape <= 0.002
        places = [(lane, b) for lane, group, _ in plan for b in group]
        assert len(places) == len(set(places))


@pytest.mark.parametrize("bucket", [4096, 40, 3])
def test_crowded_buckets_lose_no_link(spark, bucket):
    """Chains, stars and random values around a few centres; small buckets force the second filing and the balls."""
    rnd, fps = random.Random(7), set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(rnd.randrange(8)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
            if rnd.random() < 0.1:
                x = y
    fps = sorted(fps)
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    df = spark.createDataFrame([(pigeonhole.signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.link_fingerprints(df, 4, bucket).collect()}
    ours = [roots.get(pigeonhole.signed(x), pigeonhole.signed(x)) for x in fps]
    assert len(set(ours)) == len(set(group)) == len(set(zip(ours, group, strict=True)))


@pytest.mark.parametrize("members", [300, 1200])
def test_links_of_a_dense_bucket_are_linear(spark, members):
    rnd = np.random.default_rng(3)
    fp = np.unique((np.uint64(0x1234567890ABCDEF) ^ (np.uint64(1) << rnd.integers(0, 64, (members, 2)).astype(np.uint64)).sum(axis=1)).view(np.int64))
    rows = spark.createDataFrame([(1, int(x)) for x in fp], "key long, fp long")
    assert simhash.bucket_links(rows, 4).count() == len(fp) - 1
