import math

import numpy as np
import pytest

from demolake.llm import hnsw, mixing


def exact(rows, queries, k):
    out = {}
    usable = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, np.array(v, dtype=float))
    for q in queries:
        if q in usable:
            a = usable[q]
            s = [(-float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), i) for i, b in usable.items() if i != q and len(b) == len(a)]
            out[q] = sorted(s)[:k]
    return out


def test_recall_and_ties(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.standard_normal(16)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # a hot vector
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [None] * 16), (2250, [float("inf")] + [0.0] * 15), (2300, [1.0, 2.0]), (2350, [2.0, 1.0])]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS shard")
    index = hnsw.build_index(df, shard_rows=300)
    got = hnsw.search_index(index, df.filter("vec_id % 50 = 0"), block_rows=7).collect()
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {q for q, w in want.items() if w}
    hits = [len({i for _, i in want[q]} & {i for i, _ in f}) / len(want[q]) for q, f in found.items()]
    assert np.mean(hits) >= 0.9
    assert [i for i, _ in found[1000]] == [7, 1001, 1002, 1003, 1004]
    assert [i for i, _ in found[2300]] == [2350]
    for q, f in found.items():
        scores = {i: -s for s, i in exact(rows, [q], 2000)[q]}
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in f)


def test_parallel_vectors_go_to_the_smaller_ids(spark):
    """Forty vectors of one direction and different lengths have one cosine."""
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.standard_normal(4)]) for i in range(1, 60)]
    rows += [(200 - i, [2.0**i, 0.0, 0.0, 0.0]) for i in range(40)] + [(1000, [3.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.search_index(hnsw.build_index(df), df.filter("vec_id = 1000")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(161 + i, 1.0) for i in range(5)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.search_index(hnsw.build_index(df), df).collect() == []


def test_exponent():
    words = np.array([1e6, 1e5, 1e4, 1e3])
    x = mixing.choose_exponent(words, target_entropy=0.9, max_repeats=1e9, budget=None)
    assert mixing.entropy(mixing.tempered(words / words.sum(), x)) == pytest.approx(0.9 * math.log(4), rel=1e-6)
    x = mixing.choose_exponent(words, target_entropy=0.99, max_repeats=4, budget=None)
    q = mixing.tempered(words / words.sum(), x)
    assert (q / words * (words / q).max()).max() == pytest.approx(4, rel=1e-6)
    assert mixing.choose_exponent(np.array([5.0]), target_entropy=0.9, max_repeats=4, budget=None) == 1.0


def rows_of_sources():
    rows = [(i, "w " * (1 + i % 7), f"s{min(i % 10, 3)}") for i in range(400)]
    return [*rows, (900, None, "s1"), (901, "", None), (902, "a b c", None), (902, "a b c", None), (903, None, "empty")]


def plain_mix(spark, out, block_words, seed=1):
    """Every epoch's reading of every source, block by block, from the documents' blocks alone."""
    import xxhash

    def hashed(*values):  # as Spark's xxhash64 of longs and strings, seed 42
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little") if not isinstance(v, Int) else (v % 2**32).to_bytes(4, "little"), h)
        return h - 2**64 if h >= 2**63 else h

    class Int(int):
        pass

    rows = [r.asDict() for r in out]
    words, weight = {}, {}
    for r in rows:
        words[r["source"]] = words.get(r["source"], 0) + r["mix_words"]
        weight[r["source"]] = r["mix_weight"]
    total = max(words[s] / weight[s] for s in words if words[s])
    places = {}
    for s, w in words.items():
        epochs, rest = divmod(weight[s] * total, w) if w else (1, 0)
        if w and w - rest < 1e-6 * w:
            epochs, rest = epochs + 1, 0
        own = [r for r in rows if r["source"] == s]
        assert {r["mix_block"] for r in own} == {r["mix_block"] for r in own if r["mix_block"] == hashed(r["doc_id"], Int(seed)) % max(1, -(-w // block_words))}
        for epoch in range(int(epochs) + 1):
            blocks = sorted({r["mix_block"] for r in own}, key=lambda b: (hashed(s, b, epoch, Int(seed)), b))
            before = 0
            for place, b in enumerate(blocks):
                docs = sorted((r for r in own if r["mix_block"] == b), key=lambda r: (hashed(r["doc_id"], int(epochs), Int(seed)), r["doc_id"], r["text"] or ""))
                size = sum(r["mix_words"] for r in docs)
                for r in docs:
                    if epoch == epochs and before + size > rest:
                        break
                    places.setdefault(id(r), []).append(place)
                else:
                    before += size
                    continue
                at = before
                for r in docs:
                    at += r["mix_words"]
                    if at <= rest and before < rest:
                        places.setdefault(id(r), []).append(place)
                before += size
    return [(r["doc_id"], r["mix_places"], places.get(id(r), [])) for r in rows]


def test_budgets(spark):
    rows = rows_of_sources()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mix_block", "2 AS _rest_of")
    out = mixing.mix_sources(df, block_words=100).collect()
    assert len(out) == len(rows) and min(r.mix_epochs for r in out) >= 1
    words, read, weight = {}, {}, {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + r.mix_words
        read[r.source] = read.get(r.source, 0) + r.mix_words * r.mix_epochs
        weight[r.source] = r.mix_weight
    total = max(words[s] / weight[s] for s in words if words[s])
    for s in words:
        assert weight[s] * total - 7 <= read[s] <= weight[s] * total + 1e-6  # one document short at most
    assert all(r.mix_epochs == len(r.mix_places) for r in out)
    for doc, got, want in plain_mix(spark, out, 100):
        assert got == want, doc
    finer = mixing.mix_sources(df, block_words=10).collect()
    for doc, got, want in plain_mix(spark, finer, 10):
        assert got == want, doc
    orders = {}
    for r in finer:
        for epoch, place in enumerate(r.mix_places):
            orders.setdefault((r.source, epoch), {})[r.mix_block] = place
    assert any(len(o) > 3 and {b: p for b, p in orders[s, 0].items() if b in o} != o for (s, e), o in orders.items() if e)  # epochs differ
    assert all(sorted(orders[s, 0].values()) == list(range(len(orders[s, 0]))) for s, e in orders if e == 0)
    with pytest.raises(ValueError):
        mixing.mix_sources(df, budget=1e9)
    less = mixing.mix_sources(df, block_words=100, budget=300.0).collect()
    assert 0 < sum(r.mix_words * r.mix_epochs for r in less) <= 300
    again = mixing.mix_sources(df.repartition(7), block_words=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_no_documents(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
