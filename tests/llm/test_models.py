import itertools
import math
import random

import numpy as np
import pytest

from demolake.llm import langid, quality, toxicity

LANGS = {"en": "the of and ing tion er that with from".split(), "de": "der die und ung heit sch für nicht über".split(), "fr": "le la et tion eau é dans avec être".split()}


def texts(seed, n, langs=LANGS):
    rnd, out = random.Random(seed), []
    for i in range(n):
        lang = rnd.choice(list(langs))
        out.append((i, " ".join("".join(rnd.choice(langs[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 40))), lang))
    return out


def test_forward_sums_all_segmentations():
    vocabulary = [b"\x01ab", b"ab", b"abc", b"bc", *(bytes([b]) for b in range(256))]
    rnd = np.random.default_rng(0)
    p = rnd.random((len(vocabulary), 2)) * 0.1
    lattice, index = langid.Lattice(vocabulary), {v: i for i, v in enumerate(vocabulary)}

    def total(word, lang):
        if not word:
            return 1.0
        return sum(p[index[word[:k]], lang] * total(word[k:], lang) for k in range(1, len(word) + 1) if word[:k] in index)

    words = [b"abcab", b"xyz", b"a", b"abcabc"]
    want = [[total(b"\x01" + w, lang) for lang in range(2)] for w in words]
    assert np.allclose(np.exp(langid.forward(lattice, words, np.log(p))), want)
    # Expected uses: the derivative of the log sum by the log probabilities.
    keys, sums = langid.expected(lattice, [b"abcab"], np.array([1]), np.array([3.0]), np.log(p))
    for key, s in zip(keys, sums, strict=True):
        q = p.copy()
        q[key // 2, 1] *= 1 + 1e-6
        slope = (langid.forward(lattice, [b"abcab"], np.log(q)) - langid.forward(lattice, [b"abcab"], np.log(p)))[0, 1] / 1e-6
        assert s == pytest.approx(3 * slope, rel=1e-3)


def plain_log_sum(word, index, log_p, lang):
    """The forward sum of one word with exact fractions instead of floating point."""
    from fractions import Fraction

    f = [Fraction(1)] + [Fraction(0)] * len(word)
    for end in range(1, len(word) + 1):
        f[end] = sum((f[end - k] * Fraction(float(np.exp(log_p[index[word[end - k : end]], lang]))) for k in range(1, min(end, 6) + 1) if word[end - k : end] in index), Fraction(0))
    return math.log(f[-1].numerator) - math.log(f[-1].denominator)


def test_long_words_sum_all_segmentations():
    """Words of hundreds of bytes, in a script without spaces too, whose probabilities no float can hold."""
    vocabulary = [b"ab", b"abc", b"bc", "語".encode(), "日本".encode(), *(bytes([b]) for b in range(256))]
    rnd = np.random.default_rng(2)
    log_p = np.log(np.stack([rnd.random(len(vocabulary)) * 1e-5, rnd.random(len(vocabulary)) * 1e-2], axis=1))
    lattice, index = langid.Lattice(vocabulary), {v: i for i, v in enumerate(vocabulary)}
    words = [b"abc" * 20, b"x" * 700, "日本語".encode() * 40, b"q"]
    got = langid.forward(lattice, words, log_p)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([plain_log_sum(b"\x01" + w, index, log_p, lang) for lang in range(2)], rel=1e-9)
    for w, row in zip(words, got, strict=True):  # alone as among others
        assert langid.forward(lattice, [w], log_p)[0].tolist() == row.tolist()
    assert [w for part in langid.portions(words, 2, 100) for w in words[part]] == words


def test_equal_texts_have_equal_scores(spark):
    model = langid.train(spark.createDataFrame(texts(1, 60), "doc_id long, text string, lang string"))
    rows = [(i, t) for i, (_, t, _) in enumerate(texts(3, 40))] + [(100 + k, "der with être und " * 9) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS lang_pred", "2 AS extra")
    got = langid.predict(df.repartition(3), model).collect()
    assert len({(r.score, r.lang_pred) for r in got if r.doc_id >= 100}) == 1 and {r.extra for r in got} == {2}


def test_language_id_on_held_out_texts(spark):
    train = spark.createDataFrame(texts(1, 150), "doc_id long, text string, lang string")
    model = langid.train(train)
    rows = [*texts(2, 90), (1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (1003, "der " * 30000, "de"), (1003, "der die", "de")]
    test = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    got = langid.predict(test, model, keep=["doc_id", "lang"], cache_words=1).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert np.mean([r.lang == r.lang_pred for r in got if r.doc_id < 1000]) > 0.95
    assert all(r.lang_pred == "de" for r in got if r.doc_id == 1003)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_without_training(spark):
    model = langid.train(spark.createDataFrame([], "text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


INSULTS = ["idiot", "scum", "loser", "moron", "stupid"]


def toxic_corpus(seed, n):
    rnd, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = ["".join(rnd.choice(LANGS["en"]) for _ in range(rnd.randrange(1, 3))) for _ in range(rnd.randrange(20, 60))]
        bad = rnd.random() < 0.4
        if bad:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_decoding_restores_disguises(spark):
    docs, _ = toxic_corpus(3, 200)
    chars = toxicity.char_model(spark.createDataFrame(docs, "doc_id long, text string"))
    for disguised, plain in (("1d10t", "idiot"), ("s.c.u.m", "scum"), ("stuuuupid", "stupid"), ("m0r0n!!", "moron"), ("l0$er", "loser"), ("idiot###", "idiot"), ("that", "that"), ("12345", ""), ("***", "")):
        assert toxicity.restore(disguised, chars) == plain
    assert "scum" in toxicity.restored_words("you s c u m of", lambda t: toxicity.restore(t, chars))


def readings(token, i, lattice):
    if i == len(token):
        yield "", 0.0
        return
    for to, text, cost in lattice[i]:
        for rest, more in readings(token, to, lattice):
            yield text + rest, cost + more


def test_viterbi_finds_the_best_of_all_readings(spark):
    docs, _ = toxic_corpus(3, 200)
    chars = toxicity.char_model(spark.createDataFrame(docs, "doc_id long, text string"))

    def value(text, cost):
        at, s = "^^", -cost
        for y in [*map(chars.fold, text), "^"]:
            s += chars.log(at, y)
            at = at[1] + y
        return s

    tokens = ["1d10t", "l00ser", "m0r0n!!", "s.c-u_m", "|)iot", "a$$h", "sttuuupid", "$cum", "()ver", "m+o+ron", "x1|<1"]
    tokens += ["".join(t) for t in itertools.product("i1|", ".d)", "0o", "t+")][::3]
    for token in tokens:
        best = max(value(text, cost) for text, cost in readings(token, 0, toxicity.arcs(token)))
        got = toxicity.decode(token, chars, blank=1e9)
        costs = [cost for text, cost in readings(token, 0, toxicity.arcs(token)) if text == got]
        assert value(got, min(costs)) == pytest.approx(best)


def test_tokens_of_symbols_enter_the_lattice(spark):
    rows = [(k, "the ass and die that ass with die pass lass") for k in range(50)]
    chars = toxicity.char_model(spark.createDataFrame(rows, "doc_id long, text string"))
    for disguised, plain in (("@$$", "ass"), ("455", "ass"), ("|)13", "die"), ("@ss", "ass"), ("a$$", "ass"), ("7734205", ""), ("--", "")):
        assert toxicity.restore(disguised, chars) == plain


def test_ids_and_labels_of_any_type(spark):
    docs, labels = toxic_corpus(4, 200)
    d = spark.createDataFrame([(f"d{i:04}", t, "x", 3) for i, t in docs], "doc_id string, text string, score string, n int")
    y = spark.createDataFrame([(f"d{i:04}", b) for i, b in labels], "doc_id string, toxic long").selectExpr("*", "toxic AS quality")
    for got in (toxicity.score(d, toxicity.train(d, y)), quality.score(d, quality.train(d, y, per_class=30))):
        rows = got.collect()
        assert len(rows) == 200 and {r.n for r in rows} == {3} and len({r.score for r in rows}) > 1


def test_toxicity_learns_and_sees_through_disguises(spark):
    docs, labels = toxic_corpus(4, 400)
    held, truth = toxic_corpus(5, 100)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    extra = [(900, None), (901, ""), (902, "the " * 30000), (903, "the and that of " * 5 + "1d1ot s c u m lo0ser m0ron"), (903, "the")]
    rows = spark.createDataFrame([*held, *extra], "doc_id long, text string").selectExpr("*", "'x' AS score")
    got = toxicity.score(rows, model, keep=["doc_id"], cache_tokens=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert np.mean([(by[i][0] >= 0.7) == bool(y) for i, y in truth]) > 0.95
    assert max(by[903]) > 0.7 and max(by[900][0], by[901][0], by[902][0]) < 0.7


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for labels in ([], [(1, None)], [(1, 1)]):
        model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(d, model).collect()] == [0.0]


def test_quality_votes(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i, (_, text, _) in enumerate(texts(7, 300)):
        bad = rnd.random() < 0.3
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text))
        labels.append((i, int(not bad)))
    d = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "der die " * 20000), (902, "x")], "doc_id long, text string").selectExpr("*", "'x' AS terms", "2 AS label")
    train = spark.createDataFrame(labels, "doc_id long, quality int").filter("doc_id % 3 <> 0")
    space = quality.train(d.select("doc_id", "text"), train, per_class=60)
    got = quality.score(d, space, keep=["doc_id", "label"]).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got if r.doc_id < 900 and r.doc_id % 3 == 0]) > 0.95
    assert all(r.score == pytest.approx(space.prior) for r in got if r.doc_id in (900, 901))
    # Blocked votes equal the plain computation.
    z = space.project(np.abs(np.random.default_rng(0).standard_normal((5, quality.N_TERMS))).astype(np.float32))
    weight = np.where(space.labels == 1, space.prior / space.labels.mean(), (1 - space.prior) / (1 - space.labels.mean()))
    for row, v in zip(z, quality.votes(space, z, 7), strict=True):
        c = space.vectors @ row
        k = np.argsort(-c)[:7]
        s = np.maximum(c[k], 0) ** 8 * weight[k]
        assert v == pytest.approx((s * space.labels[k]).sum() / s.sum(), rel=1e-4)


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    space = quality.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(d, space).collect()] == [0.0]


def test_ties_go_to_the_first_of_the_sample():
    rnd = np.random.default_rng(4)
    vectors = np.repeat(rnd.standard_normal((6, 8)).astype(np.float32), 5, axis=0)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = (rnd.random(30) < 0.5).astype(np.float32)
    space = quality.Space(None, None, vectors, labels, 0.5)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    z = vectors[::5][:, :] + np.float32(0)
    for row, v in zip(z, quality.votes(space, z, 7), strict=True):
        c = (row[None] @ vectors.T)[0]
        k = np.argsort(-c, kind="stable")[:7]
        s = np.maximum(c[k], 0) ** 8 * weight[k]
        assert v == pytest.approx((s * labels[k]).sum() / s.sum(), rel=1e-3)
