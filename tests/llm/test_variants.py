import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demolake.llm import variants
from tests.test_queries import SF


def counted(docs):
    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if i is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return out


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(docs, ratio=2):
    n = {w: k for w, k in counted(docs).items() if len(w) >= 5 and k >= 3}
    keys = defaultdict(set)  # words that can be near share what is left without one code point
    for w in n:
        for k in range(len(w) + 1):
            keys[w[:k] + w[k + 1 :]].add(w)
    form, out = {}, {}
    for w in n:
        found = {x for k in range(len(w) + 1) for x in keys[w[:k] + w[k + 1 :]] if near(w, x)}
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = len(found)

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n)


def results(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus():
    base = ["colour", "color", "colours", "coloured", "aaaaa", "aaaaaa", "aaaab", "straße", "strasse", "Éclair", "éclair", "eclair", "grey x", "abcde", "abcdf", "bbcde", "abcdef", "zzzzz1zzzzz", "ÀÉ÷×ÿ", "five", "fives"]
    texts = [" ".join(base[: 1 + k % len(base)] * (1 + k % 4)) for k in range(60)]
    chain = "fghija " * 3 + "fghijb " * 7 + "fghikb " * 16
    return [*enumerate(texts), (None, chain), (None, "colour colour color"), (3, None), (4, ""), (5, "COLOURācolour " * 50), (5, "COLOURācolour " * 50)]


def test_variants(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS longer").repartition(3)
    want = brute(docs)
    assert results(variants.variants(df)) == want and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert variants.variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="frequent"):
        variants.variants(df, ratio=1)


def test_full_tiles_are_tiled_again(spark):
    """A tile of two words is full here, so that tiles go down to words that differ in their last free place."""
    letters = "abcde"
    words = [f"{a}{b}x{c}{d}" for a in letters for b in letters for c in letters for d in letters[: 1 + ord(a) % 4]] + [f"{a}{b}{c}xx{a}" for a in letters for b in letters for c in letters]
    docs = [(k, " ".join(w for j, w in enumerate(words) if j % 7 >= k % 5)) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert results(variants.variants(df, tile_rows=2)) == results(variants.variants(df)) == brute(docs)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=3, max_size=5), min_size=1, max_size=12))
def test_matrices_against_single_edits(words):
    words = sorted(words)
    for longer in (4, 5):
        held = [w for w in words if len(w) in (longer - 1, longer)]
        count, first = variants.near_in_tile(held, longer, 0, 0, 1 << 20, block=40)
        for k, w in enumerate(held):
            found = [j for j, x in enumerate(held) if near(w, x) and max(len(w), len(x)) == longer]
            assert (count[k], first[k]) == (len(found), min(found, default=len(held)))


def test_chains_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w0")], "word string, form string")
    assert {r.root for r in variants.roots(forms, 40).collect()} == {"w37"}


def test_an_altered_word_may_be_another_of_its_text():
    """Words that are altered aren't altered again, whatever they become."""
    texts = [(i, "abcde abcd abc ab a " * 3) for i in range(400)]
    total = Counter()
    for i, t in texts:
        total.update(variants.words_of(str(i), t))
    assert +total == +counted(texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert results(variants.op13_prefix_suffix_tiles(spark, SF)) == brute(docs)
