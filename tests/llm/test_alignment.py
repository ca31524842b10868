import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demolake.llm import alignment
from tests.test_queries import SF

PATHS = alignment.tokenizer_path("byte_bpe_50k.json"), alignment.tokenizer_path("piece_bpe_32k.model")
TEXTS = ["a b", "", None, "it's 12  apples,\n\tfine ", "é½ Ａ▁x", "<|endoftext|> </s><s>", "日本語のテキスト 👩‍👩‍👧 ok", " lead", "x" * 5000, "=" * 3000 + " " * 3000, "a b", "nul \x00 byte", "́ combining é", " nbsp 　wide", "Straße, naïve façade."]


def plain(text):
    """Ids and ends of both sides by the tokenizers alone, and the groups between common ends."""
    a, b = alignment.tokenizers(*PATHS)
    if not text:
        return None
    ids = a.whole.encode(f" {text}", add_special_tokens=False).ids, b.model.encode(text)
    if any(b"".join(side.bytes[i] for i in x) != f" {text}".encode() for side, x in zip((a, b), ids, strict=True)):
        return None
    ends = [list(itertools.accumulate(len(side.bytes[i]) for i in x)) for side, x in zip((a, b), ids, strict=True)]
    groups, at = [], (0, 0)
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = tuple(e.index(end) + 1 for e in ends)
        groups.append(tuple(x[f:t] for x, f, t in zip(ids, at, to, strict=True)))
        at = to
    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(docs):
    found = [(i, plain(t) or []) for i, t in docs]
    counts = Counter()
    for _, groups in found:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        sha = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


def results(df, id="doc_id"):
    return sorted(((r[id], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_alignment_against_all_pairs(spark):
    docs = [*enumerate(TEXTS), (None, "a b"), (3, "it's")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS portion", "'x' AS pairs", "2 AS n_a").repartition(3)
    assert results(alignment.align(df)) == brute(docs)
    assert results(alignment.align(df, portion=1)) == brute(docs)  # a portion for each batch
    got = {(r.doc_id, r.groups) for r in alignment.token_groups(df).collect()}
    assert got == {(i, written(plain(t) or [])) for i, t in docs}
    assert alignment.align(df.limit(0)).collect() == []


def test_other_ids_and_columns(spark):
    df = spark.createDataFrame([("k", "one two"), ("l", None)], "key string, body string")
    assert results(alignment.align(df, id="key", text="body"), "key") == brute([("k", "one two"), ("l", None)])


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the driver's tables")
def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert results(alignment.op11_merge_path(spark, SF)) == brute(docs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" .,'\n\tabé▁½́ "), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=4))
def test_chunks_are_the_whole_texts_tokens(texts):
    memory = alignment.Memory(*alignment.tokenizers(*PATHS))
    got = memory.groups(*memory.chunks(texts), len(texts))
    assert [g.decode() for g in got] == [written(plain(t) or []) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40), st.integers(1, 9))
def test_pieces_of_any_size_meet_the_same_ends(a, b, steps):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    upto_a, upto_b = alignment.common_ends(a, b, steps)
    common = np.intersect1d(a, b)
    assert a[upto_a - 1].tolist() == b[upto_b - 1].tolist() == common.tolist()


@given(st.lists(st.integers(0, 20), max_size=30), st.lists(st.integers(0, 20), max_size=30))
def test_diagonals_share_the_work(a, b):
    a, b = np.sort(np.array(a, np.int64)), np.sort(np.array(b, np.int64))
    order = np.lexsort((np.append(np.zeros(len(a)), np.ones(len(b))), np.append(a, b)))  # of equal ends a's first
    cuts = np.arange(len(a) + len(b) + 1)
    assert alignment.diagonals(a, b, cuts).tolist() == [int((order[:c] < len(a)).sum()) for c in cuts]


def test_wide_groups_link_by_distinct_ids():
    side = type("Side", (), {"size": 10, "lengths": np.ones(10, np.int64)})
    long = type("Side", (), {"size": 10, "lengths": np.full(10, 100, np.int64)})
    ids = np.arange(100) % 3
    g = alignment.Groups((side, long), [np.tile(ids, 1), np.array([7])], [np.array([100]), np.array([1])])
    few = [x.tolist() for x in g.pairs()]
    dense, alignment._DENSE = alignment._DENSE, 10
    try:
        assert [x.tolist() for x in g.pairs()] == few == [[0, 0, 0], [7, 17, 27], [34, 33, 33]]
    finally:
        alignment._DENSE = dense


def test_memory_forgets():
    memory = alignment.Memory(*alignment.tokenizers(*PATHS), most=2)
    for texts in (["a b c d"], ["c d e"], ["a b c d", None]):
        got = memory.groups(*memory.chunks(texts), len(texts))
        assert [g.decode() for g in got] == [written(plain(t) or []) for t in texts]
