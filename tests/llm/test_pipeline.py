"""The pipeline on a small corpus with planted cases, each stage held against its plain computation."""

import os
import random
import zlib

import pytest

import corpus_pipeline
from demolake.llm.scratch import shared_dir
from tests.llm.test_decontaminate import brute as benchmark_hits
from tests.llm.test_nearcopies import runs
from tests.llm.test_substring import brute as repeats

SYLLABLES = "the of and ing tion er that with from ly ness un re".split()
INSULTS = ["idiot", "scum", "loser", "moron", "stupid"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    docs, labels, kinds = [], [], {}

    def add(text, kind):
        i = len(docs)
        docs.append((i, text, "en", f"s{i % 3}", len(text) if text is not None else None))
        kinds[i] = kind
        return i

    for _ in range(260):
        labels.append((add(prose(rnd, rnd.randrange(60, 120)), "clean"), 1, 0))
    for _ in range(120):
        words = prose(rnd, rnd.randrange(60, 100)).split()
        for _ in range(5):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        labels.append((add(" ".join(words), "toxic"), 0, 1))
    passage = prose(rnd, 60)
    for _ in range(6):
        add(f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}", "passage")
    item = prose(rnd, 30)
    for _ in range(5):
        add(f"{prose(rnd, 20)} {item} {prose(rnd, 20)}", "benchmark")
    near = prose(rnd, 90).split()
    for k in range(7):
        add(" ".join([*near[:40], f"other{k}", *near[40:]]), "near")
    copy = prose(rnd, 80)
    for _ in range(8):
        add(copy, "copy")
    add(None, "empty")
    add("", "empty")
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), docs, kinds, passage


@pytest.fixture(scope="module")
def stages(spark, corpus):
    path, tables = corpus[0], [spark.read.parquet(f"{corpus[0]}/documents.parquet").cache()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], path).write.parquet(f"{path}/after-{name}")
        tables.append(spark.read.parquet(f"{path}/after-{name}"))
    return [[r.asDict() for r in t.collect()] for t in tables]


def test_columns_stay(stages):
    for rows in stages[:-1]:
        assert set(rows[0]) == set(corpus_pipeline.COLUMNS)


def test_toxic_documents_go_and_clean_ones_stay(corpus, stages):
    kinds, left = corpus[2], {r["doc_id"] for r in stages[1]}
    toxic = [i for i, k in kinds.items() if k == "toxic"]
    unseen = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(i in left for i in unseen) <= 0.05 * len(unseen)
    assert sum(i not in left for i, k in kinds.items() if k == "clean") <= 2
    before = {r["doc_id"]: r for r in stages[0]}
    assert all(r == before[r["doc_id"]] for r in stages[1])


def test_one_document_of_each_component(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1]]
    sets, group = [runs(t) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = {min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
    assert {r["doc_id"] for r in stages[2]} == want and len(stages[2]) == len(want)


def test_repeated_passages_are_cut(corpus, stages):
    before = {r["doc_id"]: r for r in stages[2]}
    for doc, _, gone, kept in repeats([(r["doc_id"], r["text"]) for r in stages[2]], 35):
        row = next(r for r in stages[3] if r["doc_id"] == doc)
        assert row["text"] == (kept if gone else before[doc]["text"])
        assert row["n_chars"] == (len(kept) if gone else before[doc]["n_chars"])
    assert not any(corpus[3] in (r["text"] or "") for r in stages[3])


def test_contaminated_documents_go(spark, corpus, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus[0]}/benchmark.parquet").collect()]
    want = set()
    for r in stages[3]:
        n, hit, _ = benchmark_hits(r["text"], items, 13)
        if not hit or 20 * hit < n:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in stages[4]} == want
    assert len(stages[3]) - len(stages[4]) > 0


def test_every_document_is_read(stages):
    assert {r["doc_id"] for r in stages[5]} == {r["doc_id"] for r in stages[4]}
    assert min(r["mix_epochs"] for r in stages[5]) >= 1


def test_run_gives_the_last_stage(spark, corpus, stages):
    got = [r.asDict() for r in corpus_pipeline.run(spark, corpus[0]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, stages[5]))


def test_run_leaves_one_table(spark, corpus):
    before = set(os.listdir(shared_dir(spark)))
    corpus_pipeline.run(spark, corpus[0]).count()
    assert [n.split("-")[:2] for n in set(os.listdir(shared_dir(spark))) - before] == [["pipeline", "mixing"]]
