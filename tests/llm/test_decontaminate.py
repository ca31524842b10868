import random
import re

from demolake.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(window, len(v))
        for s in range(len(v) - k + 1 if v else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def make(seed, n_docs=60, n_items=25):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "é", "dd", "x1"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 5, 9, 30])))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        text = [rnd.choice([*vocab, "zz", "A,B"]) for _ in range(rnd.randrange(80))]
        if rnd.random() < 0.5:
            item = rnd.choice(items)[1].upper().split()
            text[10:10] = item
        docs.append((i, " ".join(text)))
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    return decontaminate.find_contamination(d, i, keep=["doc_id"], **options).collect()


def test_matches_brute_force(spark):
    for window in (4, 7):
        docs, items = make(window)
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in run(spark, docs, items, window=window)}
        assert got == {i: brute(t, items, window) for i, t in docs}


def test_many_shards_give_the_same(spark):
    docs, items = make(3)
    one = sorted(map(tuple, run(spark, docs, items, window=5)))
    assert one == sorted(map(tuple, run(spark, docs, items, window=5, shard_words=40)))


def test_edges(spark):
    items = [(1, "alpha beta gamma"), (2, None), (3, "...")]
    docs = [(1, None), (2, ""), (3, "!!!"), (4, "Alpha, BETA gamma"), (4, "Alpha, BETA gamma"), (None, "x " * 30000 + "alpha beta gamma")]
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in run(spark, docs, items)]
    assert sorted(got, key=str) == sorted([(1, 0, 0, []), (2, 0, 0, []), (3, 0, 0, []), (4, 3, 3, ["1"]), (4, 3, 3, ["1"]), (None, 30003, 3, ["1"])], key=str)
    assert run(spark, [], items) == []
    assert run(spark, docs, [])[0].n_hit == 0


def test_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "keep this; Alpha, BETA gamma! and that", "s"), (2, "nothing here", "s")], "doc_id long, text string, source string")
    i = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove_contaminated(d, i, spans=True).collect()}
    assert out == {1: "keep this; ! and that", 2: "nothing here"}
    assert [r.doc_id for r in decontaminate.remove_contaminated(d, i).collect()] == [2]



def test_columns_of_clashing_names(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma", 7, "x", 5), (2, "nothing here", 8, "y", 6)], "doc_id long, text string, n_hit long, items string, c0 int")
    i = spark.createDataFrame([(1, "alpha beta gamma", 3)], "item_id long, text string, n_hit int")
    assert [tuple(r) for r in decontaminate.remove_contaminated(d, i).collect()] == [(2, "nothing here", 8, "y", 6)]
    assert {r.doc_id: (r.n_hit, list(r["items"]), r.c0) for r in decontaminate.find_contamination(d, i).collect()} == {1: (3, ["1"], 5), 2: (0, [], 6)}


def test_hot_items_cost_their_number():
    """Very many equal short items, short items that end in another, and items of one template: no state copies another's items."""
    many = 50_000
    equal = [(f"i{k:05}", [b"yes"], True) for k in range(many)] + [(f"j{k:05}", [b"w%d" % k, b"yes"], True) for k in range(5_000)]
    short = decontaminate.Automaton(equal, 13)
    assert len(short.sets) == 5_001 and sum(map(len, short.sets)) == many + 5_000
    spans, names = short.scan([b"no", b"w7", b"yes", b"no", b"yes"])
    assert decontaminate.union(spans) == [[1, 3], [4, 5]] and names == [*(f"i{k:05}" for k in range(many)), "j00007"]
    template = [b"t%d" % k for k in range(40)]
    long = decontaminate.Automaton([(f"i{k:05}", [*template, b"q%d" % k], False) for k in range(5_000)], 13)
    spans, names = long.scan(template * 20)
    assert len(names) == 5_000 and len(long.known) == 1 and decontaminate.union(spans) == [[0, 800]]


def test_short_items_inside_each_other():
    words = [b"a", b"b", b"a", b"b", b"c"]
    items = [("abc", words[2:], True), ("bc", words[3:], True), ("c", words[4:], True), ("b", [b"b"], True), ("again", [b"b"], True), ("xbc", [b"x", b"b", b"c"], True)]
    automaton = decontaminate.Automaton(items, 5)
    spans, names = automaton.scan(words)
    assert decontaminate.union(spans) == [[1, 5]] and names == ["abc", "again", "b", "bc", "c"]
    assert automaton.scan([b"x", b"b", b"c"])[1] == ["again", "b", "bc", "c", "xbc"] and automaton.scan([b"z"]) == ([], [])
