"""Benchmark decontamination with a generalised suffix automaton (operator 1).

The words of all test items make one suffix automaton. Every document is
streamed through it once; the longest match that ends at each word gives the
windows that end there: ``window`` consecutive item words, or a whole item that
is shorter. Words inside any occurrence are hit. Documents never meet each
other, so nothing is shuffled.

Items are cut into pieces that overlap by ``window - 1`` words and dealt over
automata of at most ``shard_words`` words. One automaton is broadcast and its
results leave the task at once. A larger benchmark has several: each makes a pass
of its own over the texts, so that a worker never holds two, and spans of equal
texts are put together by a join.

Nulls and texts without words have no words and no hits. Repeated rows each get
their own result. A null item_id reads as the string ``null``. An empty
benchmark hits nothing; an empty documents table gives an empty result. Input
columns named n_words, n_hit, items or clean_text are replaced; others stay.
Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.scratch import materialize
from demolake.llm.text import ALNUM, pieces, releasing, small_batches

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ADDED = ("n_words", "n_hit", "items", "clean_text")


class Automaton:
    """A suffix automaton over the word sequences of many items."""

    def __init__(self, items: Sequence[tuple[str, list[bytes], bool]], window: int):
        """items: id, words, and whether a short sequence is a whole item (and so a window)."""
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.window = [-1], [0], window
        for _, words, _ in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.full = [0] * len(self.size)  # the state of the suffix of window words
        for v in order:
            self.full[v] = v if self.size[self.link[v]] < window <= self.size[v] else self.full[self.link[v]]
        names = sorted({name for name, _, _ in items})
        number = {name: k for k, name in enumerate(names)}
        windows: dict[int, set[int]] = {}
        own: dict[int, set[int]] = {}  # a whole short item is the longest sequence of its state
        for name, words, whole in items:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][w]
                if i + 1 >= window:
                    windows.setdefault(self.full[v], set()).add(number[name])
            if words and whole and len(words) < window:
                own.setdefault(v, set()).add(number[name])
        kept: dict[frozenset[int], int] = {}  # equal sets of items are kept once, and found by their number
        of = lambda held: {v: kept.setdefault(frozenset(ids), len(kept)) for v, ids in held.items()}
        self.items, self.own = of(windows), of(own)
        self.sets = [[names[k] for k in sorted(ids)] for ids in kept]
        self.near = [0] * len(self.size)  # the longest suffix, itself included, that is a whole short item
        for v in order:
            self.near[v] = v if v in own else self.near[self.link[v]]
        self.known: dict[frozenset[int], list[str]] = {}

    def names(self, found: frozenset[int]) -> list[str]:
        """The items of some sets, sorted; remembered, as documents of one kind find the same."""
        if found not in self.known:
            if sum(map(len, self.known.values())) + len(self.known) > 1_000_000:
                self.known.clear()
            sets = [self.sets[k] for k in found]
            self.known[found] = sets[0] if len(sets) == 1 else sorted(set().union(*sets))
        return self.known[found]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size

        def copy(p: int, q: int) -> int:
            c = len(size)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = c
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            return c

        if (q := nxt[last].get(w)) is not None:  # an earlier item has the same words
            return q if size[q] == size[last] + 1 else copy(last, q)
        v, p = len(size), last
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = v
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[v] = q if size[q] == size[p] + 1 else copy(p, q)
        return v

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Hit spans (start, end), which may overlap, and the sorted items whose windows occur."""
        nxt, link, size, full, near, own, window = self.next, self.link, self.size, self.full, self.near, self.own, self.window
        root, v, n = nxt[0], 0, 0
        spans: list[list[int]] = []
        found: set[int] = set()

        def hit(start: int, end: int) -> None:
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])

        for i, w in enumerate(words):
            t = nxt[v].get(w)
            if t is None:
                if w not in root:
                    v = n = 0
                    continue
                while t is None:
                    v = link[v]
                    t = nxt[v].get(w)
                n = size[v] + 1
            else:
                n += 1
            v = t
            if n >= window:
                hit(i + 1 - window, i + 1)
                found.add(self.items[full[v]])
            u = near[v]
            while u:  # at most one for each length below the window
                if size[u] <= n:
                    hit(i + 1 - size[u], i + 1)
                    found.add(own[u])
                u = near[link[u]]
        return spans, self.names(frozenset(found)) if found else []


def union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def _shards(items: DataFrame, window: int, shard_words: int):
    """Automata over all items, one at a time, of at most shard_words words each (a piece at least)."""
    words = F.filter(F.split(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")
    piece = max(shard_words // 16, 2 * window)
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), words.alias("words")).filter(F.size("words") > 0)
    cuts = rows.select("name", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece))).alias("at"), (F.size("words") < window).alias("whole"), "words")
    cuts = cuts.select("name", "whole", F.slice("words", F.col("at") + 1, piece + window - 1).alias("words"))
    total = cuts.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-2 * total // shard_words)) if total > shard_words else 1
    held = materialize(cuts.withColumn("shard", F.pmod(F.xxhash64("name", "words"), F.lit(shards))), "items")
    for k in range(shards):
        part = held.filter(F.col("shard") == k)
        yield shards, Automaton(sorted((r["name"], [w.encode() for w in r["words"]], r["whole"]) for r in part.toLocalIterator()), window)


def _words(text: str | None) -> tuple[bytes, list[bytes]]:
    raw = (text or "").encode("utf-8", "replace").translate(ALNUM)
    return raw, raw.split()


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, keep: Sequence[str] | None = None, clean: bool = False, shard_words: int = 400_000) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with n_words, n_hit and items (ids of the items found, sorted).

    ``clean`` adds ``clean_text``: the text without the stretches from the first to the last byte of each hit span.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED and not c.startswith("_")]
    texts, passes = docs.select(*dict.fromkeys([*keep, "text"])), None
    same = [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(3), "text").alias("_h2")]
    machine = None
    for shards, automaton in _shards(items, window, shard_words):
        machine = spark.sparkContext.broadcast(automaton)
        if shards == 1:
            break

        @releasing
        def search(batches, machine=machine):
            for whole in batches:
                for batch in pieces(whole, 2):
                    found = [machine.value.scan(_words(t)[1]) for t in batch.column(2).to_pylist()]
                    hit = pa.array([k for k, (spans, _) in enumerate(found) if spans], pa.int64())
                    spans = pa.array([found[k][0] for k in hit.to_pylist()], pa.list_(pa.list_(pa.int64())))
                    names = pa.array([found[k][1] for k in hit.to_pylist()], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit), spans, names], names=["_h1", "_h2", "_spans", "_names"])

        part = materialize(texts.select(*same, "text").mapInArrow(search, "_h1 long, _h2 long, _spans array<array<long>>, _names array<string>").dropDuplicates(["_h1", "_h2"]), "spans")
        passes = part if passes is None else passes.union(part)
        machine = None
    if passes is None:
        rows = texts.withColumns({"_spans": F.lit(None).cast("array<array<long>>"), "_names": F.lit(None).cast("array<string>")})
    else:
        all_ = passes.groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_names"))).alias("_names"))
        rows = texts.select("*", *same).join(all_, ["_h1", "_h2"], "left").drop("_h1", "_h2")
    schema = docs.select(*keep).limit(0).selectExpr("*", "0L n_words", "0L n_hit", "array('') items", *["'' clean_text"] * clean).schema

    @releasing
    def scan(batches):
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in pieces(whole, at):
                n_words, n_hit, items_, cleaned = [], [], [], []
                held = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "_spans", "_names")]
                for text, spans, names in zip(*held, strict=True):
                    raw, words = _words(text)
                    if machine is not None:
                        spans, names = machine.value.scan(words)
                    spans = union(spans or [])
                    n_words.append(len(words))
                    n_hit.append(sum(e - s for s, e in spans))
                    items_.append(sorted(names or ()))
                    if clean:
                        cleaned.append(_cut(text, raw, spans) if spans else text)
                out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                out += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items_, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(cleaned, pa.string())] * clean, names=[*keep, "n_words", "n_hit", "items", *["clean_text"] * clean])

    return rows.mapInArrow(scan, schema)


def _cut(text: str, raw: bytes, spans: list[list[int]]) -> str:
    data, places = text.encode("utf-8", "replace"), [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def contaminated(coverage_in: int = 20):
    """The rule on find_contamination's columns: some hit, and at least one word in ``coverage_in`` is hit."""
    return (F.col("n_hit") > 0) & (coverage_in * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame, *, spans: bool = False, coverage_in: int = 20, **options) -> DataFrame:
    """Docs without contaminated documents; with ``spans`` they stay, and lose their hit spans instead. Columns as in docs."""
    held = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called
    found = find_contamination(docs.select(*(F.col(c).alias(x) for c, x in held.items())), items, clean=spans, **options)
    if not spans:
        return found.filter(~contaminated(coverage_in)).select(*(F.col(x).alias(c) for c, x in held.items()))
    text = F.when(contaminated(coverage_in), F.col("clean_text")).otherwise(F.col("text"))
    return found.select(*((text if c == "text" else F.col(x)).alias(c) for c, x in held.items()))


def op1_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find_contamination(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
o AS (SELECT doc_id, s, k, win FROM (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw))) q SEMI JOIN iw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT o.doc_id, CAST(iw.item_id AS VARCHAR) AS x FROM o JOIN iw USING (k, win)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
