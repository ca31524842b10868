"""SimHash near-dedup by a generalised pigeonhole (operator 2).

A text's fingerprint has bit b set if over half of its shingles' hashes have.
Two forms share the machinery of ``pigeonhole``:

* ``near_duplicates``: fingerprints of 64 bits that differ in ``radius`` bits or
  fewer link. Parts and thresholds are such that no link is missed. A bucket of
  at most ``bucket`` fingerprints is searched in memory. The fingerprints of a
  larger one are filed again, by parts of the bits that the bucket's own part
  leaves out; and those that still crowd under every value within half the
  radius of theirs: two that share such a value link, and a value has a bounded
  number of them. So any group costs its size, not its square.
* ``near_copies``: texts are alike if the sets of their runs of ``shingle`` words
  have a Jaccard similarity of ``least`` or more. Their fingerprints have 1,024
  bits, which differ with a probability that the similarity bounds; parts are
  probed until a pair at ``least`` escapes with ``miss`` at most. The members of a
  bucket whose fingerprints are near enough make a least spanning forest by their
  differing bits, whose edges, fewer than the members, are checked on the whole
  sets; those at ``least`` or above link. Where a forest left candidates out, its
  members meet again, nearest candidates first, and every candidate between two
  that are not connected yet is checked, unless counts of their runs by ranges of
  hashes show that they share too few, until none is left: so the components are
  those of checking all candidates, and pairs that are connected anyway cost nothing.
  Members of a bucket of over ``bucket`` meet in chunks, and some leaders meet all;
  afterwards only those meet again that the bucket's largest component lacks.

Linked documents form components. Copies are one fingerprint (in ``near_copies``
one hash of all lower-case words).

Nulls and texts without words have fingerprint zero and link like any other.
Rows that repeat a doc_id are documents of their own with the same id. A null
doc_id never names a component unless all its documents have none. Extra columns
are left out by ``near_duplicates`` and stay in ``near_copies``, but for columns
named ``_hash`` and ``_rest``. An empty table gives none. Texts are read whole,
whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.graph import components
from demolake.llm.pigeonhole import bit_statistics, bounds, by_bucket, n_keys, plan_bands, plan_parts, probe_keys, signed, small_pairs, spanning
from demolake.llm.scratch import materialize
from demolake.llm.text import mix, pieces, range_hashes, releasing, small_batches, text_buffer, words_of

BUCKET = 4096
LANES = 16
#: Ranges of hashes in which runs are counted: what two texts share is in each no more than the smaller count.
CELLS = 256
_ODDS = mix(np.arange(1, LANES + 1, dtype=np.uint64)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits (packed in 64-bit lanes) that over half of the rows of hashes have set; hashes: rows by lanes."""
    ones = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for k in range(0, len(hashes), 240):  # counts fit a byte
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + 240]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower changes A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends[:-1])]
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]
    return int(majority(np.array(hashes, dtype=np.uint64)[:, None]).view(np.int64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = 4, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, a 64-bit fingerprint of the text as a signed number."""
    small_batches(docs.sparkSession)
    keep = list(keep)

    @releasing
    def run(batches):
        for whole in batches:
            index = whole.schema.get_field_index("text")
            for batch in pieces(whole, index):
                fp = pa.array([fingerprint(t, shingle) for t in batch.column(index).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), fp], names=[*keep, "fp"])

    schema = docs.select(*keep).limit(0).selectExpr("*", "0L fp").schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect the members of every bucket of rows (key, fp) as all links within the radius would."""

    def act(keys, fp):
        u = fp.view(np.uint64)
        starts, sizes = bounds(keys)
        i, j, _ = small_pairs(sizes, [u], 32, radius)
        a, b = [i], [j]
        for s, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            x, y = spanning(u[s : s + size], radius)
            a.append(x + s)
            b.append(y + s)
        ends = np.sort(np.stack([fp[np.concatenate(a)], fp[np.concatenate(b)]]), axis=0)
        ends = np.unique(ends, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return by_bucket(rows.select("key", "fp"), act, "a long, b long")


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """All links among fps, up to connection, without buckets: linked fingerprints share a value within half the radius of both.

    A value has as many fingerprints near it as there are ways to flip so few bits (2,081 for a radius of 4).
    """
    if radius > 4:
        raise ValueError("a radius of over 4 bits would file a fingerprint under too many values")
    flips = [sum(1 << b for b in bits) for r in range(-(-radius // 2) + 1) for bits in combinations(range(64), r)]
    masks, far = np.array(flips, dtype=np.uint64).view(np.int64), np.array([f.bit_count() > radius // 2 for f in flips])

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k in range(0, len(fp), 32):
                x = fp[k : k + 32]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ masks).ravel()), pa.array(np.repeat(x, len(masks))), pa.array(np.tile(far, len(x)))], names=["value", "fp", "far"])

    balls = fps.select("fp").mapInArrow(run, "value long, fp long, far boolean").groupBy("value").agg(F.min(F.when(~F.col("far"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("all"))
    return balls.filter("a IS NOT NULL AND size(all) > 1").select("a", F.explode("all").alias("b")).filter("a != b").distinct()


def _crowded(rows: DataFrame, bucket: int) -> DataFrame:
    """Keys of more than ``bucket`` rows: one in so many rows at most."""
    return materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket), "crowded")


def link_fingerprints(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Columns node, root for every fingerprint that another one reaches by links; fps: distinct fp."""
    n = fps.count()
    plan = plan_parts(bit_statistics(fps.select(F.array("fp").alias("bits")), 1)[0], n, radius)
    fan_out = sum(n_keys(len(group), t) for _, group, t in plan)
    spread = max(1, n * fan_out // 1_000_000)  # a few small rows become many
    rows = probe_keys(fps.repartition(spread, "fp"), plan, lambda _: F.col("fp"), ["fp"])
    crowded = _crowded(rows, bucket)
    if crowded.isEmpty():
        return components(bucket_links(rows, radius))
    links = bucket_links(rows.join(crowded, "key", "left_anti"), radius)
    inside, again = rows.join(crowded, "key"), None
    for k, (_, group, t) in enumerate(plan):
        if t >= 0:
            rest = [b for b in range(64) if b not in group]
            masks = [signed(sum(1 << b for b in rest[m :: radius + 1])) for m in range(radius + 1)]
            sub = F.explode(F.array(*(F.xxhash64("key", F.lit(m), F.col("fp").bitwiseAND(F.lit(mask))) for m, mask in enumerate(masks)))).alias("key")
            part = inside.filter(F.col("part") == k).select(sub, "fp")
            again = part if again is None else again.union(part)
    dense = _crowded(again, bucket)
    links = links.union(bucket_links(again.join(dense, "key", "left_anti"), radius))
    if not dense.isEmpty():
        links = links.union(ball_links(again.join(dense, "key", "left_semi").select("fp").distinct(), radius))
    return components(links)


def near_duplicates(docs: DataFrame, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Columns doc_id, fp, component_id (the smallest doc_id reachable): one row per document."""
    rows = materialize(fingerprints(docs, shingle=shingle), "fingerprints")
    copies = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "copies")
    links = link_fingerprints(copies.select("fp"), radius)
    owned = materialize(copies.join(links, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "owners")
    named = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(owned.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# -- texts by the similarity of their runs of words --------------------------------------------


def run_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of all words of each text (0: no words), and the sorted distinct hashes of its runs of words."""
    data, ends = text_buffer(column)
    data = _LOWER[data]
    starts, stops, first = words_of(data, ends)
    words = range_hashes(_BYTES[data], starts, stops) if len(starts) else np.zeros(0, np.uint64)
    whole = np.where(first[1:] > first[:-1], range_hashes(words, first[:-1], first[1:]), np.uint64(0))
    places = np.arange(max(len(words) - shingle + 1, 0))
    grams = range_hashes(words, places, places + shingle)
    sets = []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        sets.append(np.unique(grams[a : b - shingle + 1]) if b - a >= shingle else whole[k : k + 1] if b > a else words[:0])
    return whole, sets


def wide_fingerprints(docs: DataFrame, *, keep: Sequence[str], shingle: int = 5) -> DataFrame:
    """The columns ``keep`` with fp, the hash of all words, and bits, the lanes of the fingerprint of the set of runs (null: one run or none)."""
    small_batches(docs.sparkSession)
    keep = list(keep)

    @releasing
    def run(batches):
        for whole in batches:
            index = whole.schema.get_field_index("text")
            for batch in pieces(whole, index, 2 << 20):
                fp, sets = run_hashes(batch.column(index), shingle)
                bits = [majority(mix(s[:, None] * _ODDS)).view(np.int64) if len(s) > 1 else None for s in sets]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(fp.view(np.int64)), pa.array(bits, pa.list_(pa.int64()))], names=[*keep, "fp", "bits"])

    schema = docs.select(*keep).limit(0).selectExpr("*", "0L fp", "cast(null AS array<bigint>) bits").schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def run_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """Columns fp, runs, the bytes of the sorted hashes, and counts, how many of them fall into each of ``CELLS`` ranges, of (fp, text)."""

    def counts(s: np.ndarray) -> bytes:
        ends = np.searchsorted(s, np.arange(1, CELLS, dtype=np.uint64) << np.uint64(64 - int(CELLS).bit_length() + 1))
        return np.diff(np.concatenate([[0], ends, [len(s)]])).astype(np.int32).tobytes()

    @releasing
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 1, 2 << 20):
                sets = run_hashes(batch.column(1), shingle)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([counts(s) for s in sets], pa.binary())], names=["fp", "runs", "counts"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, runs binary, counts binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of fp whose sets have a similarity of ``least`` or more."""

    @releasing
    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, kept = whole.slice(k, 256), []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9 else 0
                    kept.append(both >= least * (len(x) + len(y) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one, two = (sets.select(F.col("fp").alias(n), F.col("runs").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def forest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges (i, j) among n nodes make the least spanning forest by (apart, place), and each node's tree: each tree takes its shortest edge out, until none is left."""
    order = np.argsort(apart, kind="stable")
    i, j = i[order], j[order]
    tree, left, taken = np.arange(n), np.arange(len(i)), []
    while len(left):
        a, b = tree[i[left]], tree[j[left]]
        out = a != b
        left, a, b = left[out], a[out], b[out]
        if not len(left):
            break
        best = np.full(n, len(i))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        mine = np.unique(best[best < len(i)])
        taken.append(mine)
        # Trees join along these edges: to the smaller number, until nothing changes.
        one, two = tree[i[mine]], tree[j[mine]]
        name = np.arange(n)
        while True:
            low = np.minimum(name[one], name[two])
            before = name.copy()
            np.minimum.at(name, one, low)
            np.minimum.at(name, two, low)
            name = name[name]
            if (name == before).all():
                break
        tree = name[tree]
    return (order[np.concatenate(taken)] if taken else order[:0]), tree


def _distance(lanes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    apart = np.zeros(len(i), dtype=np.int32)
    for lane in range(LANES):
        x = lanes[:, lane]
        apart += np.bitwise_count(x[i] ^ x[j])
    return apart


def _lanes(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.stack(bits).view(np.uint64)) if len(bits) else np.zeros((0, LANES), np.uint64)


def _blocks(u: np.ndarray, v: np.ndarray, s: int, size: int, near: int):
    """Pairs of one bucket whose first 128 bits differ in ``near`` at most, a block of rows at a time."""
    for k in range(s, s + size, 256):
        x, y = u[k : min(k + 256, s + size)], v[k : min(k + 256, s + size)]
        one, two = np.nonzero(np.bitwise_count(x[:, None] ^ u[k : s + size]) + np.bitwise_count(y[:, None] ^ v[k : s + size]) <= near)
        up = one < two
        yield k + one[up], k + two[up]


def nearest_links(rows: DataFrame, near: int, limit: int) -> DataFrame:
    """Of each bucket of rows (key, fp, bits) a least spanning forest, and the members of trees that left candidates out.

    Candidates are members whose first 128 bits differ in ``near`` at most and all bits in ``limit`` at most; distances are differing bits.
    An edge is a row (a, b) without key; a member is a row (a) with a key of its tree, equal for equal trees of other buckets.
    """

    def act(keys, fp, bits):
        lanes = _lanes(bits)
        u, v = np.ascontiguousarray(lanes[:, 0]), np.ascontiguousarray(lanes[:, 1])
        starts, sizes = bounds(keys)
        pairs = [small_pairs(sizes, [u, v], 12, near)[:2]]
        kept: list[tuple] = []
        names = mix(fp.view(np.uint64))

        def settle():
            i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
            pairs.clear()
            apart = _distance(lanes, i, j)
            fine = apart <= limit
            i, j = i[fine], j[fine]
            nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            edges, tree = forest(at[: len(i)], at[len(i) :], apart[fine], len(nodes))
            a, b = fp[i[edges]], fp[j[edges]]
            kept.append((np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)))
            size, held = np.bincount(tree, minlength=len(nodes)), np.bincount(tree[at[: len(i)]], minlength=len(nodes))
            name = np.zeros(len(nodes), np.uint64)
            np.add.at(name, tree, names[nodes])
            more = (held >= size)[tree]
            kept.append((fp[nodes[more]], np.zeros(more.sum(), np.int64), (mix(name)[tree[more]] | np.uint64(1)).view(np.int64)))

        for s, size in zip(starts[sizes > 12].tolist(), sizes[sizes > 12].tolist(), strict=True):
            pairs.extend(_blocks(u, v, s, size, near))
            if sum(len(p[0]) for p in pairs) > 1_000_000:  # buckets are settled whole
                settle()
        if pairs:
            settle()
        a, b, key = (np.concatenate(c) for c in zip(*kept, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key)], names=["a", "b", "key"])

    return by_bucket(rows.select("key", "fp", "bits"), act, "a long, b long, key long", at_once=20_000).distinct()


def unconnected(rows: DataFrame, near: int, low: int, limit: int, least: float) -> DataFrame:
    """All candidate pairs (a, b) of buckets (key, fp, root, bits, counts) that have different roots, differ in more than ``low`` bits and ``limit`` at most,
    and can have a similarity of ``least`` or more: they share no more runs than the smaller counts of each range add up to."""

    def act(keys, fp, root, bits, counts):
        lanes = _lanes(bits)
        u, v = np.ascontiguousarray(lanes[:, 0]), np.ascontiguousarray(lanes[:, 1])
        cells = np.frombuffer(b"".join(counts), np.int32).reshape(len(fp), CELLS)
        size = cells.sum(axis=1, dtype=np.int64)
        starts, sizes = bounds(keys)
        found = []
        for s, many in zip(starts.tolist(), sizes.tolist(), strict=True):
            for i, j in _blocks(u, v, s, many, near):
                other = root[i] != root[j]
                i, j = i[other], j[other]
                apart = _distance(lanes, i, j)
                fine = (apart > low) & (apart <= limit)
                i, j = i[fine], j[fine]
                both = np.concatenate([np.minimum(cells[i[k : k + 8192]], cells[j[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 8192)] or [np.zeros(0, np.int64)])
                can = both >= least * (size[i] + size[j] - both) - 1e-9
                found.append((fp[i[can]], fp[j[can]]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return by_bucket(rows.select("key", "fp", "root", "bits", "counts"), act, "a long, b long", at_once=20_000).distinct()


def _with_leaders(rows: DataFrame, crowded: DataFrame, bucket: int, leaders: int = 64) -> DataFrame:
    """Rows of crowded keys in chunks of about half of ``bucket``; the leaders of a key, some of its rows by hash, are in all its chunks."""
    chunks = F.ceil(2 * F.col("n") / bucket).cast("long")
    inside = rows.join(crowded, "key").withColumn("_h", F.xxhash64("fp", F.lit(5)))
    # about so many leaders a key: a row leads if its hash is in the key's share
    leads = F.pmod(F.shiftright("_h", 20), F.lit(1 << 30)) * F.col("n") < leaders * (1 << 30)
    own = F.pmod("_h", chunks)
    dealt = inside.withColumn("_c", F.explode(F.when(leads, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))))
    return dealt.select(F.xxhash64("key", "_c").alias("key"), *(c for c in rows.columns if c != "key"))


def _minor_meet_all(rows: DataFrame, bucket: int) -> DataFrame:
    """Rows (key, fp, root, and others) of crowded keys, so that each row outside of a key's largest component meets all rows of its key: chunks of the former by chunks of all."""
    half = bucket // 2
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("_n"))
    tops = counts.groupBy("key").agg(F.max_by("root", F.struct("_n", "root")).alias("_top"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    tops = tops.filter("_all > _most")
    inside = rows.join(tops, "key").withColumns({"_minor": F.col("root") != F.col("_top"), "_h": F.xxhash64("fp", F.lit(7))})
    minors, alls = F.ceil((F.col("_all") - F.col("_most")) / half).cast("long"), F.ceil(F.col("_all") / half).cast("long")
    mine, other = F.pmod("_h", minors), F.pmod("_h", alls)
    as_all = inside.withColumns({"_i": F.explode(F.sequence(F.lit(0), minors - 1)), "_j": other})
    as_minor = inside.filter("_minor").withColumns({"_i": mine, "_j": F.explode(F.sequence(F.lit(0), alls - 1))})
    dealt = as_all.unionByName(as_minor).select(F.xxhash64("key", "_i", "_j").alias("key"), *(c for c in rows.columns if c != "key"))
    return dealt.dropDuplicates(["key", "fp"])


def _several_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, fp, root) of the keys whose members have several roots. A member stands under many keys; its root is looked up once, and its keys are dealt once."""
    members = rows.groupBy("fp").agg(F.collect_list("key").alias("keys"))
    found = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(found.select(F.explode("keys").alias("key"), "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a != _b").select("key")
    return materialize(rooted.join(several, "key", "left_semi"), "open")


def link_texts(signed_: DataFrame, texts: Callable[[DataFrame], DataFrame], *, shingle: int = 5, least: float = 0.8, miss: float = 0.002, bucket: int = 2048) -> DataFrame:
    """Columns node, root for every fp that a link reaches. signed_: distinct fp with bits; texts: gives (fp, text) of a table of fp."""
    fps = signed_.filter("bits IS NOT NULL")
    n = fps.count()
    # Bits differ as often as the angle between the sets; sets of few runs a little more often than that.
    differ = math.acos(2 * least / (1 + least)) / math.pi + 0.01
    plan = plan_bands(bit_statistics(fps, LANES), max(n, 2), differ, miss)
    within = lambda size, wide: math.ceil(size * differ + wide * math.sqrt(size * differ * (1 - differ)))
    near, limit = within(128, 4.4), within(64 * LANES, 3.5)
    spread = fps.repartition(max(1, n * sum(n_keys(len(group), t) for _, group, t in plan) // 200_000), "fp")
    keyed = probe_keys(spread.select("fp", "bits"), plan, lambda lane: F.col("bits")[lane], ["fp", "bits"]).select("key", "fp", "bits")
    crowded = _crowded(keyed, bucket)
    full = not crowded.isEmpty()
    met = keyed.join(crowded, "key", "left_anti").union(_with_leaders(keyed, crowded, bucket)) if full else keyed
    found = materialize(nearest_links(met, near, limit), "pairs")
    doubt = found.filter("key != 0").select("key", F.col("a").alias("fp"))
    inside = materialize(keyed.join(crowded, "key", "left_semi").select("key", "fp"), "crowded-rows") if full else None
    asked = found.filter("key = 0").select(F.explode(F.array("a", "b")).alias("fp"))
    sets = materialize(run_sets(texts((asked.union(inside.select("fp")) if full else asked).distinct()), shingle), "sets")
    known = materialize(fps.join(sets.select("fp", "counts"), "fp"), "members")
    links = materialize(similar(found.filter("key = 0").select("a", "b"), sets, least), "links")
    roots = components(links)
    asking = [doubt, inside] if full else [doubt]
    low = -1
    for high in (within(64 * LANES, 0), limit):
        # components only grow, so that keys of one component are done with: the next round asks for the others alone
        asking = [_several_roots(rows, roots) for rows in asking]
        open_ = (asking[0].unionByName(_minor_meet_all(asking[1], bucket)) if full else asking[0]).join(known, "fp")
        more = materialize(unconnected(open_, near, low, high, least), "pairs")
        if not more.isEmpty():
            new = materialize(similar(more, sets, least), "links")
            if not new.isEmpty():
                links = links.union(new)
                roots = components(links)
        low = high
    return roots


def near_copies(docs: DataFrame, *, order: Sequence[str] = ("doc_id",), shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs for each component of near copies: the smallest by ``order`` (nulls last), then by hashes of the whole row."""
    names = [c for c in docs.columns if c not in ("_hash", "_rest")]
    rest = F.xxhash64(*(F.col(c) for c in names), F.lit(2))
    keyed = docs.select(*(F.col(c) for c in names), F.xxhash64("text").alias("_hash"), rest.alias("_rest"))
    lead = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))), "_hash", "_rest")
    lean = materialize(wide_fingerprints(keyed, keep=[*order, "_hash", "_rest"], shingle=shingle), "fingerprints")
    copies = materialize(lean.groupBy("fp").agg(F.min(F.struct(lead.alias("lead"), "bits")).alias("m")).select("fp", "m.lead", "m.bits"), "copies")

    def rows_of(leads: DataFrame, kind: str) -> DataFrame:
        wanted = leads.select(F.col("lead._hash").alias("_h"), F.col("lead._rest").alias("_r"), *(c for c in leads.columns if c == "fp"))
        return keyed.join(wanted, (F.col("_hash") == F.col("_h")) & (F.col("_rest") == F.col("_r")), kind).dropDuplicates(["_hash", "_rest"])

    roots = link_texts(copies.select("fp", "bits"), lambda fps: rows_of(copies.join(fps, "fp").select("fp", "lead"), "inner").select("fp", "text"), shingle=shingle, least=least)
    leads = copies.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("lead").alias("lead"))
    return rows_of(leads, "left_semi").select(*names)


def op2_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
