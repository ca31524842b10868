"""Substring dedup with prefix-partitioned suffix trees (operator 5).

A window is ``window`` consecutive words of one text. Every word covered by a
window whose words also start anywhere else is removed, from every copy.

Not every suffix has to travel. Each window picks an anchor inside it: the
place whose prefix of ``prefixes[0]`` words has the smallest hash. Equal windows
pick the same anchor, so suffixes are compared only around anchors, about one
word in fourteen, and only around those whose prefix occurs more than once:

1. a census counts the prefixes of all anchors. Where a prefix has more than
   ``group_rows`` anchors, its windows pick another anchor by a longer prefix, and
   are counted again: the prefix of a suffix is as long as its group needs to fit
   memory. The longest prefix is the window itself, whose tree is a single leaf:
   its occurrences are counted by a plain aggregation, whatever their number;
2. around each anchor of a repeated prefix, the words that its windows can
   reach (the context) go to a group chosen by that prefix. Equal contexts are
   merged within a task first;
3. each group becomes a suffix tree, as sorted suffixes and the lengths of their
   common beginnings. Inner nodes at least ``window`` words deep are repeats;
4. the repeats return to their texts by a join, and covered words go.

The Bloom filters that choose anchors have 16 bits for each prefix they hold,
``filter_bits`` at most. What a filter lets through wrongly costs work, never a
result, and groups are sized with it. Places of crowded prefixes are dealt over
``salts`` keys for the join.

Nulls and empty texts have no words. Texts shorter than a window stay whole.
Rows that repeat a doc_id and its text are copies of each other like any other
rows. An empty table gives an empty result. Words compare by 64-bit hashes
along the whole window. Input columns named n_words, n_removed or kept, or with
a leading underscore, are left out; others stay. A text may have 2^31 words,
more than a string can hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demolake.llm.scratch import materialize
from demolake.llm.text import mix, pieces, powers, range_hashes, releasing, small_batches, text_buffer, words_of

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


ADDED = ("n_words", "n_removed", "kept")


class Windows:
    """The windows of a batch of texts and the anchors they pick."""

    def __init__(self, column: pa.Array, window: int, prefixes: Sequence[int]):
        data, bounds = text_buffer(column)
        starts, ends, first = words_of(data, bounds)
        self.window, self.prefixes, n = window, prefixes, len(starts)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        self.first, self.next = first[:-1], first[1:]
        self.words = range_hashes(_BYTES[data], starts, ends) if n else np.zeros(0, np.uint64)
        self.symbols = np.maximum(self.words, np.uint64(1))  # 0 stands for no word
        self.starts = np.nonzero(self.text[: n - window + 1] == self.text[window - 1 :])[0] if n >= window else np.zeros(0, np.int64)

    def anchors(self, level: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor (a word's place) that each window picks at a level, and its prefix's hash."""
        prefix = self.prefixes[level]
        places = np.arange(len(self.words) - prefix + 1)
        grams = range_hashes(self.words, places, places + prefix)
        low = np.uint64((1 << 31) - 1)
        least, width, span = (grams & ~low) | places.astype(np.uint64), 1, self.window - prefix + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least[starts] & low).astype(np.int64)
        return at, mix(grams[at] + np.uint64(level)).view(np.int64)

    def dealt(self, crowded: Sequence[np.ndarray], levels: int):
        """Level, anchors and keys, level by level: a window goes on while its prefix is in the filter of crowded ones."""
        starts = self.starts
        for level in range(levels):
            if not len(starts):
                return
            at, keys = self.anchors(level, starts)
            on = _in_bloom(keys, crowded[level]) if level < len(crowded) else np.zeros(len(at), dtype=bool)
            mine, once = np.unique(at[~on], return_index=True)
            yield level, mine, keys[~on][once]
            starts = starts[on]

    def around(self, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The words that the windows of each anchor can reach, 0 beyond the text, and a hash of each such row."""
        places = at[:, None] + np.arange(-reach, self.window)
        text = self.text[at]
        inside = (places >= self.first[text][:, None]) & (places < self.next[text][:, None])
        rows = np.where(inside, self.symbols[np.where(inside, places, 0)], np.uint64(0))
        up, _ = powers(rows.shape[1] + 1)
        return rows, mix((rows * up[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)).view(np.int64)

    def second(self, at: np.ndarray) -> np.ndarray:
        """Another hash of the window that starts at each place."""
        return range_hashes(mix(self.symbols), at, at + self.window).view(np.int64)


def _bits(keys: np.ndarray, size: int) -> list[np.ndarray]:
    k = keys.view(np.uint64)
    return [(mix(k + np.uint64(seed)) % np.uint64(size)).astype(np.int64) for seed in (0x51ED270B, 0xA3C59AC3, 0x7F4A7C15)]


def _bloom(keys: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of ``size`` bits over the column akey, put together by Spark."""

    def spread(batches):
        for b in batches:
            for at in _bits(b.column(0).to_numpy(), size):
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["w", "b"])

    words = keys.select("akey").mapInArrow(spread, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def _in_bloom(keys: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for at in _bits(keys, 64 * len(bloom)):
        found &= (bloom[at >> 6] >> (at & 63)) & 1 == 1
    return found


def _valid(rows: np.ndarray, window: int) -> np.ndarray:
    gaps = np.zeros((len(rows), rows.shape[1] + 1), dtype=np.int16)
    np.cumsum(rows == 0, axis=1, out=gaps[:, 1:])
    return gaps[:, window:] == gaps[:, : rows.shape[1] - window + 1]


class SuffixTree:
    """Suffixes of rows of symbols (from each start in ``starts``, cut at depth ``window``) in order, with the words each shares with the one before.

    The nodes of the tree are the runs of suffixes that share a depth; ``deep`` gives those at the cut.
    """

    def __init__(self, rows: np.ndarray, group: np.ndarray, window: int):
        _, rank = np.unique(rows, return_inverse=True)
        self.window, ranks, depth = window, [rank.reshape(rows.shape).astype(np.int64)], 1
        while depth < window:
            step, rank = min(depth, window - depth), ranks[-1]
            pair = rank[:, : rank.shape[1] - step] * (int(rank.max()) + 1) + rank[:, step:]
            _, following = np.unique(pair, return_inverse=True)
            ranks.append(following.reshape(pair.shape))
            depth += step
        n, starts = ranks[-1].shape
        # Suffixes of a prefix and a start are one branch: an occurrence is an anchor and a start.
        branch = (group[:, None] * starts + np.arange(starts)).ravel()
        self.order = np.lexsort((ranks[-1].ravel(), branch))
        row, start = np.divmod(self.order, starts)
        same = branch[self.order][1:] == branch[self.order][:-1]
        self.common = np.zeros(n * starts, dtype=np.int16)
        # Descend from the longest compared length; a length that agrees moves both suffixes on.
        lengths = [min(1 << k, window) for k in range(len(ranks))]
        whole = same & (ranks[-1].ravel()[self.order][1:] == ranks[-1].ravel()[self.order][:-1])
        shared = np.where(whole, window, 0)
        left = np.nonzero(same & ~whole)[0]
        at = np.zeros(len(left), dtype=np.int64)
        for length, rank in reversed(list(zip(lengths[:-1], ranks[:-1], strict=True))):
            fits = start[left] + at + length <= rows.shape[1]
            a = rank[row[left + 1], np.where(fits, start[left] + at, 0)]
            b = rank[row[left], np.where(fits, start[left] + at, 0)]
            at += np.where(fits & (a == b), length, 0)
        shared[left] = np.minimum(at, window)
        self.common[1:] = shared

    def deep(self) -> np.ndarray:
        """For each suffix (rows by starts), the number of its node at depth ``window``: inner if it holds several."""
        node = np.empty(len(self.order), dtype=np.int64)
        node[self.order] = np.cumsum(self.common < self.window) - 1
        return node


def tree_masks(keys: np.ndarray, contexts: np.ndarray, counts: np.ndarray, levels: np.ndarray, rows: np.ndarray, window: int, reaches: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix tree of one memory-sized group: key, context and the mask of its window starts that repeat.

    Bit i of a mask stands for the window that starts at the i-th word of the context.
    """
    names, back = np.unique(np.stack([keys, contexts]), axis=1, return_inverse=True)
    back = back.ravel()
    first = np.zeros(names.shape[1], dtype=np.int64)
    first[back[::-1]] = np.arange(len(back))[::-1]
    counts = np.bincount(back, weights=counts).astype(np.int64)
    keys, contexts, rows, levels = keys[first], contexts[first], rows[first], levels[first]
    starts = rows.shape[1] - window + 1
    valid = _valid(rows, window) & (np.arange(starts) >= (reaches[0] - np.asarray(reaches)[levels])[:, None])
    bits = np.int64(1) << np.arange(starts, dtype=np.int64)
    masks = np.where(counts[:, None] > 1, valid, False) @ bits
    # Only prefixes with several contexts, not all repeated whole, need the tree.
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    open_ = np.bincount(group, weights=counts == 1)[group] > 0
    part = np.nonzero((size[group] > 1) & open_)[0]
    if len(part):
        node = SuffixTree(rows[part], group[part], window).deep()
        held = np.where(valid[part], counts[part][:, None], 0).ravel()
        total = np.bincount(node, weights=held)
        masks[part] |= (valid[part] & (total[node] > 1).reshape(len(part), starts)) @ bits
    kept = masks != 0
    return keys[kept], contexts[kept], masks[kept]


def repeated_windows(docs: DataFrame, *, window: int, prefixes: Sequence[int], group_rows: int, filter_bits: int, piece_bytes: int, salts: int) -> DataFrame:
    """Columns of docs but text, with ``at`` (an anchor's word) and ``mask`` (which windows around it repeat)."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "text"]
    reaches, last = [window - p for p in prefixes], len(prefixes) - 1
    if list(prefixes) != sorted(set(prefixes)) or prefixes[-1] != window or reaches[0] > 61:
        raise ValueError("prefixes must grow up to the window, from a length of window - 61 or more")

    def each(batches, act):
        for whole in batches:
            index = whole.schema.get_field_index("text")
            for batch in pieces(whole, index, piece_bytes):
                yield from act(Windows(batch.column(index), window, prefixes), batch)

    def filter_of(keys: DataFrame, n: int):
        return spark.sparkContext.broadcast(_bloom(keys, min(filter_bits, 64 << max(0, (16 * n // 64)).bit_length())))

    crowded, repeated = [], []  # a filter for each level
    rows_ahead = 0.0
    for level in range(last):

        @releasing
        def census(batches, level=level):
            def act(w, _):
                for at_level, _, keys in w.dealt([c.value for c in crowded], level + 1):
                    if at_level == level:
                        keys, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["akey", "n"])

            yield from each(batches, act)

        seen = Observation()
        counted = docs.select("text").mapInArrow(census, "akey long, n long").groupBy("akey").agg(F.sum("n").alias("n"))
        counts = materialize(counted.observe(seen, F.count_if(F.col("n") == 1).alias("single")).filter("n > 1"), "prefixes")
        often = counts.filter(F.col("n") > group_rows)
        n, fits, many = counts.agg(F.count("*"), F.sum(F.when(F.col("n") <= group_rows, F.col("n"))), F.count_if(F.col("n") > group_rows)).first()
        repeated.append(filter_of(counts, n))
        passed = np.bitwise_count(repeated[-1].value).sum() / (64 * len(repeated[-1].value))
        rows_ahead += (fits or 0) + passed**3 * (seen.get.get("single") or 0)
        if not many:
            break
        crowded.append(filter_of(often, many))

    def chosen(w: Windows, levels: int):
        for level, at, keys in w.dealt([c.value for c in crowded], levels):
            if level < last:
                kept = _in_bloom(keys, repeated[level].value)
                at, keys = at[kept], keys[kept]
            yield level, at, keys

    @releasing
    def contexts(batches):
        def act(w, _):
            for level, at, keys in chosen(w, min(last, len(repeated))):
                rows, key = w.around(at, reaches[0])
                pairs, first, n = np.unique(np.stack([keys, key]), axis=1, return_index=True, return_counts=True)
                words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * rows.shape[1]), len(first), [None, pa.py_buffer(np.ascontiguousarray(rows[first]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n), pa.array(np.full(len(first), level, np.int32)), words], names=["akey", "context", "n", "level", "words"])

        yield from each(batches, act)

    @releasing
    def leaves(batches):
        def act(w, _):
            for level, at, keys in chosen(w, last + 1):
                if level == last:
                    pairs, n = np.unique(np.stack([keys, w.second(at)]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n)], names=["akey", "context", "n"])

        yield from each(batches, act)

    @releasing
    def places(batches):
        def act(w, batch):
            for level, at, keys in chosen(w, last + 1):
                key = w.second(at) if level == last else w.around(at, reaches[0])[1]
                text = w.text[at]
                out = [batch.column(batch.schema.get_field_index(x)).take(pa.array(text)) for x in names]
                salt = mix(at.astype(np.uint64) + np.uint64(7)) % np.uint64(salts) if level else np.zeros(len(at), np.uint64)
                yield pa.RecordBatch.from_arrays([*out, pa.array(keys), pa.array(key), pa.array(at - w.first[text]), pa.array(salt.astype(np.int32))], names=[*names, "akey", "context", "at", "salt"])

        yield from each(batches, act)

    @releasing
    def trees(batches):
        held = list(batches)
        if held and sum(b.num_rows for b in held):
            t = pa.Table.from_batches(held)
            rows = np.frombuffer(b"".join(t["words"].to_pylist()), dtype=np.uint64).reshape(-1, reaches[0] + window)
            levels = t["level"].to_numpy()
            keys, context, mask = tree_masks(t["akey"].to_numpy(), t["context"].to_numpy(), t["n"].to_numpy(), levels, rows, window, reaches)
            salted = np.isin(keys, np.unique(t["akey"].to_numpy()[levels > 0]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(context), pa.array(mask), pa.array(salted)], names=["akey", "context", "mask", "salted"])

    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows_ahead / group_rows))
    kept = docs.select("text").mapInArrow(contexts, "akey long, context long, n long, level int, words binary")
    masks = kept.repartition(groups, "akey").mapInArrow(trees, "akey long, context long, mask long, salted boolean")
    if len(crowded) == last:
        often = docs.select("text").mapInArrow(leaves, "akey long, context long, n long").groupBy("akey", "context").agg(F.sum("n").alias("n")).filter("n > 1")
        masks = masks.union(often.select("akey", "context", F.lit(1 << reaches[0]).cast("long"), F.lit(True)))
    masks = masks.select("akey", "context", "mask", F.explode(F.when(F.col("salted"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    schema = docs.select(*names).limit(0).selectExpr("*", "0L akey", "0L context", "0L at", "0 salt").schema
    return docs.mapInArrow(places, schema).join(masks, ["akey", "context", "salt"]).select(*names, "at", "mask")


def remove_repeats(docs: DataFrame, *, window: int = 35, prefixes: Sequence[int] = (8, 20, 35), group_rows: int = 15_000, filter_bits: int = 1 << 28, piece_bytes: int = 2 << 20, salts: int = 16, keep: Sequence[str] | None = None, keep_text: bool = False) -> DataFrame:
    """The columns ``keep`` of docs (all but text by default) with n_words, n_removed and kept (the words left, joined by one space); ``keep_text`` adds the text itself."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "text" and c not in ADDED and not c.startswith("_")]
    keyed = docs.select(*keep, "text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    found = repeated_windows(keyed.select("_id", "_hash", "text"), window=window, prefixes=prefixes, group_rows=group_rows, filter_bits=filter_bits, piece_bytes=piece_bytes, salts=salts)
    marks = found.groupBy("_id", "_hash").agg(F.collect_set(F.struct("at", "mask")).alias("marks")).select(F.col("_id").alias("_mid"), F.col("_hash").alias("_mhash"), F.col("marks.at").alias("_at"), F.col("marks.mask").alias("_mask"))
    joined = keyed.join(marks, (F.col("_hash") == F.col("_mhash")) & F.col("_id").eqNullSafe(F.col("_mid")), "left").select(*keep, "text", "_at", "_mask")
    reach, out_columns = window - prefixes[0], [*keep, "text"] if keep_text else keep

    @releasing
    def cut(batches):
        bits = np.arange(reach + 1)
        for whole in batches:
            index = whole.schema.get_field_index("text")
            for batch in pieces(whole, index, piece_bytes):
                n_words, n_removed, kept = [], [], []
                ats, masks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_at", "_mask"))
                for text, at, mask in zip(batch.column(index).to_pylist(), ats, masks, strict=True):
                    words = (text or "").encode("utf-8", "replace").split()
                    n_words.append(len(words))
                    if at:
                        row, bit = np.nonzero((np.array(mask)[:, None] >> bits) & 1)
                        start = np.array(at)[row] - reach + bit
                        change = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + window, minlength=len(words) + 1)
                        words = [w for w, c in zip(words, np.cumsum(change)[: len(words)].tolist(), strict=True) if not c]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                out = [batch.column(batch.schema.get_field_index(c)) for c in out_columns]
                yield pa.RecordBatch.from_arrays([*out, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*out_columns, "n_words", "n_removed", "kept"])

    schema = docs.select(*out_columns).limit(0).selectExpr("*", "0L n_words", "0L n_removed", "'' kept").schema
    return joined.mapInArrow(cut, schema)


def op5_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
b AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM b),
x AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
k AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN c USING (r, p)),
t AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (r) LEFT JOIN t USING (r)
"""
