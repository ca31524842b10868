"""Approximate nearest neighbours with one navigable small-world graph per shard (operator 4).

Vectors are dealt to shards of about ``shard_rows`` by a hash. Each shard's
hierarchical graph is built by one task and stored as one row: its vectors, and
the neighbour lists of every level as flat arrays. Queries are searched in every
shard: they stream past a graph that is loaded once for up to ``block_rows`` of
them. Shard results merge by exact cosine in double precision on the vectors as
given; every node that a search returns is rescored.

Equal vectors are one node of a graph, with the ids that can still appear in a
result (the ``k + 1`` smallest), so copies neither crowd a graph nor a task.

Every query meets every shard: queries times shards rows are shuffled, so shards
should be as large as a task can build (``shard_rows``), the more so in large tables.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part. Vectors of different lengths never meet. Rows that repeat an id and its
vector count once; other rows with the query's id are never its results. Ties go
to the smaller id. Extra columns are left out; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.llm.scratch import materialize
from demolake.llm.text import mix

_INDEX = "dim int, shard int, n int, entry int, ids binary, starts binary, vectors binary, level binary, base binary, upper array<binary>"


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched for many points at a time."""

    def __init__(self, unit: np.ndarray, m: int):
        self.unit, self.m, n = unit, m, len(unit)
        u = (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / 2**53
        self.level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(m)).astype(np.int8), 8)
        self.links = [np.full((n, 2 * m if h == 0 else m), -1, dtype=np.int32) for h in range(int(self.level.max()) + 1 if n else 1)]
        self.entry = 0

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, level: int, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query, nearest first (-1: none), and their similarities."""
        links, unit, rows = self.links[level], self.unit, np.arange(len(q))
        ids = np.full((len(q), width), -1, dtype=np.int64)
        sims = np.full((len(q), width), -np.inf, dtype=np.float32)
        done = np.ones((len(q), width), dtype=bool)
        seen = np.zeros((len(q), len(unit)), dtype=bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, (q * unit[start]).sum(axis=1), False
        seen[rows, start] = True
        active = rows
        while len(active):
            open_ = ~done[active]
            order = np.argsort(~open_, axis=1, kind="stable")[:, :at_once]  # nearest open candidates
            use = np.take_along_axis(open_, order, axis=1)
            active, order, use = active[use[:, 0]], order[use[:, 0]], use[use[:, 0]]
            if not len(active):
                break
            picked = np.take_along_axis(ids[active], order, axis=1)
            mark = done[active]
            np.put_along_axis(mark, order, True, axis=1)
            done[active] = mark
            near = np.where(use[:, :, None], links[np.where(use, picked, 0)], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, dtype=np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[active[r]], unit[near[r, c]])
            all_s, all_i = np.concatenate([sims[active], s], axis=1), np.concatenate([ids[active], near], axis=1)
            all_d = np.concatenate([done[active], np.zeros(near.shape, dtype=bool)], axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            sims[active] = np.take_along_axis(all_s, best, axis=1)
            ids[active] = np.where(np.isneginf(sims[active]), -1, np.take_along_axis(all_i, best, axis=1))
            done[active] = np.take_along_axis(all_d, best, axis=1) | (ids[active] < 0)
        return ids, sims

    def descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        at = np.full(len(q), self.entry)
        for level in range(int(self.level[self.entry]), down_to, -1):
            at = self.beam(q, at, 1, level)[0][:, 0]
        return at

    def spread(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first, those nearer to the node than to any chosen one; then the nearest others."""
        between = np.einsum("bcd,bed->bce", v := self.unit[np.maximum(ids, 0)], v)
        chosen = np.zeros(ids.shape, dtype=bool)
        for c in range(ids.shape[1]):
            closest = np.where(chosen, between[:, c], -np.inf).max(axis=1)
            chosen[:, c] = (ids[:, c] >= 0) & (closest < sims[:, c]) & (chosen.sum(axis=1) < most)
        order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, axis=1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def build(self, width: int, batch: int = 192) -> Graph:
        n, done = len(self.unit), 1
        top = int(self.level[0]) if n else 0
        while done < n:
            size = min(batch, max(1, done // 4), n - done)
            new = np.arange(done, done + size)
            q, at = self.unit[new], None
            for level in range(top, -1, -1):
                at = np.full(size, self.entry) if at is None else at
                mine = self.level[new] >= level
                wide = self.beam(q[mine], at[mine], width, level) if mine.any() else None
                if (~mine).any():
                    at[~mine] = self.beam(q[~mine], at[~mine], 1, level)[0][:, 0]
                if wide is not None:
                    ids, sims = wide
                    at[mine] = ids[:, 0]
                    self._connect(new[mine], ids, sims, level)
            for level in range(top + 1, len(self.links)):  # levels that begin in this batch
                mine = new[self.level[new] >= level]
                if len(mine) > 1:
                    self._connect(mine, np.full((len(mine), 1), -1), np.full((len(mine), 1), -np.inf, dtype=np.float32), level)
            if self.level[new].max() > top:
                top = int(self.level[new].max())
                self.entry = int(new[self.level[new].argmax()])
            done += size
        return self

    def _connect(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> None:
        most, links = self.links[level].shape[1], self.links[level]
        own = self.unit[new] @ self.unit[new].T  # points of a batch see each other here only
        np.fill_diagonal(own, -np.inf)
        ids = np.concatenate([ids, np.broadcast_to(new, own.shape)], axis=1)
        sims = np.concatenate([sims, own], axis=1)
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
        sims = np.take_along_axis(sims, best, axis=1)
        ids = np.where(np.isneginf(sims), -1, np.take_along_axis(ids, best, axis=1))
        links[new] = picked = self.spread(self.unit[new], ids, sims, self.m if level else min(most, self.m + self.m // 2)) if level else np.pad(self.spread(self.unit[new], ids, sims, self.m + self.m // 2), ((0, 0), (0, most - self.m - self.m // 2)), constant_values=-1)
        # Links back, at most 2 * most of the nearest per node and step; a full list is thinned.
        to, back = picked.ravel(), np.repeat(new, picked.shape[1])
        back, to = back[to >= 0], to[to >= 0]
        nodes, inverse = np.unique(to, return_inverse=True)
        if not len(nodes):
            return
        order = np.lexsort((-np.einsum("ij,ij->i", self.unit[to], self.unit[back]), inverse))
        place = np.arange(len(order)) - np.searchsorted(inverse[order], inverse[order])
        kept = place < 2 * most
        extra = np.full((len(nodes), int(place[kept].max()) + 1), -1, dtype=np.int64)
        extra[inverse[order][kept], place[kept]] = back[order][kept]
        extra[(extra[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
        both = np.concatenate([links[nodes], extra], axis=1).astype(np.int64)
        s = np.where(both >= 0, np.einsum("ij,icj->ic", self.unit[nodes], self.unit[np.maximum(both, 0)]), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")
        s, both = np.take_along_axis(s, order, axis=1), np.take_along_axis(both, order, axis=1)
        full = (both >= 0).sum(axis=1) > most
        width = min(both.shape[1], most)
        links[nodes[~full], :width] = both[~full, :width]
        for k in np.array_split(np.nonzero(full)[0], max(1, int(full.sum()) // 256)):
            if len(k):
                links[nodes[k]] = self.spread(self.unit[nodes[k]], both[k], s[k], most)

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        return self.beam(q, self.descend(q, 0), width, 0)[0]


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def build_index(vectors: DataFrame, *, k: int = 5, m: int = 16, width: int = 96, shard_rows: int = 16_384) -> DataFrame:
    """One row per shard: its graph in flat arrays, the vectors, and the ids of each (ids from starts[i] on)."""
    rows = usable(vectors).distinct()
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    nodes = materialize(ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[np.argsort([x[0] for x in part["ids"]], kind="stable")]
        x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        g = Graph(_unit(x), m).build(width)
        counts = np.array([len(i) for i in part["ids"]])
        row = {"dim": key[0], "shard": key[1], "n": len(x), "entry": g.entry, "ids": np.concatenate(part["ids"].to_numpy()).astype(np.int64).tobytes(), "starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes(), "vectors": x.tobytes(), "level": g.level.tobytes(), "base": g.links[0].tobytes(), "upper": [a[g.level >= h].tobytes() for h, a in enumerate(g.links) if h]}
        return pd.DataFrame([row])

    keyed = nodes.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")})
    return materialize(keyed.groupBy("dim", "shard").applyInPandas(build, _INDEX), "index")


def _load(row: dict, m: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["vectors"], dtype=np.float64).reshape(row["n"], row["dim"])
    g = Graph.__new__(Graph)
    g.unit, g.m, g.entry = _unit(x), m, int(row["entry"])
    g.level = np.frombuffer(row["level"], dtype=np.int8)
    g.links = [np.frombuffer(row["base"], dtype=np.int32).reshape(row["n"], -1)]
    for h, flat in enumerate(row["upper"], 1):
        own = np.nonzero(g.level >= h)[0]
        full = np.full((row["n"], m), -1, dtype=np.int32)
        full[own] = np.frombuffer(flat, dtype=np.int32).reshape(len(own), m)
        g.links.append(full)
    return g, x, np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["starts"], dtype=np.int64)


def search_index(index: DataFrame, queries: DataFrame, *, k: int = 5, m: int = 16, width: int = 128, block_rows: int = 1 << 20) -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score. queries: vec_id, embedding."""
    asked = usable(queries).distinct().select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"))
    blocks = max(1, -(-asked.count() // block_rows))
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    each = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(shards, "dim").select("query_id", "embedding", "dim", "block", F.explode("shards").alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys, parts = ["dim", "shard", "block"], max(1, index.count() * blocks)

    def find(batches):
        now, graph = None, None
        for batch in batches:
            kinds = batch.column(3).is_null().to_numpy(zero_copy_only=False)  # rows of graphs have no query
            begin = 0
            while begin < batch.num_rows:
                key = tuple(batch.column(c)[begin].as_py() for c in range(3))
                if kinds[begin]:
                    now, graph, begin = key, _load(batch.slice(begin, 1).to_pylist()[0], m), begin + 1
                    continue
                end = begin + 1
                while end < batch.num_rows and end < begin + 256 and not kinds[end]:
                    end += 1
                if now == key:
                    yield _nearest(graph, batch.column(3).slice(begin, end - begin).to_numpy(), np.array(batch.column(4).slice(begin, end - begin).to_pylist(), dtype=np.float64), k, width)
                begin = end

    rest = [c for c in graphs.columns if c not in keys]
    lone = graphs.select(*keys, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("embedding"), *rest)
    all_ = lone.union(each.select(*keys, "query_id", "embedding", *(F.lit(None).cast(graphs.schema[c].dataType).alias(c) for c in rest)))
    ordered = all_.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("query_id").asc_nulls_first())
    found = ordered.mapInArrow(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(graph, names: np.ndarray, q: np.ndarray, k: int, width: int) -> pa.RecordBatch:
    """The k nearest of one shard to each query, by exact cosine."""
    g, x, ids, starts = graph
    norm, own, out = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1)), []
    for i, nodes in enumerate(g.search(_unit(q), min(width, len(x)))):
        nodes = nodes[nodes >= 0]
        s = (x[nodes] * q[i]).sum(axis=1) / (norm[nodes] * own[i])
        rows = [(-v, int(d)) for v, node in zip(s, nodes, strict=True) for d in ids[starts[node] : starts[node + 1]] if d != names[i]]
        out += [(int(names[i]), d, -v) for v, d in sorted(rows)[:k]]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def op4_sharded_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search_index(build_index(vectors), vectors.filter(F.col("vec_id") % 50 == 0))
