"""The generalised pigeonhole of operator 2: groups of bits, thresholds by dynamic programming, keys and buckets.

Fingerprints are rows of 64-bit lanes. The bits of each lane are cut into parts,
correlated ones together. A part with threshold t files a fingerprint under every
value within s = ceil(t / 2) bits of its own, so that any two within t bits share a
key. Thresholds are dealt out unequally, at the least estimated cost of key rows
and of compared pairs, under one of two conditions:

* ``plan_parts``: the thresholds sum to ``radius - parts + 1``; then two
  fingerprints within the radius are within the threshold of some part, always;
* ``plan_bands``: fingerprints whose bits differ with a given probability miss
  each other in all parts with a probability of ``miss`` at most.

Buckets (the rows of one key) reach Python whole, sorted and streamed. Members
are compared there, and only links leave, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demolake.llm.text import releasing

#: A compared pair costs about so much of a shuffled key row.
PAIR_COST = 1 / 300

Part = tuple[int, list[int], int]  # lane, bits, threshold (-1: not probed)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_statistics(fps: DataFrame, lanes: int) -> np.ndarray:
    """How many fingerprints have bits i and j of a lane both set, over all rows of the column bits: lanes x 64 x 64."""

    @releasing
    def run(batches):
        both = np.zeros((lanes, 64, 64))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, lanes)
            for k in range(0, len(rows), 1 << 15):
                for lane in range(lanes):
                    one = np.ascontiguousarray(rows[k : k + (1 << 15), lane])
                    bits = np.unpackbits(one.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    both[lane] += bits.T @ bits
        at = np.nonzero(both.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both.ravel()[at].astype(np.int64))], names=["ij", "n"])

    found = fps.select("bits").mapInArrow(run, "ij long, n long").groupBy("ij").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(lanes * 64 * 64)
    out[found.column("ij").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(lanes, 64, 64)


def groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """A lane's bits in ``parts`` groups of nearly equal size, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = np.ones(64, dtype=bool), []
    for k in range(parts):
        group: list[int] = []
        while len(group) < 64 // parts + (k < 64 % parts):
            near = like[:, group].sum(axis=1) if group else like[:, free].sum(axis=1)
            best = int(np.where(free, near, -1).argmax())
            free[best] = False
            group.append(best)
        out.append(sorted(group))
    return out


def n_keys(width: int, t: int) -> int:
    return 0 if t < 0 else sum(math.comb(width, r) for r in range(-(-t // 2) + 1))


def _shared(width: int, differ: int, s: int) -> int:
    """Under how many common keys two values of a part that differ in so many bits are filed."""
    return sum(math.comb(differ, i) * math.comb(width - differ, j) for i in range(differ + 1) for j in range(s + 1) if i + j <= s and differ - i + j <= s)


def cost(group: list[int], p: np.ndarray, n: int, t: int) -> float:
    """Key rows and compared pairs of a part, in key rows; p: how often each bit is set."""
    if t < 0:
        return 0.0
    differ = np.array([1.0])  # how many bits of the part two fingerprints differ in
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        differ = np.convolve(differ, [1 - q, q])
    s = -(-t // 2)
    return n * n_keys(len(group), t) + PAIR_COST * n * n / 2 * sum(_shared(len(group), d, s) * differ[d] for d in range(min(2 * s, len(group)) + 1))


def plan_parts(both: np.ndarray, n: int, radius: int) -> list[Part]:
    """Parts of one lane that no two fingerprints within the radius escape. A threshold is 4 at most."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[Part]] = (math.inf, [])
    for parts in range(1, radius + 2):
        cut = groups(both, n, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in cut:
            options = {t: cost(group, p, n, t) for t in range(-1, min(radius, 4) + 1)}
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (c, ts) in table.items():
                for t, more in options.items():
                    if c + more < step.get(total + t, (math.inf,))[0]:
                        step[total + t] = (c + more, [*ts, t])
            table = step
        for total, (c, ts) in table.items():
            if total >= radius - parts + 1 and c < best[0]:
                best = (c, [(0, g, t) for g, t in zip(cut, ts, strict=True)])
    return best[1]


def plan_bands(both: np.ndarray, n: int, differ: float, miss: float, step: float = 0.02) -> list[Part]:
    """Parts of all lanes that fingerprints whose bits differ with probability ``differ`` escape with ``miss`` at most."""
    goal = math.ceil(-math.log(miss) / step)
    best: tuple[float, list[Part]] = (math.inf, [])
    for parts in range(2, 9):
        table: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for lane in range(len(both)):
            p = np.diag(both[lane]) / max(n, 1)
            for group in groups(both[lane], n, parts):
                options = []
                for t in (0, 2):
                    hit = sum(math.comb(len(group), d) * differ**d * (1 - differ) ** (len(group) - d) for d in range(t + 1))
                    options.append((t, math.floor(-math.log(1 - hit) / step), cost(group, p, n, t)))
                now = dict(table)
                for got, (c, back) in table.items():
                    for t, gain, more in options:
                        at = min(goal, got + gain)
                        if c + more < now.get(at, (math.inf,))[0]:
                            now[at] = (c + more, (back, (lane, group, t)))
                table = now
        c, back = table.get(goal, (math.inf, None))
        if c < best[0]:
            chosen: list[Part] = []
            while back is not None:
                back, part = back
                chosen.append(part)
            best = (c, chosen)
    if not best[1]:
        raise ValueError("too few lanes for this similarity")
    return best[1]


def probe_keys(fps: DataFrame, plan: list[Part], lane: Callable[[int], Column], keep: list[str]) -> DataFrame:
    """Columns key, part and ``keep``: every key under which a fingerprint is filed and probed, a hash of part and value."""
    arrays = []

    def filed(k: int, base: Column, flips: list[int]) -> Column:
        key = lambda x: F.struct(F.xxhash64(F.lit(k), base.bitwiseXOR(x)).alias("key"), F.lit(k).alias("part"))
        return F.transform(F.array(*map(F.lit, flips)), key) if len(flips) > 1 else F.array(key(F.lit(0)))

    for k, (at, group, t) in enumerate(plan):
        if t >= 0:
            flips = [signed(sum(1 << b for b in bits)) for r in range(-(-t // 2) + 1) for bits in combinations(group, r)]
            arrays.append(filed(k, lane(at).bitwiseAND(F.lit(signed(sum(1 << b for b in group)))), flips))
    return fps.select(F.explode(F.concat(*arrays)).alias("k"), *keep).select("k.key", "k.part", *keep)


def by_bucket(rows: DataFrame, act: Callable[..., Iterator[pa.RecordBatch]], schema: str, at_once: int = 50_000) -> DataFrame:
    """Applies act to the columns (numpy) of whole buckets: rows, whose first column is key, come sorted by it."""

    @releasing
    def run(batches):
        parts, size = [], 0

        def columns():
            return [np.concatenate(c) for c in zip(*parts, strict=True)]

        for batch in batches:
            if batch.num_rows:
                parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
            if size >= at_once:
                table = columns()
                cut = int(np.searchsorted(table[0], table[0][-1]))  # the last bucket may go on
                if cut:
                    yield from act(*(c[:cut] for c in table))
                parts, size = [[c[cut:] for c in table]], len(table[0]) - cut
        if size:
            yield from act(*columns())

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the buckets of sorted keys."""
    starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def small_pairs(sizes: np.ndarray, lanes: list[np.ndarray], most: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j and distance of all pairs within the radius, in buckets of ``most`` members at most, of many buckets at once."""
    size = np.repeat(sizes, sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    here = np.nonzero((size > 1) & (size <= most))[0]
    out: list[tuple] = []
    for d in range(1, most):
        here = here[here + d < last[here]]
        if not len(here):
            break
        apart = sum(np.bitwise_count(x[here] ^ x[here + d]).astype(np.int32) for x in lanes)
        near = apart <= radius
        out.append((here[near], here[near] + d, apart[near]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    i, j, apart = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, apart


def spanning(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one bucket as all links would: a search from each member not yet reached."""
    left, ends = np.arange(len(fp)), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if near.any():
                new, left = left[near], left[~near]
                ends.append((np.full(len(new), x), new))
                stack.extend(new.tolist())
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(c) for c in zip(*ends, strict=True))
    return a, b
