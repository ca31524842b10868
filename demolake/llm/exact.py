"""Exact duplicates by tree-merging sorted runs of digests (operator 12).

Every text is reduced to its SHA-256 and its length in bytes. Blocks of rows are dealt to runs; a run
is sorted by digest and holds every digest once, with the identifier that stays so far and how many rows
it stands for. Then the runs meet in binomial rounds: in each, 2**bits runs of one range of digests are
merged, and what comes out is cut by the next bits of the digest, so that a run's share halves as often as
the number of runs does. All tasks hold about one run's rows at every level, and in the end each holds one
range of digests of all runs. A digest is one row a run at most, however many rows have the text.

A merge orders digests by their first 64 bits and verifies that neighbours agree in the whole digest and the
length before it joins them; of equal texts it keeps the better identifier and adds up the rows.

Groups of at least two rows go back to their rows: those with more than one in ``hot_share`` of all rows are
at most ``hot_share`` many and are broadcast, the others are joined by digest, so that no key
of that join holds more than that share.

Of equal texts the row with the largest id stays (or the smallest, as asked for); an id beats a null id,
and of rows that repeat both id and text one stays, whichever was written first. Nulls: a null text counts as
empty. Texts may have any length. Other columns stay out of the result of ``exact_groups``, so that none can
clash; ``keep_one`` returns the rows that stay with all their columns. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.scratch import materialize

#: A digest's row in a run: digest (its bytes read as big-endian words) and length, the identifier that stays, its row, rows with the text.
_ENTRY = np.dtype([("key", "<u8", 5), ("id", "<i8"), ("null", "?"), ("row", "<i8"), ("n", "<i8")])
#: Rows of a partition that lie next to each other go to one run.
_BLOCK_BITS = 13
_RUN = "node long, part long, run binary"


def merge(entries: np.ndarray, largest: bool) -> np.ndarray:
    """One entry for each digest of concatenated sorted runs, in order."""
    if not len(entries):
        return entries
    key = np.ascontiguousarray(entries["key"])
    order = np.argsort(key[:, 0], kind="stable")  # runs are sorted: this merges them
    ordered = key[order]
    first = ordered[1:, 0] == ordered[:-1, 0]
    same = (ordered[1:] == ordered[:-1]).all(axis=1)
    if (first & ~same).any():  # 64 bits agree, the digests don't
        order = np.lexsort(key.T[::-1])
        ordered = key[order]
        same = (ordered[1:] == ordered[:-1]).all(axis=1)
    entries, group = entries[order], np.append(0, np.cumsum(~same))
    begins = np.nonzero(np.append(True, ~same))[0]
    ids = ~entries["id"] if largest else entries["id"]
    out = entries[np.lexsort((entries["row"], ids, entries["null"], group))[begins]]
    out["n"] = np.add.reduceat(entries["n"], begins)
    return out


def _cut(entries: np.ndarray, node: int, part: int, used: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """A sorted run of a range of digests, by the next bits of the digest."""
    if bits == 0:
        yield node, part, entries.tobytes()
        return
    at = (entries["key"][:, 0] << np.uint64(used)) >> np.uint64(64 - bits)
    ends = np.searchsorted(at, np.arange(2**bits + 1))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if b > a:
            yield node, part << bits | k, entries[a:b].tobytes()


def _rows(runs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    node, part, run = zip(*runs, strict=True) if runs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(part, pa.int64()), pa.array(run, pa.binary())], names=["node", "part", "run"])


def sorted_runs(base: DataFrame, depth: int, bits: int, largest: bool, at_once: int = 200_000) -> DataFrame:
    """Runs of (digest, size, id, row), sorted and reduced within tasks, cut by the first bits of the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit():
            entries = np.concatenate(held)
            block = (entries["row"] >> _BLOCK_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            of = (block >> np.uint64(64 - depth)).astype(np.int64)
            found = []
            for r in np.unique(of).tolist():
                found += _cut(merge(entries[of == r], largest), r >> bits, 0, 0, bits)
            return _rows(found)

        held: list[np.ndarray] = []
        for batch in batches:
            digest, size, id, row = (batch.column(k) for k in range(4))
            entries = np.zeros(batch.num_rows, _ENTRY)
            entries["key"][:, :4] = np.frombuffer(b"".join(digest.to_pylist()), ">u8").reshape(-1, 4)
            entries["key"][:, 4] = size.to_numpy()
            entries["null"] = id.is_null().to_numpy(zero_copy_only=False)
            entries["id"] = id.fill_null(0).to_numpy()
            entries["row"], entries["n"] = row.to_numpy(), 1
            held.append(entries)
            if sum(map(len, held)) >= at_once:
                yield emit()
                held.clear()
        if held:
            yield emit()

    return base.select("digest", "size", "id", "row").mapInArrow(run, _RUN)


def _round(used: int, more: int, largest: bool):
    def meet(table):
        entries = merge(np.concatenate([np.frombuffer(r, _ENTRY) for r in table.column("run").to_pylist()]), largest)
        return pa.Table.from_batches([_rows(list(_cut(entries, table.column("node")[0].as_py() >> more, table.column("part")[0].as_py(), used, more)))])

    return meet


def tree_merge(runs: DataFrame, depth: int, bits: int, largest: bool) -> DataFrame:
    """Digests of all runs: digest, size, keep, keep_row, n. Each round merges 2**bits runs and cuts what comes out by the next bits."""
    used = min(bits, depth)
    while True:
        more = min(bits, depth - used)
        runs = runs.groupBy("node", "part").applyInArrow(_round(used, more, largest), _RUN)
        if not more:
            break
        used += more

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                e = np.frombuffer(run, _ENTRY)
                digests = [x.tobytes() for x in e["key"][:, :4].astype(">u8")]
                columns = [pa.array(digests, pa.binary()), pa.array(e["key"][:, 4].astype(np.int64)), pa.array(e["id"], mask=e["null"]), pa.array(e["row"]), pa.array(e["n"])]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "size", "keep", "keep_row", "n"])

    return runs.select("run").mapInArrow(unpack, "digest binary, size long, keep long, keep_row long, n long")


def _digest(text: str, normalise: Callable[[Column], Column] | None) -> tuple[Column, Column]:
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    value = normalise(value) if normalise else value
    return F.unhex(F.sha2(value, 256)), F.octet_length(value).cast("long")


def exact_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, largest: bool = True, run_rows: int = 250_000, least_runs: int = 64, bits: int = 4, hot_share: int = 10_000) -> DataFrame:
    """One row for each row: id, keep_id, group_size, kept, text_sha256; see the module.

    ``id`` must be an integer column; ``normalise`` is applied to texts before they are compared.
    """
    digest, size = _digest(text, normalise)
    base = materialize(docs.select(F.col(id).cast("long").alias("id"), digest.alias("digest"), size.alias("size"), F.monotonically_increasing_id().alias("row")), "digests")
    rows = base.count()
    depth = max(1, math.ceil(math.log2(max(least_runs, rows / run_rows))))
    groups = tree_merge(sorted_runs(base, depth, min(bits, depth), largest), depth, bits, largest)
    groups = materialize(groups.filter("n > 1"), "digest-groups")
    most = F.lit(max(1, rows // hot_share))
    hot = base.join(F.broadcast(groups.filter(F.col("n") > most)), ["digest", "size"], "left")
    cold = hot.filter("n IS NULL").select(base.columns).join(groups.filter(F.col("n") <= most), ["digest", "size"], "left")
    out = hot.filter("n IS NOT NULL").unionByName(cold)
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, largest: bool = True) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = materialize(exact_groups(docs, id=id, text=text, normalise=normalise, largest=largest).withColumn("same", F.col(id).eqNullSafe(F.col("keep_id"))), "exact-groups")
    name = "text_sha256_"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.lower(F.hex(_digest(text, normalise)[0])))
    kept = found.filter("kept").select(F.col(id).alias("k"), F.col("text_sha256").alias("d"))
    stay = rows.join(kept, rows[id].cast("long").eqNullSafe(F.col("k")) & (rows[name] == F.col("d")), "left_semi")
    again = found.filter("same AND NOT kept").select(F.col("text_sha256").alias(name)).distinct()  # rows that repeat id and text
    return stay.join(again, name, "left_anti").unionByName(stay.join(again, name, "left_semi").dropDuplicates([name])).drop(name)


def op12_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON g.t = d.t
"""
