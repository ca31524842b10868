"""Frame-keyed tables that join without a shuffle: points, labels, anchors of one store, bucketed alike by the frame's key.

All tables of a store are partitioned by episode chunk, bucketed by (episode_index, frame_index) into the same number of
buckets, and sorted by it, so that joins and aggregates on the frame key read buckets side by side. What is finer than a frame, the labels of its
points or cells, joins as one map a frame (``assemble_by_frame``, ``transfer_labels_by_frame``). Another session opens a store by its path.

Beside each table stands a manifest: for every chunk and every write, how many frames came and the sum and the
exclusive or of their keys' hashes. ``pending`` compares it with the frames asked for, chunk by chunk, and reads
the keys of those chunks alone that differ. A write whose manifest is missing makes its chunks differ, so that they are read.

Appending evaluates the rows twice, for the rows and for the manifest (a table's first write reads the table for that), and a store's
first write counts their chunks before; cut their lineage first if they cost much.
Frames must have both keys. Empty tables can be written; they cover nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("episode_index", "frame_index")
#: A store's first table is divided into no more chunks.
MOST_CHUNKS = 32


def frames_of(rows: DataFrame, chunk_size: int) -> DataFrame:
    """Distinct frames and the chunk of each."""
    return rows.select(*KEYS).distinct().withColumn("episode_chunk", _chunk(chunk_size))


def _chunk(size: int):
    return F.floor(F.col("episode_index") / size).cast("int")


def _digest(frames: DataFrame) -> DataFrame:
    h = F.xxhash64(*KEYS)
    return frames.groupBy("episode_chunk").agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(2**31))).alias("total"), F.bit_xor(h).alias("mixed"))


class FrameStore:
    def __init__(self, spark: SparkSession, path: str, *, buckets: int, chunk_size: int):
        self.spark, self.path, self.buckets, self.chunk_size = spark, path.rstrip("/"), buckets, chunk_size
        self.fresh = False

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, buckets: int = 64, chunk_size: int = 1000) -> FrameStore:
        """A new store. Take so many buckets that one bucket of a chunk's largest table fits a task. The first write makes chunks larger where there would be over ``MOST_CHUNKS``."""
        store = cls(spark, path, buckets=buckets, chunk_size=chunk_size)
        store._note("error")
        store.fresh = True
        return store

    def _note(self, mode: str) -> None:
        said = json.dumps({"buckets": self.buckets, "chunk_size": self.chunk_size})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode(mode).text(f"{self.path}/_store")

    def _widen(self, rows: DataFrame) -> None:
        """Files are chunks times buckets: so that they don't grow with the episodes, chunks do."""
        self.fresh = False
        n = rows.select(_chunk(self.chunk_size)).distinct().count()
        if n > MOST_CHUNKS:
            self.chunk_size *= -(-n // MOST_CHUNKS)
            self._note("overwrite")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FrameStore:
        said = json.loads(spark.read.text(f"{path.rstrip('/')}/_store").first()[0])
        return cls(spark, path, **said)

    def _name(self, table: str) -> str:
        return f"store_{hashlib.md5(self.path.encode(), usedforsecurity=False).hexdigest()[:16]}_{table}"

    def write(self, table: str, rows: DataFrame, *, order: Sequence[str] = (), append: bool = False) -> None:
        """Writes a table, or adds rows of further frames to it; ``order`` sorts rows within a frame."""
        if self.fresh:
            self._widen(rows)
        held = rows.withColumn("episode_chunk", _chunk(self.chunk_size))
        if not append:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
        elif not self.spark.catalog.tableExists(self._name(table)):
            self._attach(table)
        dealt = held.repartition(self.buckets, *KEYS).sortWithinPartitions("episode_chunk", *KEYS, *order)
        writer = dealt.write.format("parquet").mode("append" if append else "overwrite").option("path", f"{self.path}/{table}")
        writer.partitionBy("episode_chunk").bucketBy(self.buckets, *KEYS).sortBy(*KEYS).saveAsTable(self._name(table))
        manifest = _digest(frames_of(rows if append else self.read(table), self.chunk_size)).withColumn("write", F.lit(uuid.uuid4().hex))
        manifest.write.mode("append" if append else "overwrite").parquet(f"{self.path}/_manifests/{table}")

    def _attach(self, table: str) -> None:
        """Names the files of a table that another session wrote."""
        found = self.spark.read.parquet(f"{self.path}/{table}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found if f.name != "episode_chunk")
        keys = ", ".join(KEYS)
        self.spark.sql(f"CREATE TABLE {self._name(table)} ({columns}, episode_chunk INT) USING parquet PARTITIONED BY (episode_chunk) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        self.spark.sql(f"MSCK REPAIR TABLE {self._name(table)}")

    def read(self, table: str) -> DataFrame:
        if not self.spark.catalog.tableExists(self._name(table)):
            self._attach(table)
        return self.spark.table(self._name(table)).drop("episode_chunk")

    def chunks(self, table: str, chunks: Sequence[int]) -> DataFrame:
        """The rows of some chunks; only their files are read."""
        self.read(table)
        return self.spark.table(self._name(table)).filter(F.col("episode_chunk").isin(list(chunks))).drop("episode_chunk")

    def manifest(self, table: str) -> DataFrame:
        """Frames of each chunk: episode_chunk, n, total, mixed."""
        rows = self.spark.read.parquet(f"{self.path}/_manifests/{table}")
        return rows.groupBy("episode_chunk").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))

    def pending(self, todo: DataFrame, table: str) -> DataFrame:
        """Rows of ``todo`` whose frames a table doesn't have: of chunks that the manifest shows complete, nothing is read."""
        rows = todo.withColumn("_chunk", _chunk(self.chunk_size))
        asked = _digest(frames_of(todo, self.chunk_size))
        done = self.manifest(table)
        same = [asked[c] == done[c] for c in ("episode_chunk", "n", "total", "mixed")]
        differ = [r[0] for r in asked.join(done, same, "left_anti").select("episode_chunk").collect()]  # a number for each chunk, not each frame
        known = self.chunks(table, differ).select(*KEYS)
        return rows.filter(F.col("_chunk").isin(differ)).drop("_chunk").join(known, list(KEYS), "left_anti")

    def coverage(self, reference: str, tables: Sequence[str]) -> DataFrame:
        """For each table: rows, frames, frames of the reference that it lacks, frames that the reference lacks, and the share covered. Nothing is shuffled but counts."""
        known = self.read(reference).groupBy(*KEYS).agg(F.lit(1).alias("_r"))
        out = None
        for table in tables:
            own = self.read(table).groupBy(*KEYS).agg(F.count("*").alias("_n"))
            both = known.join(own, list(KEYS), "full")
            counts = both.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                F.count("_n").alias("n_frames"),
                F.count_if(F.col("_n").isNull()).alias("n_missing"),
                F.count_if(F.col("_r").isNull()).alias("n_extra"),
                (F.count_if(F.col("_n").isNotNull() & F.col("_r").isNotNull()) / F.greatest(F.count("_r"), F.lit(1))).alias("covered"),
            ).select(F.lit(table).alias("table"), "*")
            out = counts if out is None else out.unionByName(counts)
        return out
