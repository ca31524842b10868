"""Episode array caches as a Spark data source: one ``.npz`` file for each episode.

A file holds arrays of T frames, arrays of N points of all frames one after another, and ``offsets`` (T + 1 numbers):
frame t has the points offsets[t] to offsets[t + 1]. An array that is not in the file is looked for beside it, as
``<stem>_<name>.npy``. The digits at the end of a file's name are its episode.

Reading gives one of two tables: ``frames`` (episode_index, frame_index, arrays of T) or ``points`` (episode_index,
frame_index, point_id from 0 in its frame, arrays of N); arrays of two dimensions become array columns. A file is a
partition, or a run of files where there are over 200. Only arrays that the schema names are loaded, and only files of episodes that the query asks for:
by a filter on episode_index, or by the option ``episodes``. Every file that is read is checked: offsets begin at 0,
never fall and end at N, arrays of frames have T rows, and the array that the option ``counts`` names agrees with the
offsets. What fails names its file.

Writing takes one row for each frame in order of (episode_index, frame_index), all of an episode in one task; see
``write_episode_arrays``. Files get their names when the whole job has succeeded.

Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

_KEYS = {"frames": ("episode_index", "frame_index"), "points": ("episode_index", "frame_index", "point_id")}
_TYPES = {"f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "b1": T.BooleanType()}
_CODES = {t: code for code, t in _TYPES.items()}
#: Where more files are asked for, runs of them are partitions.
_MOST_PARTITIONS = 200
_EPISODE = re.compile(r"(\d+)\.npz$")
_COMPARED = {
    EqualTo: lambda e, f: e == f.value,
    In: lambda e, f: e in f.value,
    GreaterThan: lambda e, f: e > f.value,
    GreaterThanOrEqual: lambda e, f: e >= f.value,
    LessThan: lambda e, f: e < f.value,
    LessThanOrEqual: lambda e, f: e <= f.value,
}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "/", path))


class _Episode:
    """The arrays of one file, loaded when they are asked for."""

    def __init__(self, files: fs.FileSystem, path: str, offsets: str):
        self.files, self.path = files, path
        self.held = np.load(files.open_input_file(path), allow_pickle=False)
        self.offsets = self.array(offsets).astype(np.int64)

    def fail(self, what: str) -> None:
        raise ValueError(f"{self.path}: {what}")

    def array(self, name: str) -> np.ndarray:
        if name in self.held:
            return self.held[name]
        beside = re.sub(r"\.npz$", f"_{name}.npy", self.path)
        if self.files.get_file_info(beside).type == fs.FileType.NotFound:
            self.fail(f"no array {name}; there are {', '.join(sorted(self.held))}")
        return np.load(io.BytesIO(self.files.open_input_file(beside).read()), allow_pickle=False)

    def checked(self, names: Sequence[str], table: str, counts: str | None) -> dict[str, np.ndarray]:
        o = self.offsets
        if not len(o) or o[0] != 0 or (np.diff(o) < 0).any():
            self.fail("offsets must begin at 0 and never fall")
        if counts and not np.array_equal(self.array(counts), np.diff(o)):
            self.fail(f"{counts} and offsets disagree")
        found = {n: self.array(n) for n in names}
        due = len(o) - 1 if table == "frames" else int(o[-1])
        for n, a in found.items():
            if len(a) != due:
                self.fail(f"{n} has {len(a)} rows, not {due}")
        return found


class _Reader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table = options["path"], options.get("table", "frames")
        self.offsets, self.counts, self.rows = options.get("offsets", "offsets"), options.get("counts"), int(options.get("batchrows", "65536"))
        self.kept = [lambda e, held=frozenset(json.loads(options["episodes"])): e in held] if "episodes" in options else []
        self.schema = schema

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in _COMPARED and f.attribute == ("episode_index",):
                self.kept.append(lambda e, f=f: _COMPARED[type(f)](e, f))
            else:
                yield f

    def partitions(self):
        files, path = _opened(self.path)
        found = [(int(m[1]), i.path) for i in files.get_file_info(fs.FileSelector(path)) if (m := _EPISODE.search(i.path))]
        if not found:
            raise FileNotFoundError(f"no episode files in {self.path}")
        asked = sorted(x for x in found if all(keep(x[0]) for keep in self.kept))
        run = -(-len(asked) // _MOST_PARTITIONS)
        return [InputPartition(asked[k : k + run]) for k in range(0, len(asked), run or 1)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # no file is asked for
            return
        files, _ = _opened(self.path)
        for episode, path in partition.value:
            yield from self._rows(files, episode, path)

    def _rows(self, files: fs.FileSystem, episode: int, path: str) -> Iterator[pa.RecordBatch]:
        e = _Episode(files, path, self.offsets)
        arrays = e.checked([f.name for f in self.schema if f.name not in _KEYS[self.table]], self.table, self.counts)
        n = len(e.offsets) - 1
        frame = np.arange(n) if self.table == "frames" else np.repeat(np.arange(n), np.diff(e.offsets))
        arrays |= {"episode_index": np.full(len(frame), episode), "frame_index": frame}
        if self.table == "points":
            arrays["point_id"] = np.arange(len(frame)) - e.offsets[frame]
        for k in range(0, len(frame), self.rows):
            yield pa.RecordBatch.from_arrays([_column(arrays[f.name][k : k + self.rows], f.dataType) for f in self.schema], names=self.schema.names)


def _column(a: np.ndarray, kind: T.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    if a.ndim == 1:
        return pa.array(a).cast(to_arrow_type(kind))
    flat = pa.array(np.ascontiguousarray(a).reshape(-1)).cast(to_arrow_type(kind.elementType))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a[0].size if len(a) else [0], pa.int32()), flat)


class _Message(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    """Every task writes files of names of its own; commit gives them their episodes' names."""

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite

    def write(self, iterator) -> _Message:
        files, path = _opened(self.path)
        files.create_dir(path, recursive=True)
        held, written, due = [], [], 0

        def flush(episode):
            temporary = f"{path}/_{uuid.uuid4().hex}.part"
            with files.open_output_stream(temporary) as out:
                buffer = io.BytesIO()
                np.savez_compressed(buffer, **self._arrays(pa.Table.from_batches(held)))
                out.write(buffer.getvalue())
            written.append((temporary, f"{path}/episode_{episode:06d}.npz"))
            held.clear()

        now = None
        for batch in iterator:
            episodes, frames = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in _KEYS["frames"])
            cuts = np.flatnonzero(np.diff(episodes)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(episodes)], strict=True):
                if at == end:
                    continue
                if held and episodes[at] != now:
                    flush(now)
                if not held:
                    now, due = episodes[at], 0
                wrong = np.flatnonzero(frames[at:end] != np.arange(due, due + end - at))
                if len(wrong):
                    raise ValueError(f"episode {now} has frame {frames[at + wrong[0]]} where {due + wrong[0]} is due")
                held.append(batch.slice(at, end - at))
                due += end - at
        if held:
            flush(now)
        return _Message(written)

    def _arrays(self, rows: pa.Table) -> dict[str, np.ndarray]:
        def of(name, column, kind):
            if isinstance(kind, T.ArrayType):
                sizes = set(pc.list_value_length(column).to_pylist())
                if len(sizes) > 1 or None in sizes:
                    raise ValueError(f"{name} has arrays of several lengths")
                inner = of(name, column.flatten(), kind.elementType)
                return inner.reshape(len(column), sizes.pop()) if sizes else inner
            if column.null_count and not isinstance(kind, (T.FloatType, T.DoubleType)):
                raise ValueError(f"{name} has nulls")
            return column.to_numpy(zero_copy_only=False).astype(_CODES[kind])

        whole = {n: pa.concat_arrays(rows.column(n).chunks) for n in rows.column_names}
        own = {f.name: of(f.name, whole[f.name], f.dataType) for f in self.schema if f.name not in ("episode_index", "frame_index", "points")}
        sizes = np.zeros(rows.num_rows, np.int64)
        if "points" in whole:
            sizes = pc.list_value_length(whole["points"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fields = self.schema["points"].dataType.elementType
            own |= {f.name: of(f.name, column, f.dataType) for f, column in zip(fields, whole["points"].flatten().flatten(), strict=True)}
        return own | {"offsets": np.append(0, np.cumsum(sizes))}

    def commit(self, messages) -> None:
        files, path = _opened(self.path)
        names = [x for m in messages if m for x in m.names]
        due = [final for _, final in names]
        if len(set(due)) != len(due):
            self.abort(messages)
            raise ValueError("an episode's frames came from several tasks")
        if self.overwrite:
            for i in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if _EPISODE.search(i.path) and i.path not in due:
                    files.delete_file(i.path)
        for temporary, final in names:
            files.move(temporary, final)

    def abort(self, messages) -> None:
        files, _ = _opened(self.path)
        for temporary, _ in [x for m in messages if m for x in m.names]:
            files.delete_file(temporary)


class EpisodeArrays(DataSource):
    """``spark.read.format("episode_arrays").option("table", "frames" or "points").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "episode_arrays"

    def _table(self) -> str:
        table = self.options.get("table", "frames")
        if table not in _KEYS:
            raise ValueError(f"table is frames or points, not {table}")
        return table

    def schema(self) -> T.StructType:
        """From the first file: arrays of its number of frames, or of its number of points where that is asked for."""
        files, path = _opened(self.options["path"])
        found = sorted(i.path for i in files.get_file_info(fs.FileSelector(path)) if _EPISODE.search(i.path))
        if not found:
            raise FileNotFoundError(f"no episode files in {self.options['path']}")
        name = self.options.get("offsets", "offsets")
        e, table = _Episode(files, found[0], name), self._table()
        due = len(e.offsets) - 1 if table == "frames" else int(e.offsets[-1])
        fields = [T.StructField(k, T.LongType()) for k in _KEYS[table]]
        for n in sorted(set(e.held.files) - {name}):
            a = e.held[n]
            if a.ndim in (1, 2) and len(a) == due and a.dtype.str[1:] in _TYPES:
                kind = _TYPES[a.dtype.str[1:]]
                fields.append(T.StructField(n, kind if a.ndim == 1 else T.ArrayType(kind)))
        return T.StructType(fields)

    def reader(self, schema):
        self._table()
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite)


def register_episode_arrays(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeArrays)


def read_episode_arrays(spark: SparkSession, path: str, table: str = "frames", schema: str | None = None, episodes: Sequence[int] | None = None, **options: str) -> DataFrame:
    """Frames or points of array caches; the ``schema`` chooses what is loaded, or else all arrays of the first file are."""
    register_episode_arrays(spark)
    reader = spark.read.format("episode_arrays").option("table", table).options(**options)
    reader = reader if schema is None else reader.schema(schema)
    return (reader if episodes is None else reader.option("episodes", json.dumps(list(episodes)))).load(path)


def write_episode_arrays(frames: DataFrame, points: DataFrame | None, path: str, *, order: Sequence[str] = ("point_id",), overwrite: bool = False) -> None:
    """Writes frames (episode_index, frame_index from 0 without gaps, arrays and numbers) and their points (the same keys, numbers, sorted by ``order``)."""
    register_episode_arrays(frames.sparkSession)
    keys, rows = ["episode_index", "frame_index"], frames
    if points is not None:
        own = [c for c in points.columns if c not in keys]
        kept = [c for c in own if c != "point_id"]
        packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in own if c not in order)))).alias("p"))
        rows = frames.join(packed, keys, "left").withColumn("points", F.transform("p", lambda s: F.struct(*(s[c].alias(c) for c in kept)))).drop("p")
    rows = rows.withColumns({k: F.col(k).cast("long") for k in keys})
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as a few megabytes of rows are many files
    rows.repartition(tasks, "episode_index").sortWithinPartitions(*keys).write.format("episode_arrays").mode("overwrite" if overwrite else "append").save(path)
