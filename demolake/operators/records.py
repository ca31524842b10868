"""Anchor records as old caches hold them: one flat list of 32-bit floats for each frame, its layout known by its length.

A record is the number of anchors, then so many slots of x, y, z, query, support, a pixel (u, v) for each view, and whether the
views agreed. Views are always the first of ``VIEWS``. A pixel that a view doesn't have is not a number; unused slots are zero.

Decoding runs as a table function over Arrow batches, a layout of a batch at a time. A record's number of anchors
counts up to its slots; a null record has none, and a length that no layout has is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The views in the order of their pixels, and how many slots records have had.
VIEWS = ("left", "right", "wrist")
SLOTS = (6, 2)

_BEFORE_PIXELS, _AFTER_PIXELS = 5, 1


def record_length(slots: int, views: int) -> int:
    return 1 + slots * (_BEFORE_PIXELS + 2 * views + _AFTER_PIXELS)


#: Slots and number of views of each known length.
LAYOUTS = {record_length(slots, views): (slots, views) for slots in SLOTS for views in range(1, len(VIEWS) + 1)}


def encode_anchors(anchors: Column, *, slots: int = SLOTS[0], views: int = len(VIEWS)) -> Column:
    """Anchors (an array of structs x, y, z, query_id, n_support, agree, and <view>_u, <view>_v for the views to write) as a record; further anchors than slots are left out."""
    if record_length(slots, views) not in LAYOUTS:
        raise ValueError(f"no layout has {slots} slots of {views} views")
    kept = F.slice(anchors, 1, slots)
    pixel = lambda a, name: F.coalesce(a[name].cast("float"), F.lit(float("nan")).cast("float"))

    def slot(a: Column) -> Column:
        uv = [pixel(a, f"{v}_{c}") for v in VIEWS[:views] for c in "uv"]
        return F.array(*(a[c].cast("float") for c in ("x", "y", "z", "query_id", "n_support")), *uv, F.coalesce(a["agree"], F.lit(False)).cast("float"))

    unused = (F.lit(slots) - F.size(kept)) * (record_length(slots, views) // slots)
    return F.concat(F.array(F.size(kept).cast("float")), F.flatten(F.transform(kept, slot)), F.array_repeat(F.lit(0.0).cast("float"), unused.cast("int")))


def _decoded(records: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each layout among the records: the record's place, its slot, the slot's floats, and the number of views."""
    if pa.types.is_binary(records.type) or pa.types.is_large_binary(records.type):
        rows = [None if r is None else np.frombuffer(r, "<f4") for r in records.to_pylist()]
    else:
        ends, flat = records.offsets.to_numpy(), records.values.to_numpy(zero_copy_only=False).astype(np.float32)
        gone = records.is_null().to_numpy(zero_copy_only=False)
        rows = [None if gone[k] else flat[ends[k] : ends[k + 1]] for k in range(len(records))]
    sizes = np.array([-1 if r is None else len(r) for r in rows], dtype=np.int64)
    for size in np.unique(sizes[sizes >= 0]).tolist():
        if size not in LAYOUTS:
            raise ValueError(f"no anchor record has {size} numbers")
        slots, views = LAYOUTS[size]
        at = np.nonzero(sizes == size)[0]
        whole = np.stack([rows[k] for k in at])
        n = np.clip(np.nan_to_num(whole[:, 0]), 0, slots).astype(np.int64)
        record, slot = np.nonzero(np.arange(slots) < n[:, None])
        yield at[record], slot, whole[:, 1:].reshape(len(at), slots, -1)[record, slot], views


def read_records(df: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """One row for each anchor of each record (an array of floats, or their bytes): keys, slot, x, y, z, query_id, n_support, agree, <view>_u, <view>_v. What is not finite is null."""
    pixels = [f"{v}_{c}" for v in VIEWS for c in "uv"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    names = [*keys, "slot", "x", "y", "z", "query_id", "n_support", "agree", *pixels]

    class Read:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for at, slot, x, views in _decoded(batch.column(batch.num_columns - 1)):
                number = lambda a: pa.array(a.astype(np.float64), mask=~np.isfinite(a))
                whole = lambda a: pa.array(np.nan_to_num(a).astype(np.int32), mask=~np.isfinite(a))
                own = [pa.array(slot.astype(np.int32)), *(number(x[:, k]) for k in range(3)), whole(x[:, 3]), whole(x[:, 4]), pa.array(x[:, -1] == 1)]
                uv = [number(x[:, _BEFORE_PIXELS + k]) if k < 2 * views else pa.nulls(len(at), pa.float64()) for k in range(len(pixels))]
                yield pa.Table.from_arrays([*(batch.column(k).take(pa.array(at)) for k in range(len(keys))), *own, *uv], names=names)

    read = F.arrow_udtf(Read, returnType=f"{kept}, slot int, x double, y double, z double, query_id int, n_support int, agree boolean, " + ", ".join(f"{p} double" for p in pixels))
    return read(df.select(*keys, F.col(record).alias("record_")).asTable())


def usable_anchors(decoded: DataFrame, query_ids: Sequence[int] | None = None) -> DataFrame:
    """Decoded anchors with a finite position, of some queries or of all."""
    rows = decoded.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return rows if query_ids is None else rows.filter(F.col("query_id").isin(list(query_ids)))
