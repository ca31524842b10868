"""Vector columns: statistics, quantiles, normalisation, padding, similarity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demolake.operators.quantiles import exact_quantiles, quantile_name, sketch_columns, vector_values, with_quantiles
from demolake.sources.shared import materialize


def concat_vectors(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.concat(*(F.col(k) for k in keys)))


def vslice(v: str | Column, start: int, end: int) -> Column:
    """The half-open slice [start, end)."""
    return F.slice(F.col(v) if isinstance(v, str) else v, start + 1, end - start)


def vreplace(v: str | Column, start: int, end: int, new: Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.concat(F.slice(v, 1, start), new, F.slice(v, F.lit(end + 1), F.greatest(F.size(v) - end, F.lit(0))))


def pad_vector(v: str | Column, width: int, value: float = 0.0) -> Column:
    """Fills up to ``width``; a vector of that width stays."""
    v = F.col(v) if isinstance(v, str) else v
    return F.concat(v, F.array_repeat(F.lit(value).cast("double"), F.greatest(F.lit(width) - F.size(v), F.lit(0))))


def check_width(df: DataFrame, v: str, width: int) -> DataFrame:
    """Fails on a vector of another width."""
    fine = F.when(F.size(v) == width, F.col(v)).otherwise(F.raise_error(F.concat(F.lit(f"expected width {width}, got "), F.size(v).cast("string"))))
    return df.withColumn(v, fine.cast(df.schema[v].dataType))


def vector_stats(df: DataFrame, v: str, *, by: Sequence[str] = (), quantiles: Sequence[float] = (), exact: bool = True, width: int | None = None) -> DataFrame:
    """Per dimension: dim, n, min, max, mean, population std, and quantiles qNN by linear interpolation.

    With a known ``width`` the dimensions are aggregates of one row each way,
    without exploding; partial results merge, whatever the split. Exact quantiles
    are found by rank over all tasks; ``exact=False`` takes sketches, in the same pass as the rest.
    """

    def aggs(x: Column) -> list[tuple[str, Column]]:
        x = x.cast("double")
        own = [("n", F.count(x)), ("min", F.min(x)), ("max", F.max(x)), ("mean", F.avg(x)), ("std", F.stddev_pop(x))]
        return own if exact or not quantiles else [*own, ("sketch", F.kll_sketch_agg_double(x, F.lit(1024)))]

    if width is None:
        out = df.select(*by, F.posexplode(v).alias("dim", "_x")).groupBy(*by, "dim").agg(*(a.alias(n) for n, a in aggs(F.col("_x"))))
    else:
        wide = df.groupBy(*by).agg(*(F.struct(*(a.alias(n) for n, a in aggs(F.element_at(v, k + 1)))).alias(f"_{k}") for k in range(width)))
        out = wide.select(*by, F.posexplode(F.array(*(F.col(f"_{k}") for k in range(width)))).alias("dim", "s")).select(*by, "dim", "s.*")
    if not quantiles:
        return out
    if not exact:
        return out.select(*by, "dim", "n", "min", "max", "mean", "std", *sketch_columns("sketch", quantiles)[1:])
    return with_quantiles(out, vector_values(df, v, by), "x", {quantile_name(q): q for q in quantiles}, [*by, "dim"])


def quantiles_by_rank(df: DataFrame, v: str, quantiles: Sequence[float]) -> DataFrame:
    """Exact quantiles of each dimension by linear interpolation, for vectors of any number: dim, n, qNN."""
    return exact_quantiles(vector_values(df, v), "x", quantiles, ["dim"])


def replace_zero_std(stats: DataFrame, std: str = "std") -> DataFrame:
    return stats.withColumn(std, F.when(F.col(std) == 0, 1.0).otherwise(F.col(std)))


def mask_rotation_stats(stats: DataFrame, start: int, end: int, rotation: str) -> DataFrame:
    """Mean 0 and std 1 for the dimensions of a rotation that must not be normalised (quat, rot6d, matrix)."""
    if rotation not in ("quat", "rot6d", "matrix"):
        return stats
    inside = (F.col("dim") >= start) & (F.col("dim") < end)
    return stats.withColumns({"mean": F.when(inside, 0.0).otherwise(F.col("mean")), "std": F.when(inside, 1.0).otherwise(F.col("std"))})


def merge_partials(partials: DataFrame, by: Sequence[str] = ("dim",), quantiles: Sequence[float] = ()) -> DataFrame:
    """Final statistics from partial rows (n, mean, m2, min, max, and sketch for quantiles) of disjoint parts.

    Means and squared deviations add up around one of the parts' means, so that
    means far from zero cost no digits. Quantiles qNN come from the merged sketches.
    """
    around = partials.groupBy(*by).agg(F.min("mean").alias("_m0")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    whole = partials.join(around, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]) if by else partials.crossJoin(around)
    off = F.col("mean") - F.col("_m0")
    merged = [F.kll_merge_agg_double("sketch").alias("_k")] if quantiles else []
    sums = whole.groupBy(*by).agg(F.sum("n").alias("_n"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("_m0").alias("_m0"), (F.sum(F.col("n") * off) / F.sum("n")).alias("_d"), (F.sum(F.col("m2") + F.col("n") * off * off) / F.sum("n")).alias("_s"), *merged)
    own = [F.col("_n").alias("n"), "min", "max", (F.col("_m0") + F.col("_d")).alias("mean"), F.sqrt(F.greatest(F.col("_s") - F.col("_d") * F.col("_d"), F.lit(0.0))).alias("std")]
    return sums.select(*by, *own, *(sketch_columns("_k", quantiles)[1:] if quantiles else ()))


def partial_stats(df: DataFrame, v: str, by: Sequence[str] = (), *, sketch: int | None = None) -> DataFrame:
    """The rows that merge_partials takes; with ``sketch``, its size, quantiles can be asked of them, too."""
    x = F.col("_x")
    rows = df.select(*by, F.posexplode(v).alias("dim", "_v")).withColumn("_x", F.col("_v").cast("double"))
    held = [F.kll_sketch_agg_double("_x", F.lit(sketch)).alias("sketch")] if sketch else []
    return rows.groupBy(*by, "dim").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("min"), F.max(x).alias("max"), *held)


class StatsAccumulator:
    """Statistics and quantiles of a vector column, gathered part by part: ``update`` takes rows, ``merge`` another accumulator, ``result`` may be asked at any time.

    The state is a table of partial rows in the shared folder for each part: the rows themselves aren't kept or read again.
    Two accumulators must not have a part in common.
    """

    def __init__(self, v: str, *, sketch: int = 1024):
        self.v, self.sketch, self.parts = v, sketch, []

    def update(self, df: DataFrame) -> StatsAccumulator:
        self.parts.append(materialize(partial_stats(df, self.v, sketch=self.sketch), "partials"))
        return self

    def merge(self, other: StatsAccumulator) -> StatsAccumulator:
        if (self.v, self.sketch) != (other.v, other.sketch):
            raise ValueError("accumulators of different columns or sketches don't merge")
        self.parts += other.parts
        return self

    def result(self, quantiles: Sequence[float] = ()) -> DataFrame:
        if not self.parts:
            raise ValueError("nothing was gathered yet")
        return merge_partials(reduce(DataFrame.unionByName, self.parts), quantiles=quantiles)


def normalise(x: Column, mean: Column, std: Column, *, guard: float | None = None) -> Column:
    """(x - mean) / std for arrays; ``guard`` is the least std to divide by."""
    std = F.transform(std, lambda s: F.greatest(s, F.lit(guard))) if guard is not None else std
    return F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), std, lambda a, s: a / s)


def denormalise(x: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(x, std, lambda a, s: a * s), mean, lambda a, b: a + b)


def bounds_normalise(x: Column, low: Column, high: Column, *, clip: bool) -> Column:
    """To [-1, 1] by bounds; clipped for states, not for actions."""
    y = F.zip_with(F.zip_with(x, low, lambda a, b: a - b), F.zip_with(high, low, lambda h, b: h - b), lambda a, w: a / w * 2.0 - 1.0)
    return F.transform(y, lambda a: F.greatest(F.least(a, F.lit(1.0)), F.lit(-1.0))) if clip else y


def bounds_denormalise(y: Column, low: Column, high: Column) -> Column:
    return F.zip_with(F.zip_with(y, F.zip_with(high, low, lambda h, b: h - b), lambda a, w: (a + 1.0) / 2.0 * w), low, lambda a, b: a + b)


def discretise(x: Column, bins: int = 256) -> Column:
    """The bin of each component of a vector in [-1, 1]: left edges belong to their bin; outside values go to the end bins."""
    return F.transform(x, lambda a: F.greatest(F.least(F.floor((a + 1.0) * (bins / 2)), F.lit(bins - 1)), F.lit(0)).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(df: DataFrame, key: str, v: str, names: tuple[str, str], block: int) -> DataFrame:
    """One row for each ``block`` rows at most: the keys, and the vectors as bytes (not a number: no vector)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, block):
                part = whole.slice(k, block)
                rows = part.column(1).to_pylist()
                width = max((len(r) for r in rows if r is not None), default=0)
                x = np.array([[np.nan] * width if r is None else r for r in rows], dtype=float).reshape(len(rows), width)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([x.tobytes()], pa.binary())], names=list(names))

    return df.select(key, F.col(v).cast("array<double>").alias(v)).mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} binary")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; not a number, where the length is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rounded(z: np.ndarray, x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """Cosines ``z`` of the rows of ``x`` and ``y``, rounded half away from zero as SQL rounds its own, whose sums go from first to last.

    Only those so near to a half that the order of sums could tell are taken anew in that order.
    """
    ten = 10.0**digits
    w = z * ten
    near = np.rint(w)
    off = np.abs(np.subtract(w, near, out=w), out=w)
    i, j = np.divmod(np.flatnonzero(off > 0.5 - 4 * (x.shape[1] + 8) * 2.0**-53 * ten), len(y))
    dot = lambda a, b: np.cumsum(a * b, axis=1)[:, -1]
    some = max(1, 2**20 // x.shape[1])
    for k in range(0, len(i), some):
        a, b = x[i[k : k + some]], y[j[k : k + some]]
        w = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))) * ten
        whole = np.trunc(w)
        near[i[k : k + some], j[k : k + some]] = whole + np.where(np.abs(w - whole) >= 0.5, np.copysign(1.0, w), 0.0)
    return np.divide(near, ten, out=near)


#: About so many results a task of ``cosine_to_queries`` gives; more, if there would be over ``MOST_TASKS``.
RESULTS, MOST_TASKS = 4_000_000, 20_000


def _tiled(df: DataFrame, queries: DataFrame, sizes: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
    """Rows and queries dealt into parts, of which each two make about ``RESULTS`` results, as an input file is one part, or few, whatever its rows."""
    n, m = sizes or (df.count(), queries.count())
    each = max(RESULTS, n * m // MOST_TASKS)
    if n * m <= each:
        return df, queries
    across = min(-(-m // math.isqrt(each)), -(-n * m // each))
    return df.repartition(-(-n * m // (across * each))), queries.repartition(across).hint("shuffle_replicate_nl")


def cosine_to_queries(df: DataFrame, v: str, queries: DataFrame, *, key: str, block: int = 1000, sizes: tuple[int, int] | None = None, digits: int | None = None) -> DataFrame:
    """Similarity of every row to every query row, by blocks of at most ``block`` rows and queries, whatever their number.

    Null where a vector is null or has length zero. A task takes blocks of both sides from batches of bounded size (Spark's
    ``arrow.maxBytesPerBatch``) and sends on about 64,000 results at a time. The result itself is as large as the product of both
    sides; its tasks grow in number with it, and rows and queries alone are shuffled. ``sizes``, the numbers of rows and queries or
    bounds of them, spare the counting of both. With ``digits`` the similarity is rounded to so many, half away from zero, a block at a time
    rather than row by row, and equals what SQL makes of double sums in the order of components.
    """
    df, queries = _tiled(df.select(key, v), queries.select(key, v), sizes)
    rows, asked = _packed(df, key, v, ("_k", "_x"), block), _packed(queries, key, v, ("_q", "_y"), block)

    def run(batches):
        for b in batches:
            for k, x, q, y in zip(b.column(0), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x).reshape(len(k), -1), np.frombuffer(y).reshape(len(q), -1)
                known, u, w = x.shape[1] and y.shape[1], _unit(x), _unit(y).T
                step = max(1, 65536 // len(q))
                two = q.values.take(pa.array(np.tile(np.arange(len(q)), min(step, len(k)))))
                for i in range(0, len(k), step):
                    z = u[i : i + step] @ w if known else np.full((len(x[i : i + step]), len(y)), np.nan)
                    if known and digits is not None:
                        z = _rounded(z, x[i : i + step], y, digits)
                    one = k.values.take(pa.array(np.repeat(np.arange(i, i + len(z)), len(q))))
                    yield pa.RecordBatch.from_arrays([one, two.slice(0, z.size), pa.array(z.ravel(), from_pandas=True)], names=[key, "query_id", "cosine"])

    schema = df.select(F.col(key), F.col(key).alias("query_id")).limit(0).selectExpr("*", "CAST(NULL AS DOUBLE) AS cosine").schema
    return rows.crossJoin(asked).mapInArrow(run, schema)


def pairwise_cosine_percentiles(df: DataFrame, v: str, key: str, *, n: int = 2000, percents: Sequence[int] = (1, 5, 25, 50, 75, 95, 99), seed: int = 0, order: Column | None = None) -> DataFrame:
    """Percentiles of similarity over all pairs of a sample of at most ``n`` rows, the first by ``order`` (a seeded hash by default)."""
    sample = df.select(key, v).orderBy(F.xxhash64(key, F.lit(seed)) if order is None else order, key).limit(n)
    pairs = cosine_to_queries(sample, v, sample, key=key, sizes=(n, n)).filter(F.col(key) < F.col("query_id")).select(F.col("cosine").alias("c"))
    return pairs.agg(F.count("*").alias("pairs"), *(F.percentile("c", F.lit(p / 100)).alias(f"p{p:02d}") for p in percents))


def paired_cosine(a: DataFrame, b: DataFrame, v: str, key: str, repeat: str) -> DataFrame:
    """Mean similarity of the same rows in two runs, then mean and population std over repeats."""
    both = a.select(key, repeat, F.col(v).alias("_a")).join(b.select(key, repeat, F.col(v).alias("_b")), [key, repeat])
    each = both.groupBy(repeat).agg(F.avg(cosine(F.col("_a"), F.col("_b"))).alias("m"))
    return each.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("*").alias("repeats"))
