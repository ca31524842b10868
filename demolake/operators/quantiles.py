"""Quantiles that merge: states of disjoint parts are kept, merged and asked later, in any order and split.

Two states are offered. Counts of values (``value_counts``) are exact: merged, they give the
quantiles of all parts by linear interpolation between ranks. Sketches (``sketch_state``) have a bounded size,
whatever the number of rows, and answer within a rank error.

Exact quantiles are found by rank: values lie in sorted ranges over all tasks, a range's size tells which ranks it
holds, and only ranges that hold a wanted rank are numbered inside. No task holds the distinct values of a column, and
a value that a third of all rows have is one row.

Nulls and not-a-numbers are no values. Groups without values give no row (without group columns: a row
of nulls); group columns may be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demolake.sources.shared import materialize


def quantile_name(q: float) -> str:
    return f"q{round(100 * q):02d}"


def _valued(df: DataFrame, x: str | Column, by: Sequence[str]) -> DataFrame:
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    return df.select(*by, F.nanvl(value, F.lit(None).cast("double")).alias("x")).filter("x IS NOT NULL")


def vector_values(df: DataFrame, v: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each component: by, dim, x."""
    return df.select(*by, F.posexplode(v).alias("dim", "x"))


def value_counts(df: DataFrame, x: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """The exact state: by, x, n."""
    return _valued(df, x, by).groupBy(*by, "x").agg(F.count("*").alias("n"))


def merge_counts(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*by, "x").agg(F.sum("n").alias("n"))


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Left rows with the right columns of the same group; groups may have null keys."""
    if not (by or keys):
        return left.crossJoin(right)  # one row on the right
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in (*by, *keys)})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col(c) == F.col(f"_of_{c}") for c in keys]
    return left.join(named, same).drop(*(f"_of_{c}" for c in (*by, *keys)))


def counted_quantiles(counts: DataFrame, quantiles: Mapping[str, float] | Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """By, n, and the named quantiles (qNN where only shares are given) of merged counts (by, x, n)."""
    asked = dict(quantiles) if isinstance(quantiles, Mapping) else {quantile_name(q): q for q in quantiles}
    ranged = materialize(counts.select(*by, "x", F.col("n").alias("_n")).repartitionByRange(*by, "x").withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_c"))  # one row for each group and range
    before = sizes.select(*by, "_p", "_c", (F.sum("_c").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_c")).alias("_o"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    low = {name: F.floor(F.lit(q) * (F.col("n") - 1)) for name, q in asked.items()}

    def holds(first: Column, last: Column) -> Column:
        """Whether a wanted rank lies in [first, last)."""
        out = F.lit(False)
        for r in low.values():
            out = out | ((r < last) & (r + 1 >= first))
        return out

    wanted = before.filter(holds(F.col("_o"), F.col("_o") + F.col("_c")))
    inside = _beside(ranged, wanted, by, ["_p"])
    upto = F.col("_o") + F.sum("_n").over(Window.partitionBy("_p", *by).orderBy("x"))
    kept = inside.withColumn("_e", upto).withColumn("_s", F.col("_e") - F.col("_n")).filter(holds(F.col("_s"), F.col("_e")))

    def value(name: str) -> Column:
        at = lambda r: F.max(F.when((F.col("_s") <= r) & (r < F.col("_e")), F.col("x")))
        a, b = at(low[name]), at(low[name] + 1)
        part = F.max(F.lit(asked[name]) * (F.col("n") - 1) - low[name])
        return a + F.coalesce(part * (b - a), F.lit(0.0))

    return kept.groupBy(*by).agg(F.max("n").alias("n"), *(value(name).alias(name) for name in asked))


def exact_quantiles(df: DataFrame, x: str | Column, quantiles: Mapping[str, float] | Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return counted_quantiles(value_counts(df, x, by), quantiles, by)


def with_quantiles(report: DataFrame, df: DataFrame, x: str | Column, quantiles: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """A report of one row a group with exact quantiles beside it; null in groups without values."""
    found = exact_quantiles(df, x, quantiles, by).drop("n")
    if not by:
        return report.join(F.broadcast(found), F.lit(True), "left")  # one row each
    named = found.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return report.join(named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], "left").drop(*(f"_of_{c}" for c in by))


def sketch_state(df: DataFrame, x: str | Column, by: Sequence[str] = (), *, k: int = 1024) -> DataFrame:
    """The bounded state: by, sketch. ``k`` sets its size and rank error: 1024 answers within half a percent of the rows."""
    return _valued(df, x, by).groupBy(*by).agg(F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"))


def merge_sketches(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_columns(sketch: str | Column, quantiles: Sequence[float]) -> list[Column]:
    """n and qNN of a merged sketch. The ends of the scale are the least and the greatest value, exactly."""
    return [F.kll_sketch_get_n_double(sketch).alias("n"), *(F.kll_sketch_get_quantile_double(sketch, F.lit(float(q))).alias(quantile_name(q)) for q in quantiles)]
