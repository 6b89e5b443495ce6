"""Profiles of a table: sizes, moments, quantiles, histograms, outcome trimming.

Group keys that are null are dropped, as data frames of the origin do; empty
tables give empty results (scalar profiles one row of nulls).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import inside, scaled_ceil
from ..runtime import spill_table

SCAN_POINTS = [i / 200 for i in range(200)]


def group_size(df: DataFrame, *keys: str) -> DataFrame:
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def group_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    v = F.col(value)
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.min(v).alias(f"{value}_min"), F.max(v).alias(f"{value}_max"), F.avg(v).alias(f"{value}_mean"), F.stddev_samp(v).alias(f"{value}_std"))


def _at_ranks(points: list[float], keys: list[str]):
    """Rows whose run of equal values covers a rank that some point needs, once for each such rank."""

    def run(batches):
        for batch in batches:
            total = batch.column("_total").to_numpy()
            stop = batch.column("_before").to_numpy() + batch.column("_run").to_numpy()
            start = stop - batch.column("_n").to_numpy()
            rows, ranks = [], []
            for n in np.unique(total).tolist():
                at = (n - 1) * np.asarray(points)
                wanted = np.unique(np.concatenate([np.floor(at), np.ceil(at)]).astype(np.int64))
                own = np.flatnonzero(total == n)
                first, last = np.searchsorted(wanted, start[own]), np.searchsorted(wanted, stop[own])
                for i, a, b in zip(own[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist()):
                    rows += [i] * (b - a)
                    ranks += wanted[a:b].tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(ranks, pa.int64()), batch.column("_v").take(take)], names=[*keys, "_rank", "_v"])

    return run


def group_quantiles(df: DataFrame, value: str, keys: list[str], points: list[float]) -> DataFrame:
    """(keys..., q, value): exact, linearly interpolated, all points at once; without keys, of the whole table.

    Distinct values are counted on the map side, sorted by range over all tasks, and
    placed by counts per range, so no task ever holds the values of a group.
    """
    kinds = dict(df.dtypes)
    counted = df.na.drop(subset=keys) if keys else df
    counted = counted.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    # written once: counts and places must see the same ranges
    part = spill_table(counted.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()), "values")
    sums = part.groupBy("_p", *keys).agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # one row for each range and group
    offsets = sums.select("_p", *keys, F.coalesce(F.sum("_m").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("_total"))
    run = part.withColumn("_run", F.sum("_n").over(Window.partitionBy("_p", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "_rank long, _v double"
    found = run.join(offsets, ["_p", *keys]).select(*keys, "_v", "_n", "_run", "_before", "_total").mapInArrow(_at_ranks(points, keys), ddl)
    # a group's few ranks, as a map
    ranked = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"))
    totals = offsets.groupBy(*keys).agg(F.max("_total").alias("_total"))
    both = ranked.join(totals, keys) if keys else ranked.join(F.broadcast(totals))
    at = both.select(*keys, "_at", "_total", F.explode(F.array(*map(F.lit, points))).alias("q")).withColumn("_pos", (F.col("_total") - 1) * F.col("q"))
    low, high = F.col("_at")[F.floor("_pos")], F.col("_at")[F.ceil("_pos")]
    part_ = F.col("_pos") - F.floor("_pos")
    return at.select(*keys, "q", F.when((part_ == 0) | (low == high), low).otherwise((1 - part_) * low + part_ * high).alias("value"))


def describe(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    moments = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    q = group_quantiles(df, value, [], list(names)).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in names.items()])
    return moments.join(F.broadcast(q)).select("count", "mean", "std", "min", *names.values(), "max")


def _bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows with the equal-width bin of their finite value (the top edge in the last bin)."""
    v = F.col(value)
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # one row of extremes: a bound of one by construction
    ends = finite.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    pos = F.floor((v - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))
    return finite.join(F.broadcast(ends)).withColumn("bin", F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), pos)).cast("int"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, count) of equal-width bins that hold something."""
    return _bins(df, value, bins).groupBy("bin").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.count(F.lit(1)).alias("count")).select("bin", (F.col("_lo") + F.col("bin") * ((F.col("_hi") - F.col("_lo")) / bins)).alias("low"), "count")


def weighted_histogram(df: DataFrame, value: str, weight: str, by: str, bins: int = 30) -> DataFrame:
    """(by, bin, share): weights per bin over the total weight of all bins and groups."""
    cells = _bins(df, value, bins).groupBy(by, "bin").agg(F.sum(weight).alias("_w"))
    total = cells.agg(F.sum("_w").alias("_t"))
    return cells.join(F.broadcast(total)).select(by, "bin", (F.col("_w") / F.col("_t")).alias("share"))


def zscore(df: DataFrame, value: str, out: str = "normed") -> DataFrame:
    one = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(F.broadcast(one)).withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def quantile_scan(df: DataFrame, value: str, low: float, high: float, points: list[float] | None = None) -> DataFrame:
    """One row (low_value, low_q, high_value, high_q): the first grid quantile above ``low``
    from below, and the first below ``high`` from above. One pass for the grid;
    NaN values are left out, infinities take part."""
    rows = group_quantiles(df.where(~F.isnan(value)), value, [], points or SCAN_POINTS).select("q", F.col("value").alias("v"))
    up, down = (F.col("v") > low) & ~F.isnan("v"), (F.col("v") < high) & ~F.isnan("v")
    return rows.agg(
        F.min_by("v", F.when(up, F.col("q"))).alias("low_value"), F.min(F.when(up, F.col("q"))).alias("low_q"), F.max_by("v", F.when(down, F.col("q"))).alias("high_value"), F.max(F.when(down, F.col("q"))).alias("high_q")
    )


def trim_outcome(df: DataFrame, value: str, low: float, high: float, scale: int = 100) -> DataFrame:
    """Rows strictly inside the scanned bounds, which are raised to multiples of 1/scale."""
    ends = quantile_scan(df, value, low, high).select(scaled_ceil(F.col("low_value"), scale).alias("_lo"), scaled_ceil(F.col("high_value"), scale).alias("_hi"))
    return df.join(F.broadcast(ends)).where(inside(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first rows of an explicit order (a report)."""
    return df.orderBy(*order).limit(n)
