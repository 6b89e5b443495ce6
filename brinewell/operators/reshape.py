"""Window-like and reshaping operators of the panel analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_max(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A group's largest value on every row: a map-side aggregate joined back, so a crowded group is never sorted."""
    top = df.groupBy(key).agg(F.max(value).alias(out))
    return df.join(top.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def step_change(cells: DataFrame, group: str, order: str, value: str, out: str = "change") -> DataFrame:
    """Difference to the previous row within a group of an aggregated table."""
    return cells.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(order)))


def tag_blocks(df: DataFrame, treated: Column, post: Column, out: str = "dataset") -> DataFrame:
    """control_pre, control_post, treated_pre or treated_post in one pass."""
    return df.withColumn(out, F.concat(F.when(treated, "treated").otherwise("control"), F.lit("_"), F.when(post, "post").otherwise("pre")))


def wide_to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "dataset", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], name, value)


def attach_mean(df: DataFrame, keys: list[str], outcome: str, suffix: str = "_mean") -> DataFrame:
    """Left join of a group's mean outcome, the clashing column suffixed."""
    m = df.groupBy(*keys).agg(F.avg(outcome).alias(outcome + suffix))
    renamed = m.select(*[F.col(k).alias(f"_{k}") for k in keys], outcome + suffix)
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return df.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])


def once_per(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropDuplicates(columns)


def treatment_matrix(panel: DataFrame, unit: str, period: str, value: str, periods: list) -> DataFrame:
    """Units by periods, gaps as 0.0. A cell with two rows is an error."""
    counted = panel.groupBy(unit, period).agg(F.first(value).alias(value), F.count(F.lit(1)).alias("_n"))
    checked = counted.withColumn(value, F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("two rows for one unit and period"))))
    return checked.groupBy(unit).pivot(period, periods).agg(F.first(value)).na.fill(0.0)


def ordinal(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based place in an explicit order, for small aggregated tables."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)) - 1)
