"""Profiles of the readings: sizes, moments, quantiles, histograms, filters, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import indicator, inside, round_even, scaled_ceil
from ..operators import profile
from .panel import PANEL, PREP, panel, prepared, rounded


def group_size(s, d):
    return profile.group_size(prepared(s, d), "regions")


def group_size_2key(s, d):
    return profile.group_size(prepared(s, d), "oceans", "density")


def group_stats(s, d):
    return rounded(profile.group_stats(prepared(s, d), "measurement", "oceans"))


def group_mean(s, d):
    return rounded(prepared(s, d).na.drop(subset=["density"]).groupBy("density").agg(F.avg("measurement").alias("measurement")))


def group_quantiles(s, d):
    return rounded(profile.group_quantiles(prepared(s, d), "measurement", ["oceans"], [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]))


def describe_outcome(s, d):
    return rounded(profile.describe(prepared(s, d).where(~F.isnan("log_m")), "log_m"))


def hist_outcome(s, d):
    return rounded(profile.histogram(panel(s, d), "log_m", 50))


def hist_bins(s, d):
    """The other widths that are drawn: 10, 20 and 30 bins."""
    p = panel(s, d).select("log_m")
    out = None
    for n in (10, 20, 30):
        h = profile.histogram(p, "log_m", n).select(F.lit(n).alias("bins"), "bin", "low", "count")
        out = h if out is None else out.unionByName(h)
    return rounded(out)


def reference_lines(s, d):
    """Where lines are drawn over the outcome: its mean in each arm, and over all."""
    return rounded(panel(s, d).rollup("treated").agg(F.avg("log_m").alias("level"), F.grouping("treated").cast("int").alias("whole")))


def zscore(s, d):
    return rounded(profile.zscore(panel(s, d).select("obs_id", "log_m"), "log_m"), 5)


def distinct_values(s, d):
    return prepared(s, d).select("sampling_method").distinct()


def count_where(s, d):
    p = prepared(s, d)
    return profile.count_where(p, capped=F.col("measurement") >= 1, zero=F.col("measurement") == 0, in_years=F.col("year").between(2011, 2019), pieces=F.col("unit") == "pieces/m3")


def count_distinct(s, d):
    return prepared(s, d).agg(F.countDistinct("regions").alias("regions"), F.count(F.lit(1)).alias("n"))


def filtered_readings(s, d):
    p = prepared(s, d)
    f = p.where((F.col("unit") == "pieces/m3") & F.col("oceans").isin("Atlantic Ocean", "Pacific Ocean") & inside(F.col("measurement"), F.lit(0.0), F.lit(1.0)))
    return f.select("obs_id", F.col("measurement").alias("value"), F.col("oceans").alias("ocean"), indicator(F.col("year") > 2010).alias("late"))


def scaled_values(s, d):
    """Upward to a thousandth, and to two places half to even."""
    p = prepared(s, d).where("measurement between 0 and 1")
    return p.select("obs_id", F.round(scaled_ceil(F.col("measurement"), 1000), 6).alias("up"), round_even(F.col("measurement"), 2).alias("even")).where("even is not null")


def latest_readings(s, d):
    """The ten latest readings by date and id: a report."""
    p = prepared(s, d).where("year is not null")
    return profile.top_rows(p.select("obs_id", "year", "month", "day"), [F.col("year").desc(), F.col("month").desc(), F.col("day").desc(), F.col("obs_id")], 10)


def union_arms(s, d):
    p = panel(s, d).select("obs_id", "treated", "log_m")
    return rounded(p.where("treated = 1").unionByName(p.where("treated = 0")))


def filled_cells(s, d):
    """Missing densities and means as constants."""
    g = prepared(s, d).groupBy("oceans", "density").agg(F.avg(F.when(F.col("neuston_net") == 1, F.col("measurement"))).alias("net_mean"))
    return rounded(g.na.fill(0.0, ["net_mean"]).na.fill("none", ["oceans", "density"]))


QUERIES = {f.__name__: f for f in (
    group_size, group_size_2key, group_stats, group_mean, group_quantiles, describe_outcome, hist_outcome, hist_bins, reference_lines, zscore, distinct_values, count_where, count_distinct, filtered_readings, scaled_values, latest_readings, union_arms, filled_cells,
)}

_Q = "[0.05, 0.25, 0.5, 0.75, 0.95, 0.99]"
ORACLES = {
    "group_size": PREP + "SELECT regions, count(*) AS count FROM obs WHERE regions IS NOT NULL GROUP BY regions",
    "group_size_2key": PREP + "SELECT oceans, density, count(*) AS count FROM obs WHERE oceans IS NOT NULL AND density IS NOT NULL GROUP BY ALL",
    "group_stats": PREP + "SELECT oceans, round(min(measurement), 6) AS measurement_min, round(max(measurement), 6) AS measurement_max, round(avg(measurement), 6) AS measurement_mean, round(stddev_samp(measurement), 6) AS measurement_std FROM obs WHERE oceans IS NOT NULL GROUP BY oceans",
    "group_mean": PREP + "SELECT density, round(avg(measurement), 6) AS measurement FROM obs WHERE density IS NOT NULL GROUP BY density",
    "group_quantiles": PREP + f"SELECT oceans, unnest({_Q}::DOUBLE[]) AS q, round(unnest(quantile_cont(measurement, {_Q})), 6) AS value FROM obs WHERE oceans IS NOT NULL GROUP BY oceans",
    "describe_outcome": PREP + "SELECT count(log_m) AS count, round(avg(log_m), 6) AS mean, CASE WHEN min(log_m) = '-inf'::DOUBLE THEN 'nan'::DOUBLE ELSE round(stddev_samp(log_m) FILTER (isfinite(log_m)), 6) END AS std, round(min(log_m), 6) AS min, round(quantile_cont(log_m, 0.25), 6) AS q25, round(quantile_cont(log_m, 0.5), 6) AS q50, round(quantile_cont(log_m, 0.75), 6) AS q75, round(max(log_m), 6) AS max FROM obs WHERE NOT isnan(log_m)",
    "hist_outcome": PANEL + ", e AS (SELECT min(log_m) AS lo, max(log_m) AS hi FROM panel), b AS (SELECT least(49, floor((log_m - lo) / ((hi - lo) / 50)))::INT AS bin, lo, hi FROM panel, e) SELECT bin, round(lo + bin * ((hi - lo) / 50), 6) AS low, count(*) AS count FROM b GROUP BY bin, lo, hi",
    "hist_bins": PANEL + ", e AS (SELECT min(log_m) AS lo, max(log_m) AS hi FROM panel), n AS (SELECT unnest([10, 20, 30])::INT AS bins), b AS (SELECT bins, least(bins - 1, floor((log_m - lo) / ((hi - lo) / bins)))::INT AS bin, lo, hi FROM panel, e, n) SELECT bins, bin, round(lo + bin * ((hi - lo) / bins), 6) AS low, count(*) AS count FROM b GROUP BY bins, bin, lo, hi",
    "reference_lines": PANEL + "SELECT treated, round(avg(log_m), 6) AS level, grouping(treated)::INT AS whole FROM panel GROUP BY ROLLUP (treated)",
    "zscore": PANEL + "SELECT obs_id, round(log_m, 5) AS log_m, round((log_m - avg(log_m) OVER ()) / stddev_samp(log_m) OVER (), 5) AS normed FROM panel",
    "distinct_values": PREP + "SELECT DISTINCT sampling_method FROM obs",
    "count_where": PREP + "SELECT count(*) FILTER (measurement >= 1) AS capped, count(*) FILTER (measurement = 0) AS zero, count(*) FILTER (year BETWEEN 2011 AND 2019) AS in_years, count(*) FILTER (unit = 'pieces/m3') AS pieces FROM obs",
    "count_distinct": PREP + "SELECT count(DISTINCT regions) AS regions, count(*) AS n FROM obs",
    "filtered_readings": PREP + "SELECT obs_id, measurement AS value, oceans AS ocean, coalesce(year > 2010, false)::INT AS late FROM obs WHERE unit = 'pieces/m3' AND oceans IN ('Atlantic Ocean', 'Pacific Ocean') AND measurement > 0 AND measurement < 1",
    "scaled_values": PREP + "SELECT obs_id, round(ceil(measurement * 1000) / 1000, 6) AS up, round_even(measurement::DECIMAL(38, 18), 2)::DOUBLE AS even FROM obs WHERE measurement BETWEEN 0 AND 1",
    "latest_readings": PREP + "SELECT obs_id, year, month, day FROM obs WHERE year IS NOT NULL ORDER BY year DESC, month DESC, day DESC, obs_id LIMIT 10",
    "union_arms": PANEL + "SELECT obs_id, treated, round(log_m, 6) AS log_m FROM panel",
    "filled_cells": PREP + "SELECT coalesce(oceans, 'none') AS oceans, coalesce(density, 'none') AS density, round(coalesce(avg(measurement) FILTER (neuston_net = 1), 0), 6) AS net_mean FROM obs GROUP BY obs.oceans, obs.density",
}
