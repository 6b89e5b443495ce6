"""Causal panel: readings as a treated/control, before/after panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cap, edges, indicator, parse_date, safe_ln
from ..operators import causal, profile, regression, reshape
from ..runtime import bounded_rows, cut_lineage
from ..sources.tables import table

TREATED_REGION = "Caribbean Sea"
LOW, HIGH = -7.5, 0.0
MAX_YEARS = 10_000

#: The same preparation for DuckDB.
PREP = """
WITH raw AS (
  SELECT obs_id, coalesce(try_strptime(obs_date, '%m/%d/%Y %I:%M:%S %p'), try_strptime(obs_date, '%Y-%m-%d'), try_strptime(obs_date, '%Y/%m/%d'),
         try_strptime(obs_date, '%Y%m%d'), try_strptime(obs_date, '%d.%m.%Y')) AS ts, measurement AS raw_m, unit, sampling_method, density_class, oceans, regions, longitude, latitude, x, y
  FROM observations WHERE measurement IS NOT NULL
), obs AS (
  SELECT obs_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, CASE WHEN raw_m > 1 THEN 1.0 ELSE raw_m END AS measurement,
         CASE WHEN raw_m <= 0 THEN CASE WHEN raw_m = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE ln(CASE WHEN raw_m > 1 THEN 1.0 ELSE raw_m END) END AS log_m,
         coalesce(sampling_method = 'Neuston net', false)::INT AS neuston_net, density_class AS density, coalesce(regions = 'Caribbean Sea', false)::INT AS target_region,
         unit, sampling_method, oceans, regions, longitude, latitude, x, y, raw_m
  FROM raw
)
"""
GRID = "[" + ", ".join(str(i / 200) for i in range(200)) + "]"
PANEL = (
    PREP
    + f""", grid AS (SELECT unnest({GRID}::DOUBLE[]) AS q, unnest(quantile_cont(log_m, {GRID})) AS v FROM obs WHERE NOT isnan(log_m)),
bounds AS (
  SELECT arg_min(v, q) FILTER (v > -7.5) AS low_value, min(q) FILTER (v > -7.5) AS low_q, arg_max(v, q) FILTER (v < 0.0) AS high_value, max(q) FILTER (v < 0.0) AS high_q FROM grid
), trimmed AS (
  SELECT obs.* FROM obs, bounds WHERE NOT isnan(log_m) AND log_m > ceil(low_value * 100) / 100 AND log_m < ceil(high_value * 100) / 100 AND year IS NOT NULL
), pivot_year AS (
  SELECT min(year) AS first_year, max(year) AS last_year, trunc(min(year) + (max(year) - min(year)) / 2)::INT AS intervention_year FROM trimmed WHERE target_region = 1
), panel AS (
  SELECT t.*, target_region AS treated, (year > intervention_year)::INT AS post FROM trimmed t, pivot_year
)
"""
)


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "observations").where("measurement is not null").withColumn("_ts", parse_date(F.col("obs_date")))
    return o.select(
        "obs_id", F.year("_ts").alias("year"), F.month("_ts").alias("month"), F.dayofmonth("_ts").alias("day"), cap(F.col("measurement"), 1.0).alias("measurement"), safe_ln(cap(F.col("measurement"), 1.0)).alias("log_m"),
        indicator(F.col("sampling_method") == "Neuston net").alias("neuston_net"), F.col("density_class").alias("density"), indicator(F.col("regions") == TREATED_REGION).alias("target_region"),
        "unit", "sampling_method", "oceans", "regions", "longitude", "latitude", "x", "y", F.col("measurement").alias("raw_m"),
    )


def trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return profile.trim_outcome(prepared(spark, folder), "log_m", LOW, HIGH).where("year is not null")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return causal.assign_periods(trimmed(spark, folder), F.col("target_region") == 1)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def did_cell_means(s, d):
    return rounded(causal.cell_means(panel(s, d), "log_m"))


def did_att_2x2(s, d):
    return rounded(causal.att_2x2(panel(s, d), "log_m"))


def did_outcome_growth(s, d):
    return rounded(causal.outcome_growth(panel(s, d), "regions", "log_m")[0])


def did_growth_effect(s, d):
    return rounded(causal.outcome_growth(panel(s, d), "regions", "log_m")[1])


def did_dataset_blocks(s, d):
    tagged = reshape.tag_blocks(panel(s, d), F.col("treated") == 1, F.col("post") == 1)
    return rounded(tagged.select("obs_id", "dataset", F.col("log_m").alias("value")))


def did_lines(s, d):
    return rounded(causal.counterfactual_lines(panel(s, d), "log_m"))


def cell_melt(s, d):
    return rounded(reshape.wide_to_long(causal.att_2x2(panel(s, d), "log_m"), [], ["y00", "y01", "y10", "y11"]))


def intervention_year(s, d):
    return causal.intervention_year(trimmed(s, d), F.col("target_region") == 1)


def treated_year_range(s, d):
    p = panel(s, d).withColumn("w", F.col("treated") * F.col("post"))
    return p.groupBy("w").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def quantile_bounds(s, d):
    return rounded(profile.quantile_scan(prepared(s, d), "log_m", LOW, HIGH))


def trimmed_outcome(s, d):
    return rounded(trimmed(s, d).select("obs_id", "log_m"))


def year_trend(s, d):
    """Mean and spread by year and arm, with the normal 95 % band of the mean."""
    t = panel(s, d).groupBy("year", "treated").agg(F.avg("log_m").alias("outcome_mean"), F.stddev_samp("log_m").alias("outcome_std"), F.count(F.lit(1)).alias("n"))
    half = 1.959964 * F.col("outcome_std") / F.sqrt("n")
    return rounded(t.withColumns({"low": F.col("outcome_mean") - half, "high": F.col("outcome_mean") + half}))


def date_parts(s, d):
    return prepared(s, d).select("obs_id", "year", "month", "day")


def unit_year_panel(s, d):
    p = panel(s, d).na.drop(subset=["regions"]).withColumn("w", F.col("treated") * F.col("post"))
    per = p.groupBy("regions", "year").agg(F.max("w").alias("w"), F.avg("log_m").alias("outcome"))
    return rounded(reshape.spread_max(per, "regions", "w", "ever_treated"))


def panel_join_mean(s, d):
    p = panel(s, d).select("obs_id", "regions", "year", "log_m").na.drop(subset=["regions"])
    return rounded(reshape.attach_mean(p, ["regions", "year"], "log_m"))


def unit_year_once(s, d):
    p = panel(s, d).select("treated", "year", "post")
    return reshape.once_per(p, ["treated", "year", "post"])


def treatment_matrix(s, d):
    """Units by the years that occur, gaps as 0, in order of the latest year; read back cell by cell."""
    p = panel(s, d).withColumn("w", F.col("treated") * F.col("post")).groupBy("treated", "year").agg(F.max("w").alias("w"))
    p = cut_lineage(p)
    years = sorted(r[0] for r in bounded_rows(p.select("year").distinct(), MAX_YEARS, "years"))
    m = reshape.treatment_matrix(p.withColumnRenamed("treated", "unit"), "unit", "year", "w", years).withColumnsRenamed({str(y): f"y{y}" for y in years})
    placed = reshape.ordinal(m, [F.col(f"y{years[-1]}").desc(), F.col("unit")], "position") if years else m.withColumn("position", F.lit(0))
    cells = reshape.wide_to_long(placed.select("unit", "position", *[F.col(f"y{y}").cast("double").alias(f"y{y}") for y in years]), ["unit", "position"], [f"y{y}" for y in years], "year", "w") if years else placed.select("unit", "position", F.lit(None).cast("string").alias("year"), F.lit(None).cast("double").alias("w"))
    return cells.select("unit", "position", F.substring("year", 2, 10).cast("int").alias("year"), "w")


def year_labels(s, d):
    """Years as labels beside the cell's bounds of the aggregated table."""
    c = causal.cell_means(panel(s, d), "log_m")
    return rounded(c.agg(F.min("outcome_mean").alias("low"), F.max("outcome_mean").alias("high"), F.concat_ws(",", F.sort_array(F.collect_set(F.col("first_year").cast("string")))).alias("years")))


def treated_after(s, d):
    """Treated rows after the intervention; an error if there is none."""
    p = cut_lineage(panel(s, d).select("treated", "post", "regions"))
    return causal.require_treated_after(p).where("treated = 1 and post = 1").groupBy("regions").agg(F.count(F.lit(1)).alias("n"))


def post_change(s, d):
    return rounded(reshape.step_change(causal.cell_means(panel(s, d), "log_m").select("treated", "post", "outcome_mean"), "treated", "post", "outcome_mean"))


def pre_post_units(s, d):
    p = panel(s, d).na.drop(subset=["regions"])
    pre, post = p.where("post = 0").select("regions").distinct(), p.where("post = 1").select("regions").distinct()
    return pre.intersect(post)


def bin_xy(s, d):
    """20 bins per axis over the whole span of the projected metres."""
    from ..functions.scalars import bin_index

    o = prepared(s, d).where("x is not null and y is not null").select("obs_id", "x", "y")
    ends = o.agg(*[f(c).cast("int").alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    b = o.join(F.broadcast(ends))
    for c in ("x", "y"):
        step = ((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / 20).cast("int")
        b = b.withColumn(f"{c}_bin", bin_index(F.col(c), F.col(f"{c}_lo").cast("double"), F.col(f"{c}_lo") + 21.0 * step, step.cast("double")))
    return b.select("obs_id", "x_bin", "y_bin", F.concat_ws("_", F.col("x_bin").cast("string"), F.col("y_bin").cast("string")).alias("bin_region"))


def bin_edges(s, d):
    """Edges of the bins of both axes: 20 whole-number steps over the span, and one past its end."""
    o = prepared(s, d).where("x is not null and y is not null")
    ends = o.agg(*[f(c).cast("int").alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    rows = s.range(1)
    out = None
    for c in ("x", "y"):
        low, high = ends[f"{c}_lo"], ends[f"{c}_hi"]
        one = rows.select(F.lit(c).alias("axis"), F.posexplode(edges(low, high, int((high - low) / 20))).alias("edge_no", "edge"))
        out = one if out is None else out.unionByName(one)
    return out


def bounding_area(s, d):
    o = prepared(s, d).where("latitude between -90 and 90 and longitude between -180 and 360")
    return rounded(o.agg(((F.max("longitude") - F.min("longitude")) * (F.max("latitude") - F.min("latitude"))).alias("area")))


# -- regression -----------------------------------------------------------------------------------


def ols_univariate(s, d):
    fit = regression.ols(panel(s, d), "log_m ~ year")
    return rounded(fit.table(s).select("term", "estimate"), 5)


def ols_interaction(s, d):
    fit = regression.ols(panel(s, d), "log_m ~ treated*post")
    return rounded(fit.table(s).select("term", "estimate"), 5)


def ols_saturated_cells(s, d):
    """The four cell means fitted exactly: no residual degree of freedom, so no standard error."""
    cells = causal.cell_means(panel(s, d), "log_m")
    return rounded(regression.ols(cells, "outcome_mean ~ treated*post").table(s).select("term", "estimate", "std_error"), 5)


def ols_fixed_effects(s, d):
    fit = regression.ols(panel(s, d), "log_m ~ treated:post + C(target_region) + C(year)")
    return rounded(fit.table(s), 5)


def ols_cluster_se(s, d):
    fit = regression.ols(panel(s, d).na.drop(subset=["regions"]), "log_m ~ treated*post", cluster="regions")
    return rounded(fit.table(s), 5)


QUERIES = {f.__name__: f for f in (
    did_cell_means, did_att_2x2, did_outcome_growth, did_growth_effect, did_dataset_blocks, did_lines, cell_melt, intervention_year, treated_year_range, quantile_bounds, trimmed_outcome, year_trend, date_parts,
    unit_year_panel, panel_join_mean, unit_year_once, treatment_matrix, year_labels, treated_after, post_change, pre_post_units, bin_xy, bin_edges, bounding_area, ols_univariate, ols_interaction, ols_saturated_cells, ols_fixed_effects, ols_cluster_se,
)}

_CELLS = "SELECT treated, post, avg(log_m) AS m FROM panel GROUP BY ALL"
_WIDE = "SELECT avg(log_m) FILTER (treated = 0 AND post = 0) AS y00, avg(log_m) FILTER (treated = 0 AND post = 1) AS y01, avg(log_m) FILTER (treated = 1 AND post = 0) AS y10, avg(log_m) FILTER (treated = 1 AND post = 1) AS y11 FROM panel"
_GROWTH = """per AS (
  SELECT regions, avg(log_m) FILTER (post = 0) AS before, avg(log_m) FILTER (post = 1) AS after, max(treated) AS treated FROM panel WHERE regions IS NOT NULL GROUP BY regions
), paired AS (SELECT *, after - before AS growth FROM per WHERE before IS NOT NULL AND after IS NOT NULL)
"""

ORACLES = {
    "did_cell_means": PANEL + "SELECT treated, post, round(avg(log_m), 6) AS outcome_mean, min(year) AS first_year, count(*) AS n FROM panel GROUP BY treated, post",
    "did_att_2x2": PANEL + f", w AS ({_WIDE}) SELECT round(y00, 6) AS y00, round(y01, 6) AS y01, round(y10, 6) AS y10, round(y11, 6) AS y11, round(y10 + (y01 - y00), 6) AS counterfactual, round(y11 - (y10 + (y01 - y00)), 6) AS att, round(y00 + (y11 - y10), 6) AS mirrored_counterfactual, round(y00 - (y00 + (y11 - y10)), 6) AS mirrored_att FROM w",
    "did_outcome_growth": PANEL + f", {_GROWTH} SELECT regions, round(before, 6) AS before, round(after, 6) AS after, treated, round(growth, 6) AS growth FROM paired",
    "did_growth_effect": PANEL + f", {_GROWTH}, a AS (SELECT avg(growth) FILTER (treated = 1) AS t, avg(growth) FILTER (treated = 0) AS c FROM paired) SELECT round(t, 6) AS treated_growth, round(c, 6) AS control_growth, round(t - c, 6) AS att, round(c - t, 6) AS reversed FROM a",
    "did_dataset_blocks": PANEL + "SELECT obs_id, CASE WHEN treated = 1 THEN 'treated' ELSE 'control' END || '_' || CASE WHEN post = 1 THEN 'post' ELSE 'pre' END AS dataset, round(log_m, 6) AS value FROM panel",
    "did_lines": PANEL + f", w AS ({_WIDE}) SELECT line, post, round(value, 6) AS value FROM (SELECT 'control' AS line, 0 AS post, y00 AS value FROM w UNION ALL SELECT 'control', 1, y01 FROM w UNION ALL SELECT 'treated', 0, y10 FROM w UNION ALL SELECT 'treated', 1, y11 FROM w UNION ALL SELECT 'counterfactual', 0, y10 FROM w UNION ALL SELECT 'counterfactual', 1, y10 + (y01 - y00) FROM w)",
    "cell_melt": PANEL + f", w AS ({_WIDE}) SELECT 'y' || treated || post AS dataset, round(m, 6) AS value FROM ({_CELLS})",
    "intervention_year": PANEL + "SELECT first_year, last_year, intervention_year FROM pivot_year",
    "treated_year_range": PANEL + "SELECT treated * post AS w, min(year) AS first_year, max(year) AS last_year FROM panel GROUP BY 1",
    "quantile_bounds": PANEL + "SELECT round(low_value, 6) AS low_value, low_q, round(high_value, 6) AS high_value, high_q FROM bounds",
    "trimmed_outcome": PANEL + "SELECT obs_id, round(log_m, 6) AS log_m FROM trimmed",
    "year_trend": PANEL + "SELECT year, treated, round(avg(log_m), 6) AS outcome_mean, round(stddev_samp(log_m), 6) AS outcome_std, count(*) AS n, round(avg(log_m) - 1.959964 * stddev_samp(log_m) / sqrt(count(*)), 6) AS low, round(avg(log_m) + 1.959964 * stddev_samp(log_m) / sqrt(count(*)), 6) AS high FROM panel GROUP BY year, treated",
    "date_parts": PREP + "SELECT obs_id, year, month, day FROM obs",
    "unit_year_panel": PANEL + ", per AS (SELECT regions, year, max(treated * post) AS w, avg(log_m) AS outcome FROM panel WHERE regions IS NOT NULL GROUP BY ALL) SELECT regions, year, w, round(outcome, 6) AS outcome, max(w) OVER (PARTITION BY regions) AS ever_treated FROM per",
    "panel_join_mean": PANEL + "SELECT obs_id, regions, year, round(log_m, 6) AS log_m, round(avg(log_m) OVER (PARTITION BY regions, year), 6) AS log_m_mean FROM panel WHERE regions IS NOT NULL",
    "unit_year_once": PANEL + "SELECT DISTINCT treated, year, post FROM panel",
    "treatment_matrix": PANEL + """, c AS (SELECT treated AS unit, year, max(treated * post) AS w FROM panel GROUP BY ALL), y AS (SELECT DISTINCT year FROM c), u AS (SELECT DISTINCT unit FROM c),
m AS (SELECT unit, year, coalesce(w, 0)::DOUBLE AS w FROM u CROSS JOIN y LEFT JOIN c USING (unit, year)), p AS (SELECT unit, (row_number() OVER (ORDER BY w DESC, unit) - 1)::INT AS position FROM m WHERE year = (SELECT max(year) FROM y))
SELECT unit, position, year, w FROM m JOIN p USING (unit)""",
    "year_labels": PANEL + ", c AS (SELECT avg(log_m) AS m, min(year) AS y FROM panel GROUP BY treated, post) SELECT round(min(m), 6) AS low, round(max(m), 6) AS high, array_to_string(list_sort(list_distinct(list(y::VARCHAR))), ',') AS years FROM c",
    "treated_after": PANEL + "SELECT regions, count(*) AS n FROM panel WHERE treated = 1 AND post = 1 GROUP BY regions",
    "post_change": PANEL + f", c AS ({_CELLS}) SELECT treated, post, round(m, 6) AS outcome_mean, round(m - lag(m) OVER (PARTITION BY treated ORDER BY post), 6) AS change FROM c",
    "pre_post_units": PANEL + "SELECT regions FROM panel WHERE regions IS NOT NULL GROUP BY regions HAVING count(*) FILTER (post = 0) > 0 AND count(*) FILTER (post = 1) > 0",
    "bin_xy": PREP + """, o AS (SELECT obs_id, x, y FROM obs WHERE x IS NOT NULL AND y IS NOT NULL), e AS (SELECT trunc(min(x)) AS xl, trunc(max(x)) AS xh, trunc(min(y)) AS yl, trunc(max(y)) AS yh FROM o),
f AS (SELECT obs_id, x, y, xl, yl, trunc((xh - xl) / 20) AS xs, trunc((yh - yl) / 20) AS ys FROM o, e),
g AS (SELECT obs_id, CASE WHEN x = xl THEN 0 WHEN x > xl AND x <= xl + 21 * xs THEN ceil((x - xl) / xs) - 1 END::INT AS x_bin, CASE WHEN y = yl THEN 0 WHEN y > yl AND y <= yl + 21 * ys THEN ceil((y - yl) / ys) - 1 END::INT AS y_bin FROM f)
SELECT obs_id, x_bin, y_bin, concat_ws('_', x_bin, y_bin) AS bin_region FROM g""",
    "bin_edges": PREP + ", o AS (SELECT x, y FROM obs WHERE x IS NOT NULL AND y IS NOT NULL), e AS (SELECT 'x' AS axis, trunc(min(x))::INT AS lo, trunc(max(x))::INT AS hi FROM o UNION ALL SELECT 'y', trunc(min(y))::INT, trunc(max(y))::INT FROM o), s AS (SELECT axis, lo, hi, trunc((hi - lo) / 20)::INT AS step FROM e), g AS (SELECT axis, lo, step, unnest(generate_series(0, (hi + step - lo) // step)) AS k FROM s) SELECT axis, k::INT AS edge_no, (lo + k * step)::INT AS edge FROM g",
    "bounding_area": PREP + "SELECT round((max(longitude) - min(longitude)) * (max(latitude) - min(latitude)), 6) AS area FROM obs WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360",
    "ols_univariate": PANEL + "SELECT 'Intercept' AS term, round(regr_intercept(log_m, year), 5) AS estimate FROM panel UNION ALL SELECT 'year', round(regr_slope(log_m, year), 5) FROM panel",
    "ols_interaction": PANEL + f", w AS ({_WIDE}) SELECT term, round(v, 5) AS estimate FROM (SELECT 'Intercept' AS term, y00 AS v FROM w UNION ALL SELECT 'treated', y10 - y00 FROM w UNION ALL SELECT 'post', y01 - y00 FROM w UNION ALL SELECT 'treated:post', y11 - y10 - y01 + y00 FROM w)",
    "ols_saturated_cells": PANEL + f", w AS ({_WIDE}) SELECT term, round(v, 5) AS estimate, NULL::DOUBLE AS std_error FROM (SELECT 'Intercept' AS term, y00 AS v FROM w UNION ALL SELECT 'treated', y10 - y00 FROM w UNION ALL SELECT 'post', y01 - y00 FROM w UNION ALL SELECT 'treated:post', y11 - y10 - y01 + y00 FROM w)",
}
