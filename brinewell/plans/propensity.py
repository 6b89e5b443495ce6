"""Propensity analyses: does a neuston net go with another measurement, given density and year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, cellfits, profile, regression
from ..runtime import bounded_rows
from .panel import PREP, prepared, rounded

CELLS = ["density", "target_region"]

EFFECTS = (
    PREP
    + """, base AS (SELECT obs_id, measurement AS y, neuston_net AS t, density, target_region, year FROM obs WHERE measurement >= 0 AND density IS NOT NULL AND year IS NOT NULL),
effects AS (SELECT *, avg(t) OVER (PARTITION BY density, target_region) AS ps FROM base)
"""
)


def effects(s, d):
    e = prepared(s, d).where("measurement >= 0 and density is not null and year is not null")
    return e.select("obs_id", F.col("measurement").alias("y"), F.col("neuston_net").alias("t"), "density", "target_region", "year")


def scored(s, d):
    return causal.cell_score(effects(s, d), "t", CELLS)


def ps_cell_mean(s, d):
    return rounded(scored(s, d).select("obs_id", "t", "ps"))


def ps_logit(s, d):
    """The fitted logistic model of the saturated design; its scores are the cell means."""
    e = effects(s, d)
    fit = regression.logit(e, "t ~ C(density)*C(target_region)")
    return rounded(e.select("obs_id", "t", regression.probability(fit).alias("ps")), 5)


def ps_coefficients(s, d):
    return rounded(regression.logit(effects(s, d), "t ~ C(density) + year").table(s), 4)


def regression_adjustment(s, d):
    return rounded(regression.ols(effects(s, d), "y ~ t + C(density) + target_region").table(s), 5)


def score_adjustment(s, d):
    return rounded(regression.ols(scored(s, d), "y ~ t + ps").table(s).select("term", "estimate"), 5)


def ipw_ate(s, d):
    return rounded(causal.ipw(scored(s, d), "y", "t", "ps"), 5)


def ipw_short_form(s, d):
    return rounded(causal.ipw_short(scored(s, d), "y", "t", "ps"))


def ipw_stabilised(s, d):
    return rounded(causal.ipw_stabilised(scored(s, d), "y", "t", "ps"), 5)


def row_weights(s, d):
    return rounded(scored(s, d).select("obs_id", causal.row_weight(F.col("t"), F.col("ps")).alias("weight")), 5)


def ps_buckets(s, d):
    return rounded(causal.score_buckets(scored(s, d), "y", "t", "ps"), 5)


def hist_weighted_prob(s, d):
    e = scored(s, d).withColumn("w", causal.row_weight(F.col("t"), F.col("ps")))
    return rounded(profile.weighted_histogram(e, "ps", "w", "t", 30))


def match_1nn_ate(s, d):
    return rounded(causal.matching_ate(causal.nearest_match(scored(s, d), "obs_id", "y", "t", "ps"), "y", "t"))


def dr_ate(s, d):
    """Saturated models: both outcome predictions are cell means of the arms."""
    e = scored(s, d)
    arm = e.groupBy("density", "target_region").agg(F.avg(F.when(F.col("t") == 1, F.col("y"))).alias("mu1"), F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("mu0"))
    both = e.join(arm, CELLS)
    return rounded(causal.doubly_robust(both, "y", "t", F.col("ps"), F.coalesce("mu1", F.lit(0.0)), F.coalesce("mu0", F.lit(0.0))))


def dr_ate_models(s, d):
    """Logistic score, one linear model per arm, predictions for all rows."""
    e = effects(s, d)
    levels = {"density": sorted(r[0] for r in bounded_rows(e.select("density").distinct(), regression.MAX_LEVELS, "levels of density"))}
    p = regression.logit(e, "t ~ C(density) + year", levels=levels)
    m1, m0 = (regression.ols(e.where(F.col("t") == a), "y ~ C(density) + year", levels=levels) for a in (1, 0))
    return rounded(causal.doubly_robust(e, "y", "t", regression.probability(p), m1.predict(), m0.predict()), 5)


COVARIATES = ["density", "year"]


def bootstrap_rows(s, d):
    """Interval of the inverse-weighted effect, the score fitted anew in each of 200 rounds."""
    fit = cellfits.ipw_ate("t ~ C(density) + year", COVARIATES, "t", "y")
    return causal.interval(causal.bootstrap_rows(effects(s, d), "obs_id", [*COVARIATES, "t"], "y", fit), "estimate")


def bootstrap_doubly_robust(s, d):
    fit = cellfits.doubly_robust_ate("t ~ C(density) + year", COVARIATES, "t", "y")
    return causal.interval(causal.bootstrap_rows(effects(s, d), "obs_id", [*COVARIATES, "t"], "y", fit), "estimate")


def bootstrap_blocks(s, d):
    """Interval of treated:post with unit and year effects, regions drawn as blocks, the regression fitted anew in each round."""
    from .panel import panel

    fit = cellfits.coefficient("log_m ~ treated:post + C(target_region) + C(year)", "treated:post", "log_m")
    rounds = causal.bootstrap_blocks(panel(s, d), "regions", ["target_region", "treated", "post", "year"], "log_m", fit)
    return causal.interval(rounds.where("identified and estimate is not null"), "estimate")


def year_score(s, d):
    """Positivity on the real table: a score of the year alone, its stabilised weights and effect."""
    e = effects(s, d)
    fit = regression.logit(e, "t ~ year")
    return rounded(causal.ipw_stabilised(e.withColumn("ps", regression.probability(fit)), "y", "t", "ps"), 5)


def synthetic_effect(s, d):
    """Inverse weighting on the synthetic sample, whose true effect is 1."""
    e = causal.synthetic_sample(s)
    fit = regression.logit(e, "t ~ x")
    return causal.ipw_stabilised(e.withColumn("ps", regression.probability(fit)), "y", "t", "ps")


QUERIES = {f.__name__: f for f in (
    ps_cell_mean, ps_logit, ps_coefficients, regression_adjustment, score_adjustment, ipw_ate, ipw_short_form, ipw_stabilised, row_weights, ps_buckets, hist_weighted_prob, match_1nn_ate, dr_ate, dr_ate_models, bootstrap_rows, bootstrap_doubly_robust, bootstrap_blocks, year_score, synthetic_effect,
)}

_W = "CASE WHEN t = 1 THEN 1 / ps ELSE 1 / (1 - ps) END"
ORACLES = {
    "ps_cell_mean": EFFECTS + "SELECT obs_id, t, round(ps, 6) AS ps FROM effects",
    "ps_logit": EFFECTS + "SELECT obs_id, t, round(ps, 5) AS ps FROM effects",
    "ipw_ate": EFFECTS + f", r AS (SELECT sum(CASE WHEN t = 1 THEN y / ps ELSE 0 END) / count(*) AS y1, sum(CASE WHEN t = 0 THEN y / (1 - ps) ELSE 0 END) / count(*) AS y0, sum({_W}) FILTER (t = 1) AS size1, sum({_W}) FILTER (t = 0) AS size0, count(*) AS n FROM effects) SELECT round(y1, 5) AS y1, round(y0, 5) AS y0, round(size1, 5) AS size1, round(size0, 5) AS size0, n, round(y1 - y0, 5) AS ate FROM r",
    "ipw_short_form": EFFECTS + "SELECT round(avg(CASE WHEN ps > 0 AND ps < 1 THEN y * (t - ps) / (ps * (1 - ps)) END), 6) AS ate FROM effects",
    "ipw_stabilised": EFFECTS + ", p AS (SELECT avg(t) AS p, sum(t) AS n1, sum(1 - t) AS n0 FROM effects), r AS (SELECT p, n1, n0, sum(1 / ps) FILTER (t = 1) AS w1, sum(1 / (1 - ps)) FILTER (t = 0) AS w0, sum(y / ps) FILTER (t = 1) AS s1, sum(y / (1 - ps)) FILTER (t = 0) AS s0 FROM effects, p GROUP BY ALL) SELECT round(p * w1, 5) AS size1, round((1 - p) * w0, 5) AS size0, round(p * s1 / n1, 5) AS y1, round((1 - p) * s0 / n0, 5) AS y0, round(p * s1 / n1 - (1 - p) * s0 / n0, 5) AS ate FROM r",
    "row_weights": EFFECTS + f"SELECT obs_id, round({_W}, 5) AS weight FROM effects",
    "ps_buckets": EFFECTS + f"SELECT round_even(ps, 2) AS ps_bucket, t, round(avg({_W}), 5) AS weight_mean, round(avg(y), 5) AS outcome_mean, count(*) AS n FROM effects GROUP BY ALL",
    "hist_weighted_prob": EFFECTS + f", e AS (SELECT min(ps) AS lo, max(ps) AS hi FROM effects), b AS (SELECT t, least(29, floor((ps - lo) / ((hi - lo) / 30)))::INT AS bin, {_W} AS w FROM effects, e) SELECT t, bin, round(sum(w) / sum(sum(w)) OVER (), 6) AS share FROM b GROUP BY t, bin",
    "match_1nn_ate": EFFECTS + """, r AS (SELECT *, round(ps, 12) AS p FROM effects), arm AS (SELECT p, t, arg_min(y, obs_id) AS y FROM r GROUP BY p, t),
lo AS (SELECT q.p, q.t, a.p AS ap, a.y FROM (SELECT DISTINCT p, t FROM r) q ASOF LEFT JOIN (SELECT p, 1 - t AS ot, y FROM arm) a ON q.t = a.ot AND q.p >= a.p),
hi AS (SELECT q.p, q.t, a.p AS ap, a.y FROM (SELECT DISTINCT p, t FROM r) q ASOF LEFT JOIN (SELECT p, 1 - t AS ot, y FROM arm) a ON q.t = a.ot AND q.p <= a.p),
m AS (SELECT lo.p, lo.t, CASE WHEN lo.ap IS NULL THEN hi.y WHEN hi.ap IS NULL THEN lo.y WHEN round(lo.p - lo.ap, 12) <= round(hi.ap - lo.p, 12) THEN lo.y ELSE hi.y END AS match FROM lo JOIN hi ON lo.p = hi.p AND lo.t = hi.t)
SELECT round(avg((y - match) * r.t + (match - y) * (1 - r.t)), 6) AS ate, count(match) AS n FROM r LEFT JOIN m ON r.p = m.p AND r.t = m.t""",
    "dr_ate": EFFECTS + """, mu AS (SELECT density, target_region, coalesce(avg(y) FILTER (t = 1), 0) AS mu1, coalesce(avg(y) FILTER (t = 0), 0) AS mu0 FROM effects GROUP BY ALL),
r AS (SELECT avg(CASE WHEN ps > 0 THEN t * (y - mu1) / ps + mu1 END) AS y1, avg(CASE WHEN ps < 1 THEN (1 - t) * (y - mu0) / (1 - ps) + mu0 END) AS y0 FROM effects JOIN mu USING (density, target_region))
SELECT round(y1, 6) AS y1, round(y0, 6) AS y0, round(y1 - y0, 6) AS ate FROM r""",
}
