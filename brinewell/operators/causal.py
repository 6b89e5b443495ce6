"""Difference-in-differences, propensity weighting, matching and resampling.

Everything that a report needs is one aggregation over the rows; only cell
tables, coefficients and bounds reach the driver.  Rows whose outcome is null,
NaN or infinite are left out by :func:`finite`.  Divisions by a score of 0 or 1
give null instead of an error; ``clip`` keeps scores away from both.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import indicator, midpoint_year
from ..runtime import bounded_rows, cut_lineage, spill_table


def finite(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


# -- difference in differences --------------------------------------------------------------------


def intervention_year(df: DataFrame, treated: Column, year: str = "year") -> DataFrame:
    """One row (first_year, last_year, intervention_year) over the treated rows."""
    lo, hi = F.min(year), F.max(year)
    return df.where(treated).agg(lo.alias("first_year"), hi.alias("last_year")).withColumn("intervention_year", midpoint_year(F.col("first_year"), F.col("last_year")))


def assign_periods(df: DataFrame, treated: Column, year: str = "year", at: int | None = None) -> DataFrame:
    """Adds treated and post (0/1); ``at`` defaults to the midpoint year of the treated rows."""
    if at is not None:
        marked = df.withColumn("_at", F.lit(at))
    else:
        marked = df.join(F.broadcast(intervention_year(df, treated, year).select(F.col("intervention_year").alias("_at"))))
    return marked.withColumn("treated", indicator(treated)).withColumn("post", indicator(F.col(year) > F.col("_at"))).drop("_at")


def require_treated_after(df: DataFrame) -> DataFrame:
    """The frame itself, or a clear error if no treated row lies after the intervention."""
    if df.where("treated = 1 and post = 1").limit(1).isEmpty():
        raise ValueError("no treated row after the intervention")
    return df


def cell_means(df: DataFrame, outcome: str, year: str = "year") -> DataFrame:
    """The four cells: mean outcome, first year, rows."""
    return df.groupBy("treated", "post").agg(F.avg(outcome).alias("outcome_mean"), F.min(year).alias("first_year"), F.count(F.lit(1)).alias("n"))


def att_2x2(df: DataFrame, outcome: str) -> DataFrame:
    """One row: cell means, the counterfactual of the treated, the effect, and the mirrored check
    (the control arm before, less what the treated arm's growth would have made of it)."""
    m = lambda t, p: F.avg(F.when((F.col("treated") == t) & (F.col("post") == p), F.col(outcome)))
    cells = df.agg(m(0, 0).alias("y00"), m(0, 1).alias("y01"), m(1, 0).alias("y10"), m(1, 1).alias("y11"))
    y0 = F.col("y10") + (F.col("y01") - F.col("y00"))
    y1 = F.col("y00") + (F.col("y11") - F.col("y10"))
    return cells.withColumns({"counterfactual": y0, "att": F.col("y11") - y0, "mirrored_counterfactual": y1, "mirrored_att": F.col("y00") - y1})


def outcome_growth(df: DataFrame, unit: str, outcome: str) -> tuple[DataFrame, DataFrame]:
    """Per-unit growth of units seen before and after, and the difference of the arms' mean growth."""
    per = (
        df.na.drop(subset=[unit])
        .groupBy(unit)
        .agg(F.avg(F.when(F.col("post") == 0, F.col(outcome))).alias("before"), F.avg(F.when(F.col("post") == 1, F.col(outcome))).alias("after"), F.max("treated").alias("treated"))
        .where("before is not null and after is not null")
        .withColumn("growth", F.col("after") - F.col("before"))
    )
    arms = per.agg(F.avg(F.when(F.col("treated") == 1, F.col("growth"))).alias("treated_growth"), F.avg(F.when(F.col("treated") == 0, F.col("growth"))).alias("control_growth"))
    return per, arms.withColumns({"att": F.col("treated_growth") - F.col("control_growth"), "reversed": F.col("control_growth") - F.col("treated_growth")})


def counterfactual_lines(df: DataFrame, outcome: str) -> DataFrame:
    """(line, post, value) of observed arms and the treated arm's counterfactual, as rows to draw."""
    one = att_2x2(df, outcome)
    rows = [("control", 0, "y00"), ("control", 1, "y01"), ("treated", 0, "y10"), ("treated", 1, "y11"), ("counterfactual", 0, "y10"), ("counterfactual", 1, "counterfactual")]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.lit(p).alias("post"), F.col(c).alias("value")) for n, p, c in rows])).alias("r")).select("r.*")


# -- propensity -----------------------------------------------------------------------------------


def cell_score(df: DataFrame, treatment: str, cells: list[str], out: str = "ps") -> DataFrame:
    """The fitted score of a saturated model: the share treated in each covariate cell."""
    share = df.groupBy(*cells).agg(F.avg(treatment).alias(out))
    on = None
    renamed = share.select(*[F.col(c).alias(f"_{c}") for c in cells], out)
    for c in cells:
        term = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = term if on is None else on & term
    return df.join(renamed, on).drop(*[f"_{c}" for c in cells])


def clipped(ps: Column, clip: float | None) -> Column:
    return ps if clip is None else F.greatest(F.lit(clip), F.least(F.lit(1 - clip), ps))


def row_weight(t: Column, ps: Column) -> Column:
    return F.when(t == 1, F.try_divide(F.lit(1.0), ps)).otherwise(F.try_divide(F.lit(1.0), 1 - ps))


def ipw(df: DataFrame, outcome: str, t: str, ps: str, clip: float | None = None) -> DataFrame:
    """One row: E[Y1], E[Y0] and the average effect, with the sizes of the pseudo-populations."""
    p, y, d = clipped(F.col(ps), clip), F.col(outcome), F.col(t)
    n = F.count(F.lit(1))
    y1 = F.sum(F.when(d == 1, F.try_divide(y, p)).otherwise(F.lit(0.0))) / n
    y0 = F.sum(F.when(d == 0, F.try_divide(y, 1 - p)).otherwise(F.lit(0.0))) / n
    w = row_weight(d, p)
    return df.agg(y1.alias("y1"), y0.alias("y0"), F.sum(F.when(d == 1, w)).alias("size1"), F.sum(F.when(d == 0, w)).alias("size0"), n.alias("n")).withColumn("ate", F.col("y1") - F.col("y0"))


def ipw_short(df: DataFrame, outcome: str, t: str, ps: str, clip: float | None = None) -> DataFrame:
    p = clipped(F.col(ps), clip)
    return df.agg(F.avg(F.try_divide(F.col(outcome) * (F.col(t) - p), p * (1 - p))).alias("ate"))


def ipw_stabilised(df: DataFrame, outcome: str, t: str, ps: str, clip: float | None = None) -> DataFrame:
    """Weights p/ps and (1-p)/(1-ps); the arms' sums are divided by the arms' sizes. One pass:
    the share treated is a factor of sums."""
    q, y, d = clipped(F.col(ps), clip), F.col(outcome), F.col(t)
    sums = df.agg(
        F.avg(d).alias("p"), F.sum(d).alias("n1"), F.sum(1 - d).alias("n0"), F.sum(F.when(d == 1, F.try_divide(F.lit(1.0), q))).alias("w1"), F.sum(F.when(d == 0, F.try_divide(F.lit(1.0), 1 - q))).alias("w0"),
        F.sum(F.when(d == 1, F.try_divide(y, q))).alias("s1"), F.sum(F.when(d == 0, F.try_divide(y, 1 - q))).alias("s0"),
    )
    p = F.col("p")
    out = sums.select((p * F.col("w1")).alias("size1"), ((1 - p) * F.col("w0")).alias("size0"), F.try_divide(p * F.col("s1"), F.col("n1")).alias("y1"), F.try_divide((1 - p) * F.col("s0"), F.col("n0")).alias("y0"))
    return out.withColumn("ate", F.col("y1") - F.col("y0"))


def score_buckets(df: DataFrame, outcome: str, t: str, ps: str) -> DataFrame:
    """Mean weight and outcome by score (two places, half to even) and arm."""
    return df.withColumn("_w", row_weight(F.col(t), F.col(ps))).groupBy(F.bround(ps, 2).alias("ps_bucket"), t).agg(F.avg("_w").alias("weight_mean"), F.avg(outcome).alias("outcome_mean"), F.count(F.lit(1)).alias("n"))


def nearest_match(df: DataFrame, row_id: str, outcome: str, t: str, ps: str, places: int = 12) -> DataFrame:
    """Every row with the outcome of the nearest score in the other arm.

    Ties: of equal scores the lowest id; of equal distances the lower score. Each
    arm is reduced to one row per distinct score first (map-side), and neighbours
    are found in range partitions: each looks within itself, and takes the last and
    first scores of the partitions around it from a small table of ends.
    """
    key = F.round(F.col(ps), places)
    rows = df.withColumn("_p", key)
    arm = rows.where(F.col("_p").isNotNull() & F.col(t).isNotNull()).groupBy("_p", F.col(t).alias("_t")).agg(F.min_by(outcome, row_id).alias("_y"))
    cells = arm.groupBy("_p").agg(F.max(F.when(F.col("_t") == 1, F.struct("_p", "_y"))).alias("m1"), F.max(F.when(F.col("_t") == 0, F.struct("_p", "_y"))).alias("m0"))
    # written once: both uses below must see the same partitions
    part = spill_table(cells.repartitionByRange("_p").withColumn("_part", F.spark_partition_id()), "scores")
    up = Window.partitionBy("_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_part").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    near = part
    for m in ("m1", "m0"):
        near = near.withColumn(f"{m}_lo", F.last(m, ignorenulls=True).over(up)).withColumn(f"{m}_hi", F.first(m, ignorenulls=True).over(down))
    ends = part.groupBy("_part").agg(*[f(m).alias(f"{m}_{n}") for m in ("m1", "m0") for f, n in ((F.max, "last"), (F.min, "first"))])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    # one row per range partition
    around = ends.select(F.col("_part").alias("_ep"), *[F.max(f"{m}_last").over(before).alias(f"{m}_below") for m in ("m1", "m0")], *[F.min(f"{m}_first").over(after).alias(f"{m}_above") for m in ("m1", "m0")])
    full = near.join(F.broadcast(around), F.col("_part") == F.col("_ep"))

    def pick(m: str) -> Column:
        lo, hi = F.coalesce(f"{m}_lo", f"{m}_below"), F.coalesce(f"{m}_hi", f"{m}_above")
        below, above = F.round(F.col("_p") - lo["_p"], places), F.round(hi["_p"] - F.col("_p"), places)
        return F.when(lo.isNull(), hi["_y"]).when(hi.isNull(), lo["_y"]).when(below <= above, lo["_y"]).otherwise(hi["_y"])

    table = full.select(F.col("_p").alias("_q"), pick("m1").alias("_treated"), pick("m0").alias("_control"))
    return rows.join(table, F.col("_p") == F.col("_q"), "left").withColumn("match", F.when(F.col(t) == 1, F.col("_control")).otherwise(F.col("_treated"))).drop("_p", "_q", "_treated", "_control")


def matching_ate(matched: DataFrame, outcome: str, t: str) -> DataFrame:
    d, y, m = F.col(t), F.col(outcome), F.col("match")
    return matched.agg(F.avg((y - m) * d + (m - y) * (1 - d)).alias("ate"), F.count("match").alias("n"))


def doubly_robust(df: DataFrame, outcome: str, t: str, ps: Column, mu1: Column, mu0: Column) -> DataFrame:
    """AIPW: model predictions for both arms, corrected by weighted residuals."""
    d, y = F.col(t), F.col(outcome)
    one = F.avg(F.try_divide(d * (y - mu1), ps) + mu1)
    zero = F.avg(F.try_divide((1 - d) * (y - mu0), 1 - ps) + mu0)
    return df.agg(one.alias("y1"), zero.alias("y0")).withColumn("ate", F.col("y1") - F.col("y0"))


# -- resampling -----------------------------------------------------------------------------------


def poisson_draws(ids: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Poisson(1) counts, rows by rounds, that depend on the id, the round and the seed only: repeatable however rows are partitioned."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = x[:, None] ^ (np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))[None, :]
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    total, chance, steps = 0.0, math.exp(-1), []
    for k in range(14):
        total += chance
        steps.append(min(total, 1.0) * 2**53)
        chance /= k + 1
    return np.searchsorted(np.array(steps), (h >> np.uint64(11)).astype(np.float64), "right")


def resampled_cells(df: DataFrame, row_id: str, cells: list[str], sums: list[str], *, rounds: int = 200, seed: int = 123) -> DataFrame:
    """(round, cells..., n, sums...) of row bootstraps: in every round the drawn rows of each cell and the sums over them.

    Rows are read once; a batch multiplies its rows' draws by their values for all
    rounds together, so what is shuffled is cells times rounds and not rows times
    rounds.  With a key among ``cells`` every row stays on its own.
    """
    kinds = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for c in cells:
                d = batch.column(c).dictionary_encode()
                part = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                code = np.unique(code * (len(d.dictionary) + 1) + part, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
            w = poisson_draws(batch.column(row_id).to_numpy()[order], rounds, seed).astype(np.float64)
            out = [np.add.reduceat(w, start)] + [np.add.reduceat(w * batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[order, None], start) for c in sums]
            g, r = np.nonzero(out[0])
            at = pa.array(order[start][g])
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), *(batch.column(c).take(at) for c in cells), *(pa.array(o[g, r]) for o in out)], names=["round", *cells, "n", *sums])

    ddl = ", ".join(["round int", *(f"`{c}` {kinds[c]}" for c in cells), "n double", *(f"`{c}` double" for c in sums)])
    picked = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias(row_id), *cells, *[F.col(c).cast("double").alias(c) for c in sums])
    return picked.mapInArrow(run, ddl).groupBy("round", *cells).agg(*[F.sum(c).alias(c) for c in ("n", *sums)])


def estimate_rounds(cells: DataFrame, est_fn: Callable) -> DataFrame:
    """(round, estimate): ``est_fn`` takes the pandas frame of one round's cells and gives a number; null where it is not identified (NaN)."""

    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame({"round": [key[0]], "estimate": [float(est_fn(pdf))]})

    # a group is one round's cells: the design, not the rows
    return cells.groupBy("round").applyInPandas(run, "round int, estimate double")


def bootstrap_rows(df: DataFrame, row_id: str, cells: list[str], outcome: str, est_fn: Callable, *, rounds: int = 200, seed: int = 123) -> DataFrame:
    """(round, estimate) of row bootstraps of any estimator of cells (with columns n and ``outcome``, its sum): it is fitted anew in each round."""
    return estimate_rounds(resampled_cells(df, row_id, cells, [outcome], rounds=rounds, seed=seed), est_fn)


def block_draws(units: list, rounds: int, seed: int) -> list[tuple]:
    """(round, unit, times): as many units as there are, with replacement, in every round."""
    r, out = np.random.default_rng(seed), []
    for k in range(rounds):
        times = np.bincount(r.integers(0, len(units), len(units)), minlength=len(units)) if units else []
        out += [(k, u, int(n)) for u, n in zip(units, times) if n]
    return out


def bootstrap_blocks(df: DataFrame, unit: str, cells: list[str], outcome: str, est_fn: Callable, *, rounds: int = 200, seed: int = 123, min_units: int = 2, max_units: int = 100_000) -> DataFrame:
    """(round, n_units, identified, estimate) of block bootstraps: units are drawn, all rows of each draw count.

    Rows are summed per unit and cell once; a round weights those sums. Rounds of
    fewer than ``min_units`` different units are marked as not identified.
    """
    own = cut_lineage(df.na.drop(subset=[unit]).groupBy(unit, *cells).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(outcome).alias(outcome)))
    names = sorted(r[0] for r in bounded_rows(own.select(unit).distinct(), max_units, f"units of {unit}"))
    draws = df.sparkSession.createDataFrame(block_draws(names, rounds, seed), f"round int, `{unit}` {dict(df.dtypes)[unit]}, _w int")
    both = own.join(draws, unit).groupBy("round", *cells).agg(F.sum(F.col("n") * F.col("_w")).alias("n"), F.sum(F.col(outcome) * F.col("_w")).alias(outcome))
    sizes = draws.groupBy("round").agg(F.count(F.lit(1)).cast("int").alias("n_units"))
    return estimate_rounds(both, est_fn).join(sizes, "round").select("round", "n_units", (F.col("n_units") >= min_units).alias("identified"), "estimate")


def interval(replicates: DataFrame, stat: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    p = F.percentile(stat, F.array(F.lit(low), F.lit(high)))
    return replicates.agg(p.alias("_p"), F.count(stat).alias("rounds")).select(F.element_at("_p", 1).alias("low"), F.element_at("_p", 2).alias("high"), "rounds")


def synthetic_sample(spark, n: int = 1000, seed: int = 1) -> DataFrame:
    """x ~ N(0,1), t = N(x, .5) > 0, y = N((1-t)(-x) + t(1-x), .2): true effect 1."""
    base = spark.range(n).select("id", F.randn(seed).alias("x"), F.randn(seed + 1).alias("_a"), F.randn(seed + 2).alias("_b"))
    t = ((F.col("x") + 0.5 * F.col("_a")) > 0).cast("int")
    return base.withColumn("t", t).withColumn("y", (1 - F.col("t")) * (-F.col("x")) + F.col("t") * (1 - F.col("x")) + 0.2 * F.col("_b")).select("id", "x", "t", "y")
