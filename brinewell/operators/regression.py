"""Least squares and logistic regression from a formula.

A formula becomes a list of column expressions; one aggregation yields X'X, X'y
and y'y, the driver solves a matrix whose side is the number of terms.  Rank
deficient designs are solved by pseudo-inverse, and terms that are not
identified come out as null.  Rows with a null, NaN or infinite term are left
out, as the design would drop them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_rows

MAX_TERMS = 400
MAX_LEVELS = 200


@dataclass
class Design:
    outcome: str
    names: list[str]
    terms: list[Column] = field(repr=False)


def parse_formula(formula: str) -> tuple[str, list[list[str]]]:
    """(outcome, terms): ``a*b`` is a + b + a:b, every term a list of factors; the intercept is implied unless ``-1``/``0``."""
    left, _, right = formula.partition("~")
    terms: list[list[str]] = []

    def add(t: list[str]) -> None:
        if t not in terms:
            terms.append(t)

    intercept = True
    for raw in re.split(r"\+", re.sub(r"-\s*1", "+ 0", right)):
        raw = raw.strip()
        if raw in ("", "1"):
            continue
        if raw == "0":
            intercept = False
            continue
        if "*" in raw:
            factors = [x.strip() for x in raw.split("*")]
            for mask in sorted(range(1, 1 << len(factors)), key=lambda m: (bin(m).count("1"), m)):
                add([f for i, f in enumerate(factors) if mask >> i & 1])
        else:
            add([x.strip() for x in raw.split(":")])
    terms.sort(key=len)
    return left.strip(), ([[]] if intercept else []) + terms


def design(df: DataFrame, formula: str, levels: dict[str, list] | None = None) -> Design:
    """Columns of the design; levels of ``C(x)`` are read once, sorted, the first is the base."""
    outcome, terms = parse_formula(formula)
    names, cols, known = [], [], dict(levels or {})

    def factor(f: str, full: bool) -> list[tuple[str, Column]]:
        m = re.fullmatch(r"C\((.+)\)", f)
        if not m:
            return [(f, F.col(f).cast("double"))]
        c = m.group(1).strip()
        if c not in known:
            known[c] = sorted(r[0] for r in bounded_rows(df.select(c).where(F.col(c).isNotNull()).distinct(), MAX_LEVELS, f"levels of {c}"))
        use = known[c] if full else known[c][1:]
        return [(f"C({c})[{v}]", F.when(F.col(c).isNull(), None).otherwise((F.col(c) == F.lit(v)).cast("double"))) for v in use]

    for t in terms:
        combo: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for f in t:
            combo = [((a + ":" + b) if a else b, x * y) for a, x in combo for b, y in factor(f, full=False)]
        for n, c in combo:
            names.append(n or "Intercept")
            cols.append(c)
    if len(names) > MAX_TERMS:
        raise ValueError(f"{len(names)} terms; at most {MAX_TERMS}")
    return Design(outcome, names, cols)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _usable(df: DataFrame, d: Design, outcome: Column | None) -> DataFrame:
    out = df.select("*", *[c.alias(f"_x{i}") for i, c in enumerate(d.terms)], *([outcome.cast("double").alias("_y")] if outcome is not None else []))
    ok = F.lit(True)
    for n in [f"_x{i}" for i in range(len(d.terms))] + (["_y"] if outcome is not None else []):
        ok = ok & _finite(F.col(n))
    return out.where(ok)


def _moments(rows: DataFrame, k: int, weight: Column | None = None, target: str = "_y") -> tuple[np.ndarray, np.ndarray, float, int]:
    w = weight if weight is not None else F.lit(1.0)
    x = [F.col(f"_x{i}") for i in range(k)]
    cells = [F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * x[i] * F.col(target)) for i in range(k)]
    got = rows.agg(F.array(*cells).alias("m"), F.sum(w * F.col(target) * F.col(target)).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    m = [0.0 if v is None else float(v) for v in got["m"]]
    a, b, at = np.zeros((k, k)), np.zeros(k), 0
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = m[at]
            at += 1
    b[:] = m[at:]
    return a, b, float(got["yy"] or 0.0), int(got["n"])


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    df_resid: int
    rank: int
    identified: np.ndarray
    design: Design
    critical: float = 1.959963984540054
    normal: bool = True

    def chance(self, z: float) -> float:
        """Distribution of the statistic: normal, or Student's t with the residual degrees of freedom."""
        return NormalDist().cdf(z) if self.normal else t_chance(z, self.df_resid)

    def rows(self) -> list[tuple]:
        out = []
        for i, n in enumerate(self.names):
            if not self.identified[i]:
                out.append((n, None, None, None, None, None, None))
                continue
            se = float(self.se[i]) if np.isfinite(self.se[i]) else None
            b = float(self.beta[i])
            z = b / se if se else None
            out.append((n, b, se, z, None if z is None else 2 * (1 - self.chance(abs(z))), b - self.critical * se if se is not None else None, b + self.critical * se if se is not None else None))
        return out

    def table(self, spark) -> DataFrame:
        """term, estimate, std_error, statistic, p_value, ci_low, ci_high (nulls where not identified)."""
        return spark.createDataFrame(self.rows(), "term string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double")

    def coefficient(self, name: str) -> float | None:
        i = self.names.index(name)
        return float(self.beta[i]) if self.identified[i] else None

    def predict(self) -> Column:
        out = F.lit(0.0)
        for b, c in zip(self.beta, self.design.terms):
            out = out + F.lit(float(b)) * c
        return out


def t_chance(t: float, df: int) -> float:
    """Distribution of Student's t at ``t`` >= 0: the density integrated by Simpson's rule."""
    if df <= 0:
        return math.nan
    if df > 2000:
        return NormalDist().cdf(t * (1 - 1 / (4 * df)) / math.sqrt(1 + t * t / (2 * df)))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    u = np.linspace(0.0, math.atan(t / math.sqrt(df)), 2001)
    y = np.cos(u) ** (df - 1) * math.sqrt(df) * c
    h = u[1] - u[0]
    return float(0.5 + h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection (df >= 1)."""
    if df <= 0:
        return math.nan
    if df > 2000:
        z = NormalDist().inv_cdf(p)
        return z + (z**3 + z) / (4 * df)
    lo, hi = 0.0, 1e3 if df > 1 else 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_chance(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _pinv(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(generalised inverse, which terms are identified, rank), after scaling the diagonal to one."""
    scale = np.sqrt(np.diag(a))
    s = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    unit = a * s[:, None] * s[None, :]
    inv = np.linalg.pinv(unit, rcond=1e-11, hermitian=True)
    # a term is identified if its unit vector lies in the row space
    identified = np.abs(np.diag(inv @ unit) - 1) < 1e-5
    rank = int(np.linalg.matrix_rank(unit, tol=1e-11 * max(1.0, len(a)), hermitian=True)) if len(a) else 0
    return inv * s[:, None] * s[None, :], identified, rank


def ols(df: DataFrame, formula: str, *, cluster: str | None = None, small_sample: bool = True, levels: dict[str, list] | None = None) -> Fit:
    """Least squares; with ``cluster`` the sandwich covariance of within-cluster score sums
    (factor G/(G-1) * (n-1)/(n-rank) unless ``small_sample`` is off; normal quantiles)."""
    d = design(df, formula, levels)
    rows = _usable(df, d, F.col(d.outcome))
    k = len(d.names)
    a, b, yy, n = _moments(rows, k)
    inv, identified, rank = _pinv(a)
    beta = inv @ b
    resid = n - rank
    sse = max(0.0, yy - float(beta @ b))
    if cluster is None:
        var = np.diag(inv) * (sse / resid) if resid > 0 else np.full(k, np.nan)
        crit = t_quantile(0.975, resid) if resid > 0 else math.nan
    else:
        e = F.col("_y")
        for i in range(k):
            e = e - F.lit(float(beta[i])) * F.col(f"_x{i}")
        scores = rows.withColumn("_e", e).groupBy(cluster).agg(*[F.sum(F.col(f"_x{i}") * F.col("_e")).alias(f"s{i}") for i in range(k)])
        got = scores.agg(F.count(F.lit(1)).alias("g"), F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]).alias("m")).first()
        meat, g = np.array([v or 0.0 for v in got["m"]], float).reshape(k, k), int(got["g"])
        f = (g / (g - 1) * (n - 1) / resid if g > 1 and resid > 0 else math.nan) if small_sample else 1.0
        var, crit = np.diag(inv @ meat @ inv) * f, NormalDist().inv_cdf(0.975)
    return Fit(d.names, beta, np.sqrt(np.where(var >= 0, var, np.nan)), n, resid, rank, identified, d, crit, cluster is not None)


#: Up to this many different rows of a design, a logistic fit needs one job only.
MAX_CELLS = 20_000


def logit(df: DataFrame, formula: str, *, max_iter: int = 100, tol: float = 1e-10, levels: dict[str, list] | None = None) -> Fit:
    """Unpenalised logistic regression by iteratively reweighted least squares.

    Rows are counted by distinct (design, outcome) first. If those are few (a
    checked bound), the steps run on the counts; otherwise every step is one
    aggregation over the rows. Steps end when neither the coefficients nor the
    deviance move, so separated cells, whose coefficients have no limit, end too.
    """
    d = design(df, formula, levels)
    rows = _usable(df, d, F.col(d.outcome))
    k = len(d.names)
    xs = [f"_x{i}" for i in range(k)]
    cells = rows.groupBy(*xs, "_y").agg(F.count(F.lit(1)).alias("_n")).limit(MAX_CELLS + 1).collect()
    local = len(cells) <= MAX_CELLS
    if local:
        x, y, m = np.array([r[:k] for r in cells], float).reshape(-1, k), np.array([r["_y"] for r in cells], float), np.array([r["_n"] for r in cells], float)

    # steps are taken on centred and scaled columns, whatever the units of the covariates are
    if local:
        total = max(1.0, float(m.sum()))
        mean, spread = (m @ x) / total, np.sqrt(np.maximum((m @ (x * x)) / total - ((m @ x) / total) ** 2, 0))
    else:
        got = rows.agg(F.array(*[F.avg(c) for c in xs]).alias("m"), F.array(*[F.stddev_pop(c) for c in xs]).alias("s")).first()
        mean, spread = np.array([v or 0.0 for v in got["m"]]), np.array([v or 0.0 for v in got["s"]])
    varies = spread > 1e-12 * (1 + np.abs(mean))
    scale, shift = np.where(varies, spread, 1.0), np.where(varies & ("Intercept" in d.names), mean, 0.0)
    if local:
        x = (x - shift) / scale
    else:
        rows = rows.withColumns({c: (F.col(c) - F.lit(float(a))) / F.lit(float(b)) for c, a, b in zip(xs, shift, scale)})

    def step(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
        if local:
            eta = x @ beta
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            w = m * p * (1 - p)
            dev = 2 * float((m * (np.logaddexp(0, eta) - y * eta)).sum())
            return (x * w[:, None]).T @ x, x.T @ (m * (y - p)), dev, int(m.sum())
        eta = F.lit(0.0)
        for b, c in zip(beta, xs):
            eta = eta + F.lit(float(b)) * F.col(c)
        part = rows.withColumn("_eta", eta).withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_eta")))).withColumn("_w", F.col("_p") * (1 - F.col("_p"))).withColumn("_g", F.col("_y") - F.col("_p"))
        sums = [F.sum(F.col("_w") * F.col(xs[i]) * F.col(xs[j])) for i in range(k) for j in range(i, k)] + [F.sum(F.col(c) * F.col("_g")) for c in xs]
        dev = F.sum(F.greatest(F.col("_eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta"))) - F.col("_y") * F.col("_eta"))
        got = part.agg(F.array(*sums).alias("m"), dev.alias("dev"), F.count(F.lit(1)).alias("n")).first()
        v, at, a = [z or 0.0 for z in got["m"]], 0, np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                a[i, j] = a[j, i] = v[at]
                at += 1
        return a, np.array(v[at:]), 2 * float(got["dev"] or 0.0), int(got["n"])

    beta, last = np.zeros(k), math.inf
    for _ in range(max_iter):
        a, g, dev, n = step(beta)
        inv, ident, rank = _pinv(a)
        move = np.clip(inv @ g, -5, 5)
        beta = beta + move
        if np.abs(move).max(initial=0.0) < tol or abs(last - dev) < tol * (abs(dev) + 0.1):
            break
        last = dev
    back = np.diag(1 / scale)
    if "Intercept" in d.names:
        back[d.names.index("Intercept")] -= shift / scale
    return Fit(d.names, back @ beta, np.sqrt(np.maximum(np.diag(back @ inv @ back.T), 0)), n, n - rank, rank, ident, d)


def probability(fit: Fit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-fit.predict()))
