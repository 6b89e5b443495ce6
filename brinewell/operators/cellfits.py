"""Estimators on cells: frames of distinct covariates with ``n`` rows and the sum of an outcome in each.

The same formulas as :mod:`regression`, for frames that are small because they hold
one row for each combination of covariates; resampling fits them in every round.
Terms that are not identified get the least-norm solution, as there.
"""

from __future__ import annotations

import numpy as np

from .regression import parse_formula


def design_matrix(pdf, formula: str) -> np.ndarray:
    """Columns of the right-hand side; levels are those of the frame, sorted, the first is the base."""
    _, terms = parse_formula(formula)

    def factor(f: str) -> list[np.ndarray]:
        if not f.startswith("C("):
            return [pdf[f].to_numpy(float)]
        v = pdf[f[2:-1].strip()]
        return [(v == k).to_numpy(float) for k in sorted(v.dropna().unique())[1:]]

    cols = []
    for t in terms:
        combo = [np.ones(len(pdf))]
        for f in t:
            combo = [x * y for x in combo for y in factor(f)]
        cols += combo
    return np.stack(cols, 1) if cols else np.zeros((len(pdf), 0))


def least_squares(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Coefficients from cells of ``n`` rows whose outcome sums to ``total``."""
    return np.linalg.pinv((x * n[:, None]).T @ x, rcond=1e-11, hermitian=True) @ (x.T @ total)


def logistic(x: np.ndarray, ones: np.ndarray, n: np.ndarray, max_iter: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Fitted chances of cells with ``ones`` of ``n`` rows treated, by reweighted least squares."""
    # chances do not depend on the scale of the columns, the steps do
    centre, spread = (x.mean(0), x.std(0)) if len(x) and (x == 1).all(0).any() else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
    x = np.where(spread > 0, (x - centre) / np.where(spread > 0, spread, 1), x)
    beta = np.zeros(x.shape[1])
    for _ in range(max_iter):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        move = np.clip(np.linalg.pinv((x * (n * p * (1 - p))[:, None]).T @ x, rcond=1e-11, hermitian=True) @ (x.T @ (ones - n * p)), -5, 5)
        beta = beta + move
        if np.abs(move).max(initial=0.0) < tol:
            break
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _arms(pdf, covariates: list[str], t: str, y: str):
    """One row per combination of covariates with n and the outcome's sum in both arms."""
    a = pdf.assign(n1=pdf["n"] * pdf[t], n0=pdf["n"] * (1 - pdf[t]), s1=pdf[y] * pdf[t], s0=pdf[y] * (1 - pdf[t]))
    return a.groupby(covariates, dropna=False, sort=True)[["n1", "n0", "s1", "s0"]].sum().reset_index()


def ipw_ate(formula: str, covariates: list[str], t: str, y: str):
    """Average effect by inverse weighting with a score fitted on the cells themselves."""

    def est(pdf) -> float:
        c = _arms(pdf, covariates, t, y)
        n1, n0 = c["n1"].to_numpy(float), c["n0"].to_numpy(float)
        p = logistic(design_matrix(c, formula), n1, n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.nansum(c["s1"].to_numpy(float) / p - c["s0"].to_numpy(float) / (1 - p)) / (n1 + n0).sum())

    return est


def doubly_robust_ate(formula: str, covariates: list[str], t: str, y: str):
    """AIPW: a fitted score and one linear model for each arm."""

    def est(pdf) -> float:
        c = _arms(pdf, covariates, t, y)
        n1, n0, s1, s0 = (c[k].to_numpy(float) for k in ("n1", "n0", "s1", "s0"))
        x = design_matrix(c, formula)
        p, m1, m0 = logistic(x, n1, n1 + n0), x @ least_squares(x, n1, s1), x @ least_squares(x, n0, s0)
        with np.errstate(divide="ignore", invalid="ignore"):
            one, zero = np.where(n1 > 0, (s1 - n1 * m1) / p, 0.0), np.where(n0 > 0, (s0 - n0 * m0) / (1 - p), 0.0)
        return float(((one + (n1 + n0) * m1).sum() - (zero + (n1 + n0) * m0).sum()) / (n1 + n0).sum())

    return est


def coefficient(formula: str, term: str, y: str):
    """The least-squares coefficient of a term without levels; NaN where the cells do not identify it."""
    _, terms = parse_formula(formula)

    def est(pdf) -> float:
        x = design_matrix(pdf, formula)
        # terms come in order of their number of factors; the one asked for has no levels, so it is one column
        at = sum(design_matrix(pdf, "y ~ 0 + " + ":".join(f)).shape[1] if f else 1 for f in terms[: terms.index(term.split(":"))])
        n = pdf["n"].to_numpy(float)
        a = (x * n[:, None]).T @ x
        inv = np.linalg.pinv(a, rcond=1e-11, hermitian=True)
        return float((inv @ (x.T @ pdf[y].to_numpy(float)))[at]) if abs((inv @ a)[at, at] - 1) < 1e-5 else float("nan")

    return est
