"""Sparse inverse covariance (graphical lasso), one matrix per group.

The dual problem maximises logdet(X) over |X_ij - S_ij| <= l off the diagonal
with X_ii = S_ii + l; the precision is X^-1. Every method stops on the duality
gap for each variable, (tr(S P) + l |P|_1 - n) / n, so all of them give the
same optimum; they differ in their steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.linalg import dense

METHODS = ("gradient", "masked_gradient", "heavy_ball", "continuation", "adm")


def momentum(level: float) -> float:
    """Fixed break points and slopes of the heavy-ball momentum."""
    if level < 0.65:
        return (0.65 - level) * 0.35 + 0.75
    return 0.75 - 4 * (level - 0.65) if level <= 0.80 else (1 - level) / 2


def clip_to_box(x: np.ndarray, s: np.ndarray, level: float) -> np.ndarray:
    out = np.clip(x, s - level, s + level)
    np.fill_diagonal(out, np.diag(s) + level)
    return out


def duality_gap(s: np.ndarray, p: np.ndarray, level: float) -> float:
    n = len(s)
    return float(((s * p).sum() + level * np.abs(p).sum() - n) / n)


def kkt_residual(x: np.ndarray, s: np.ndarray, level: float, tol: float = 1e-9) -> float:
    """Largest |P_ij| over the entries strictly inside the box."""
    p, inside = np.linalg.inv(x), np.abs(x - s) < level - tol
    np.fill_diagonal(inside, False)
    return float(np.abs(p[inside]).max()) if inside.any() else 0.0


def _logdet(x: np.ndarray) -> float:
    try:
        return 2 * float(np.log(np.diag(np.linalg.cholesky(x))).sum())
    except np.linalg.LinAlgError:
        return -np.inf


def first_guess(s: np.ndarray, level: float) -> np.ndarray:
    """The soft-thresholded matrix where that is positive definite, else the raw one with a raised diagonal, else the diagonal."""
    soft = np.sign(s) * np.maximum(np.abs(s) - level, 0)
    for x in (soft, s):
        x = clip_to_box(x, s, level)
        if np.isfinite(_logdet(x)):
            return x
    return np.diag(np.diag(s) + level)


def _ascend(s: np.ndarray, level: float, x: np.ndarray, tol: float, max_iter: int, beta: float) -> tuple[np.ndarray, int]:
    """Projected gradient ascent with momentum; a step that does not raise the determinant is halved and drops its momentum."""
    before, value, step = x, _logdet(x), float(np.linalg.eigvalsh(x)[0] ** 2)
    for k in range(1, max_iter + 1):
        p = np.linalg.inv(x)
        if duality_gap(s, p, level) < tol:
            return x, k
        push, tried = beta, step
        for _ in range(60):
            new = clip_to_box(x + tried * p + push * (x - before), s, level)
            raised = _logdet(new)
            if raised >= value - 1e-14:
                break
            push, tried = 0.0, tried / 2
        else:
            return x, k
        before, x, value, step = x, new, raised, tried * 1.6
    return x, max_iter


def _alternate(s: np.ndarray, level: float, tol: float, max_iter: int) -> tuple[np.ndarray, int]:
    """Alternating directions: an eigenvalue map for the likelihood, soft thresholds for the penalty."""
    n = len(s)
    z, u, rho = np.diag(1 / (np.diag(s) + level)), np.zeros((n, n)), 1.0
    x = first_guess(s, level)
    for k in range(1, max_iter + 1):
        e, v = np.linalg.eigh(rho * (z - u) - s)
        p = (v * ((e + np.sqrt(e * e + 4 * rho)) / (2 * rho))) @ v.T
        old = z
        z = np.sign(p + u) * np.maximum(np.abs(p + u) - level / rho, 0)
        u = u + p - z
        x = clip_to_box(np.linalg.inv(p), s, level)
        if np.isfinite(_logdet(x)) and duality_gap(s, np.linalg.inv(x), level) < tol:
            return x, k
        primal, dual = np.linalg.norm(p - z), rho * np.linalg.norm(z - old)
        if primal > 10 * dual:
            rho, u = rho * 2, u / 2
        elif dual > 10 * primal:
            rho, u = rho / 2, u * 2
    return x, max_iter


def masked_gradient(g: np.ndarray, x: np.ndarray, s: np.ndarray, level: float, tol: float = 1e-12) -> np.ndarray:
    """The gradient without what points out of the box at its faces; the diagonal is fixed."""
    out = np.where((x >= s + level - tol) & (g > 0) | (x <= s - level + tol) & (g < 0), 0.0, g)
    np.fill_diagonal(out, 0.0)
    return out


def _climb(s: np.ndarray, level: float, x: np.ndarray, tol: float, max_iter: int) -> tuple[np.ndarray, int]:
    """Ascent along the masked gradient, unprojected: a step ends at the first face, or before where the objective would fall."""
    value, step = _logdet(x), 1.0
    for k in range(1, max_iter + 1):
        p = np.linalg.inv(x)
        if duality_gap(s, p, level) < tol:
            return x, k
        g = masked_gradient(p, x, s, level)
        room = np.where(g > 0, s + level - x, np.where(g < 0, s - level - x, np.inf))
        with np.errstate(divide="ignore", invalid="ignore"):
            wall = np.where(g != 0, room / g, np.inf).min()
        if not np.isfinite(wall):
            return x, k
        t = min(wall, 2 * step)
        while not (np.isfinite(now := _logdet(x + t * g)) and now >= value + 0.25 * t * (g * g).sum()):
            t /= 2
            if t < 1e-16:
                return x, k
        x, value, step = x + t * g, now, t
    return x, max_iter


def closed_form(s: np.ndarray, level: float) -> np.ndarray:
    """The precision of one or two variables: the covariance shrinks toward 0, the diagonal grows by the level."""
    x = s + level * np.eye(len(s))
    if len(s) == 2:
        x[0, 1] = x[1, 0] = np.sign(s[0, 1]) * max(abs(s[0, 1]) - level, 0.0)
    return np.linalg.inv(x)


def solve(s: np.ndarray, level: float, method: str = "heavy_ball", tol: float = 1e-6, max_iter: int = 5000) -> tuple[np.ndarray, float, int]:
    """(precision, gap, iterations) of one covariance matrix."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    n = len(s)
    if n == 1 or n == 2 and method == "heavy_ball":
        p = closed_form(s, level)
        return p, duality_gap(s, p, level) if n == 2 else 0.0, 0
    x = first_guess(s, level)
    if method == "adm":
        x, k = _alternate(s, level, tol, max_iter)
    elif method == "masked_gradient":
        x, k = _climb(s, level, x, tol, max_iter)
    elif method == "continuation":
        k, at = 0, max(level, 0.7 * float(np.abs(s - np.diag(np.diag(s))).max()))
        x = first_guess(s, at)
        while True:
            x, more = _ascend(s, at, x, tol if at == level else 1e-2, max_iter, momentum(at))
            k += more
            if at == level:
                break
            at = max(level, at * 0.6)
            moved = clip_to_box(x, s, at)
            x = moved if np.isfinite(_logdet(moved)) else first_guess(s, at)
    else:
        x, k = _ascend(s, level, x, tol, max_iter, 0.0 if method == "gradient" else momentum(min(level, 1.0)))
    p = np.linalg.inv(x)
    return p, duality_gap(s, p, level), k


def solve_pair(s1: np.ndarray, s2: np.ndarray, level: float, tol: float = 1e-6, max_iter: int = 2000) -> tuple[np.ndarray, np.ndarray, int]:
    """Two precisions whose difference is penalised: minimise sum(tr(S P) - logdet P) + level |P1 - P2|_1 off the diagonal.

    Alternating directions on the difference; equal inputs give equal outputs.
    """
    n, rho = len(s1), 1.0
    z1, z2 = np.diag(1 / np.diag(s1)), np.diag(1 / np.diag(s2))
    u1, u2 = np.zeros((n, n)), np.zeros((n, n))
    off = ~np.eye(n, dtype=bool)
    for k in range(1, max_iter + 1):
        ps = []
        for s, z, u in ((s1, z1, u1), (s2, z2, u2)):
            e, v = np.linalg.eigh(rho * (z - u) - s)
            ps.append((v * ((e + np.sqrt(e * e + 4 * rho)) / (2 * rho))) @ v.T)
        a, b = ps[0] + u1, ps[1] + u2
        half = np.where(off, np.clip((a - b) / 2, -level / rho, level / rho), 0.0)
        new1, new2 = a - half, b + half
        change = max(np.abs(new1 - z1).max(), np.abs(new2 - z2).max(), np.abs(ps[0] - new1).max(), np.abs(ps[1] - new2).max())
        z1, z2, u1, u2 = new1, new2, a - new1, b - new2
        if change < tol:
            break
    return z1, z2, k


def graphical_lasso(cells: DataFrame, level: float | list[float], name: str = "m", method: str = "heavy_ball", tol: float = 1e-6) -> DataFrame:
    """``(m, level, i, j, v, gap, iterations)``: the precision of each group's covariance (m, i, j, v) at each level.

    Groups and levels are rows, each solved by a task of its own.
    """
    levels = [float(x) for x in (level if isinstance(level, list) else [level])]
    each = cells.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    kind = cells.schema[name].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, gap, k = solve(dense(pdf), float(pdf.level.iloc[0]), method, tol)
        i, j = np.indices(p.shape).reshape(2, -1)
        return pd.DataFrame({name: pdf[name].iloc[0], "level": pdf.level.iloc[0], "i": i, "j": j, "v": p.ravel(), "gap": gap, "iterations": k})

    return each.groupBy(name, "level").applyInPandas(run, f"{name} {kind}, level double, i long, j long, v double, gap double, iterations long")


def paired_lasso(first: DataFrame, second: DataFrame, level: float, name: str = "m", tol: float = 1e-6) -> DataFrame:
    """``(m, i, j, v1, v2, iterations)``: for each group that both tables have, two precisions whose difference is penalised."""
    kind = first.schema[name].dataType.simpleString()

    both = first.select(name, "i", "j", "v", F.lit(1).alias("side")).unionByName(second.select(name, "i", "j", "v", F.lit(2).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf.side == 1], pdf[pdf.side == 2]
        if one.empty or two.empty:
            return pd.DataFrame({c: np.array([], kind) for c, kind in ((name, object), ("i", int), ("j", int), ("v1", float), ("v2", float), ("iterations", int))})
        p1, p2, k = solve_pair(dense(one), dense(two), level, tol)
        i, j = np.indices(p1.shape).reshape(2, -1)
        return pd.DataFrame({name: pdf[name].iloc[0], "i": i, "j": j, "v1": p1.ravel(), "v2": p2.ravel(), "iterations": k})

    return both.groupBy(name).applyInPandas(run, f"{name} {kind}, i long, j long, v1 double, v2 double, iterations long")


def tune_momentum(s: np.ndarray, level: float, reps: int = 2000, size: int = 10, seed: int = 1) -> float:
    """The momentum with the fewest mean iterations over random sub-matrices; tied ones are averaged.

    Every pair of a sub-matrix and a momentum (0 to 0.95 in steps of 0.005) is
    a row of the active session, counted by Spark's tasks.
    """
    rng = np.random.Generator(np.random.MT19937(seed))
    picks = np.array([rng.choice(len(s), min(size, len(s)), replace=False) for _ in range(reps)])
    steps = 191
    spark = SparkSession.active()

    def run(batches):
        for pdf in batches:
            rep, step = np.divmod(pdf["id"].to_numpy(), steps)
            parts = (s[np.ix_(picks[r], picks[r])] for r in rep)
            yield pd.DataFrame({"step": step, "k": [_ascend(x, level, first_guess(x, level), 1e-4, 500, 0.005 * b)[1] for x, b in zip(parts, step, strict=True)]})

    tasks = max(spark.sparkContext.defaultParallelism, reps * steps // 5000)
    found = spark.range(0, reps * steps, 1, tasks).mapInPandas(run, "step long, k long").groupBy("step").agg(F.sum("k").alias("k")).collect()
    least = min(r["k"] for r in found)
    return float(np.mean([0.005 * r["step"] for r in found if r["k"] == least]))
