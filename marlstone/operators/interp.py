"""Interpolation, approximation and quadrature.

Functions over tables take knots ``(grp, t, y)`` with strictly increasing t in
each group and queries ``(grp, t)``; they find intervals with ``asof.bracket``.
Functions over arrays (folds, small bases) work on one row's arrays.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.asof import bracket, with_neighbours
from marlstone.operators.ranges import ROWS, cut, running, stored


def bad_knots(knots: DataFrame, least: int = 2) -> DataFrame:
    """Groups that break the rules: fewer than ``least`` knots, or positions that do not strictly increase."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("grp").orderBy("t"))
    return knots.select("grp", gap.alias("gap")).groupBy("grp").agg(F.count("*").alias("n"), F.min("gap").alias("gap")).where((F.col("n") < least) | (F.col("gap") <= 0)).select("grp")


def _u() -> tuple[Column, Column]:
    """Distance from the interval's start, and the interval's length."""
    return F.col("t") - F.col("lo.t"), F.col("hi.t") - F.col("lo.t")


# linear


def linear(knots: DataFrame, queries: DataFrame, bucket: float | None = None, size: int | None = None) -> DataFrame:
    """``value`` and ``slope``; the end intervals extend beyond the knots."""
    d, h = _u()
    slope = (F.col("hi.y") - F.col("lo.y")) / F.nullif(h, F.lit(0.0))
    out = bracket(knots, queries, bucket=bucket, size=size)
    return out.select(*queries.columns, F.coalesce(F.col("lo.y") + d * slope, F.col("lo.y")).alias("value"), slope.alias("slope"))


def linear_integral(knots: DataFrame, limits: DataFrame, bucket: float | None = None, size: int | None = None) -> DataFrame:
    """``limits`` (grp, a, b) with the signed ``integral`` of the linear interpolant from a to b.

    F(b) - F(a) with F the running trapezoid sum at the bracketing knot plus a
    part of its interval, so each limit costs one as-of lookup. With ``size``
    groups of more knots are cut into ranges.
    """
    area = (F.col("_k.t") - F.col("_k.t_p")) * (F.col("_k.y") + F.col("_k.y_p")) / 2
    areas = with_neighbours(knots.select("grp", "t", "y"), size=size).select("grp", "t", "y", F.coalesce(area, F.lit(0.0)).alias("part"))
    if size:
        areas = stored(running(stored(areas), "grp", "t", {"area": F.col("part")}, size).drop("part"))
    else:
        areas = areas.withColumn("area", F.sum("part").over(Window.partitionBy("grp").orderBy("t"))).drop("part")
    q = limits.withColumn("_id", F.struct("grp", "a", "b")).select("grp", "_id", F.explode(F.array(F.struct(F.col("a").cast("double").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("b").cast("double").alias("t"), F.lit(1).alias("sign")))).alias("e")).select("grp", "_id", "e.*")
    found = bracket(areas, q, values=("y", "area"), bucket=bucket, size=size)
    d, h = _u()
    slope = (F.col("hi.y") - F.col("lo.y")) / F.nullif(h, F.lit(0.0))
    upto = F.col("lo.area") + d * F.col("lo.y") + slope * d * d / 2
    sums = found.groupBy("_id").agg(F.sum(F.when(F.col("sign") > 0, upto)).alias("up"), F.sum(F.when(F.col("sign") < 0, upto)).alias("down"), F.count_if(F.col("sign") > 0).alias("n"))
    return sums.select("_id.*", ((F.col("up") - F.col("down")) / F.col("n")).alias("integral"))


# quadratic


def quadratic(knots: DataFrame, queries: DataFrame, bucket: float | None = None) -> DataFrame:
    """``value`` and ``slope`` of the parabolas through knots (0, 1, 2), (2, 3, 4), ...; an odd number of knots."""
    order = Window.partitionBy("grp").orderBy("t")
    triples = knots.select("grp", "t", "y", F.lead("t").over(order).alias("t2"), F.lead("y").over(order).alias("y2"), F.lead("t", 2).over(order).alias("t3"), F.lead("y", 2).over(order).alias("y3"), F.row_number().over(order).alias("i"))
    starts = triples.where("i % 2 = 1")
    out = bracket(starts, queries, values=("y", "t2", "y2", "t3", "y3"), bucket=bucket)
    base = F.when((F.col("t") >= F.col("hi.t")) & F.col("hi.t3").isNotNull(), F.col("hi")).otherwise(F.col("lo"))
    out = out.withColumn("b", base)
    value, slope = parabola(F.col("t"), *(F.col(f"b.{c}") for c in ("t", "y", "t2", "y2", "t3", "y3")))
    return out.select(*queries.columns, value.alias("value"), slope.alias("slope"))


def parabola(t: Column, t1: Column, y1: Column, t2: Column, y2: Column, t3: Column, y3: Column) -> tuple[Column, Column]:
    """Value and slope at t of the parabola through three points."""
    d1 = (y2 - y1) / F.nullif(t2 - t1, F.lit(0.0))
    d2 = ((y3 - y1) / F.nullif(t3 - t1, F.lit(0.0)) - d1) / F.nullif(t3 - t2, F.lit(0.0))
    return y1 + (t - t1) * (d1 + (t - t2) * d2), d1 + d2 * ((t - t1) + (t - t2))


def three_point_derivative(knots: DataFrame) -> DataFrame:
    """``(grp, t, slope)`` at the inner knots, of the parabola through each knot and its neighbours."""
    order = Window.partitionBy("grp").orderBy("t")
    side = [F.lag(c).over(order).alias(f"{c}0") for c in ("t", "y")] + [F.lead(c).over(order).alias(f"{c}2") for c in ("t", "y")]
    _, slope = parabola(F.col("t"), F.col("t0"), F.col("y0"), F.col("t"), F.col("y"), F.col("t2"), F.col("y2"))
    return knots.select("grp", "t", "y", *side).where("t0 is not null and t2 is not null").select("grp", "t", slope.alias("slope"))


# Hermite and PCHIP


def cubic_on_interval(d: Column, h: Column, y0: Column, y1: Column, s0: Column, s1: Column) -> tuple[Column, Column]:
    """Value and slope at distance d of the cubic with end values and slopes on an interval of length h."""
    delta = (y1 - y0) / F.nullif(h, F.lit(0.0))
    c3 = (s0 + s1 - 2 * delta) / F.nullif(h * h, F.lit(0.0))
    c2 = (delta - s0) / F.nullif(h, F.lit(0.0)) - c3 * h
    return y0 + d * (s0 + d * (c2 + d * c3)), s0 + d * (2 * c2 + 3 * d * c3)


def hermite_coefficients(knots: DataFrame) -> DataFrame:
    """``(grp, t, c0, c1, c2, c3)`` for every interval of knots (grp, t, y, slope)."""
    order = Window.partitionBy("grp").orderBy("t")
    h = F.lead("t").over(order) - F.col("t")
    rows = knots.select("grp", "t", "y", "slope", h.alias("h"), F.lead("y").over(order).alias("y1"), F.lead("slope").over(order).alias("s1")).where("h is not null")
    delta = (F.col("y1") - F.col("y")) / F.col("h")
    d3 = F.col("slope") + F.col("s1") - 2 * delta
    return rows.select("grp", "t", F.col("y").alias("c0"), F.col("slope").alias("c1"), ((delta - F.col("slope") - d3) / F.col("h")).alias("c2"), (d3 / (F.col("h") * F.col("h"))).alias("c3"))


def hermite(knots: DataFrame, queries: DataFrame, bucket: float | None = None) -> DataFrame:
    """``value`` and ``slope`` from knots (grp, t, y, slope)."""
    d, h = _u()
    value, slope = cubic_on_interval(d, h, F.col("lo.y"), F.col("hi.y"), F.col("lo.slope"), F.col("hi.slope"))
    return bracket(knots, queries, values=("y", "slope"), bucket=bucket).select(*queries.columns, value.alias("value"), slope.alias("slope"))


def pchip_slopes(knots: DataFrame) -> DataFrame:
    """``(grp, t, y, slope)`` with slopes that keep the interpolant monotone where the data are."""
    order = Window.partitionBy("grp").orderBy("t")
    at = lambda c, k: F.lead(c, k).over(order) if k > 0 else F.lag(c, -k).over(order)
    x = knots.select("grp", "t", "y", *(at(c, k).alias(f"{c}{k + 2}") for c in ("t", "y") for k in (-2, -1, 1, 2)))
    t, y = F.col("t"), F.col("y")
    rise = lambda y1, y0, t1, t0: (y1 - y0) / F.nullif(t1 - t0, F.lit(0.0))
    h0, h1 = t - F.col("t1"), F.col("t3") - t
    d0, d1 = rise(y, F.col("y1"), t, F.col("t1")), rise(F.col("y3"), y, F.col("t3"), t)
    big, small = F.greatest(F.abs(d0), F.abs(d1)), F.least(F.abs(d0), F.abs(d1))
    total = h0 + h1
    inner = F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise(F.signum(d0) * small / ((total + h0) / (3 * total) * F.abs(d0) / F.nullif(big, F.lit(0.0)) + (total + h1) / (3 * total) * F.abs(d1) / F.nullif(big, F.lit(0.0))))

    def end(ha: Column, hb: Column, da: Column, db: Column) -> Column:
        raw = ((2 * ha + hb) * da - ha * db) / F.nullif(ha + hb, F.lit(0.0))
        return F.when(F.signum(raw) != F.signum(da), F.lit(0.0)).when((F.signum(da) != F.signum(db)) & (F.abs(raw) > F.abs(3 * da)), 3 * da).otherwise(raw)

    first = end(h1, F.col("t4") - F.col("t3"), d1, rise(F.col("y4"), F.col("y3"), F.col("t4"), F.col("t3")))
    last = end(h0, F.col("t1") - F.col("t0"), d0, rise(F.col("y1"), F.col("y0"), F.col("t1"), F.col("t0")))
    slope = (
        F.when(F.col("t1").isNull() & F.col("t3").isNull(), F.lit(0.0))
        .when(F.col("t1").isNull(), F.when(F.col("t4").isNull(), d1).otherwise(first))
        .when(F.col("t3").isNull(), F.when(F.col("t0").isNull(), d0).otherwise(last))
        .otherwise(inner)
    )
    return x.select("grp", "t", "y", slope.alias("slope"))


def pchip(knots: DataFrame, queries: DataFrame, bucket: float | None = None) -> DataFrame:
    """Monotone piecewise cubic ``value`` and ``slope``, and whether the query lies outside the knots."""
    d, h = _u()
    value, slope = cubic_on_interval(d, h, F.col("lo.y"), F.col("hi.y"), F.col("lo.slope"), F.col("hi.slope"))
    return bracket(pchip_slopes(knots), queries, values=("y", "slope"), bucket=bucket).select(*queries.columns, value.alias("value"), slope.alias("slope"), ((d < 0) | (d > h)).alias("outside"))


def count_outside(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("grp").agg(F.count_if("outside").alias("n_outside"))


# tridiagonal systems and cubic splines: folds over one group's arrays


def tridiagonal_solve(sub: Column, diag: Column, sup: Column, rhs: Column) -> Column:
    """Solution of a small tridiagonal system without pivoting (arrays of equal length; sub[0] and sup[n-1] unused); null on a zero pivot.

    For systems that fit a row; splines solve theirs by :func:`thomas` in blocks.
    """
    rows = F.arrays_zip(sub.alias("a"), diag.alias("b"), sup.alias("c"), rhs.alias("d"))
    pair = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    start = F.struct(F.lit(0).alias("i"), pair.alias("last"), F.array().cast("array<struct<c:double,d:double>>").alias("out"))

    def forward(acc: Column, r: Column) -> Column:
        below = F.when(acc["i"] > 0, r["a"]).otherwise(0.0)
        pivot = F.nullif(r["b"] - below * acc["last"]["c"], F.lit(0.0))
        now = F.struct((r["c"] / pivot).alias("c"), ((r["d"] - below * acc["last"]["d"]) / pivot).alias("d"))
        return F.struct((acc["i"] + 1).alias("i"), now.alias("last"), F.array_append(acc["out"], now).alias("out"))

    swept = F.aggregate(rows, start, forward, lambda acc: F.reverse(acc["out"]))
    end = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("x"), F.array().cast("array<double>").alias("out"))

    def back(acc: Column, r: Column) -> Column:
        x = r["d"] - F.when(acc["i"] > 0, r["c"] * acc["x"]).otherwise(0.0)
        return F.struct((acc["i"] + 1).alias("i"), x.alias("x"), F.array_append(acc["out"], x).alias("out"))

    solved = F.aggregate(swept, end, back, lambda acc: F.reverse(acc["out"]))
    return F.when(~F.exists(solved, lambda x: x.isNull()), solved)


def thomas(sub: np.ndarray, diag: np.ndarray, sup: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of a tridiagonal system without pivoting; NaN from a zero pivot on."""
    n = len(diag)
    c, d = np.zeros(n), np.zeros(n)
    last_c = last_d = 0.0
    for i, (a, b, up, r) in enumerate(zip(sub.tolist(), diag.tolist(), sup.tolist(), rhs.tolist(), strict=True)):
        pivot = (b - a * last_c) or float("nan")
        c[i] = last_c = up / pivot
        d[i] = last_d = (r - a * last_d) / pivot
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def tridiagonal_multiply(df: DataFrame, group: str = "grp") -> DataFrame:
    """``(grp, i, v)``: matrix times vector of rows (grp, i, sub, diag, sup, x)."""
    order = Window.partitionBy(group).orderBy("i")
    part = lambda c, x: F.coalesce(F.col(c) * x, F.lit(0.0))
    return df.select(group, "i", (part("sub", F.lag("x").over(order)) + F.col("diag") * F.col("x") + part("sup", F.lead("x").over(order))).alias("v"))


def knot_arrays(knots: DataFrame) -> DataFrame:
    """``(grp, ts, ys)``: each group's knots in order. For groups whose knots fit a row."""
    k = F.sort_array(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))))
    return knots.groupBy("grp").agg(k.alias("k")).select("grp", F.col("k.t").alias("ts"), F.col("k.y").alias("ys"))


#: Knots of a group that one task solves, and knots beyond its ends that it sees.
BLOCK, OVERLAP = 20_000, 64


def cubic_second_derivatives(knots: DataFrame, start: tuple[int, float] = (0, 0.0), end: tuple[int, float] = (0, 0.0), block: int = BLOCK) -> DataFrame:
    """``(grp, t, y, ypp)`` of the cubic spline.

    An end condition is (0, _) for a quadratic end interval, (1, slope) for a
    given slope, (2, second derivative). Two knots with (0, _) on both sides
    give a straight line; groups of one knot have no rows.

    A group is solved in blocks of consecutive knots. In every inner row of the
    system the diagonal is twice the sum of its neighbours, so what happens
    beyond a block fades by half with each knot; with 64 more knots on either
    side nothing of it is left in a double.
    """
    order = Window.partitionBy("grp").orderBy("t")
    rows = knots.select("grp", F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("first", F.col("i") == 0).withColumn("last", F.lead("t").over(order).isNull())
    own, rest = F.floor(F.col("i") / block), F.col("i") % block
    seen = F.array_compact(F.array(own, F.when((rest < OVERLAP) & (own > 0), own - 1), F.when(rest >= block - OVERLAP, own + 1)))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(seen))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        t, y, n = pdf.t.to_numpy(), pdf.y.to_numpy(), len(pdf)
        mine = (pdf.own == pdf.part).to_numpy()
        if n == 1 or not mine.any():
            return pd.DataFrame({"grp": pdf.grp[:0].astype(object), "t": t[:0], "y": y[:0], "ypp": y[:0]})
        h = np.diff(t)
        with np.errstate(all="ignore"):
            slope = np.diff(y) / h
        sub, diag, sup, rhs = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        sub[1:-1], sup[1:-1] = h[:-1] / 6, h[1:] / 6
        diag[1:-1], rhs[1:-1] = (h[:-1] + h[1:]) / 3, np.diff(slope)
        straight = n == 2 and start[0] == 0 and end[0] == 0 and pdf["first"].iloc[0] and pdf["last"].iloc[-1]
        if pdf["first"].iloc[0] and not straight:
            diag[0], sup[0], rhs[0] = {0: (1.0, -1.0, 0.0), 1: (h[0] / 3, h[0] / 6, slope[0] - start[1]), 2: (1.0, 0.0, start[1])}[start[0]]
        if pdf["last"].iloc[-1] and not straight:
            diag[-1], sub[-1], rhs[-1] = {0: (1.0, -1.0, 0.0), 1: (h[-1] / 3, h[-1] / 6, end[1] - slope[-1]), 2: (1.0, 0.0, end[1])}[end[0]]
        ypp = thomas(sub, diag, sup, rhs)
        return pd.DataFrame({"grp": pdf.grp, "t": t, "y": y, "ypp": np.where(np.isfinite(ypp), ypp, np.nan)})[mine]

    kind = knots.schema["grp"].dataType.simpleString()
    return rows.groupBy("grp", "part").applyInPandas(solve, f"grp {kind}, t double, y double, ypp double")


def cubic(knots: DataFrame, queries: DataFrame, start: tuple[int, float] = (0, 0.0), end: tuple[int, float] = (0, 0.0), bucket: float | None = None) -> DataFrame:
    """Cubic spline ``value``, ``slope`` and ``second`` derivative."""
    out = bracket(cubic_second_derivatives(knots, start, end), queries, values=("y", "ypp"), bucket=bucket)
    d, h = _u()
    y0, y1, p0, p1 = F.col("lo.y"), F.col("hi.y"), F.col("lo.ypp"), F.col("hi.ypp")
    delta = (y1 - y0) / F.nullif(h, F.lit(0.0))
    third = (p1 - p0) / F.nullif(h, F.lit(0.0))
    s = delta - (p1 / 6 + p0 / 3) * h
    value, slope = y0 + d * (s + d * (p0 / 2 + d * third / 6)), s + d * (p0 + d * third / 2)
    return out.select(*queries.columns, value.alias("value"), slope.alias("slope"), (p0 + d * third).alias("second"))


def linear_from_integrals(cells: DataFrame, size: int = ROWS) -> DataFrame:
    """``(grp, t, y)``: the linear interpolant whose integral over each cell (grp, t0, t1, area) is given.

    Cells adjoin. With heights h the areas give y1 = 2 area / h - y0, so with the
    sign of every second knot turned y is a running sum of 2 area / h and one
    number that is free; it is chosen to minimise the jumps of the slope, from
    two sums a group. Groups of more than ``size`` cells are cut into ranges.
    """
    h = F.col("t1").cast("double") - F.col("t0").cast("double")
    rows = cells.select("grp", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), F.col("area").cast("double").alias("area"), h.alias("h"))
    rows = stored(running(rows, "grp", "t0", {"i": F.lit(1)}, size))
    sign = F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0)  # of the cell's right knot
    rows = running(rows, "grp", "t0", {"turned": sign * 2 * F.col("area") / F.col("h")}, size)
    rows = rows.withColumn("right", sign * F.col("turned")).withColumn("left", 2 * F.col("area") / F.col("h") - F.col("right")).withColumn("free", -sign)
    rows = rows.withColumn("base_slope", (F.col("right") - F.col("left")) / F.col("h")).withColumn("free_slope", -2 * F.col("free") / F.col("h"))
    rows = stored(with_neighbours(rows, t="t0", values=("base_slope", "free_slope"), size=size))
    base, free = (F.col(f"_k.{c}_n") - F.col(f"_k.{c}") for c in ("base_slope", "free_slope"))
    sums = rows.groupBy("grp").agg(F.sum(base * free).alias("ab"), F.sum(free * free).alias("bb"), F.min_by(F.col("area") / F.col("h"), "t0").alias("only"))
    sums = sums.select(F.col("grp").alias("_g"), F.when(F.col("bb") > 0, -F.col("ab") / F.col("bb")).otherwise(F.col("only")).alias("s"))
    joined = rows.join(sums, F.col("grp").eqNullSafe(F.col("_g")))
    knot = lambda t, y, sign: F.struct(F.col(t).alias("t"), (F.col(y) + sign * F.col("s") * F.col("free")).alias("y"))
    ends = F.when(F.col("_k.t_n").isNull(), F.array(knot("t0", "left", 1), knot("t1", "right", -1))).otherwise(F.array(knot("t0", "left", 1)))
    return joined.select("grp", F.inline(ends))


# splines over four neighbours


def _four(knots: DataFrame, queries: DataFrame, bucket: float | None = None) -> DataFrame:
    """The bracket with the neighbours beyond it: t_a, y_a, t_d, y_d; phantom values where the data end."""
    near = with_neighbours(knots, values=("y",)).select("grp", "t", "y", F.col("_k.t_p").alias("tp"), F.col("_k.y_p").alias("yp"), F.col("_k.t_n").alias("tn"), F.col("_k.y_n").alias("yn"))
    out = bracket(near, queries, values=("y", "tp", "yp", "tn", "yn"), bucket=bucket)
    return out.select(
        *queries.columns, "lo", "hi", F.col("lo.tp").alias("t_a"), F.coalesce(F.col("lo.yp"), 2 * F.col("lo.y") - F.col("hi.y")).alias("y_a"),
        F.col("hi.tn").alias("t_d"), F.coalesce(F.col("hi.yn"), 2 * F.col("hi.y") - F.col("lo.y")).alias("y_d"),
    )


def beta_weights(u: Column, bias: float = 1.0, tension: float = 0.0) -> list[Column]:
    """Weights of the four neighbours of a uniform beta spline; bias 1 and tension 0 give the B-spline."""
    b1, b2, b3 = bias, bias * bias, bias**3
    delta = 2 * b3 + 4 * b2 + 4 * b1 + 2 + tension
    v = 1 - u
    second = 2 * b3 * u * (u * u - 3 * u + 3) + 2 * b2 * (u * u * u - 3 * u * u + 2) + 2 * b1 * (u * u * u - 3 * u + 2) + tension * (2 * u * u * u - 3 * u * u + 1)
    third = 2 * b2 * u * u * (3 - u) + 2 * b1 * u * (3 - u * u) + tension * u * u * (3 - 2 * u) + 2 * (1 - u * u * u)
    return [2 * b3 * v * v * v / delta, second / delta, third / delta, 2 * u * u * u / delta]


def beta_spline(knots: DataFrame, queries: DataFrame, bias: float = 1.0, tension: float = 0.0, bucket: float | None = None) -> DataFrame:
    """``value`` of the uniform beta spline approximation with phantom end values."""
    d, h = _u()
    w = beta_weights(d / F.nullif(h, F.lit(0.0)), bias, tension)
    value = w[0] * F.col("y_a") + w[1] * F.col("lo.y") + w[2] * F.col("hi.y") + w[3] * F.col("y_d")
    return _four(knots, queries, bucket).select(*queries.columns, value.alias("value"))


def b_spline(knots: DataFrame, queries: DataFrame, bucket: float | None = None) -> DataFrame:
    return beta_spline(knots, queries, bucket=bucket)


def beta_basis(t: Column, ts: list[float], bias: float = 1.0, tension: float = 0.0) -> Column:
    """Value at t of the basis function on five knots; 0 outside."""
    out = F.lit(0.0)
    for k in range(4):
        u = (t - ts[k]) / (ts[k + 1] - ts[k])
        out = F.when((t >= ts[k]) & (t < ts[k + 1]), beta_weights(u, bias, tension)[3 - k]).otherwise(out)
    return out


def overhauser(knots: DataFrame, queries: DataFrame, bucket: float | None = None) -> DataFrame:
    """``value`` of the blend of the two parabolas around each interval (end intervals use one); any spacing, 3 knots or more."""
    t = F.col("t")
    left, _ = parabola(t, F.col("t_a"), F.col("y_a"), F.col("lo.t"), F.col("lo.y"), F.col("hi.t"), F.col("hi.y"))
    right, _ = parabola(t, F.col("lo.t"), F.col("lo.y"), F.col("hi.t"), F.col("hi.y"), F.col("t_d"), F.col("y_d"))
    d, h = _u()
    u = d / F.nullif(h, F.lit(0.0))
    value = F.when(F.col("t_a").isNull(), right).when(F.col("t_d").isNull(), left).otherwise((1 - u) * left + u * right)
    return _four(knots, queries, bucket).select(*queries.columns, value.alias("value"))


# basis matrices: value = (u^3, u^2, u, 1) M (y0, y1, y2, y3); fixed values

BASIS = {
    "b_uniform": [[-1 / 6, 3 / 6, -3 / 6, 1 / 6], [3 / 6, -6 / 6, 3 / 6, 0.0], [-3 / 6, 0.0, 3 / 6, 0.0], [1 / 6, 4 / 6, 1 / 6, 0.0]],
    "bezier": [[-1.0, 3.0, -3.0, 1.0], [3.0, -6.0, 3.0, 0.0], [-3.0, 3.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]],
    "hermite": [[2.0, -2.0, 1.0, 1.0], [-3.0, 3.0, -2.0, -1.0], [0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0]],
    "overhauser_uniform": [[-0.5, 1.5, -1.5, 0.5], [1.0, -2.5, 2.0, -0.5], [-0.5, 0.0, 0.5, 0.0], [0.0, 1.0, 0.0, 0.0]],
    "overhauser_left": [[0.5, -1.0, 0.5], [-1.5, 2.0, -0.5], [1.0, 0.0, 0.0]],
    "overhauser_right": [[0.5, -1.0, 0.5], [-0.5, 0.0, 0.5], [0.0, 1.0, 0.0]],
}


def beta_uniform_basis(bias: float, tension: float) -> list[list[float]]:
    """The beta spline's matrix, read off its weights' values at four points."""
    u = np.array([0.0, 1 / 3, 2 / 3, 1.0])
    b1, b2, b3 = bias, bias**2, bias**3
    delta = 2 * b3 + 4 * b2 + 4 * b1 + 2 + tension
    w = np.stack([2 * b3 * (1 - u) ** 3, 2 * b3 * u * (u**2 - 3 * u + 3) + 2 * b2 * (u**3 - 3 * u**2 + 2) + 2 * b1 * (u**3 - 3 * u + 2) + tension * (2 * u**3 - 3 * u**2 + 1), 2 * b2 * u**2 * (3 - u) + 2 * b1 * u * (3 - u**2) + tension * u**2 * (3 - 2 * u) + 2 * (1 - u**3), 2 * u**3]) / delta
    return np.linalg.solve(np.stack([u**3, u**2, u, u**0], 1), w.T).tolist()


def overhauser_basis(alpha: float, beta: float) -> list[list[float]]:
    """Non-uniform Overhauser matrix; alpha = (t1-t0)/(t2-t0), beta = (t2-t1)/(t3-t1). 0 < alpha, beta < 1."""
    a, b = alpha / (1 - alpha), (1 - beta) / beta
    lagrange = lambda xs: np.array([np.poly([x for x in xs if x != k]) / np.prod([k - x for x in xs if x != k]) for k in xs]).T
    left, right = lagrange([-a, 0.0, 1.0]), lagrange([0.0, 1.0, 1 + b])
    out = np.zeros((4, 4))
    for m, blend, at in ((left, [-1.0, 1.0], 0), (right, [1.0, 0.0], 1)):
        for c in range(3):
            out[:, at + c] += np.convolve(blend, m[:, c])
    return out.tolist()


def overhauser_end_basis(ratio: float, right: bool = False) -> list[list[float]]:
    """Matrix of the one parabola of an end interval over three knots; ``ratio`` is the other interval's length over this one's."""
    xs = [-ratio, 0.0, 1.0] if right else [0.0, 1.0, 1.0 + ratio]
    return [list(row) for row in zip(*(np.poly([x for x in xs if x != k]) / np.prod([k - x for x in xs if x != k]) for k in xs), strict=True)]


def overhauser_vectors(knots: DataFrame, queries: DataFrame) -> DataFrame:
    """``values``, an array: the Overhauser value of each component of knots (grp, t, ys)."""
    each = knots.select("grp", "t", F.posexplode("ys").alias("_part", "y")).select(F.struct("grp", "_part").alias("grp"), "t", "y")
    parts = each.select("grp").distinct()
    wanted = queries.join(parts.select(F.col("grp").alias("_g"), F.col("grp.grp").alias("grp")), "grp").select(F.col("_g").alias("grp"), "t")
    found = overhauser(each, wanted)
    return found.groupBy(F.col("grp.grp").alias("grp"), "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("grp._part", "value"))), lambda z: z["value"]).alias("values"))


def basis_value(u: Column, matrix: list[list[float]], ys: list[Column]) -> Column:
    """(.., u^2, u, 1) M y by Horner's rule."""
    out = F.lit(0.0)
    for row in matrix:
        out = out * u + sum((F.lit(float(m)) * y for m, y in zip(row, ys, strict=True)), F.lit(0.0))
    return out


# Bernstein and Bezier


def bernstein_basis(n: int, x: Column, a: float = 0.0, b: float = 1.0) -> Column:
    """The n + 1 Bernstein polynomials of degree n on [a, b], an array."""
    if a == b:
        raise ValueError("a null interval")
    u = (x - a) / (b - a)
    power = lambda c, k: F.lit(1.0) if k == 0 else F.pow(c, F.lit(float(k)))
    return F.array(*(comb(n, k) * power(u, k) * power(1 - u, n - k) for k in range(n + 1)))


def bezier(control: Column, n: int, x: Column, a: float = 0.0, b: float = 1.0) -> Column:
    """Sum of n + 1 control values (an array) times the Bernstein polynomials: a Bezier function or one coordinate of a curve."""
    terms = F.zip_with(control, bernstein_basis(n, x, a, b), lambda c, w: c.cast("double") * w)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


bernstein_approximation = bezier


# polynomials


def divided_differences(ts: Column, ys: Column) -> Column:
    """Newton's coefficients of the polynomial through the points (arrays of equal length, distinct positions)."""
    start = F.struct(ys.alias("row"), F.slice(ys, 1, 1).alias("out"))

    def order(acc: Column, k: Column) -> Column:
        row = F.transform(F.sequence(F.lit(0), F.size(acc["row"]) - 2), lambda i: (F.get(acc["row"], i + 1) - F.get(acc["row"], i)) / F.nullif(F.get(ts, i + k) - F.get(ts, i), F.lit(0.0)))
        return F.struct(row.alias("row"), F.concat(acc["out"], F.slice(row, 1, 1)).alias("out"))

    steps = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ts) - 1, F.lit(1))), lambda k: k < F.size(ts))
    return F.aggregate(steps, start, order, lambda a: a["out"])


def newton_value(ts: Column, coefficients: Column, x: Column) -> Column:
    """Horner's rule on Newton's form."""
    pairs = F.reverse(F.arrays_zip(coefficients.alias("c"), ts.alias("t")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s * (x - p["t"]) + p["c"])


def newton_local(knots: DataFrame, queries: DataFrame, n: int, bucket: float | None = None) -> DataFrame:
    """``value`` of the polynomial through the ``n`` knots around each query (at the ends the outermost ones), by Newton's form.

    A group of fewer knots has the polynomial through all of them.
    """
    order = Window.partitionBy("grp").orderBy("t")
    some = order.rowsBetween(0, n - 1)
    first = knots.select("grp", (F.row_number().over(order) - 1).alias("_s"), F.count("*").over(Window.partitionBy("grp")).alias("_n"), F.collect_list(F.col("t").cast("double")).over(some).alias("_ts"), F.collect_list(F.col("y").cast("double")).over(some).alias("_ys"))
    stencils = first.where(F.col("_s") <= F.greatest(F.col("_n") - n, F.lit(0))).select(F.col("grp").alias("_g"), "_s", "_n", "_ts", divided_differences(F.col("_ts"), F.col("_ys")).alias("_c"))
    sizes = knots.groupBy(F.col("grp").alias("_h")).agg(F.count("*").alias("_m"))
    found = bracket(knots, queries, bucket=bucket).join(sizes, F.col("grp").eqNullSafe(F.col("_h")))
    place = F.greatest(F.least(F.col("lo.i") - (n // 2 - 1), F.col("_m") - n), F.lit(0)).cast("int")
    joined = found.withColumn("_at", place).join(stencils, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_s")))
    return joined.select(*queries.columns, newton_value(F.col("_ts"), F.col("_c"), F.col("t")).alias("value"))


def least_squares(points: DataFrame, degree: int) -> DataFrame:
    """``(grp, b, c, d, rms)``: least squares of a degree by orthogonal polynomials.

    Each degree is one round: the recurrence so far gives the next polynomial of
    every row, and three sums a group its coefficients. Groups are never
    gathered. A degree beyond a group's distinct positions gets the coefficient 0.
    """
    if degree < 1:
        raise ValueError("the degree must be 1 or more")
    if degree == 1:
        n, x, y = F.count("*"), F.col("t").cast("double"), F.col("y").cast("double")
        sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
        sums = points.groupBy("grp").agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"))
        slope = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
        rms = F.sqrt(F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)) / F.col("n"))
        return sums.select("grp", F.array(F.col("mx")).alias("b"), F.array("my", slope).alias("c"), F.array().cast("array<double>").alias("d"), rms.alias("rms"))

    rows = points.select("grp", F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))
    none = F.array().cast("array<double>")
    fit = rows.groupBy("grp").agg(F.avg("t").alias("centre"), F.avg("y").alias("mean"), F.count("*").cast("double").alias("norm"))
    fit = stored(fit.select(F.col("grp").alias("_g"), F.array("centre").alias("b"), F.array("mean").alias("c"), none.alias("d"), "norm"))
    for k in range(1, degree + 1):
        p = orthogonal_polynomial(F.col("t"), F.col("b"), F.col("d"), k)
        with_p = _joined(rows, fit).withColumn("p", p)
        sums = with_p.groupBy("_g").agg(F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("p") * F.col("y")).alias("py"), F.sum(F.col("t") * F.col("p") * F.col("p")).alias("tpp"), F.first("b").alias("b"), F.first("c").alias("c"), F.first("d").alias("d"), F.first("norm").alias("norm"))
        share = lambda x: F.when(F.col("pp") > 0, x / F.nullif(F.col("pp"), F.lit(0.0))).otherwise(0.0)
        ratio = F.when(F.col("norm") > 0, F.col("pp") / F.nullif(F.col("norm"), F.lit(0.0))).otherwise(0.0)
        # the next polynomial is (t - b_k) p_k - d_k p_(k-1) with d_k the ratio of the two norms
        more_b, more_d = (F.array(share(F.col("tpp"))), F.array(ratio)) if k < degree else (none, none)
        fit = stored(sums.select("_g", F.concat("b", more_b).alias("b"), F.concat("c", F.array(share(F.col("py")))).alias("c"), F.concat("d", more_d).alias("d"), F.col("pp").alias("norm")))
    joined = _joined(rows, fit)
    off = clenshaw(F.col("t"), F.col("b"), F.col("c"), F.col("d")) - F.col("y")
    rms = joined.groupBy("_g").agg(F.sqrt(F.avg(off * off)).alias("rms"), *(F.first(x).alias(x) for x in "bcd"))
    return rms.select(F.col("_g").alias("grp"), "b", "c", "d", "rms")


#: Groups whose coefficients may be broadcast.
BROADCAST_FITS = 100_000


def _joined(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Rows beside the coefficients of their group, which are broadcast where they are few: no group is gathered."""
    few = F.broadcast(fit) if fit.count() <= BROADCAST_FITS else fit
    return rows.join(few, F.col("grp").eqNullSafe(F.col("_g")))


def orthogonal_polynomial(t: Column, b: Column, d: Column, k: int) -> Column:
    """The k-th orthogonal polynomial at t by its three-term recurrence; a group's d starts with the factor of the third one."""
    before, p = F.lit(0.0), F.lit(1.0)
    for j in range(k):
        before, p = p, (t - F.get(b, F.lit(j))) * p - (F.get(d, F.lit(j - 1)) * before if j else F.lit(0.0))
    return p


def clenshaw(t: Column, b: Column, c: Column, d: Column) -> Column:
    """Sum of c_k times the k-th orthogonal polynomial at t."""
    zero = F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))

    def step(acc: Column, k: Column) -> Column:
        u = F.get(c, k) + F.coalesce((t - F.get(b, k)) * acc["u"], F.lit(0.0)) - F.coalesce(F.get(d, k) * acc["v"], F.lit(0.0))
        return F.struct(u.alias("u"), acc["u"].alias("v"))

    return F.aggregate(F.sequence(F.size(c) - 1, F.lit(0), F.lit(-1)), zero, step, lambda a: a["u"])


def evaluate_orthogonal(x, b, c, d):
    """Sum of the orthogonal polynomials by Clenshaw's recurrence (numpy)."""
    up, upper = np.zeros_like(x), np.zeros_like(x)
    for k in range(len(c) - 1, -1, -1):
        up, upper = c[k] + ((x - b[k]) * up if k < len(b) else 0.0) - (d[k] * upper if k < len(d) else 0.0), up
    return up


def least_squares_value(fit: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (grp, t) with ``value`` of the fitted polynomial, by Clenshaw's recurrence over the arrays."""
    value = clenshaw(F.col("t"), F.col("b"), F.col("c"), F.col("d"))
    return queries.join(fit, "grp").select(*queries.columns, value.alias("value"))
