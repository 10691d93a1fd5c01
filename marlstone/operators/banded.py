"""Tridiagonal systems of any length, solved exactly in blocks.

The rows of a block hold the unknowns of its own and one beyond either end. All
but the block's first and last unknown stand in no other block; rotations of rows
remove them, which is possible in every system that has one solution, whether
its diagonal dominates or not. What is left are two equations a block in four
unknowns. This reduced system is solved by group, and each block then finds its
inner unknowns from its borders.
"""

from __future__ import annotations

from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unknowns of a block.
BLOCK = 20_000


def eliminate(sub: list, diag: list, sup: list, rhs: list) -> tuple[list, list]:
    """Removes the inner unknowns of a block.

    Returns the pivot rows (one an inner unknown c: coefficients of the unknown
    before the block, the block's first, c, c + 1, c + 2, and the right side) and
    the two (of one row: one) equations in the unknown before the block, its
    first, its last and the one behind it.
    """
    n = len(diag)
    if n == 1:
        return [], [(sub[0], diag[0], 0.0, sup[0], rhs[0])]
    # a row: before, first, and three consecutive unknowns from the current one on
    row = lambda j: (0.0, 0.0, sub[j], diag[j], sup[j], rhs[j])
    if n == 2:
        return [], [(sub[0], diag[0], sup[0], 0.0, rhs[0]), (0.0, sub[1], diag[1], sup[1], rhs[1])]
    active = [(sub[0], diag[0], sup[0], 0.0, 0.0, rhs[0]), (0.0, sub[1], diag[1], sup[1], 0.0, rhs[1])]
    pivots = []
    for c in range(1, n - 1):
        p, *rest = *active, row(c + 1)
        active = []
        for r in rest:  # a rotation of both rows: it lets nothing grow, as row exchange would over many rows
            size = hypot(p[2], r[2])
            u, w = (p[2] / size, r[2] / size) if size else (1.0, 0.0)
            p, r = [u * x + w * y for x, y in zip(p, r, strict=True)], [u * y - w * x for x, y in zip(p, r, strict=True)]
            active.append((r[0], r[1], r[3], r[4], 0.0, r[5]))
        pivots.append(p)
    return pivots, [(r[0], r[1], r[2], r[3], r[5]) for r in active]


def inner(pivots: list, before: float, first: float, last: float, behind: float) -> list:
    """All unknowns of a block from its borders and pivot rows."""
    out = [behind, last]
    for p in reversed(pivots):
        out.append((p[5] - p[0] * before - p[1] * first - p[3] * out[-1] - p[4] * out[-2]) / p[2])
    return [first, *out[:1:-1], last] if pivots else [first, last]


def _reduced(blocks: list[tuple[int, list]]) -> list[float]:
    """The border unknowns, first and last of each block (of one row: one), by elimination with row exchange over the band."""
    names, equations = 0, []
    at = []
    for size, _ in blocks:
        at.append((names, names + (size > 1)))
        names += 1 + (size > 1)
    for b, (size, rows) in enumerate(blocks):
        first, last = at[b]
        for before, own, end, behind, rhs in rows:
            cells: dict[int, float] = {}
            for k, v in ((at[b - 1][1] if b else None, before), (first, own), (last if size > 1 else None, end), (at[b + 1][0] if b + 1 < len(blocks) else None, behind)):
                if k is not None and v:
                    cells[k] = cells.get(k, 0.0) + v
            equations.append((min(cells, default=0), cells, rhs))
    waiting = sorted(equations, key=lambda e: e[0])[::-1]
    active, pivots = [], []
    for c in range(names):
        while waiting and waiting[-1][0] <= c:
            active.append(waiting.pop()[1:])
        rows = [r for r in active if r[0].get(c)]
        if not rows:
            return [float("nan")] * names
        p = max(rows, key=lambda r: abs(r[0][c]))
        pivots.append(p)
        rest = []
        for r in active:
            if r is p:
                continue
            cells, rhs = r
            if cells.get(c):
                f = cells[c] / p[0][c]
                cells = {k: cells.get(k, 0.0) - f * p[0].get(k, 0.0) for k in {*cells, *p[0]} if k != c}
                rhs = rhs - f * p[1]
            rest.append((cells, rhs))
        active = rest
    x = [0.0] * names
    for c in reversed(range(names)):
        cells, rhs = pivots[c]
        x[c] = (rhs - sum(v * x[k] for k, v in cells.items() if k > c)) / cells[c]
    return x


def solve(system: DataFrame, group: str = "grp", i: str = "i", block: int = BLOCK) -> DataFrame:
    """``(grp, i, x)`` of rows (grp, i, sub, diag, sup, rhs), ``i`` from 0 without gaps in each group.

    The first row's ``sub`` and the last row's ``sup`` do not count. A system
    without one solution has null everywhere. The reduced system of a group, two
    equations a block, is solved in one task.
    """
    kind = system.schema[group].dataType.simpleString()
    rows = system.select(F.col(group).alias("g"), F.col(i).cast("long").alias("i"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("sub", "diag", "sup", "rhs")), F.floor(F.col(i) / block).alias("b"))
    parts = lambda pdf: [pdf[c].tolist() for c in ("sub", "diag", "sup", "rhs")]

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        _, left = eliminate(*parts(pdf.sort_values("i")))
        return pd.DataFrame({"g": pdf.g.iloc[:1], "b": pdf.b.iloc[:1], "n": [len(pdf)], "left": [[v for r in left for v in r]]})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b", ignore_index=True)
        blocks = [(n, [tuple(v[k : k + 5]) for k in range(0, len(v), 5)]) for n, v in zip(pdf.n, pdf.left.map(list), strict=True)]
        with np.errstate(all="ignore"):
            x = _reduced(blocks)
        ends, at = [], 0
        for n, _ in blocks:
            ends.append((x[at], x[at + (n > 1)]))
            at += 1 + (n > 1)
        before, behind = [0.0, *(e[1] for e in ends[:-1])], [*(e[0] for e in ends[1:]), 0.0]
        return pd.DataFrame({"g": pdf.g, "b": pdf.b, "before": before, "first": [e[0] for e in ends], "last": [e[1] for e in ends], "behind": behind})

    def back(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        e = ends.iloc[0]
        pivots, _ = eliminate(*parts(pdf))
        try:
            x = inner(pivots, e.before, e["first"], e["last"], e.behind)[: len(pdf)]
        except ZeroDivisionError:
            x = [float("nan")] * len(pdf)
        return pd.DataFrame({"g": pdf.g, "i": pdf.i, "x": x})

    left = rows.groupBy("g", "b").applyInPandas(forward, f"g {kind}, b long, n long, left array<double>")
    ends = left.groupBy("g").applyInPandas(borders, f"g {kind}, b long, before double, first double, last double, behind double")
    found = rows.groupBy("g", "b").cogroup(ends.groupBy("g", "b")).applyInPandas(back, f"g {kind}, i long, x double")
    return found.select(F.col("g").alias(group), F.col("i").alias(i), F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x")).alias("x"))
